"""Pages and contents that arrive in streams."""
