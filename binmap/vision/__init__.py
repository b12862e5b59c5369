"""Page images as rows, with numpy alone."""
