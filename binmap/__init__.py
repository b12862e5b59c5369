"""Locating catalogue items in ordered documents, as DataFrame transformations."""
