"""Expression building."""
