"""Functions of noteflow."""
