"""Sources of noteflow."""
