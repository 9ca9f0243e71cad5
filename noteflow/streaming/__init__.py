"""Streaming of noteflow."""
