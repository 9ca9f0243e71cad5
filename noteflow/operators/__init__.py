"""Operators of noteflow."""
