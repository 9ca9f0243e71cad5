"""noteflow: batch and streaming Spark jobs over large collections of notes."""
