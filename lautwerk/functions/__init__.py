"""Column functions on transcriptions."""
