"""Phonetic transcription analytics on Spark."""
