"""Spark jobs for building, deduplicating and searching a corpus of timestamped transcripts."""
