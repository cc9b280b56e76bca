"""Relational operators over transcripts, spans, candidates and facts: DataFrames in, DataFrames out."""
