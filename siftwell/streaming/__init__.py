"""Streaming forms of the batch operators: dedupe, failure merge, islands, limits. An extension of ours."""
