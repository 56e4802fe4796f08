"""Strict JSON processing on Spark: checks, events, typed documents, chunked input, and queries over them."""
