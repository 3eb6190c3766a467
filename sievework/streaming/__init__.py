"""Incremental forms of a few operators on Structured Streaming (an extension; the batch operators don't need it)."""
