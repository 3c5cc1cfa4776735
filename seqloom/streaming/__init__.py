"""Sequences in streams. Row-wise functions run on a streaming table as they are."""
