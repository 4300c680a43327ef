"""Structured Streaming: incremental refresh and keyed pattern automata."""
