"""Structured Streaming forms of the refresh and of usage analytics."""
