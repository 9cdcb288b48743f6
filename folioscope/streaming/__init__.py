"""Structured Streaming: log events, the page index, the visited set."""
