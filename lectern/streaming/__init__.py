"""Structured Streaming: pages as they arrive, and players' states."""
