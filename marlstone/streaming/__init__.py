"""Resumable appends as streams, and event-time windows (an extension of this engine's own)."""
