"""Readers and writers: tables by suffix, nested JSON, JSON lines, checked CSV, run collections, projections."""
