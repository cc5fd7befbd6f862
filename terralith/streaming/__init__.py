"""Streaming extensions: de-duplication and windowed counts of events, imports as files land."""
