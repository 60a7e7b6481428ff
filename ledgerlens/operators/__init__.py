"""Operators over model tables (see sources.schemas)."""
