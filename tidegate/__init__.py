"""Replay and measurement of streaming moderation decisions, as Spark plans."""
