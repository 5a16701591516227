"""Rounds as a stream."""
