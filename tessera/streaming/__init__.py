"""Streams over the history of a repository."""
