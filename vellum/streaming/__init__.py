"""Streaming use of the stateless column functions."""
