"""Streams: the status log of claims, and events over time windows."""
