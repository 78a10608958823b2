"""Sinks of batch and streaming results."""
