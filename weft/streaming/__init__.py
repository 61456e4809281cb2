"""Streaming of weft."""
