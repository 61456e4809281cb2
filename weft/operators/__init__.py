"""Operators of weft."""
