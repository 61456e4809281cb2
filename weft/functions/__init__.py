"""Functions of weft."""
