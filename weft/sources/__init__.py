"""Sources of weft."""
