"""Plans of weft."""
