"""sources of lumatab."""
