"""operators of lumatab."""
