"""streaming of lumatab."""
