"""functions of lumatab."""
