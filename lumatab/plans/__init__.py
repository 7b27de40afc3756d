"""plans of lumatab."""
