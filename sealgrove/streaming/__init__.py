"""Jobs over documents that arrive as a stream."""
