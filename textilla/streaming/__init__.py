"""streaming of the text-corpus engine."""
