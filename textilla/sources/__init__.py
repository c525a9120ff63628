"""sources of the text-corpus engine."""
