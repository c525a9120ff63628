"""operators of the text-corpus engine."""
