"""functions of the text-corpus engine."""
