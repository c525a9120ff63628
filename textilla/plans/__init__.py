"""plans of the text-corpus engine."""
