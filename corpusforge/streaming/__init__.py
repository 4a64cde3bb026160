"""streaming of corpusforge."""
