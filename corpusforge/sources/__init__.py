"""sources of corpusforge."""
