"""operators of corpusforge."""
