"""functions of corpusforge."""
