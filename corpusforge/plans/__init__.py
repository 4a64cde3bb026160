"""plans of corpusforge."""
