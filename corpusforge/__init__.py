"""corpusforge: curation, de-duplication, validation and scoring of text corpora as Spark plans."""
