"""siftwork: curation, evaluation and training-data operators as lazy PySpark plans."""
