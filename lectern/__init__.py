"""Text analytics over tables of documents, expressed as Spark DataFrame plans."""
