"""tessella: a document-retrieval and corpus-processing engine expressed in Spark plans."""
