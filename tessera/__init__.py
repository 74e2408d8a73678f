"""tessera: hybrid document retrieval and analysis as Spark plans."""
