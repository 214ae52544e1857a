"""Evidence retrieval and audit analytics over semi-structured documents, as Spark DataFrame transformations."""
