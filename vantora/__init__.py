"""vantora: similarity retrieval and record processing expressed as Spark plans."""
