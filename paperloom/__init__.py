"""Literature-curation analytics expressed as Spark DataFrame plans."""
