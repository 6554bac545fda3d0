"""Record linkage and corpus analytics expressed as Spark DataFrame plans."""
