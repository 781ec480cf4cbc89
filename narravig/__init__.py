"""Drug-safety text analytics expressed as Spark DataFrame plans."""
