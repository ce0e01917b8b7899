"""entlink: entity linking and text analytics expressed as Spark DataFrame plans."""
