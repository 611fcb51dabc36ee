"""pagemill: web-content and corpus analytics expressed as Spark DataFrame plans."""
