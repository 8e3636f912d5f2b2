"""cardwatch: payment-abuse analytics expressed as Spark DataFrame jobs."""
