"""Material matching, certificate analytics and inventory analytics as Spark DataFrame jobs."""
