"""Public-pension disclosure analytics as Spark jobs."""
