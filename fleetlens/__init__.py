"""Fleet telemetry analytics on Spark: metric histories, incidents, actions, logs and predictions."""
