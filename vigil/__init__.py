"""Sensor-event analytics and training-corpus operators as Spark DataFrame jobs."""
