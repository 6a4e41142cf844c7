"""caseloom: case evidence, policy passages and reviewed summaries as Spark jobs."""
