"""Change-data pipelines on Spark, and the jobs that prove they are right."""
