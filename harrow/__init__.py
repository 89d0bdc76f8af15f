"""harrow: evaluation of predictions over many groups and periods, written as Spark jobs."""
