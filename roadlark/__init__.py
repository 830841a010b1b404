"""roadlark: Spark-first analytics over drone-observed road traffic and road surfaces."""
