"""plumbline: a Spark-first engine for scoring, auditing and preparing large record sets."""
