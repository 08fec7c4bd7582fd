"""Rules over tables, as Spark jobs: prepare, profile, find rules, check, repair and generate rows."""
