"""diffsieve: review analytics over tables and streams of changed files, written for Spark."""
