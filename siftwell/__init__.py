"""Text-evidence screening on Spark: DataFrame operators from raw text to ranked findings."""
