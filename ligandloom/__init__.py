"""Bioactivity curation, matching and screening as Spark DataFrame jobs."""
