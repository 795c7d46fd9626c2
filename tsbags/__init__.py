"""tsbags: Spark jobs that classify time series by bags of symbolic patterns."""
