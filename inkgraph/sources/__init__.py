"""Sources and sinks of corpora."""
