"""Files, logs, sidecars and reports that are written."""
