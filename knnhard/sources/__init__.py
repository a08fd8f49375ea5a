"""Sources and sinks: raw vector files (Data Source), text vectors, result tables."""
