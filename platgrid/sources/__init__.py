"""Sources and sinks: CSV with and without descriptions to parse, file names, and CSV with unique identifiers."""
