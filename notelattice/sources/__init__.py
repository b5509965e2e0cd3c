"""Sources and sinks: note files, landed service responses, versioned tables."""
