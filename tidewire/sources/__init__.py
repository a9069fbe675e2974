"""Sources and sinks: strategies, search services, article files, history and reports."""
