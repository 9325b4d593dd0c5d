"""Sources and sinks: driver tables, file scans, stores, connectors."""
