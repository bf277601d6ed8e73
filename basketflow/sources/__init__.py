"""Sources and sinks: driver-table lens, JSON documents, stream messages,
feature exports, import files."""
