"""Sources and sinks (files in, files out)."""
