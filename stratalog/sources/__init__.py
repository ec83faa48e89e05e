"""Episode sources and sinks."""
