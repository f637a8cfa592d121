"""Sources, sinks and configuration tables."""
