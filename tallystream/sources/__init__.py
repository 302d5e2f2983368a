"""Event sources, sinks and generators."""
