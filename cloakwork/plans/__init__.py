"""Plans that combine operators, sources and sinks."""
