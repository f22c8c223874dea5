"""Sources, the chunk store, configuration, and subprocess execution."""
