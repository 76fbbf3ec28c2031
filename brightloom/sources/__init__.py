"""Table generators, distributions and sinks."""
