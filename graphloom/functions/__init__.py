"""Part of the graph-building library."""
