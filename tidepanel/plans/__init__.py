"""Named feature sets and the panel query."""
