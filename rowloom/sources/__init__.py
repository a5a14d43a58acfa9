"""Sources, sinks and functions from outside, and the catalog's tables."""
