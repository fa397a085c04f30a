"""Part of the vellumq engine."""
