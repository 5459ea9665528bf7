"""Part of the seekwell library."""
