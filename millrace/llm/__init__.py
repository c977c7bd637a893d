"""Operators on text corpora.  Optional: no module outside this subpackage imports it."""
