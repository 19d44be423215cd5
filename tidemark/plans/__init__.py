"""Training and evaluation plans, and the named queries over the test tables."""
