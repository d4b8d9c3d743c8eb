"""The query catalog over the test tables."""
