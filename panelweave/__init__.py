"""Disclosure-text analytics as declarative Spark plans."""
