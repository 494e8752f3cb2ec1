"""Stateless streaming over new page records."""
