"""Composed jobs and the query catalog."""
