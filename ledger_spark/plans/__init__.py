"""Composite plans: requests, narratives, report sets and the query catalogue."""
