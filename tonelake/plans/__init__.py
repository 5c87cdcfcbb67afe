"""Whole queries: views, endpoints, hourly compaction and the registered catalogue."""
