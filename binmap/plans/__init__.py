"""Queries over the driver's tables with their SQL, and how results are written."""
