"""Queries over the driver's tables, each beside the SQL that must give the same rows."""
