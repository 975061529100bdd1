"""Queries: operators bound to the driver's tables, with the SQL they are held against."""
