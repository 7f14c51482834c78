"""The query catalogue over the driver's tables, with the same queries in SQL."""
