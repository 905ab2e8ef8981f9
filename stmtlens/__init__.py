"""Analytics over logs of SQL statements, their lineage and the tables they touch."""
