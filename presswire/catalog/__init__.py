"""Registered queries with their SQL oracles, by theme. Each module has QUERIES: name -> (function of spark and folder, SQL or None)."""
