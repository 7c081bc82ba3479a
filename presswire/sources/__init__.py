"""Sources and sinks. Network and model steps are tables that are supplied; nothing is fetched inside a query."""
