"""Named queries over the driver tables (``catalog``), the point sets they use
(``fixtures``) and the DuckDB statements that check them (``oracles``)."""
