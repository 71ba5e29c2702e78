"""Registered queries (``queries.REGISTRY``) and their DuckDB oracles
(``oracle.ORACLE_SQL``)."""
