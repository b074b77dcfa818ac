"""Every registered query of the engine and its DuckDB twin."""

from __future__ import annotations

from . import endtoend, retrieval, twins, understanding

QUERIES = {**retrieval.QUERIES, **understanding.QUERIES, **twins.QUERIES, **endtoend.QUERIES}
ORACLE_SQL = {**retrieval.ORACLE_SQL, **understanding.ORACLE_SQL, **twins.ORACLE_SQL, **endtoend.ORACLE_SQL}
