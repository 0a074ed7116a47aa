"""All core queries and their SQL, by name."""

from __future__ import annotations

from vellumgrid.plans import corpus, problems, publication

_MODULES = (problems, corpus, publication)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
