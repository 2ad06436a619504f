"""The engine's queries by name, each with the SQL that gives the same rows where SQL has it."""

from weftline.queries import expressions, groups, plans

MODULES = (plans, expressions, groups)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
