"""Queries over the driver's tables, with DuckDB SQL for those that SQL can express."""

from . import audits, evaluations, media, relations, scans, texts

QUERIES = texts.QUERIES | evaluations.QUERIES | audits.QUERIES | media.QUERIES | scans.QUERIES | relations.QUERIES
ORACLE_SQL = texts.ORACLE_SQL | evaluations.ORACLE_SQL | audits.ORACLE_SQL | media.ORACLE_SQL | scans.ORACLE_SQL | relations.ORACLE_SQL
