"""Every operator as a query over the test tables, with the same query in SQL where SQL can say it."""

from chronotext.registry import activity_queries, dedup_queries, search_queries, text_queries

PARTS = [text_queries.R, search_queries.R, dedup_queries.R, activity_queries.R]
QUERIES = {name: fn for part in PARTS for name, fn in part.queries.items()}
ORACLE_SQL = {name: sql for part in PARTS for name, sql in part.sql.items()}
