"""Every query of the engine by name, and the SQL of those that SQL can express."""
from . import answer_queries, relational_queries, retrieval_queries, run_queries, text_queries

PARTS = (text_queries, retrieval_queries, relational_queries, answer_queries, run_queries)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
