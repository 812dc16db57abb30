import os

import duckdb
import pytest

from folioscan.plans import catalogue, text_queries, relational_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = [*text_queries.QUERIES, *relational_queries.QUERIES, "question_features", "option_queries", "local_idf", "routing_scores", "route_docs", "doc_reprs", "score_full", "score_matches", "retrieve_question_topk", "pack_two_phase", "routing_recall", "normalize_answer", "legal_answer", "json_extract", "verify_flags", "validate_citations", "calc_execute", "calc_refused"]


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in CHOSEN if n in catalogue.ORACLE_SQL])
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*cols).collect()]
    want = con.execute(f"""SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({catalogue.ORACLE_SQL[name]})""").fetchall()
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    spark.catalog.clearCache()
