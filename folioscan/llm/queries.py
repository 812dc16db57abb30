"""The queries of this subpackage, and the SQL of those that SQL can express."""
from __future__ import annotations

from .bpe import op7_bpe
from .fingerprints import op1_fingerprints
from .line_dedup import op9_line_dedup
from .mixing import op3_mixing
from .ngram_join import op10_ngram_jaccard
from .quality_model import op5_quality_classifier
from .quality_rules import op4_quality_rules
from .token_counts import op2_token_counts
from .toxicity import op6_toxicity
from .warc_fixity import op8_warc_fixity


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_token_counts, op3_mixing, op4_quality_rules, op5_quality_classifier, op6_toxicity, op7_bpe, op8_warc_fixity, op9_line_dedup, op10_ngram_jaccard, pipeline)}
# links by counting shared shingles, components by reachability; the words and A-Z lower case as in the operator
ORACLE_SQL: dict[str, str] = {
    "op10_ngram_jaccard": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
f AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p WHERE 100 * o >= 75 * (na + nb - o) UNION ALL SELECT b, a FROM p WHERE 100 * o >= 75 * (na + nb - o)), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM s LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) ON a = doc_id""",
}
