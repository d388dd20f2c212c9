"""Pieces of SQL that several oracles share. They state results independently of the Spark code."""

from __future__ import annotations

from tessella import taxonomy

SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORDS = f"len(regexp_extract_all(text, '[^{SPACE}]+'))"


def rounded(words: str) -> str:
    return f"CASE WHEN {words} > 0 THEN greatest(1, floor({words} * 1.35::DOUBLE + 0.5::DOUBLE))::BIGINT ELSE 0 END"


def ceiled(words: str) -> str:
    return f"CASE WHEN {words} > 0 THEN greatest(1, ceil({words} * 1.35::DOUBLE))::BIGINT ELSE 0 END"


def values(rows: list[tuple]) -> str:
    def cell(x: object) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


TOPICS = values(list(enumerate(taxonomy.TOPICS)))
FORMATS = values(list(enumerate(taxonomy.FORMATS)))
#: The manifest of `documents` on the 576 bins.
MANIFEST = f"""manifest AS (
  SELECT d.doc_id, t.topic, f.format, (t.i * 24 + f.j + 1)::INT AS bin_id, {rounded(WORDS)} AS token_count, {ceiled(WORDS)} AS estimated_token_count
  FROM documents d JOIN {TOPICS} t(i, topic) ON t.i = d.doc_id % 24 JOIN {FORMATS} f(j, format) ON f.j = (d.doc_id // 24) % 24)"""
BINS = f"bins AS (SELECT (t.i * 24 + f.j + 1)::INT AS bin_id, t.topic, f.format FROM {TOPICS} t(i, topic) CROSS JOIN {FORMATS} f(j, format))"
#: Queries are the vectors whose id 50 divides, against all; a score is an inner product.
SCORES = """scores AS (
  SELECT i.vec_id AS doc_id, q.vec_id AS query_id, list_inner_product(i.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
  FROM embeddings i CROSS JOIN embeddings q WHERE q.vec_id % 50 = 0)"""
VECTOR_BINS = "vbins AS (SELECT vec_id AS doc_id, 't' || label AS topic, 'f' || (vec_id % 24) AS format FROM embeddings)"
GRID = f"""{SCORES}, {VECTOR_BINS}, means AS (SELECT doc_id, avg(score) AS score FROM scores GROUP BY doc_id),
  grid AS (SELECT topic, format, avg(score) AS mean_score, avg(abs(score)) AS abs_mean_score, stddev_pop(score) AS std_score, count(*) AS doc_count
           FROM means JOIN vbins USING (doc_id) GROUP BY topic, format)"""
#: The score fact at scale: an order is a document, a line number a query.
LINES = """scores AS (SELECT l_orderkey AS doc_id, l_linenumber AS query_id, l_extendedprice * (1 - l_discount) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS score FROM lineitem),
  obins AS (SELECT o_orderkey AS doc_id, o_orderpriority AS topic, o_orderstatus AS format FROM orders)"""
GAMMA = """gamma AS (SELECT CASE event_type WHEN 'click' THEN 'expA' ELSE 'exp1' END AS condition, event_type, 't' || (user_id % 24) AS topic, (event_id % 3)::INT AS seed,
  'b' || (event_id % 4) AS eval_benchmark, 'b' || ((event_id // 4) % 4) AS target, value AS gamma, event_id FROM events)"""
