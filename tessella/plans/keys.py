"""Queries over records, labels, answers and keys, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella import taxonomy
from tessella.functions import numbers, text, web
from tessella.operators import bins, evidence, lexical, queryset, records, sampling, scoring, statistics
from tessella.plans import sqltext as S
from tessella.plans.catalog import register
from tessella.plans.tables import gamma, manifest, mean_scores, table, vector_bins, vectors


def r6(c):
    return F.round(c, 6)


# Records.


@register("project_records", "SELECT doc_id::VARCHAR AS id, md5(text) AS text_md5, CASE WHEN source IS NULL THEN 0 ELSE 1 END AS n_metadata, source FROM documents")
def project_records(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.when(F.col("source").isNotNull(), F.create_map(F.lit("source"), F.col("source"))).alias("metadata"))
    return records.project(rows).select("id", F.md5("text").alias("text_md5"), F.size("metadata").alias("n_metadata"), F.col("metadata")["source"].alias("source"))


@register("clean_records", f"SELECT doc_id FROM documents WHERE {S.WORDS} >= 50 AND {S.rounded(S.WORDS)} >= 100")
def clean_records(spark, d):
    return records.clean(table(spark, d, "documents"), 50, 100).select("doc_id")


@register("strip_fields", "SELECT page_id, CASE WHEN url LIKE '%en%' THEN url ELSE '{\"id\":\"' || page_id || '\",\"text\":\"' || page_id || ' x\"}' END AS value FROM pages")
def strip_fields(spark, d):
    line = F.when(F.col("url").contains("en"), F.col("url")).otherwise(F.to_json(F.struct(F.col("page_id").cast("string").alias("id"), F.lit(3).alias("extra"), F.concat("page_id", F.lit(" x")).alias("text"))))
    return records.strip_fields(table(spark, d, "pages").select("page_id", line.alias("value")))


@register("sampleable_rows", "SELECT doc_id FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL")
def sampleable_rows(spark, d):
    return records.sampleable(table(spark, d, "documents"), ["lang", "source", "text"]).select("doc_id")


@register("validated_labels", "SELECT o_orderkey, o_orderstatus FROM orders")
def validated_labels(spark, d):
    return records.require_labels(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])


@register("column_fallback", "SELECT source AS topic, sum(n_chars)::BIGINT AS n FROM documents GROUP BY 1")
def column_fallback(spark, d):
    docs = table(spark, d, "documents")
    topic, size = records.first_column(docs, "bin_topic", "weborganizer_topic", "source"), records.first_column(docs, "token_count", "n_chars")
    return docs.groupBy(F.col(topic).alias("topic")).agg(F.sum(size).alias("n"))


@register("keep_first_rows", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1")
def keep_first_rows(spark, d):
    return records.keep_first(table(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_nationkey", "c_custkey")


@register("union_manifests", "SELECT doc_id, 'documents' AS origin FROM documents UNION ALL SELECT doc_id, 'labels' FROM labels")
def union_manifests(spark, d):
    a, b = table(spark, d, "documents").select("doc_id", F.lit("documents").alias("origin")), table(spark, d, "labels").select(F.lit("labels").alias("origin"), "doc_id")
    return a.unionByName(b)


@register("record_tokens", f"SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN doc_id END, CASE WHEN doc_id % 3 = 1 THEN floor({S.WORDS} * 1.3::DOUBLE)::BIGINT END, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4.0))::BIGINT END) AS tokens FROM documents")
def record_tokens(spark, d):
    third, words = F.col("doc_id") % 3, text.word_count(F.col("text"))
    tokens = numbers.tokens_of_record(F.when(third == 0, F.col("doc_id")), F.when(third == 1, words), 1.3, numbers.tokens_approximate(F.col("text")))
    return table(spark, d, "documents").select("doc_id", tokens.alias("tokens"))


# Labels, names, dates.


@register("list_split", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ', ,' || p_brand || ' ,', ','), lambda x: trim(x)), lambda x: x != ''), '|') AS items FROM part")
def list_split(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.split_list(F.concat("p_name", F.lit(", ,"), "p_brand", F.lit(" ,"))), "|").alias("items"))


@register("utc_timestamps", "SELECT event_id, event_id % 3 = 0 AS ok FROM events")
def utc_timestamps(spark, d):
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(at, F.lit("Z"))).when(F.col("event_id") % 3 == 1, at).otherwise(F.concat(at, F.lit("+00:00")))
    return table(spark, d, "events").select("event_id", web.is_utc_timestamp(said).alias("ok"))


@register("language_of_scores", "SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN lang END, CASE WHEN doc_id % 2 = 0 THEN 'fr' ELSE 'de' END) AS language FROM documents")
def language_of_scores(spark, d):
    found = F.when(F.col("doc_id") % 2 == 0, F.expr("map('en', 0.1D, 'fr', 0.6D, 'de', 0.6D)")).otherwise(F.expr("map('en', 0.1D, 'de', 0.8D, 'fr', 0.6D)"))
    return table(spark, d, "documents").select("doc_id", web.language(F.when(F.col("doc_id") % 5 == 0, F.col("lang")), found).alias("language"))


@register("sha256_valid", "SELECT doc_id, doc_id % 2 = 0 AS ok FROM documents")
def sha256_valid(spark, d):
    h = F.sha2("text", 256)
    return table(spark, d, "documents").select("doc_id", web.is_sha256(F.when(F.col("doc_id") % 2 == 0, F.coalesce(h, F.sha2(F.lit(""), 256))).otherwise(F.upper(F.concat(F.lit("x"), h)))).alias("ok"))


@register("shard_paths", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'data/' || page_id WHEN 1 THEN 'x/' || page_id ELSE 'plain/' || page_id END AS path FROM pages")
def shard_paths(spark, d):
    n = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("datasets/a/b/data/"), n)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("datasets/c/d/x/"), n)).otherwise(F.concat(F.lit("plain/"), n))
    return table(spark, d, "pages").select("page_id", web.dataset_path(path, "a/b").alias("path"))


@register("task_subjects", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE nullif(p_type, '') END AS subject FROM part")
def task_subjects(spark, d):
    return table(spark, d, "part").select("p_partkey", text.subject_of_task(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("mmlu_"), "p_brand")).otherwise(F.col("p_type"))).alias("subject"))


@register("asked_question", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS question FROM part")
def asked_question(spark, d):
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Context\nQuestion:  "), "p_name", F.lit(" \nAnswer:"))).otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", text.asked(said).alias("question"))


_QUESTIONS = {
    "How would Ann feel afterwards?": ("xReact", "ann"), "What will Bo want to do next?": ("xWant", "bo"),
    "What will happen to Cy?": ("xEffect", "cy"), "Why did Di do this?": ("xIntent", None), "How would Others feel as a result?": ("oReact", None),
}


@register("question_classes", "SELECT conv_id, turn, CASE abs(conv_id + turn) % 5 " + " ".join(f"WHEN {k} THEN '{label}'" for k, (label, _) in enumerate(_QUESTIONS.values())) + " END AS label, CASE abs(conv_id + turn) % 5 " + " ".join(f"WHEN {k} THEN '{who}'" for k, (_, who) in enumerate(_QUESTIONS.values()) if who) + " END AS subject FROM conversations")
def question_classes(spark, d):
    k = F.abs(F.col("conv_id") + F.col("turn")) % 5
    asked = F.element_at(F.array(*[F.lit("Ann met Bo. " + q) for q in _QUESTIONS]), (k + 1).cast("int"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", asked.alias("q"))
    rows = rows.withColumn("label", text.reasoning_type(F.col("q")))
    return rows.select("conv_id", "turn", "label", text.question_subject(F.col("q"), F.col("label")).alias("subject"))


# Answers and rosters.


@register("parsed_answers", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 END::INT AS idx FROM part")
def parsed_answers(spark, d):
    said = F.element_at(F.array(F.lit("(B)"), F.concat("p_brand", F.lit(".")), F.concat(F.lit("So the answer is: "), F.upper("p_type")), F.lit("neither")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", queryset.parse_answer(said, F.array(F.lit("A"), F.lit("B")), F.array("p_brand", "p_type")).alias("idx"))


@register("base_correctness", "WITH r AS (SELECT l_orderkey AS query_id, l_linenumber AS idx FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) = 1) SELECT query_id, idx AS chosen, idx = query_id % 7 + 1 AS is_correct FROM r")
def base_correctness(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("index"), F.col("l_quantity").alias("score"))
    gold = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") % 7 + 1).alias("gold_index"))
    return queryset.correctness(queryset.select_candidate(c, "score"), gold).select("query_id", F.col("index").alias("chosen"), "is_correct")


@register("unexpected_keys", "SELECT doc_id, CASE WHEN source IS NULL THEN 'lang' ELSE 'lang,source' END AS extra FROM documents")
def unexpected_keys(spark, d):
    value = F.map_concat(F.create_map(F.lit("id"), F.lit("x"), F.lit("lang"), F.lit("y")), F.when(F.col("source").isNotNull(), F.create_map(F.lit("source"), F.col("source"))).otherwise(F.expr("cast(map() as map<string,string>)")))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(queryset.unexpected_keys(value, ["id", "text"])), ",").alias("extra"))


@register("zip_conflicts", "SELECT c_custkey AS ordinal, 'q' || c_custkey AS compiled_id, CASE WHEN c_custkey % 10 != 0 THEN 'r' || c_custkey END AS rendered_id FROM customer WHERE c_custkey % 5 = 0")
def zip_conflicts(spark, d):
    c, q = table(spark, d, "customer"), lambda mark: F.concat(F.lit(mark), "c_custkey")
    compiled = c.select(F.col("c_custkey").alias("ordinal"), q("q").alias("query_id"))
    changed = c.where("c_custkey % 10 != 0").select(F.col("c_custkey").alias("ordinal"), F.when(F.col("c_custkey") % 5 == 0, q("r")).otherwise(q("q")).alias("query_id"))
    return evidence.zip_conflicts(compiled, changed)


@register("unspanned_queries", "SELECT o_orderkey AS query_id FROM orders WHERE o_orderkey % 3 != 0")
def unspanned_queries(spark, d):
    k = F.col("o_orderkey") % 3
    mask = F.when(k == 0, F.expr("array(false, true, true)")).when(k == 1, F.expr("array(true, false, true)")).otherwise(F.expr("array(false, false)"))
    return evidence.spans_contiguous(table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), mask.alias("scored")))


@register("ordered_evidence", "SELECT doc_id, quality FROM labels ORDER BY doc_id")
def ordered_evidence(spark, d):
    return table(spark, d, "labels").select("doc_id", "quality").orderBy("doc_id")


# Scores and keys.


@register("selected_keys", "SELECT k AS grad_key, k = 'k1' AS preferred FROM (VALUES ('k0'), ('k1')) v(k)")
def selected_keys(spark, d):
    index, queries = vectors(spark, d, keys=True)
    chosen = scoring.select_keys(index, queries, "k1")
    return spark.createDataFrame([(k, k in chosen) for k in scoring.select_keys(index, queries)], "grad_key string, preferred boolean")


@register("checked_topk", f"WITH {S.SCORES} SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores) WHERE rank <= 3")
def checked_topk(spark, d):
    return scoring.checked_top_k(*vectors(spark, d), 3).select("query_id", "doc_id", "rank")


@register("located_rows", "WITH s AS (SELECT o_orderstatus AS shard, count(*) AS n, sum(count(*)) OVER (ORDER BY o_orderstatus) AS e FROM orders GROUP BY 1), p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders) SELECT o_orderkey, position, shard, (position - (e - n))::BIGINT AS \"offset\" FROM p JOIN s ON position >= e - n AND position < e")
def located_rows(spark, d):
    orders = table(spark, d, "orders")
    rows = sampling.numbered(orders.select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", F.col("_i").alias("position"))
    return scoring.locate(rows, orders.groupBy(F.col("o_orderstatus").alias("shard")).agg(F.count("*").alias("n")))


@register("axis_order", f"WITH {S.MANIFEST}, t AS (SELECT topic AS label, sum(token_count)::BIGINT AS total FROM manifest GROUP BY 1) SELECT label, total, row_number() OVER (ORDER BY total DESC, label) AS place FROM t")
def axis_order(spark, d):
    return bins.axis_order(manifest(spark, d), "topic", taxonomy.TOPICS, "token_count")


@register("zscore_zero_sigma", f"WITH {S.GRID} SELECT topic, format, round(coalesce((mean_score - avg(mean_score) OVER w) / nullif(stddev_samp(mean_score) OVER w, 0), 0), 6) AS zscore FROM grid WINDOW w AS (PARTITION BY topic)")
def zscore_zero_sigma(spark, d):
    grid = bins.score_bins(mean_scores(spark, d), vector_bins(spark, d))
    return bins.z_scores(grid, by=("topic",), zero_sigma="zero").select("topic", "format", r6("zscore").alias("zscore"))


@register("worker_budgets", "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice, sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS s FROM orders) WHERE s - o_totalprice < 500000")
def worker_budgets(spark, d):
    return sampling.worker_budgets(table(spark, d, "orders"), "o_orderpriority", ["o_orderkey"], "o_totalprice", 500_000).select("o_orderkey")


@register("budget_of_table", "SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey, sum(o_custkey) OVER (ORDER BY o_orderkey) AS s FROM orders) WHERE s - o_custkey < 1000000")
def budget_of_table(spark, d):
    return sampling.budget(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], "o_custkey", 1_000_000).select("o_orderkey")


@register("resampled_retain", "SELECT doc_id FROM documents WHERE lang != 'fr' QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id || ':11'), doc_id) <= 2")
def resampled_retain(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("topic"), F.col("source").alias("format"))
    return sampling.resampled(docs, ["fr"], 2, 8, 3).select("doc_id")


@register("topic_means", f"WITH {S.GAMMA}, a AS (SELECT topic, target, seed, avg(gamma) AS g FROM gamma WHERE condition = 'expA' AND target = eval_benchmark GROUP BY 1, 2, 3), e AS (SELECT topic, eval_benchmark AS target, seed, avg(gamma) AS g FROM gamma WHERE condition = 'exp1' GROUP BY 1, 2, 3) SELECT target, topic, round(avg(a.g - e.g), 6) AS d FROM a JOIN e USING (topic, target, seed) GROUP BY 1, 2")
def topic_means(spark, d):
    return statistics.topic_means(statistics.paired_cells(gamma(spark, d), "expA", "exp1")).withColumn("d", r6("d"))


_CROSSWALK = {"grammar": ["article", "preposition"], "persons": ["pronoun"]}


@register("dimension_counts", "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM documents), x(dimension, word) AS " + S.values([(dim, w) for dim, cs in _CROSSWALK.items() for c in cs for w in lexical.LEXICON.get(c, ())]) + " SELECT doc_id, dimension, count(*) AS n FROM w JOIN x USING (word) GROUP BY 1, 2")
def dimension_counts(spark, d):
    return lexical.dimension_counts(lexical.lexicon_counts(table(spark, d, "documents")), _CROSSWALK)


@register("feature_composite", f"WITH f AS (SELECT doc_id, n_chars::DOUBLE AS a, {S.WORDS}::DOUBLE AS b FROM documents) SELECT doc_id, round(((a - avg(a) OVER ()) / stddev_samp(a) OVER () + (b - avg(b) OVER ()) / stddev_samp(b) OVER ()) / 2, 6) AS composite FROM f")
def feature_composite(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("a"), text.word_count(F.col("text")).cast("double").alias("b"))
    return lexical.composite(rows, ["a", "b"]).select("doc_id", r6("composite").alias("composite"))


@register("answered_queries", "SELECT p_name AS prompt, substr('ABC', (p_size % 4 + 1)::INT, 1) AS completion, 'set-' || p_partkey AS query_id, p_brand AS label FROM part WHERE p_size % 4 < 3")
def answered_queries(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("prompt"), (F.col("p_size") % 4).cast("string").alias("answer"), F.col("p_brand").alias("label"))
    return queryset.answered(rows, {"0": "A", "1": "B", "2": "C"}, "set")


@register("benchmark_groups", f"SELECT benchmark_group, count(*) AS n, min(label) AS first_label FROM {S.values(taxonomy.BENCHMARKS)} b(benchmark, label, benchmark_group) GROUP BY 1")
def benchmark_groups(spark, d):
    return taxonomy.dim_benchmark(spark).groupBy("benchmark_group").agg(F.count("*").alias("n"), F.min("label").alias("first_label"))
