"""Every operator as a query over whole tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella import taxonomy
from tessella.functions import numbers, text, web
from tessella.operators import bins, evidence, integrity, lexical, queryset, records, sampling, scoring, statistics
from tessella.plans import sqltext as S
from tessella.plans.catalog import register
from tessella.plans.tables import gamma, line_scores, manifest, mean_scores, modules, order_bins, table, vector_bins, vectors
from tessella.streaming import events as streams


def r6(c):
    return F.round(c, 6)


# Scalars over texts, numbers, urls and dates.


@register("word_count", f"SELECT doc_id, {S.WORDS} AS words, length(text) AS chars, strlen(text) AS bytes FROM documents")
def word_count(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.word_count(t).alias("words"), text.char_length(t).alias("chars"), text.byte_length(t).alias("bytes"))


@register(
    "token_estimates",
    f"""SELECT doc_id, {S.rounded(S.WORDS)} AS tokens_rounded, {S.ceiled(S.WORDS)} AS tokens_ceiled, floor({S.WORDS} * 1.35::DOUBLE)::BIGINT AS tokens_truncated,
    CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4.0))::BIGINT END AS tokens_approximate FROM documents""",
)
def token_estimates(spark, d):
    w = text.word_count(F.col("text"))
    return table(spark, d, "documents").select("doc_id", numbers.tokens_rounded(w).alias("tokens_rounded"), numbers.tokens_ceiled(w).alias("tokens_ceiled"), numbers.tokens_truncated(w).alias("tokens_truncated"), numbers.tokens_approximate(F.col("text")).alias("tokens_approximate"))


_HOST = "nullif(regexp_extract(lower(url), '^[a-z]+://(?:[^/@]*@)?([^/:?#]+)', 1), '')"


@register("url_domain", f"SELECT page_id, {_HOST} AS domain, regexp_replace({_HOST}, '^www\\.', '') AS bare_domain FROM pages")
def url_domain(spark, d):
    return table(spark, d, "pages").select("page_id", web.domain(F.col("url")).alias("domain"), web.domain(F.col("url"), strip_www=True).alias("bare_domain"))


@register("domain_counts", f"SELECT regexp_replace({_HOST}, '^www\\.', '') AS bare_domain, count(*) AS n FROM pages GROUP BY 1")
def domain_counts(spark, d):
    return table(spark, d, "pages").groupBy(web.domain(F.col("url"), strip_www=True).alias("bare_domain")).agg(F.count("*").alias("n"))


@register("year_extract", "SELECT o_orderkey, nullif(regexp_extract(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), '\\b(?:19|20)[0-9]{2}\\b', 0), '')::INT AS year FROM orders")
def year_extract(spark, d):
    return table(spark, d, "orders").select("o_orderkey", web.year(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("year"))


@register(
    "label_normalize",
    """SELECT p_partkey, '__label__' || replace(lower(trim(p_type)), ' ', '_') AS label, replace(lower(trim(p_type)), ' ', '_') AS stripped FROM part""",
)
def label_normalize(spark, d):
    label = text.normalize_taxonomy_label(F.concat(F.lit("  "), "p_type", F.lit(" ")))
    return table(spark, d, "part").select("p_partkey", label.alias("label"), text.strip_label_prefix(label).alias("stripped"))


@register("bin_id", f"WITH {S.MANIFEST} SELECT doc_id, topic, format, bin_id FROM manifest")
def bin_id(spark, d):
    return manifest(spark, d).select("doc_id", "topic", "format", records.bin_id(F.col("topic"), F.col("format")).alias("bin_id"))


@register("last_sentence", "SELECT item_id, regexp_replace(regexp_extract(trim(text), '([^.!?]*[.!?]*)$', 1), '^\\s+|\\s+$', '', 'g') AS sentence FROM benchmark")
def last_sentence(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.trim(text.last_sentence(F.col("text"))).alias("sentence"))


@register("question_phrases", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'want to do next') THEN 'wants' WHEN contains(lower(text), 'need to do before') THEN 'needs' WHEN contains(lower(text), 'how would you describe') THEN 'descriptions' WHEN contains(lower(text), 'feel') THEN 'reactions' WHEN contains(lower(text), 'why did') THEN 'motivations' WHEN contains(lower(text), 'what will happen') THEN 'effects' ELSE 'other' END AS label FROM conversations")
def question_phrases(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.question_phrase(F.col("text")).alias("label"))


@register("choice_keys", "SELECT r.i AS n, k.i AS idx, CASE WHEN r.i <= 26 THEN chr(65 + k.i::INT) ELSE 'choice_' || lpad(k.i::VARCHAR, 2, '0') END AS choice FROM range(2, 41) r(i), range(0, 40) k(i) WHERE k.i < r.i")
def choice_keys(spark, d):
    pairs = spark.range(2, 41).withColumnRenamed("id", "n").withColumn("idx", F.explode(F.expr("sequence(0L, n - 1)")))
    return pairs.select("n", "idx", text.choice_key(F.col("idx"), F.col("n")).alias("choice"))


@register("query_id_escape", "SELECT page_id, replace(replace(url, '%', '%25'), ':', '%3A') AS part, 'task%3Aa:' || replace(replace(url, '%', '%25'), ':', '%3A') || ':' || page_id AS query_id FROM pages")
def query_id_escape(spark, d):
    return table(spark, d, "pages").select("page_id", text.escape_component(F.col("url")).alias("part"), queryset.query_id(F.col("url"), F.lit("task:a"), F.col("page_id")).alias("query_id"))


@register("hash_ids", "SELECT doc_id, 'q_' || sha1(text) AS short_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def hash_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", web.short_id(F.col("text"), "q_").alias("short_id"), F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@register("split_last", "SELECT p_partkey, regexp_extract(p_name || '__x__' || p_brand, '^(.*)__(.*)$', 1) AS head, p_brand AS tail FROM part")
def split_last(spark, d):
    head, tail = text.split_last(F.concat_ws("__", "p_name", F.lit("x"), "p_brand"))
    return table(spark, d, "part").select("p_partkey", head.alias("head"), tail.alias("tail"))


@register("unit_norm", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(1.0::DOUBLE, 6) AS unit_norm FROM embeddings")
def unit_norm(spark, d):
    v = F.col("embedding")
    u = numbers.unit(v)
    return table(spark, d, "embeddings").select("vec_id", r6(F.sqrt(numbers.dot(v, v))).alias("norm"), r6(F.sqrt(numbers.dot(u, u))).alias("unit_norm"))


_PUNCT = {"all_punctuation": "[!-/:-@\\[-`{-~]", "period": "\\.", "comma": ",", "question": "\\?", "exclamation": "!", "apostrophe": "''"}


@register(
    "punct_counts",
    "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {n}" for n, p in _PUNCT.items())
    + ", len(regexp_extract_all(text, '[!-/:-@\\[-`{-~]')) - len(regexp_extract_all(text, '[.,?!'']')) AS other_punctuation FROM documents",
)
def punct_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in lexical.punctuation(F.col("text")).items()])


@register(
    "text_statistics",
    f"""SELECT doc_id, {S.WORDS} AS word_count, round({S.WORDS} / greatest(1, len(regexp_extract_all(text, '[.!?]+'))), 6) AS words_per_sentence,
    round(len(regexp_extract_all(text, '[A-Za-z]{{7,}}')) / nullif({S.WORDS}, 0), 6) AS long_word_share FROM documents""",
)
def text_statistics(spark, d):
    s = lexical.statistics(F.col("text"))
    return table(spark, d, "documents").select("doc_id", s["word_count"].alias("word_count"), r6(s["words_per_sentence"]).alias("words_per_sentence"), r6(s["long_word_share"]).alias("long_word_share"))


_LEXICON = S.values([(w, c) for c, ws in lexical.LEXICON.items() for w in ws])


@register("lexicon_counts", f"SELECT doc_id, category, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM documents) w JOIN {_LEXICON} l(word, category) USING (word) GROUP BY 1, 2")
def lexicon_counts(spark, d):
    return lexical.lexicon_counts(table(spark, d, "documents"))


@register(
    "lexicon_densities",
    f"""WITH c AS (SELECT doc_id, category, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM documents) w JOIN {_LEXICON} l(word, category) USING (word) GROUP BY 1, 2)
    SELECT category, count(*) AS n_docs, round(avg(n * 1000.0 / {S.WORDS}), 6) AS mean_per_1k FROM c JOIN documents USING (doc_id) GROUP BY 1""",
)
def lexicon_densities(spark, d):
    docs = table(spark, d, "documents")
    return lexical.densities(lexical.lexicon_counts(docs), docs).groupBy("category").agg(F.count("*").alias("n_docs"), r6(F.avg("per_1k")).alias("mean_per_1k"))


def _tense(pattern: str) -> str:
    return f"len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: regexp_full_match(x, '{pattern}')))"


@register("tense_counts", f"SELECT doc_id, {_tense('was|were|had|did|[a-z]+ed')} AS past, {_tense('is|are|am|has|have|does|do')} AS present, {_tense('will|shall|gonna')} AS future FROM documents")
def tense_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in lexical.tenses(F.col("text")).items()])


_GROUPS = S.values([(f, g) for g, fs in lexical.GROUPS.items() for f in fs])


@register("format_groups", f"WITH {S.MANIFEST} SELECT g.grp AS format_group, CASE WHEN g.grp = 'institutional' THEN NULL ELSE g.grp = 'dialogue' END AS interactive, count(*) AS n FROM manifest JOIN {_GROUPS} g(format, grp) USING (format) GROUP BY 1, 2")
def format_groups(spark, d):
    return manifest(spark, d).groupBy(lexical.format_group(F.col("format")).alias("format_group"), lexical.interactive(F.col("format")).alias("interactive")).agg(F.count("*").alias("n"))


# Cleaning and manifests.


@register(
    "clean_drop_reasons",
    f"SELECT CASE WHEN {S.WORDS} = 0 THEN 'blank' WHEN {S.WORDS} < 50 THEN 'short_words' WHEN {S.rounded(S.WORDS)} < 100 THEN 'short_tokens' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1",
)
def clean_drop_reasons(spark, d):
    return records.drop_counts(table(spark, d, "documents"), 50, 100)


@register("min_token_coverage", f"SELECT lang, count(*) AS n_before, count(*) FILTER (WHERE {S.WORDS} >= 379) AS n_after FROM documents GROUP BY 1")
def min_token_coverage(spark, d):
    return records.coverage(table(spark, d, "documents"), "lang", 512)


@register(
    "manifest_row",
    f"""SELECT doc_id, source AS shard_path, 'unknown' AS source_family, lang AS topic, source AS format, NULL::INT AS bin_id, {S.ceiled(S.WORDS)} AS estimated_token_count,
    CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4.0))::BIGINT END AS token_count, length(text) AS document_length_chars, {S.WORDS} AS original_word_count,
    lang AS language, 2000 + (doc_id % 20)::INT AS year, 'example.org' AS url_domain FROM documents""",
)
def manifest_row(spark, d):
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("source").alias("shard_path"), F.concat(F.lit("__label__"), "lang").alias("topic"), F.col("source").alias("format"), "lang",
        F.concat((F.col("doc_id") % 20 + 2000).cast("string"), F.lit("-01-02")).alias("warc_date"), F.lit("https://WWW.example.org/x").alias("url"),
    )
    return records.manifest(rows)


@register("enrich_record", f"SELECT page_id AS id, {_HOST} AS domain, length(html) AS char_length, len(regexp_extract_all(html, '[^{S.SPACE}]+')) AS original_word_count, {S.rounded(f'len(regexp_extract_all(html, {chr(39)}[^{S.SPACE}]+{chr(39)}))')} AS token_count_est FROM pages")
def enrich_record(spark, d):
    rows = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"), F.lit("").alias("warc_url"), "url", F.lit(None).cast("string").alias("source_url"))
    return records.enrich(rows).select("id", "domain", "char_length", "original_word_count", "token_count_est")


@register("metadata_join", "SELECT d.doc_id, l.quality, l.toxic, l.doc_id IS NOT NULL AS matched FROM documents d LEFT JOIN labels l USING (doc_id)")
def metadata_join(spark, d):
    labels = table(spark, d, "labels").withColumn("m", F.lit(True))
    return table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", "quality", "toxic", F.coalesce("m", F.lit(False)).alias("matched"))


@register("record_id_extract", "SELECT doc_id, 'k' || doc_id AS found FROM documents")
def record_id_extract(spark, d):
    line = F.to_json(F.struct(F.concat(F.lit("k"), "doc_id").alias("id"), "text"))
    return table(spark, d, "documents").select("doc_id", web.record_id(line).alias("found"))


@register("shard_families", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'common_crawl' WHEN 1 THEN 'stack_edu' WHEN 2 THEN 'wiki' ELSE 'unknown' END AS family, doc_id % 4 = 0 AS pool FROM documents")
def shard_families(spark, d):
    path = F.element_at(F.array(F.lit("data/common_crawl-x/a.zst"), F.lit("data/stack_edu-py/a"), F.lit("data/wiki/a"), F.lit("other/a")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", web.source_family(path).alias("family"), web.is_pool_family(path).alias("pool"))


@register("dedup_keep_first", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedup_keep_first(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


# Bins.


@register("score_bin_rank", f"WITH {S.GRID}, z AS (SELECT *, (mean_score - avg(mean_score) OVER ()) / stddev_samp(mean_score) OVER () AS z FROM grid) SELECT topic, format, round(mean_score, 6) AS mean_score, round(abs_mean_score, 6) AS abs_mean_score, round(std_score, 6) AS std_score, doc_count, round(z, 6) AS zscore FROM z ORDER BY round(z, 6) DESC, topic, format LIMIT 20")
def score_bin_rank(spark, d):
    z = bins.z_scores(bins.score_bins(mean_scores(spark, d), vector_bins(spark, d)))
    z = z.select("topic", "format", *[r6(c).alias(c) for c in ("mean_score", "abs_mean_score", "std_score", "zscore")], "doc_count")
    return bins.top(z, F.col("zscore"), 20, "topic", "format")


@register("bin_mean_abs_std", f"WITH {S.LINES}, m AS (SELECT doc_id, avg(score) AS score FROM scores GROUP BY 1) SELECT topic, format, round(avg(score), 4) AS mean_score, round(avg(abs(score)), 4) AS abs_mean_score, round(stddev_pop(score), 4) AS std_score, count(*) AS doc_count FROM m JOIN obins USING (doc_id) GROUP BY 1, 2")
def bin_mean_abs_std(spark, d):
    return bins.score_bins(line_scores(spark, d), order_bins(spark, d)).select("topic", "format", *[F.round(c, 4).alias(c) for c in ("mean_score", "abs_mean_score", "std_score")], "doc_count")


@register("bin_match_counts", "SELECT count(*) AS n_docs, count(*) FILTER (WHERE o_orderkey IS NULL) AS n_missed FROM (SELECT DISTINCT l_orderkey FROM lineitem) l LEFT JOIN orders o ON l_orderkey = o_orderkey")
def bin_match_counts(spark, d):
    return bins.match_counts(bins.document_means(line_scores(spark, d)), order_bins(spark, d))


@register("bin_split_correct", f"WITH {S.LINES}, m AS (SELECT doc_id, query_id % 2 = 0 AS is_correct, avg(score) AS score FROM scores GROUP BY 1, 2) SELECT is_correct, topic, format, round(avg(score), 4) AS mean_score, count(*) AS doc_count FROM m JOIN obins USING (doc_id) GROUP BY 1, 2, 3")
def bin_split_correct(spark, d):
    correct = spark.range(1, 8).select(F.col("id").cast("int").alias("query_id"), F.when(F.col("id") % 2 == 0, True).alias("is_correct"))
    return bins.split_bins(line_scores(spark, d), correct, order_bins(spark, d)).select("is_correct", "topic", "format", F.round("mean_score", 4).alias("mean_score"), "doc_count")


_QUANTILES = "round(quantile_cont(m, 0.5), 7) AS median_influence, round(avg(m), 7) AS mean_influence, round(quantile_cont(m, 0.25), 7) AS p25_influence, round(quantile_cont(m, 0.75), 7) AS p75_influence, round(stddev_pop(m), 7) AS std_influence, round(quantile_cont(a, 0.5), 7) AS median_abs_influence, round(avg(a), 7) AS mean_abs_influence, max(n) AS doc_count"


@register("bin_perquery_quantiles", f"WITH {S.LINES}, e AS (SELECT topic, format, query_id, avg(score) AS m, avg(abs(score)) AS a, count(*) AS n FROM scores JOIN obins USING (doc_id) GROUP BY 1, 2, 3) SELECT topic, format, {_QUANTILES} FROM e GROUP BY 1, 2")
def bin_perquery_quantiles(spark, d):
    out = bins.per_query_bins(line_scores(spark, d), order_bins(spark, d))
    return out.select("topic", "format", *[F.round(c, 7).alias(c) for c in out.columns if c not in ("topic", "format", "doc_count")], "doc_count")


@register("bin_zscore", f"WITH {S.GRID} SELECT topic, format, round((mean_score - avg(mean_score) OVER ()) / stddev_samp(mean_score) OVER (), 6) AS zscore FROM grid")
def bin_zscore(spark, d):
    return bins.z_scores(bins.score_bins(mean_scores(spark, d), vector_bins(spark, d))).select("topic", "format", r6("zscore").alias("zscore"))


def two_grids(spark, d) -> tuple[DataFrame, DataFrame]:
    """The grids of queries with small and with large labels."""
    label = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("k"))
    (index, queries), where = vectors(spark, d), vector_bins(spark, d)
    held = queries.join(label, "id")
    return tuple(bins.z_scores(bins.score_bins(scoring.mean_scores(index, held.where(F.col("k") == k)), where)) for k in (0, 1))


_TWO = ", ".join(
    f"m{k} AS (SELECT doc_id, avg(score) AS score FROM scores JOIN embeddings ON vec_id = query_id WHERE (label >= 5)::INT = {k} GROUP BY 1), b{k} AS (SELECT topic, format, avg(score) AS mean_score, count(*) AS doc_count FROM m{k} JOIN vbins USING (doc_id) GROUP BY 1, 2), "
    f"g{k} AS (SELECT topic, format, mean_score, doc_count, (mean_score - avg(mean_score) OVER ()) / stddev_samp(mean_score) OVER () AS zscore FROM b{k})"
    for k in (0, 1)
)
_CONTRAST = f"WITH {S.SCORES}, {S.VECTOR_BINS}, {_TWO}, c AS (SELECT topic, format, coalesce(g0.zscore, 0) AS a, coalesce(g1.zscore, 0) AS b FROM g0 FULL JOIN g1 USING (topic, format))"


@register("contrastive_bins", f"{_CONTRAST} SELECT topic, format, round(a, 6) AS value_a, round(b, 6) AS value_b, round(a - b, 6) AS diff FROM c ORDER BY diff DESC, topic, format LIMIT 20")
def contrastive_bins(spark, d):
    c = bins.contrast(*two_grids(spark, d)).select("topic", "format", *[r6(x).alias(x) for x in ("value_a", "value_b", "diff")])
    return bins.top(c, F.col("diff"), 20, "topic", "format")


@register("correctness_diff", f"{_CONTRAST} SELECT topic, format, round(a - b, 6) AS diff FROM c ORDER BY abs(round(a - b, 6)) DESC, topic, format LIMIT 15")
def correctness_diff(spark, d):
    c = bins.contrast(*two_grids(spark, d)).select("topic", "format", r6("diff").alias("diff"))
    return bins.top(c, F.abs("diff"), 15, "topic", "format")


@register("contrast_verdict", f"{_CONTRAST} SELECT CASE WHEN a - b > 0.4 THEN 'a' WHEN a - b < -0.4 THEN 'b' ELSE 'balanced' END AS verdict, count(*) AS n FROM c GROUP BY 1")
def contrast_verdict(spark, d):
    diff = F.col("diff")
    return bins.contrast(*two_grids(spark, d)).groupBy(F.when(diff > 0.4, "a").when(diff < -0.4, "b").otherwise("balanced").alias("verdict")).agg(F.count("*").alias("n"))


@register("topic_marginals", f"WITH {S.GRID} SELECT topic, round(avg(mean_score), 6) AS mean_score, sum(doc_count)::BIGINT AS doc_count FROM grid GROUP BY 1")
def topic_marginals(spark, d):
    return bins.marginal_means(bins.score_bins(mean_scores(spark, d), vector_bins(spark, d)), "topic").select("topic", r6("mean_score").alias("mean_score"), "doc_count")


@register("significant_bins")
def significant_bins(spark, d):
    return bins.significant(bins.score_bins(line_scores(spark, d), order_bins(spark, d))).select("topic", "format", "significant")


_STATS = f"""WITH {S.MANIFEST}, {S.BINS}, s AS (SELECT topic, format, count(*) AS n, sum(token_count)::BIGINT AS t, avg(token_count) AS a, median(token_count) AS m FROM manifest GROUP BY 1, 2)
SELECT b.bin_id, b.topic, b.format, coalesce(n, 0) AS doc_count, coalesce(t, 0) AS token_count, coalesce(round_even(a, 1), 0) AS mean_tokens, coalesce(round_even(m, 1), 0) AS median_tokens,
CASE WHEN n IS NULL THEN 'empty' WHEN n < 1000 THEN 'sparse' WHEN n < 100000 THEN 'partial' ELSE 'full' END AS classification FROM bins b LEFT JOIN s USING (topic, format)"""


@register("bin_stats_576", _STATS)
def bin_stats_576(spark, d):
    return bins.bin_statistics(manifest(spark, d), taxonomy.dim_bin(spark))


@register("corpus_bin_composition", f"SELECT nullif(lang, 'es') AS topic, source AS format, count(*) AS doc_count, sum({S.rounded(S.WORDS)})::BIGINT AS token_count, sum({S.ceiled(S.WORDS)})::BIGINT AS estimated_token_count FROM documents GROUP BY 1, 2")
def corpus_bin_composition(spark, d):
    w = text.word_count(F.col("text"))
    rows = table(spark, d, "documents").select(F.nullif("lang", F.lit("es")).alias("topic"), F.col("source").alias("format"), numbers.tokens_rounded(w).alias("token_count"), numbers.tokens_ceiled(w).alias("estimated_token_count"))
    return bins.composition(rows)


@register("marginals_grouping_sets", f"SELECT lang AS topic, source AS format, grouping(lang, source)::BIGINT AS level, count(*) AS doc_count, floor(sum({S.rounded(S.WORDS)}) / 1.35::DOUBLE)::BIGINT AS word_count_sum FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source))")
def marginals_grouping_sets(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("topic"), F.col("source").alias("format"), numbers.tokens_rounded(text.word_count(F.col("text"))).alias("token_count"))
    return bins.marginals(rows)


_LANG_GRID = f"lgrid AS (SELECT lang AS topic, source AS format, count(*) AS doc_count, sum({S.rounded(S.WORDS)})::BIGINT AS token_count FROM documents GROUP BY 1, 2)"


def lang_grid(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("topic"), F.col("source").alias("format"), numbers.tokens_rounded(text.word_count(F.col("text"))).alias("token_count"))
    return rows.groupBy("topic", "format").agg(F.count("*").alias("doc_count"), F.sum("token_count").alias("token_count"))


@register("grid_complete", f"WITH {S.MANIFEST}, {S.BINS}, g AS (SELECT topic, format, count(*) AS doc_count, sum(token_count)::BIGINT AS token_count FROM manifest GROUP BY 1, 2) SELECT bin_id, topic, format, coalesce(doc_count, 0) AS doc_count, coalesce(token_count, 0) AS token_count FROM bins LEFT JOIN g USING (topic, format)")
def grid_complete(spark, d):
    g = manifest(spark, d).groupBy("topic", "format").agg(F.count("*").alias("doc_count"), F.sum("token_count").alias("token_count"))
    return bins.complete(g, taxonomy.dim_bin(spark), ["doc_count", "token_count"]).select("bin_id", "topic", "format", "doc_count", "token_count")


@register("top_bottom_bins", f"WITH {_LANG_GRID}, r AS (SELECT *, row_number() OVER (ORDER BY token_count DESC, topic, format) AS rank, count(*) OVER () AS n, token_count / sum(token_count) OVER () AS s FROM lgrid) SELECT topic, format, doc_count, token_count, rank, round(s, 6) AS share, CASE WHEN rank <= 10 THEN 'top' ELSE 'bottom' END AS side FROM r WHERE rank <= 10 OR rank > n - 10")
def top_bottom_bins(spark, d):
    out = bins.top_and_bottom(lang_grid(spark, d), "token_count", 10)
    return out.select("topic", "format", "doc_count", "token_count", "rank", r6("share").alias("share"), "side")


_GINI = "2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)"


@register("gini", f"WITH {_LANG_GRID}, v AS (SELECT token_count::DOUBLE AS x, row_number() OVER (ORDER BY token_count) AS i FROM lgrid) SELECT round({_GINI}, 6) AS gini FROM v")
def gini(spark, d):
    return bins.gini(lang_grid(spark, d), "token_count").select(r6("gini").alias("gini"))


@register("effective_bins", f"WITH {_LANG_GRID}, p AS (SELECT token_count / sum(token_count) OVER () AS p FROM lgrid WHERE token_count > 0) SELECT round(exp(-sum(p * ln(p))), 6) AS effective_bins FROM p")
def effective_bins(spark, d):
    return bins.effective_bins(lang_grid(spark, d), "token_count").select(r6("effective_bins").alias("effective_bins"))


@register(
    "concentration",
    f"""WITH {S.MANIFEST}, {S.BINS}, g AS (SELECT topic, format, count(*) AS c, sum(token_count) AS k FROM manifest GROUP BY 1, 2), f AS (SELECT coalesce(c, 0)::DOUBLE AS d, coalesce(k, 0)::DOUBLE AS t FROM bins LEFT JOIN g USING (topic, format)),
    r AS (SELECT d, t, row_number() OVER (ORDER BY d) AS id, row_number() OVER (ORDER BY t) AS it, row_number() OVER (ORDER BY t DESC) AS r, CASE WHEN d > 0 THEN d / sum(d) OVER () END AS pd, CASE WHEN t > 0 THEN t / sum(t) OVER () END AS pt FROM f)
    SELECT count(*) AS total_bins, count(*) FILTER (WHERE d = 0) AS empty_bins, count(*) FILTER (WHERE d > 0 AND d < 100) AS near_empty_100, count(*) FILTER (WHERE d > 0 AND d < 1000) AS near_empty_1000,
    round(2 * sum(id * d) / (count(*) * sum(d)) - (count(*) + 1) / count(*), 6) AS gini_doc, round(2 * sum(it * t) / (count(*) * sum(t)) - (count(*) + 1) / count(*), 6) AS gini_token,
    round(exp(-sum(pd * ln(pd))), 6) AS effective_bins_doc, round(exp(-sum(pt * ln(pt))), 6) AS effective_bins_token,
    round(sum(t) FILTER (WHERE r <= 10) / sum(t), 6) AS top_10_share, round(sum(t) FILTER (WHERE r <= 50) / sum(t), 6) AS top_50_share, round(sum(t) FILTER (WHERE r <= 100) / sum(t), 6) AS top_100_share FROM r""",
)
def concentration(spark, d):
    g = manifest(spark, d).groupBy("topic", "format").agg(F.count("*").alias("doc_count"), F.sum("token_count").alias("token_count"))
    out = bins.concentration(bins.complete(g, taxonomy.dim_bin(spark), ["doc_count", "token_count"]))
    return out.select(*[r6(c).alias(c) if k == "double" else c for c, k in out.dtypes])


@register(
    "share_log2_ratio",
    f"""WITH a AS (SELECT lang AS topic, source AS format, count(*)::DOUBLE AS v FROM documents WHERE n_chars < 1500 GROUP BY 1, 2), b AS (SELECT lang AS topic, source AS format, count(*)::DOUBLE AS v FROM documents WHERE n_chars >= 1500 GROUP BY 1, 2),
    s AS (SELECT topic, format, coalesce(a.v, 0) / (SELECT sum(v) FROM a) AS x, coalesce(b.v, 0) / (SELECT sum(v) FROM b) AS y FROM a FULL JOIN b USING (topic, format))
    SELECT topic, format, round(x, 6) AS share_a, round(y, 6) AS share_b, round(log2((x + 1e-10) / (y + 1e-10)), 6) AS log2_ratio FROM s""",
)
def share_log2_ratio(spark, d):
    docs = table(spark, d, "documents").groupBy(F.col("lang").alias("topic"), F.col("source").alias("format"), (F.col("n_chars") >= 1500).alias("h")).agg(F.count("*").cast("double").alias("v"))
    return bins.share_ratio(docs.where("not h"), docs.where("h"), "v").select("topic", "format", *[r6(c).alias(c) for c in ("share_a", "share_b", "log2_ratio")])


@register("pivot_topic_format", "SELECT lang AS topic, " + ", ".join(f"nullif(count(*) FILTER (WHERE source = 'src{k}'), 0) AS src{k}" for k in range(20)) + " FROM documents GROUP BY 1")
def pivot_topic_format(spark, d):
    g = table(spark, d, "documents").groupBy(F.col("lang").alias("topic"), F.coalesce("source", F.lit("null")).alias("format")).agg(F.count("*").alias("n"))
    usual = [f"src{k}" for k in range(20)]
    return bins.pivot(g, "n", usual + sorted({r[0] for r in g.select("format").distinct().collect()} - set(usual)))


@register("merge_typo_labels", "SELECT CASE WHEN p_brand = 'Brand#11' THEN 'Brand#12' ELSE p_brand END AS label, count(*) AS doc_count, round(sum(p_retailprice) / count(*), 4) AS score_mean FROM part GROUP BY 1")
def merge_typo_labels(spark, d):
    m = table(spark, d, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("doc_count"), F.sum("p_retailprice").alias("score_sum"), F.sum("p_size").alias("word_count_sum"), F.count("*").alias("word_count_docs"))
    return bins.merge_labels(m, {"Brand#11": "Brand#12"}).select("label", "doc_count", F.round("score_mean", 4).alias("score_mean"))


@register("score_stats", f"WITH {S.SCORES} SELECT query_id, count(*) AS n, round(sum(score), 6) AS total, round(min(score), 6) AS lowest, round(max(score), 6) AS highest, round(avg(score), 6) AS mean FROM scores GROUP BY 1")
def score_stats(spark, d):
    return scoring.query_statistics(*vectors(spark, d)).select("query_id", "n", *[r6(c).alias(c) for c in ("total", "lowest", "highest", "mean")])


@register("nonzero_fraction", "SELECT l_linenumber AS query_id, round(count(*) FILTER (WHERE l_discount != 0) / count(*), 6) AS nonzero_fraction FROM lineitem GROUP BY 1")
def nonzero_fraction(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("query_id"), F.col("l_discount").alias("score"))
    return bins.nonzero_fraction(rows, ("query_id",)).select("query_id", r6("nonzero_fraction").alias("nonzero_fraction"))


@register("shard_mismatch", "SELECT l_suppkey AS shard, count(*) AS n_scores, count(*) FILTER (WHERE l_linenumber > 1 OR l_suppkey % 3 > 0) AS n_ids FROM lineitem GROUP BY 1 HAVING count(*) != count(*) FILTER (WHERE l_linenumber > 1 OR l_suppkey % 3 > 0)")
def shard_mismatch(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("shard"), "l_linenumber")
    return bins.mismatched_shards(rows, rows.where("l_linenumber > 1 or shard % 3 > 0"))


@register("shard_summary", "SELECT l_suppkey AS shard, count(*) AS n_rows, 2 * count(*) AS n_values, count(*) FILTER (WHERE l_discount != 0) + count(*) FILTER (WHERE l_tax != 0) AS n_nonzero, least(min(l_discount), min(l_tax)) AS lowest, greatest(max(l_discount), max(l_tax)) AS highest FROM lineitem GROUP BY 1")
def shard_summary(spark, d):
    a, b = F.col("l_discount"), F.col("l_tax")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("shard")).agg(F.count("*").alias("n_rows"), (2 * F.count("*")).alias("n_values"), (F.count_if(a != 0) + F.count_if(b != 0)).alias("n_nonzero"), F.least(F.min(a), F.min(b)).alias("lowest"), F.greatest(F.max(a), F.max(b)).alias("highest"))


# Scoring and top-k.


@register("dot_topk", f"WITH {S.SCORES} SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores QUALIFY rank <= 10")
def dot_topk(spark, d):
    return scoring.top_k(scoring.block_scores(*vectors(spark, d), k=10), 10).select("query_id", "doc_id", r6("score").alias("score"), "rank")


@register("dot_topk_global", f"WITH {S.SCORES} SELECT query_id, doc_id, round(score, 6) AS score FROM scores ORDER BY scores.score DESC, doc_id LIMIT 25")
def dot_topk_global(spark, d):
    return scoring.top_k_all(scoring.block_scores(*vectors(spark, d), k=25, each=False), 25).select("query_id", "doc_id", r6("score").alias("score"))


@register("multi_key_scores", f"WITH {S.SCORES} SELECT doc_id, query_id, round(score, 6) AS score, round(score / 2, 6) AS mean_score FROM scores")
def multi_key_scores(spark, d):
    found = scoring.key_scores(*modules(spark, d))
    mean = F.col("score") / F.col("n_keys")
    return found.select("doc_id", "query_id", numbers.half_away(F.col("score"), 6).alias("score"), numbers.half_away(mean, 6).alias("mean_score"))


@register("key_space", "SELECT k AS grad_key, count(*) AS n_rows, 32 AS min_width, 32 AS max_width FROM embeddings, (VALUES ('k0'), ('k1')) v(k) GROUP BY 1")
def key_space(spark, d):
    index, queries = vectors(spark, d, keys=True)
    return scoring.key_widths(index).join(scoring.common_keys(index, queries), "grad_key")


@register("proponent_text", f"WITH {S.SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores) SELECT query_id, r.doc_id, rank, md5(text) AS text_md5 FROM r LEFT JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= 5")
def proponent_text(spark, d):
    ranked = scoring.top_k(scoring.block_scores(*vectors(spark, d), k=5), 5)
    return scoring.with_texts(ranked, table(spark, d, "documents").select("doc_id", "text")).select("query_id", "doc_id", "rank", F.md5("text").alias("text_md5"))


@register("nested_records", f"WITH {S.SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores) SELECT query_id, array_to_string(list(doc_id ORDER BY rank), ',') AS doc_ids FROM r WHERE rank <= 5 GROUP BY 1")
def nested_records(spark, d):
    return scoring.nested(scoring.top_k(scoring.block_scores(*vectors(spark, d), k=5), 5)).select("query_id", F.concat_ws(",", F.col("doc_ids").cast("array<string>")).alias("doc_ids"))


@register("wide_scores", f"WITH {S.SCORES} SELECT * FROM (PIVOT scores ON query_id USING round(max(score), 6) GROUP BY doc_id)")
def wide_scores(spark, d):
    return scoring.wide(*vectors(spark, d), 6)


# Samples.


@register("stratified_sample", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) <= 20")
def stratified_sample(spark, d):
    return sampling.per_group(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], 20, 42)


@register(
    "stratified_token_floor",
    f"""WITH m AS (SELECT doc_id, lang, source, {S.rounded(S.WORDS)} AS token_count FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id || ':42'), doc_id) AS rank FROM m),
    f AS (SELECT *, sum(CASE WHEN rank <= 3 THEN token_count END) OVER (PARTITION BY lang, source) AS first FROM r WHERE rank <= 6) SELECT doc_id, token_count FROM f WHERE rank <= 3 OR first < 1500""",
)
def stratified_token_floor(spark, d):
    m = table(spark, d, "documents").select("doc_id", F.col("lang").alias("topic"), F.col("source").alias("format"), numbers.tokens_rounded(text.word_count(F.col("text"))).alias("token_count"))
    return sampling.stratified(m, 3, 1500).select("doc_id", "token_count")


@register(
    "representative_sample",
    f"""WITH m AS (SELECT doc_id, lang, {S.rounded(S.WORDS)} AS token_count FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) > 20), g AS (SELECT lang, floor(50000 * (sum(token_count) / (SELECT sum(token_count) FROM m))) AS goal FROM m GROUP BY 1),
    c AS (SELECT *, sum(token_count) OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) AS s FROM m) SELECT doc_id, c.lang AS topic, token_count FROM c JOIN g USING (lang) WHERE s <= goal""",
)
def representative_sample(spark, d):
    m = table(spark, d, "documents").select("doc_id", F.col("lang").alias("topic"), F.lit("x").alias("format"), numbers.tokens_rounded(text.word_count(F.col("text"))).alias("token_count"))
    return sampling.representative(m, sampling.per_group(m, ["topic"], 20, 42), 50_000).select("doc_id", "topic", "token_count")


@register("budget_prefix", "SELECT o_orderkey, o_totalprice FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS s FROM orders) WHERE s - o_totalprice < 1000000")
def budget_prefix(spark, d):
    return sampling.budget(table(spark, d, "orders"), ["o_orderkey"], "o_totalprice", 1_000_000, ["o_orderpriority"]).select("o_orderkey", "o_totalprice")


@register("forget_sample", "SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':7'), doc_id) <= 15")
def forget_sample(spark, d):
    return sampling.forget(table(spark, d, "documents"), ["fr", "de"], 30, 7, topic="lang").select("doc_id", "lang")


@register("retain_excluding_forget", "WITH f AS (SELECT doc_id FROM documents WHERE lang = 'fr' QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':7'), doc_id) <= 15) SELECT doc_id, lang, source FROM documents WHERE lang != 'fr' AND doc_id NOT IN (SELECT doc_id FROM f) QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id || ':8'), doc_id) <= 2")
def retain_excluding_forget(spark, d):
    docs = table(spark, d, "documents")
    gone = sampling.forget(docs, ["fr"], 15, 7, topic="lang")
    return sampling.retain(docs, ["fr"], 2, 8, gone, by=("lang", "source")).select("doc_id", "lang", "source")


@register("null_bin_split", "SELECT doc_id, CASE WHEN r <= 30 THEN 'forget' ELSE 'retain' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':5'), doc_id) AS r FROM documents) WHERE r <= 80")
def null_bin_split(spark, d):
    return sampling.null_split(table(spark, d, "documents").select("doc_id"), 30, 50, 5)


@register("train_rows", "SELECT doc_id, CASE WHEN lang = 'fr' THEN 'forget' ELSE 'retain' END AS split FROM documents")
def train_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return sampling.train_rows(docs.where("lang = 'fr'"), docs.where("lang <=> 'fr' = false")).select("doc_id", "split")


@register("modular_pairing", "WITH f AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE lang = 'fr'), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS j, count(*) OVER () AS n FROM documents WHERE lang IS DISTINCT FROM 'fr') SELECT i, f.doc_id AS forget_id, r.doc_id AS retain_id FROM f JOIN r ON i % n = j")
def modular_pairing(spark, d):
    docs = table(spark, d, "documents")
    return sampling.paired(docs.where("lang = 'fr'"), docs.where("lang <=> 'fr' = false"))


@register("round_robin_shards", "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 7)::INT AS shard FROM documents")
def round_robin_shards(spark, d):
    return sampling.round_robin(table(spark, d, "documents").select("doc_id"), ["doc_id"], 7)


@register("remaining_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def remaining_anti(spark, d):
    return integrity.members(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", negate=True)


@register("semi_known", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_known(spark, d):
    return integrity.members(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").where("quality = 1"), "doc_id")


@register("greedy_stratified")
def greedy_stratified(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("topic"), F.lit(10).alias("token_count"))
    return sampling.greedy_stratified(rows, ["doc_id"], ["topic"], 100)


# Statistics.


_PAIRED = f"{S.GAMMA}, a AS (SELECT topic, target, seed, gamma, event_id FROM gamma WHERE condition = 'expA' AND target = eval_benchmark), e AS (SELECT topic, eval_benchmark AS target, seed, gamma, event_id FROM gamma WHERE condition = 'exp1'), cells AS (SELECT topic, target, seed, a.gamma - e.gamma AS d FROM (SELECT topic, target, seed, avg(gamma) AS gamma FROM a GROUP BY 1, 2, 3) a JOIN (SELECT topic, target, seed, avg(gamma) AS gamma FROM e GROUP BY 1, 2, 3) e USING (topic, target, seed))"


@register("paired_diff", f"WITH {_PAIRED} SELECT topic, target, seed, round(d, 6) AS d FROM cells")
def paired_diff(spark, d):
    return statistics.paired_cells(gamma(spark, d), "expA", "exp1").select("topic", "target", "seed", r6("d").alias("d"))


@register("cohens_dz", f"WITH {_PAIRED} SELECT target, count(*) AS n_cells, count(DISTINCT seed) AS n_seeds, count(DISTINCT topic) AS n_topics, count(*) FILTER (WHERE d < 0) AS n_neg, count(*) FILTER (WHERE d > 0) AS n_pos, count(*) FILTER (WHERE d = 0) AS n_zero, round(median(d), 6) AS median_diff, round(avg(d) / nullif(stddev_samp(d), 0), 6) AS cohens_dz FROM cells GROUP BY 1")
def cohens_dz(spark, d):
    out = statistics.describe(statistics.paired_cells(gamma(spark, d), "expA", "exp1"))
    return out.withColumns({"median_diff": r6("median_diff"), "cohens_dz": r6("cohens_dz")})


@register("paired_significance")
def paired_significance(spark, d):
    return statistics.analyze(statistics.paired_cells(gamma(spark, d), "expA", "exp1"))


@register(
    "paired_tests",
    f"""WITH {_PAIRED}, nz AS (SELECT target, d, rank() OVER w + (count(*) OVER (PARTITION BY target, abs(d)) - 1) / 2.0 AS r FROM cells WHERE d != 0 WINDOW w AS (PARTITION BY target ORDER BY abs(d))),
    w AS (SELECT target, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS w FROM nz GROUP BY 1), m AS (SELECT target, topic, avg(d) AS d FROM cells GROUP BY 1, 2)
    SELECT target, 'wilcoxon_pooled' AS test, count(*) AS n_cells, round(median(d), 6) AS median_diff, round(max(w), 6) AS statistic FROM cells JOIN w USING (target) GROUP BY 1
    UNION ALL SELECT target, 't_topic_means', count(*), round(median(d), 6), round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) FROM m GROUP BY 1""",
)
def paired_tests(spark, d):
    out = statistics.analyze(statistics.paired_cells(gamma(spark, d), "expA", "exp1"))
    return out.select("target", "test", "n_cells", r6("median_diff").alias("median_diff"), r6("statistic").alias("statistic"))


@register("bh_adjust", "WITH p AS (SELECT c_custkey, c_nationkey, (c_custkey * 7919 % 1000 + 1) / 1001.0::DOUBLE AS p FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY p, c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM p) SELECT c_custkey, round(least(1.0::DOUBLE, min(p * n / r) OVER (PARTITION BY c_nationkey ORDER BY r DESC)), 6) AS p_bh FROM r")
def bh_adjust(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", ((F.col("c_custkey") * 7919 % 1000 + 1) / F.lit(1001.0)).alias("p"))
    return statistics.bh_adjust(rows, "p", ("c_nationkey",)).select("c_custkey", r6("p_bh").alias("p_bh"))


@register("selectivity", f"WITH {S.GAMMA}, s AS (SELECT topic, target, coalesce(max(abs(gamma)) FILTER (WHERE eval_benchmark = target), 0) AS on_t, avg(abs(gamma)) FILTER (WHERE eval_benchmark != target) AS off_t FROM gamma GROUP BY 1, 2) SELECT topic, target, round(on_t, 6) AS on_target, round(off_t, 6) AS off_target, round(on_t / nullif(off_t, 0), 6) AS selectivity FROM s")
def selectivity(spark, d):
    out = statistics.selectivity(gamma(spark, d), ["topic"])
    return out.select("topic", "target", *[r6(c).alias(c) for c in ("on_target", "off_target", "selectivity")])


@register("best_topic", f"WITH {S.SCORES}, {S.VECTOR_BINS}, b AS (SELECT 'q' || (query_id % 4) AS benchmark, topic, format, avg(score) AS zscore FROM scores JOIN vbins USING (doc_id) GROUP BY 1, 2, 3) SELECT benchmark, topic, round(zscore, 6) AS zscore FROM b QUALIFY row_number() OVER (PARTITION BY benchmark ORDER BY b.zscore DESC, topic, format) = 1")
def best_topic(spark, d):
    sums = scoring.score_sums(*vectors(spark, d), F.concat(F.lit("q"), (F.col("id") % 4).cast("string")))
    g = sums.join(vector_bins(spark, d), "doc_id").groupBy(F.col("by").alias("benchmark"), "topic", "format").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("zscore"))
    return statistics.best_topic(g).withColumn("zscore", r6("zscore"))


# Query sets.


@register("candidate_argmax_tie", "WITH c AS (SELECT l_orderkey AS query_id, l_linenumber AS idx, l_quantity AS s FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, idx) AS r, count(*) FILTER (WHERE s = m) OVER (PARTITION BY query_id) AS n_tied FROM (SELECT *, max(s) OVER (PARTITION BY query_id) AS m FROM c)) SELECT query_id, idx AS \"index\", s AS score, n_tied FROM r WHERE r = 1")
def candidate_argmax_tie(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("index"), F.col("l_quantity").alias("score"))
    return queryset.select_candidate(c, "score")


@register("candidate_argmin", "SELECT l_orderkey AS query_id, arg_min(l_linenumber, l_discount * 1000 + l_linenumber / 1000.0) AS \"index\" FROM lineitem GROUP BY 1")
def candidate_argmin(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("index"), F.col("l_discount").alias("score"))
    return queryset.select_candidate(c, "score", lowest=True).select("query_id", "index")


@register("candidate_scores", "SELECT doc_id, round(-length(text) * 0.5 / length(text), 6) AS per_character, round(length(text) * 0.5 * 1.4426950408889634 / strlen(text), 6) AS per_byte FROM documents WHERE length(text) > 0")
def candidate_scores(spark, d):
    t = F.col("text")
    s = numbers.candidate_scores(-F.length(t) * 0.5, F.length(t), text.word_count(t), F.octet_length(t))
    return table(spark, d, "documents").where("length(text) > 0").select("doc_id", r6(s["per_character"]).alias("per_character"), r6(s["per_byte"]).alias("per_byte"))


@register("group_contiguity", "SELECT conv_id, count(*)::INT AS n, list(turn ORDER BY turn) = range(0, count(*)) AS contiguous FROM conversations GROUP BY 1")
def group_contiguity(spark, d):
    return queryset.contiguous(table(spark, d, "conversations"), ["conv_id"], "turn")


@register("conversation_prompts", "SELECT conv_id, count(*)::INT AS n_turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS prompt_md5 FROM conversations GROUP BY 1")
def conversation_prompts(spark, d):
    return queryset.conversation_prompts(table(spark, d, "conversations")).select("conv_id", "n_turns", F.md5("prompt").alias("prompt_md5"))


@register("roster_coverage", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS state FROM documents d FULL JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR d.doc_id IS NULL")
def roster_coverage(spark, d):
    return queryset.coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "state")


@register("roster_diff", "(SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)) UNION ALL (SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents))")
def roster_diff(spark, d):
    return queryset.roster_difference(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"))


@register("duplicate_keys", "SELECT text_md5, count(*) AS n FROM (SELECT md5(text) AS text_md5 FROM documents) GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return queryset.duplicates(table(spark, d, "documents").select(F.md5("text").alias("text_md5")), ["text_md5"])


@register("offset_self_join", "SELECT a.doc_id, b.doc_id AS paired_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 100")
def offset_self_join(spark, d):
    return queryset.offset_pairs(table(spark, d, "documents"), 100)


@register("label_agreement", "SELECT text_md5, count(DISTINCT lang) AS n_values FROM (SELECT md5(text) AS text_md5, lang FROM documents) GROUP BY 1 HAVING count(DISTINCT lang) != 1")
def label_agreement(spark, d):
    return queryset.agreed(table(spark, d, "documents").select(F.md5("text").alias("text_md5"), "lang"), ["text_md5"], "lang")


@register("contract_gaps", "SELECT lang, count(*) AS n_rows, 100 AS n_expected FROM documents GROUP BY 1 HAVING count(*) != 100 UNION ALL SELECT 'xx', 0, 100")
def contract_gaps(spark, d):
    contract = spark.createDataFrame([(x, 100) for x in ("en", "fr", "de", "es", "xx")], "lang string, n_expected bigint")
    return queryset.contract_gaps(table(spark, d, "documents"), contract, "lang")


@register("probe_lookup", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'alias' WHEN p_type = 'STANDARD' THEN 'name' WHEN p_size <= 10 THEN 'core' END AS probe FROM part")
def probe_lookup(spark, d):
    tasks = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("task_alias"), F.col("p_type").alias("task_name"), F.when(F.col("p_size") <= 10, "small").otherwise("big").alias("task_core"))
    registry = spark.createDataFrame([("Brand#11", "alias"), ("STANDARD", "name"), ("small", "core")], "key string, probe string")
    return queryset.probe_lookup(tasks, registry).select("p_partkey", "probe")


@register("span_islands", "WITH s AS (SELECT user_id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 3600 AS b FROM events), m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM s), g AS (SELECT *, sum(CASE WHEN t IS NULL OR a >= t THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT user_id, island::BIGINT AS island, min(a) AS \"start\", max(b) AS \"end\", count(*) AS n FROM g GROUP BY 1, 2")
def span_islands(spark, d):
    at = F.unix_timestamp("ts")
    return queryset.islands(table(spark, d, "events").select("user_id", at.alias("start"), (at + 3600).alias("end")), "user_id")


@register("loss_labels", "SELECT conv_id, len(w) + (8 - len(w) % 8) % 8 AS n_ids, 2 + (8 - len(w) % 8) % 8 AS n_masked FROM (SELECT conv_id, range(0, (max(turn) + 4)) AS w FROM conversations GROUP BY 1)")
def loss_labels(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("m")).select("conv_id", F.array(F.lit(7), F.lit(8)).alias("p"), F.expr("transform(sequence(1, cast(m as int) + 2), x -> x)").alias("t"))
    ids, labels = queryset.loss_labels(F.col("p"), F.col("t"))
    return rows.select("conv_id", F.size(ids).alias("n_ids"), F.size(F.filter(labels, lambda x: x == queryset.LABEL_PAD)).alias("n_masked"))


@register("reference_policies", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size % 3 WHEN 1 THEN (p_size % 2) WHEN 2 THEN 1 ELSE p_size END AS reference_index FROM part")
def reference_policies(spark, d):
    size = F.col("p_size")
    rows = table(spark, d, "part").select(
        "p_partkey", F.element_at(F.array(F.lit("parsed"), F.lit("ordering"), F.lit("consensus"), F.lit("explicit")), size % 4 + 1).alias("policy"),
        F.array(F.lit("Yes."), F.lit("no"), F.lit("Maybe  so")).alias("choices"), F.element_at(F.array(F.lit(" yes"), F.lit("No."), F.lit("maybe so")), size % 3 + 1).alias("answer"),
        F.array(size % 2 == 0, size % 2 == 1).alias("marks"), F.array(F.lit(2.0), F.lit(7.0), F.lit(1.0)).alias("votes"), size.cast("bigint").alias("index"),
    )
    return queryset.resolve_reference(rows).select("p_partkey", F.col("reference_index").cast("bigint").alias("reference_index"))


# Integrity and streams.


@register("row_digests", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def row_digests(spark, d):
    return integrity.row_digests(table(spark, d, "documents"), "doc_id", "text")


@register("conflicting_duplicates", "SELECT text_md5, count(DISTINCT lang || '/' || source) AS n_versions FROM (SELECT md5(text) AS text_md5, lang, source FROM documents) GROUP BY 1 HAVING count(DISTINCT lang || '/' || source) > 1")
def conflicting_duplicates(spark, d):
    return integrity.conflicting(table(spark, d, "documents").select(F.md5("text").alias("text_md5"), "lang", "source"), "text_md5", ["lang", "source"])


@register("last_wins", "SELECT text_md5, max(doc_id) AS doc_id FROM (SELECT md5(text) AS text_md5, doc_id FROM documents) GROUP BY 1")
def last_wins(spark, d):
    return integrity.last_wins(table(spark, d, "documents").select(F.md5("text").alias("text_md5"), "doc_id"), "text_md5", "doc_id")


@register(
    "ordered_digest",
    """WITH v AS (SELECT sha256(strlen(text) || ':' || text) AS h, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
    a AS (SELECT i // 4096 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, count(*) AS n FROM v GROUP BY 1), b AS (SELECT i // 4096 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, sum(n) AS n FROM a GROUP BY 1)
    SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY i)) AS sha256 FROM b""",
)
def ordered_digest(spark, d):
    return integrity.ordered_digest(table(spark, d, "documents"), ["doc_id"], "text")


@register("multiset_digest")
def multiset_digest(spark, d):
    return integrity.multiset_digest(table(spark, d, "documents"), ["doc_id", "text"])


@register("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return streams.windowed_sums(table(spark, d, "events")).withColumn("total", r6("total"))


@register("event_sessions", "WITH m AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM g GROUP BY user_id, s")
def event_sessions(spark, d):
    return streams.sessions(table(spark, d, "events"))


@register("running_bins", f"WITH {S.LINES} SELECT topic, format, round(sum(score) / 1e6::DOUBLE, 6) AS total, round(sum(abs(score)) / 1e6::DOUBLE, 6) AS abs_total, count(*) AS doc_count FROM scores JOIN obins USING (doc_id) GROUP BY 1, 2")
def running_bins(spark, d):
    out = streams.running_bins(line_scores(spark, d).join(order_bins(spark, d), "doc_id"))
    return out.select("topic", "format", r6(F.col("total") / 1e6).alias("total"), r6(F.col("abs_total") / 1e6).alias("abs_total"), "doc_count")


@register("cumulative_shares", f"WITH {_LANG_GRID} SELECT topic, format, row_number() OVER w AS rank, round(sum(token_count) OVER w / sum(token_count) OVER (), 6) AS cumulative_share FROM lgrid WINDOW w AS (ORDER BY token_count DESC, topic, format ROWS UNBOUNDED PRECEDING)")
def cumulative_shares(spark, d):
    w = Window.orderBy(F.desc("token_count"), "topic", "format").rowsBetween(Window.unboundedPreceding, 0)  # a row a bin
    total = F.sum("token_count").over(Window.partitionBy())
    return lang_grid(spark, d).select("topic", "format", F.row_number().over(Window.orderBy(F.desc("token_count"), "topic", "format")).alias("rank"), r6(F.sum("token_count").over(w) / total).alias("cumulative_share"))


# Evidence and smaller variants.


def candidates(spark, d) -> DataFrame:
    """Lines as candidates: an order is a query."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("index"), F.col("l_returnflag").alias("continuation"),
        (-F.col("l_quantity")).alias("sum_logits"), (F.col("l_linenumber") % 3).alias("num_tokens"), F.when(F.col("l_orderkey") % 2 == 0, -F.col("l_quantity") / 2).alias("sum_logits_uncond"),
    )


_CANDIDATES = """c AS (SELECT l_orderkey AS query_id, l_linenumber AS idx, -l_quantity AS raw, -l_quantity / 1 AS per_character, -l_quantity / greatest(l_linenumber % 3, 1) AS per_token,
  -(l_quantity * 1.4426950408889634::DOUBLE) AS per_byte, CASE WHEN l_orderkey % 2 = 0 THEN -l_quantity + l_quantity / 2 END AS unconditioned FROM lineitem),
  e AS (SELECT query_id, idx, unnest(['raw', 'per_character', 'per_token', 'per_byte', 'unconditioned']) AS rule, unnest([raw, per_character, per_token, per_byte, unconditioned]) AS v FROM c),
  w AS (SELECT query_id, rule, idx FROM e WHERE v IS NOT NULL QUALIFY v = max(v) OVER (PARTITION BY query_id, rule))"""


@register("winning_sets", f"WITH {_CANDIDATES} SELECT query_id, rule, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS winners FROM w GROUP BY 1, 2")
def winning_sets(spark, d):
    out = evidence.winning_sets(evidence.scored_candidates(candidates(spark, d)))
    return out.select("query_id", "rule", F.concat_ws(",", F.col("winners").cast("array<string>")).alias("winners"))


@register("metric_conflicts", f"WITH {_CANDIDATES}, s AS (SELECT o_orderkey AS query_id, 'raw' AS rule, 1 AS predicted, (o_orderkey % 2)::DOUBLE AS accuracy, 1 AS gold_index FROM orders), j AS (SELECT s.query_id, count(w.idx) AS n, count(*) FILTER (WHERE w.idx = 1) AS hit, any_value(accuracy) AS accuracy FROM s LEFT JOIN w ON w.query_id = s.query_id AND w.rule = 'raw' GROUP BY 1), t AS (SELECT query_id, CASE WHEN n = 0 THEN 'no_evidence' WHEN hit = 0 THEN 'not_a_winner' WHEN accuracy != 1 THEN 'accuracy_differs' END AS state FROM j) SELECT state, count(*) AS n FROM t WHERE state IS NOT NULL GROUP BY 1")
def metric_conflicts(spark, d):
    stored = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.lit("raw").alias("rule"), F.lit(1).alias("predicted"), (F.col("o_orderkey") % 2).cast("double").alias("accuracy"), F.lit(1).alias("gold_index"))
    winners = evidence.winning_sets(evidence.scored_candidates(candidates(spark, d)))
    return evidence.metric_conflicts(stored, winners).groupBy("state").agg(F.count("*").alias("n"))


@register("reconstruction_conflicts", "SELECT conv_id AS native_id, turn AS doc_id, CASE WHEN conv_id % 5 = 0 THEN 'missing' ELSE 'differs' END AS state FROM conversations WHERE conv_id % 5 = 0 OR conv_id % 7 = 0")
def reconstruction_conflicts(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("native_id"), F.col("turn").alias("doc_id"), F.lit(0).alias("idx"), F.col("role").alias("context"), F.col("text").alias("continuation"))
    rebuilt = rows.where("native_id % 5 != 0").withColumn("context", F.when(F.col("native_id") % 7 == 0, "x").otherwise(F.col("context")))
    return evidence.reconstruction_conflicts(rows, rebuilt).select("native_id", "doc_id", "state")


@register("probe_contracts", "SELECT 11 AS n_probes, 34 AS n_tasks, 143008 AS n_rows")
def probe_contracts(spark, d):
    return evidence.probe_contracts(spark).agg(F.count_distinct("probe").alias("n_probes"), F.count("*").alias("n_tasks"), F.sum("n_expected").alias("n_rows"))


def query_evidence(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.lit("bbq").alias("probe"), F.lit("bbq").alias("task"), F.col("text").alias("prompt"), F.concat(F.lit(" w"), "item_id").alias("completion"),
        (F.col("item_id") % 2 == 0).alias("is_correct"), F.concat(F.lit(" r"), "item_id").alias("reference"),
    )


_COMPILED = """SELECT item_id AS query_id, 'model_completion' AS condition, 'joint_sequence' AS objective, ' w' || item_id AS target, 'base_completion' AS target_source, 'sensitivity' AS study_role FROM benchmark
UNION ALL SELECT item_id, 'reference_answer', 'completion_target', ' r' || item_id, 'benchmark_reference', 'primary' FROM benchmark
UNION ALL SELECT item_id, 'prompt_only', 'prompt_next_token', NULL, NULL, 'primary' FROM benchmark"""


@register("compiled_queries", _COMPILED)
def compiled_queries(spark, d):
    rows = query_evidence(spark, d)
    kinds = [("model_completion", "joint_sequence"), ("reference_answer", "completion_target"), ("prompt_only", "prompt_next_token")]
    parts = [evidence.compile_queries(rows, c, o).select("query_id", "condition", "objective", "target", "target_source", "study_role") for c, o in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("rendered_queries", "SELECT item_id AS query_id, len(regexp_extract_all(text || ' r' || item_id, '\\S+'))::INT AS n_words, 1 AS n_scored, length(text || ' r' || item_id)::INT AS last_end FROM benchmark")
def rendered_queries(spark, d):
    rows = evidence.rendered(evidence.compile_queries(query_evidence(spark, d), "reference_answer", "completion_target"))
    return rows.select("query_id", F.size("offsets").alias("n_words"), F.size(F.filter("scored", lambda x: x)).alias("n_scored"), F.element_at("offsets", -1)["end"].alias("last_end"))


@register("positive_range", "SELECT min(c_acctbal) FILTER (WHERE c_acctbal > 0) AS lowest, max(c_acctbal) FILTER (WHERE c_acctbal > 0) AS highest FROM customer")
def positive_range(spark, d):
    return bins.positive_range(table(spark, d, "customer"), "c_acctbal")


@register("column_summary", "SELECT 'l_quantity' AS \"column\", min(l_quantity) AS lowest, max(l_quantity) AS highest, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std FROM lineitem UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax), round(avg(l_tax), 6), round(stddev_samp(l_tax), 6) FROM lineitem")
def column_summary(spark, d):
    return bins.column_summary(table(spark, d, "lineitem"), ["l_quantity", "l_tax"]).withColumns({"mean": r6("mean"), "std": r6("std")})


@register("robust_limit", "SELECT round(greatest(quantile_cont(abs(c_acctbal), 0.95), 1e-8), 6) AS \"limit\" FROM customer")
def robust_limit(spark, d):
    return bins.robust_limit(table(spark, d, "customer"), "c_acctbal").select(r6("limit").alias("limit"))


@register("single_query_statistics", f"WITH {S.SCORES} SELECT count(*) AS n, round(sum(score), 6) AS total, round(min(score), 6) AS lowest, round(max(score), 6) AS highest, round(avg(score), 6) AS mean FROM scores WHERE query_id = 7")
def single_query_statistics(spark, d):
    index, queries = vectors(spark, d)
    return bins.score_statistics(scoring.block_scores(index, queries.where("id = 7"))).select("n", *[r6(c).alias(c) for c in ("total", "lowest", "highest", "mean")])


@register("manifest_slice", "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'O') ORDER BY o_orderkey LIMIT 50 OFFSET 10")
def manifest_slice(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("condition"), F.col("o_orderstatus").alias("label"))
    return sampling.manifest_slice(rows, ["doc_id"], ["1-URGENT"], ["F", "O"], 10, 50).select("doc_id")


@register("key_differences", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'b,c' ELSE 'a,b,c' END AS keys FROM part")
def key_differences(spark, d):
    left, right = F.create_map(F.lit("a"), F.col("p_size") % 2, F.lit("b"), F.lit(1)), F.create_map(F.lit("a"), F.lit(0), F.lit("c"), F.lit(1))
    return table(spark, d, "part").select("p_partkey", F.concat_ws(",", queryset.key_differences(left, right)).alias("keys"))


@register("option_blocks", "SELECT p_partkey, p_size % 3 != 0 AS valid FROM part")
def option_blocks(spark, d):
    prompt = F.concat(F.lit("Q?\nA. "), "p_name", F.lit("\nB. "), "p_brand", F.when(F.col("p_size") % 3 == 0, "\nD. x").otherwise(""))
    choices = F.when(F.col("p_size") % 3 == 0, F.array("p_name", "p_brand", F.lit("x"))).otherwise(F.array("p_name", "p_brand"))
    return table(spark, d, "part").select("p_partkey", queryset.options_valid(prompt, choices).alias("valid"))


@register("factorial_selectivity", f"WITH {S.GAMMA}, s AS (SELECT event_type, target, coalesce(max(abs(gamma)) FILTER (WHERE eval_benchmark = target), 0) / avg(abs(gamma)) FILTER (WHERE eval_benchmark != target) AS x FROM gamma GROUP BY 1, 2) SELECT target, round(max(x) FILTER (WHERE event_type = arms[1]), 6) AS sel_a, round(max(x) FILTER (WHERE event_type = arms[2]), 6) AS sel_1, round(max(x) FILTER (WHERE event_type = arms[3]), 6) AS sel_c, round(max(x) FILTER (WHERE event_type = arms[4]), 6) AS sel_3, round(sel_a_ / sel_1_, 6) AS influence_effect, round(sel_a_ / sel_c_, 6) AS topic_effect FROM (SELECT *, max(x) FILTER (WHERE event_type = arms[1]) OVER (PARTITION BY target) AS sel_a_, max(x) FILTER (WHERE event_type = arms[2]) OVER (PARTITION BY target) AS sel_1_, max(x) FILTER (WHERE event_type = arms[3]) OVER (PARTITION BY target) AS sel_c_ FROM s, (SELECT list(DISTINCT event_type ORDER BY event_type) AS arms FROM gamma)) GROUP BY target, sel_a_, sel_1_, sel_c_")
def factorial_selectivity(spark, d):
    g = gamma(spark, d)
    arms = [r[0] for r in g.select("event_type").distinct().orderBy("event_type").collect()]  # a row an arm
    out = statistics.factorial(*[statistics.selectivity(g.where(F.col("event_type") == e), []) for e in arms[:4]])
    return out.select("target", *[r6(c).alias(c) for c in ("sel_a", "sel_1", "sel_c", "sel_3", "influence_effect", "topic_effect")])


@register("collateral", f"WITH {S.GAMMA}, best AS (SELECT target, topic FROM (SELECT target, topic, avg(gamma) AS g FROM gamma WHERE eval_benchmark = target GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY target ORDER BY g DESC, topic) = 1) SELECT target, topic, condition, round(max(gamma) FILTER (WHERE eval_benchmark = target), 6) AS on_target, round(avg(abs(gamma)) FILTER (WHERE eval_benchmark IN ('b0', 'b1') AND eval_benchmark != target), 6) AS primary_collateral, round(avg(abs(gamma)) FILTER (WHERE eval_benchmark IN ('b2', 'b3')), 6) AS other_collateral FROM gamma JOIN best USING (target, topic) GROUP BY 1, 2, 3")
def collateral(spark, d):
    g = gamma(spark, d)
    grid = g.where("eval_benchmark = target").groupBy(F.col("target").alias("benchmark"), "topic").agg(F.avg("gamma").alias("zscore")).withColumn("format", F.lit(""))
    out = statistics.collateral(g, statistics.best_topic(grid).select(F.col("benchmark").alias("target"), "topic"), ["b0", "b1"], ["b2", "b3"])
    return out.select("target", "topic", "condition", *[r6(c).alias(c) for c in ("on_target", "primary_collateral", "other_collateral")])


@register("bin_draws")
def bin_draws(spark, d):
    return bins.bin_draws(bins.score_bins(line_scores(spark, d), order_bins(spark, d)))


@register("synthetic_manifest")
def synthetic_manifest(spark, d):
    return sampling.synthetic_manifest(spark, 2000).groupBy("topic").agg(F.count("*").alias("n"))
