"""Behaviour of single operators on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import taxonomy
from tessella.functions import numbers, text, web
from tessella.operators import bins, evidence, integrity, lexical, queryset, records, reports, sampling, scoring, statistics


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_word_count_is_that_of_str_split(spark):
    texts = ["", "  ", "a", " a  b\n", "a b", "x\x1cy", "a b　c", "\x85", "tab\tnew\x0bline", "é ñ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.word_count(F.col("t")).alias("n"), text.is_blank(F.col("t")).alias("b")).collect()
    assert {r["t"]: (r["n"], r["b"]) for r in rows} == {t: (len(t.split()), not t.strip()) for t in texts}
    assert one(spark, n=text.word_count(F.lit(None).cast("string")), b=text.is_blank(F.lit(None).cast("string"))) == (0, True)


def test_token_estimates_differ_by_design(spark):
    for w in (0, 1, 2, 3, 10, 379, 380, 1000):
        r = one(spark, a=numbers.tokens_rounded(F.lit(w)), b=numbers.tokens_ceiled(F.lit(w)), c=numbers.tokens_truncated(F.lit(w)))
        assert tuple(r) == ((max(1, int(w * 1.35 + 0.5)), max(1, math.ceil(w * 1.35)), int(w * 1.35)) if w else (0, 0, 0))
    assert records.min_token_words(512) == 379
    assert [one(spark, a=numbers.tokens_approximate(F.lit(t)))[0] for t in ("", "a", "abcd", "abcde")] == [0, 1, 1, 2]
    assert one(spark, a=numbers.tokens_of_record(F.lit(None), F.lit(10), 1.35, F.lit(3)))[0] == 13


def test_taxonomy(spark):
    assert len(taxonomy.TOPICS) == len(taxonomy.FORMATS) == 24 and taxonomy.dim_bin(spark).count() == 576
    assert one(spark, a=records.bin_id(F.lit("software"), F.lit("academic_writing")), b=records.bin_id(F.lit("adult_content"), F.lit("truncated")), c=records.bin_id(F.lit("x"), F.lit("faq"))) == (1, 576, None)
    assert one(spark, a=text.normalize_topic(F.lit("travel")), b=text.normalize_topic(F.lit("zz")), c=text.normalize_topic(F.lit(None).cast("string"))) == ("travel_and_tourism", "zz", None)
    assert one(spark, a=text.normalize_taxonomy_label(F.lit(" Electronics and hardare ")))[0] == "__label__electronics_and_hardware"
    assert one(spark, a=text.bin_label(F.lit("__label__art_and_design"), F.lit("q_a_forum")))[0] == "Art And Design / Q&A Forum"
    for bad in (F.lit(None).cast("string"), F.lit("  ")):
        with pytest.raises(Exception, match="taxonomy label"):
            one(spark, a=text.normalize_taxonomy_label(bad))
    with pytest.raises(Exception, match="unknown topic"):
        records.require_labels(spark.createDataFrame([("nope",)], "topic string"), "topic", taxonomy.TOPICS).collect()


def test_choice_keys(spark):
    assert one(spark, a=text.choice_key(F.lit(0), F.lit(2)), b=text.choice_key(F.lit(25), F.lit(26)), c=text.choice_key(F.lit(3), F.lit(77)), d=text.choice_key(F.lit(76), F.lit(77))) == ("A", "Z", "choice_03", "choice_76")
    with pytest.raises(Exception, match="two choices"):
        one(spark, a=text.choice_key(F.lit(0), F.lit(1)))


def test_reasoning_types(spark):
    asked = {
        "How would Others feel as a result?": "oReact", "How would Alex feel afterwards?": "xReact", "What will Kim want to do next?": "xWant", "Why did Sam do this?": "xIntent",
        "What does Jan need to do before this?": "xNeed", "How would you describe Lee?": "xAttr", "What will happen to Max?": "xEffect", "It rained. What will others want to do next?": "oWant", "Nothing here": None,
    }
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select("q", text.reasoning_type(F.col("q")).alias("t")).collect()
    assert {r["q"]: r["t"] for r in rows} == asked
    q = F.lit("How would Kim feel afterwards?")
    assert one(spark, a=text.reasoning_type(q, F.lit("alex"), F.lit("kim")), b=text.reasoning_type(q, F.lit("kim"), F.lit("kim")))[:] == ("oReact", "xReact")
    assert one(spark, a=text.first_known(F.lit("Yesterday, Alex met Kim. Sam left."), ["kim", "alex"]))[0] == "alex"


def test_urls_dates_paths(spark):
    u = F.lit("https://user@WWW.Example.org:80/x")
    assert one(spark, a=web.domain(u), b=web.domain(u, strip_www=True), c=web.domain(F.lit("not a url")), d=web.first_text(F.lit(""), F.lit(None), F.lit("b"))) == ("www.example.org", "example.org", None, "b")
    assert one(spark, a=web.year(F.lit("made 1899, 2019-2020")), b=web.year(F.lit("12019")), c=web.is_utc_timestamp(F.lit("2024-01-02T03:04:05Z")), d=web.is_utc_timestamp(F.lit("2024-01-02T03:04:05+00:00"))) == (2019, None, True, False)
    assert one(spark, a=web.source_family(F.lit("data/finemath-3/x")), b=web.source_family(F.lit("data/wiki/x")), c=web.source_family(F.lit("x")), d=web.record_id(F.lit('{"id": "a b", "text": ""}'))) == ("finemath", "wiki", "unknown", "a b")
    scores = F.expr("map('fr', 0.2D, 'en', 0.7D, 'de', 0.7D)")
    assert one(spark, a=web.language(F.lit(None).cast("string"), scores), b=web.language(F.lit("xx"), scores), c=web.language(F.lit(None).cast("string"), F.expr("cast(map() as map<string,double>)"))) == ("en", "xx", None)
    ids = spark.createDataFrame([("a",), ("b",)], "id string").select(web.blake_bucket(10)("id")).collect()
    assert all(0 <= r[0] < 10 for r in ids)


def test_bloom_files(tmp_path):
    bloom = integrity.BloomFile(500, 0.01)
    for k in range(500):
        bloom.add(f"k{k}")
    bloom.save(str(tmp_path / "b"))
    again = integrity.BloomFile.load(str(tmp_path / "b"))
    assert all(f"k{k}" in again for k in range(500)) and sum(f"n{k}" in again for k in range(2000)) < 60


def score_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, query_id int, score double")


def test_bins_count_misses_and_follow_the_mean(spark):
    scores = score_frame(spark, [("u0", 0, 1.0), ("u0", 1, 3.0), ("orphan", 0, 7.0)])
    where = spark.createDataFrame([("u0", "t", "f")], "doc_id string, topic string, format string")
    r = bins.score_bins(scores, where).first()
    assert (r["mean_score"], r["abs_mean_score"], r["std_score"], r["doc_count"]) == (2.0, 2.0, 0.0, 1)
    assert tuple(bins.match_counts(bins.document_means(scores), where).first()) == (2, 1)
    split = bins.split_bins(score_frame(spark, [("u0", 0, 1.0), ("u0", 1, 2.0)]), spark.createDataFrame([(0, True), (1, None)], "query_id int, is_correct boolean"), where)
    assert {r["is_correct"]: r["mean_score"] for r in split.collect()} == {True: 1.0, False: 2.0}


def test_bin_sums_merge_in_any_order(spark):
    rng = np.random.default_rng(0)
    rows = [(f"d{k}", int(q), float(rng.normal())) for k in range(40) for q in range(3)]
    where = spark.createDataFrame([(f"d{k}", f"t{k % 3}", "f") for k in range(40)], "doc_id string, topic string, format string")
    a, b = (sorted((r["topic"], round(r["mean_score"], 9), round(r["std_score"], 9)) for r in bins.score_bins(score_frame(spark, x), where).collect()) for x in (rows, rows[::-1]))
    assert a == b


def test_z_scores_without_spread(spark):
    grid = spark.createDataFrame([("t", "f", 1.0), ("t", "g", 1.0), ("t", "h", None), ("t", "i", math.nan)], "topic string, format string, mean_score double")
    assert [r["zscore"] for r in bins.z_scores(grid).collect()] == [None, None]
    assert [r["zscore"] for r in bins.z_scores(grid, zero_sigma="zero").collect()] == [0.0, 0.0]


def test_concentration_of_even_and_single_bins(spark):
    even = spark.createDataFrame([(10, 100)] * 20, "doc_count int, token_count int")
    r = bins.concentration(even).first()
    assert r["gini_token"] == pytest.approx(0) and r["effective_bins_token"] == pytest.approx(20) and r["top_10_share"] == pytest.approx(0.5) and r["top_50_share"] == 1
    assert bins.gini(spark.createDataFrame([(0,), (0,)], "x int"), "x").first()[0] == 0
    with pytest.raises(Exception, match="total is 0"):
        g = spark.createDataFrame([("t", "f", 0)], "topic string, format string, v int")
        bins.share_ratio(g, g, "v").collect()


def test_scores_need_the_same_width(spark):
    index = spark.createDataFrame([(0, "k", [1.0, 0.0]), (1, "k", [0.0, 1.0]), (1, "only", [1.0])], "id int, grad_key string, vec array<double>")
    queries = spark.createDataFrame([(0, "k", [1.0, 0.0]), (1, "k", [0.2, 0.8])], "id int, grad_key string, vec array<double>")
    best = scoring.top_k(scoring.pair_scores(index, queries), 1)
    assert {r["query_id"]: r["doc_id"] for r in best.collect()} == {0: 0, 1: 1} and [r[0] for r in scoring.common_keys(index, queries).collect()] == ["k"]
    with pytest.raises(Exception, match="widths differ"):
        scoring.pair_scores(index, queries.withColumn("vec", F.array(F.lit(1.0)))).collect()
    with pytest.raises(Exception, match="not finite"):
        scoring.require_finite(score_frame(spark, [("a", 0, math.inf)])).collect()


def test_block_scores_equal_pair_scores(spark, monkeypatch):
    rng = np.random.default_rng(1)
    frame = lambda n: spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(n)], "id bigint, vec array<double>")
    index, queries = frame(50), frame(7)
    index.cache(), queries.cache()
    want = {(r["doc_id"], r["query_id"]): r["score"] for r in scoring.pair_scores(index.withColumn("grad_key", F.lit("k")), queries.withColumn("grad_key", F.lit("k"))).collect()}
    for size in (1 << 20, 100):
        monkeypatch.setattr(scoring, "QUERY_BYTES", size)
        got = {(r["doc_id"], r["query_id"]): r["score"] for r in scoring.block_scores(index, queries).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        top = scoring.top_k(scoring.block_scores(index, queries, k=3), 3)
        assert {(r["query_id"], r["doc_id"], r["rank"]) for r in top.collect()} == {(r["query_id"], r["doc_id"], r["rank"]) for r in scoring.top_k(scoring.block_scores(index, queries), 3).collect()}


def test_key_scores_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    width = {"a": 3, "b": 5, "c": 2}
    sides = [{(f"{x}{n}", k): rng.normal(size=width[k]).tolist() for n in range(size) for k in keys if rng.random() < 0.7} for x, size, keys in (("d", 60, "ab"), ("q", 9, "abc"))]
    sides[0]["d0", "a"], sides[0]["d1", "b"], sides[1]["q0", "b"] = None, [1.0, None, 0.0, 0.0, 0.0], [math.inf] * 5
    index, queries = (spark.createDataFrame([(i, k, v) for (i, k), v in side.items()], "id string, grad_key string, vec array<double>").cache() for side in sides)
    want = {}
    for (d, k), a in sides[0].items():
        for (q, other), b in sides[1].items():
            if k == other:
                want.setdefault((d, q), []).append(None if a is None or None in a else float(np.sum(np.multiply(a, b))))
    for size, batch in ((1 << 20, 1 << 18), (300, 20)):
        monkeypatch.setattr(scoring, "QUERY_BYTES", size), monkeypatch.setattr(scoring, "BATCH_SCORES", batch)
        found = scoring.key_scores(scoring.module_rows(index), scoring.module_rows(queries)).collect()
        got = {(r["doc_id"], r["query_id"]): (r["score"], r["n_keys"]) for r in found}
        means = {(r["doc_id"], r["query_id"]): r["score"] for r in scoring.pair_scores(index, queries, mean=True).collect()}
        assert len(found) == len(want) and got.keys() == want.keys() == means.keys()
        for pair, parts in want.items():
            total = None if None in parts else sum(parts)
            assert got[pair][1] == len(parts) and got[pair][0] == (None if total is None else pytest.approx(total, nan_ok=True))
            assert means[pair] == (None if total is None else pytest.approx(total / len(parts), nan_ok=True))
    assert scoring.pair_scores(index, queries.where("false")).count() == scoring.pair_scores(index.where("false"), queries).count() == 0


def test_half_away_rounds_as_sql_does(spark):
    duckdb = pytest.importorskip("duckdb")
    values = [0.5e-6, -0.5e-6, 1.5e-6, 2.5e-6, -2.5e-6, 0.4999999e-6, -1e-9, 0.0, 0.1234565, 123456789.1234565, 4503599627.3704965, 1e300, 1.7e308, -math.inf, math.nan, None]
    got = [r[0] for r in spark.createDataFrame(enumerate(values), "k int, x double").orderBy("k").select(numbers.half_away(F.col("x"), 6)).collect()]
    assert list(map(repr, got)) == [repr(duckdb.connect().execute("SELECT round(?::DOUBLE, 6)", [x]).fetchall()[0][0]) for x in values]


def test_top_k_breaks_ties_by_id(spark):
    got = scoring.top_k(score_frame(spark, [("b", 0, 1.0), ("a", 0, 1.0), ("c", 0, 2.0), ("d", 0, 0.0)]), 3).orderBy("rank")
    assert [r["doc_id"] for r in got.collect()] == ["c", "a", "b"]


def test_budget_and_prefix(spark):
    rows = spark.createDataFrame([(k, 10) for k in range(10)], "doc_id int, token_count int")
    assert sampling.budget(rows, ["doc_id"], "token_count", 35).count() == 4
    keyed = rows.withColumn("g", F.lit(1)).withColumn("_key", sampling.draw_key(F.col("doc_id"), 1))
    sums = sorted(r["s"] for r in sampling.prefix(keyed, ["g"], ["_key", "doc_id"], "token_count", "s").collect())
    assert sums == [10 * k for k in range(1, 11)]


def test_samples_are_disjoint_and_repeat(spark):
    rows = spark.createDataFrame([(k, f"t{k % 4}", f"f{k % 3}", 100, "text" if k % 5 else " ") for k in range(200)], "doc_id int, topic string, format string, token_count int, text string")
    a = sampling.stratified(rows, 5, 1)
    assert a.count() == 60 and {r["doc_id"] for r in a.collect()} == {r["doc_id"] for r in sampling.stratified(rows.repartition(5), 5, 1).collect()}
    assert sampling.stratified(rows, 5, 10**9).count() == 120
    rest = sampling.representative(rows, a, 3000)
    assert not {r["doc_id"] for r in a.collect()} & {r["doc_id"] for r in rest.collect()} and rest.agg(F.sum("token_count")).first()[0] <= 3000
    f = sampling.forget(rows, ["t0", "t1"], 20, 1)
    assert f.where("topic not in ('t0', 't1') or trim(text) = ''").count() == 0
    assert sampling.retain(rows, ["t0"], 2, 1, f).join(f, "doc_id").count() == 0
    split = sampling.null_split(rows, 10, 15, 3).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"forget": 10, "retain": 15}
    assert {r["doc_id"] for r in sampling.resampled(rows, ["t0"], 2, 1, 1).collect()} != {r["doc_id"] for r in sampling.resampled(rows, ["t0"], 2, 1, 2).collect()}


@pytest.mark.parametrize("n,shards", [(10, 3), (2, 10), (0, 4), (500, 7)])
def test_round_robin(spark, n, shards):
    rows = sampling.round_robin(spark.range(n), ["id"], shards).collect()
    assert {r["id"]: r["shard"] for r in rows} == {k: k % shards for k in range(n)}


def test_greedy_stratified_follows_the_order(spark):
    rows = spark.createDataFrame([(k, "a" if k < 30 else "b", 5) for k in range(60)], "doc_id int, topic string, token_count int")
    got = [r["topic"] for r in sampling.greedy_stratified(rows, ["doc_id"], ["topic"], 20).collect()]
    assert got.count("a") == 20 and got.count("b") == 0
    mixed = rows.withColumn("doc_id", (F.col("doc_id") * 7) % 60)
    taken = sampling.greedy_stratified(mixed, ["doc_id"], ["topic"], 20, token_limit=50).count()
    assert taken == 10


def test_statistics_against_known_values():
    d = np.array([1.83, 0.50, 1.62, 2.48, 1.68, 1.88, 1.55, 3.06, 1.30]) - np.array([0.878, 0.647, 0.598, 2.05, 1.06, 1.29, 1.06, 3.14, 1.29])
    assert statistics.wilcoxon(d) == (40.0, pytest.approx(0.01953125))
    assert statistics.t_greater(2.0, 10) == pytest.approx(0.0366940174) and statistics.t_greater(-2.0, 10) == pytest.approx(1 - 0.0366940174) and statistics.t_greater(0.0, 5) == pytest.approx(0.5)
    assert statistics.t_greater(12.0, 3) == pytest.approx(0.000622, rel=2e-2)
    assert all(math.isnan(x) for x in statistics.wilcoxon(np.zeros(4)))
    low, high = statistics.bootstrap_median(np.arange(100.0))
    assert 35 < low < 49.5 < high < 65


def test_bh_and_dz(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double")
    assert {r["k"]: r["p_bh"] for r in statistics.bh_adjust(p).collect()} == {"a": pytest.approx(0.03), "b": pytest.approx(0.04), "c": pytest.approx(0.04), "d": None}
    cells = spark.createDataFrame([("x", "t", 1, 1.0), ("x", "u", 1, 3.0), ("y", "t", 1, 2.0)], "target string, topic string, seed int, d double")
    got = {r["target"]: r for r in statistics.describe(cells).collect()}
    assert got["x"]["cohens_dz"] == pytest.approx(2 / math.sqrt(2)) and got["y"]["cohens_dz"] is None
    assert one(spark, a=numbers.two_sided_normal(F.lit(1.96)))[0] == pytest.approx(0.05, abs=1e-4)


def test_selectivity_rules(spark):
    rows = spark.createDataFrame([("k", "b1", "b1", 4.0), ("k", "b1", "b2", -2.0), ("l", "b1", "b1", 4.0), ("l", "b1", "b2", 0.0), ("m", "b1", "b2", 0.0), ("n", "b1", "b1", 1.0)], "topic string, target string, eval_benchmark string, gamma double")
    assert {r["topic"]: r["selectivity"] for r in statistics.selectivity(rows, ["topic"]).collect()} == {"k": 2.0, "l": math.inf, "m": None, "n": None}


def test_candidates(spark):
    c = spark.createDataFrame([("q", 0, 1.0), ("q", 1, 2.0), ("q", 2, 2.0)], "query_id string, index int, score double")
    r = queryset.select_candidate(c, "score").first()
    assert (r["index"], r["n_tied"]) == (1, 2) and queryset.select_candidate(c, "score", lowest=True).first()["index"] == 0
    with pytest.raises(Exception, match="tie"):
        queryset.select_candidate(c, "score", on_tie="reject").collect()


def test_answers_and_lookup(spark):
    keys, choices = F.array(*[F.lit(x) for x in "ABC"]), F.array(F.lit("Red."), F.lit("blue  sky"), F.lit("green"))
    asked = {"B": 1, "(c)": 2, "blue sky.": 1, "The answer is: red": 0, "the answer is B": 1, "purple": None}
    rows = spark.createDataFrame([(a,) for a in asked], "a string").select("a", queryset.parse_answer(F.col("a"), keys, choices).alias("i")).collect()
    assert {r["a"]: r["i"] for r in rows} == asked
    head, tail = text.split_last(F.lit("a__b__c"))
    none, _ = text.split_last(F.lit("abc"))
    assert one(spark, a=head, b=tail, c=none, d=text.escape_component(F.lit("a:b%c"))) == ("a__b", "c", None, "a%3Ab%25c")


def test_rosters(spark):
    a, b = (spark.createDataFrame([(x,) for x in rows], "id int") for rows in ([1, 1, 2, 3], [1, 2, 4]))
    assert sorted(map(tuple, queryset.roster_difference(a, b).collect())) == [(1, "left"), (3, "left"), (4, "right")]
    assert {r["id"]: r["state"] for r in queryset.coverage(a, b, "id").collect()} == {1: "duplicate", 3: "missing", 4: "extra"}
    turns = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2)], "conv string, turn int")
    assert {r["conv"]: r["contiguous"] for r in queryset.contiguous(turns, ["conv"], "turn").collect()} == {"a": True, "b": False}


def test_multiple_choice(spark):
    row = spark.createDataFrame([("q", "Ann fell.", "Why did Ann cry?", "x", "y", "z", "2")], "query_id string, context string, question string, answerA string, answerB string, answerC string, label string")
    r = queryset.multiple_choice(row).first()
    assert r["prompt"] == "Ann fell.\nQuestion: Why did Ann cry?\nA. x\nB. y\nC. z\nAnswer:" and r["label_index"] == 1 and r["completion"] == " B"


def test_strict_json_and_digests(spark, tmp_path):
    assert integrity.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'.encode()
    for bad in ('{"a":1,"a":2}', '{"a":NaN}'):
        with pytest.raises(ValueError):
            integrity.strict_json(bad)
    with pytest.raises(ValueError):
        integrity.canonical_json(math.nan)
    with pytest.raises(Exception, match="repeated key"):
        integrity.strict_lines(spark.createDataFrame([('{"a":1,"a":2}',)], "value string")).collect()
    path = str(tmp_path / "a.json")
    sha = integrity.write_once(path, {"x": 1})
    assert integrity.load_verified(path, sha) == {"x": 1}
    with pytest.raises(FileExistsError):
        integrity.write_once(path, {"x": 2})
    with pytest.raises(ValueError):
        integrity.load_verified(path, "0" * 64)
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(100)], "id int, v string")
    assert integrity.ordered_digest(rows, ["id"], "v").first() == integrity.ordered_digest(rows.orderBy(F.desc("id")), ["id"], "v").first()
    assert integrity.multiset_digest(rows, ["id", "v"]).first() == integrity.multiset_digest(rows.repartition(3), ["id", "v"]).first()
    assert integrity.ordered_digest(rows, ["id"], "v").first()[1] != integrity.ordered_digest(rows.withColumn("v", F.when(F.col("id") == 7, "w").otherwise(F.col("v"))), ["id"], "v").first()[1]


def test_cleaning(spark):
    rows = spark.createDataFrame([("a", None), ("b", "  "), ("c", "one two"), ("d", "one two three four")], "id string, text string")
    assert {r["reason"]: r["n"] for r in records.drop_counts(rows, 3).collect()} == {"blank": 2, "short_words": 1, "kept": 1}
    assert [r["id"] for r in records.clean(rows, 3).collect()] == ["d"]
    lines = spark.createDataFrame([('{"id":"a","text":"t","x":1}',), ("not json",)], "value string")
    assert [r[0] for r in records.strip_fields(lines).collect()] == ['{"id":"a","text":"t"}', "not json"]
    first = records.keep_first(spark.createDataFrame([(2, "x"), (1, "x"), (3, "y")], "i int, k string"), ["k"], [F.col("i")])
    assert sorted(r["i"] for r in first.collect()) == [1, 3]


def test_lexical(spark):
    r = one(spark, **lexical.punctuation(F.lit("a.b,c?d!e'f;g-")))
    assert r.asDict() == {"all_punctuation": 7, "period": 1, "comma": 1, "question": 1, "exclamation": 1, "apostrophe": 1, "other_punctuation": 2}
    features = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert sorted(r["composite"] for r in lexical.composite(features, ["a", "b"]).collect()) == [pytest.approx(-math.sqrt(0.5) / 2), pytest.approx(math.sqrt(0.5) / 2)]
    assert sorted(f for fs in lexical.GROUPS.values() for f in fs) == sorted(taxonomy.FORMATS)


def test_reports(spark):
    frame = spark.createDataFrame([("a_b & c", 1234567, 0.5)], "bin string, n bigint, x double")
    assert "a\\_b \\& c & 1,234,567 & 0.5000" in reports.latex_table(frame, ["bin", "n", "x"]) and "| a_b & c | 1,234,567 | 0.5000 |" in reports.markdown_table(frame, ["bin", "n", "x"])
    assert reports.humanize(5_678_621) == "5.7M" and reports.ticks(1, 60, log=True) == [1, 2, 5, 10, 20, 50]


def test_evidence_rules(spark):
    from tessella.operators import evidence

    rows = spark.createDataFrame([("q", 0, " ab", -2.0, 1, -1.0), ("q", 1, " é", -2.0, 2, None)], "query_id string, index int, continuation string, sum_logits double, num_tokens int, sum_logits_uncond double")
    got = {r["index"]: r for r in evidence.scored_candidates(rows).collect()}
    assert got[0]["per_character"] == pytest.approx(-2 / 3) and got[1]["per_byte"] == pytest.approx(2 / 3 * 1.4426950408889634) and got[0]["unconditioned"] == -1 and got[1]["unconditioned"] is None
    assert evidence.incomplete_unconditioned(rows).count() == 1
    wins = {r["rule"]: r["winners"] for r in evidence.winning_sets(evidence.scored_candidates(rows)).collect()}
    assert wins["raw"] == [0, 1] and wins["per_token"] == [1] and wins["per_byte"] == [0, 1][:2] or wins["per_byte"] == [0]
    asked = spark.createDataFrame([("q", "bbq", "bbq", "One two", " three", True, None)], "query_id string, probe string, task string, prompt string, completion string, is_correct boolean, reference string")
    for condition, objective in (("prompt_only", "joint_sequence"), ("nothing", "completion_target")):
        with pytest.raises(ValueError):
            evidence.compile_queries(asked, condition, objective)
    with pytest.raises(Exception, match="no reference"):
        evidence.compile_queries(asked, "reference_answer", "completion_target").collect()
    out = evidence.rendered(evidence.compile_queries(asked, "model_completion", "completion_target"))
    r = out.first()
    assert [(x["start"], x["end"]) for x in r["offsets"]] == [(0, 3), (4, 7), (8, 13)] and r["scored"] == [False, False, True] and evidence.spans_contiguous(out).count() == 0
    names = ["queries_arc_challenge.jsonl", "mmlu.jsonl", "mmlu_x.jsonl.zst"]
    assert evidence.resolve_query_file("mmlu", names, {}) == "mmlu.jsonl" and evidence.resolve_query_file("arc_challenge", names, {}) == names[0] and evidence.resolve_query_file("mmlu", names, {"mmlu_x.jsonl.zst": "mmlu"}) == "mmlu_x.jsonl.zst"


def test_small_reports(spark):
    grid = spark.createDataFrame([("t", "f", 0.5, 0.0, 3), ("t", "g", -1.0, 0.0, 500)], "topic string, format string, mean_score double, std_score double, doc_count int")
    assert sorted((r["format"], r["value"]) for r in bins.bin_draws(grid, most=4).collect()) == [("f", 0.5)] * 3 + [("g", -1.0)] * 4
    assert bins.robust_limit(grid, "std_score").first()[0] == 1e-8 and tuple(bins.positive_range(grid, "mean_score").first()) == (0.5, 0.5)
    with pytest.raises(ValueError, match="no rows"):
        sampling.manifest_slice(grid.withColumn("label", F.col("format")), ["topic"], labels=["f", "zz"])
    assert sampling.synthetic_manifest(spark, 50).where("token_count < 1").count() == 0


def test_numbers_and_sums_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(sampling, "RANGE_ROWS", 40)
    rows = [(k * 37 % 1009, k % 11) for k in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, tokens bigint")
    want, total = [], 0
    for i, (d, n) in enumerate(sorted(rows)):
        total += n
        want.append((d, n, i, total))
    assert sorted(map(tuple, sampling.numbered(frame, ["doc_id"], "tokens").collect())) == want
    kept = sampling.budget(frame, ["doc_id"], "tokens", 500)
    assert sorted(map(tuple, kept.collect())) == [(d, n) for d, n, _, s in want if s - n < 500]
    assert sampling.budget(frame.limit(0), ["doc_id"], "tokens", 500).count() == 0
    pairs = sampling.paired(frame.where("doc_id % 2 = 0"), frame.where("doc_id % 2 = 1"))
    even, odd = ([d for d, *_ in want if d % 2 == k] for k in (0, 1))
    assert sorted(map(tuple, pairs.collect())) == [(i, d, odd[i % len(odd)]) for i, d in enumerate(even)]


def test_roster_coverage_names_missing_and_extra_rows(spark):
    wanted, there = (spark.createDataFrame([(k,) for k in ks], "doc_id bigint") for ks in ((1, 2, 3), (2, 3, 4)))
    assert sorted(map(tuple, queryset.coverage(wanted, there, "doc_id").select("doc_id", "state").collect())) == [(1, "missing"), (4, "extra")]
    assert bins.match_counts(wanted, there.selectExpr("doc_id", "'a' as topic", "'b' as format")).first().asDict() == {"n_docs": 3, "n_missed": 1}


def test_bootstrap_in_strips(monkeypatch):
    d = np.random.default_rng(0).normal(1, 1, 400)
    whole = statistics.bootstrap_median(d)
    monkeypatch.setattr(statistics, "STRIP", 1000)
    low, high = statistics.bootstrap_median(d)
    assert low < np.median(d) < high and abs(low - whole[0]) < 0.05 and abs(high - whole[1]) < 0.05


def test_rendering_with_a_tokenizer(spark):
    tokenizers, paths = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = paths.path("byte_bpe_50k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    rows = [("a", "Q: été?", " Yes, it is", "completion"), ("b", "just this", None, "prompt_next_token"), ("c", "x", " y z", "joint_sequence")]
    found = evidence.rendered(spark.createDataFrame(rows, "query_id string, prompt string, target string, objective string"), path)
    for r in found.collect():
        e = plain.encode(r["prompt"] + (r["target"] or ""), add_special_tokens=False)
        assert [(x["id"], x["start"], x["end"]) for x in r["offsets"]] == [(i, *o) for i, o in zip(e.ids, e.offsets)]
        scored = {"a": [b > len(r["prompt"]) for _, b in e.offsets], "b": [False] * (len(e.ids) - 1) + [True], "c": [True] * len(e.ids)}[r["query_id"]]
        assert r["scored"] == scored


def test_keys_are_selected_or_fail(spark):
    index, queries, other = (spark.createDataFrame([(1, k, [1.0]) for k in ks], "id bigint, grad_key string, vec array<double>") for ks in (["b", "a", "c"], ["a", "b"], ["z"]))
    assert scoring.select_keys(index, queries) == ["a", "b"] and scoring.select_keys(index, queries, "b") == ["b"]
    for bad in (lambda: scoring.select_keys(index, queries, "c"), lambda: scoring.select_keys(queries, index, "c")):
        with pytest.raises(KeyError):
            bad()
    with pytest.raises(ValueError):
        scoring.select_keys(index, other)


@pytest.mark.parametrize("rows,k", [([(1, 1, 0.5), (1, 1, 0.6)], None), ([(1, 1, math.nan)], None), ([(1, 1, math.inf)], None), ([(1, 1, None)], None), ([(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.5)], None), ([(1, 1, 0.5)], 2)])
def test_scores_that_are_not_fit_for_top_k_fail(spark, rows, k):
    with pytest.raises(ValueError):
        scoring.checked(spark.createDataFrame(rows, "query_id bigint, doc_id bigint, score double"), k)


def test_scores_fit_for_top_k_pass(spark):
    rows = [(q, d, float(q - d)) for q in range(3) for d in range(4)]
    assert scoring.checked(spark.createDataFrame(rows, "query_id bigint, doc_id bigint, score double"), 4).count() == 12
    assert scoring.checked(spark.createDataFrame([], "query_id bigint, doc_id bigint, score double")).count() == 0


def test_positions_in_shards_laid_end_to_end(spark):
    shards = spark.createDataFrame([("a", 2), ("b", 0), ("c", 3)], "shard string, n bigint")
    found = scoring.locate(spark.createDataFrame([(k,) for k in range(6)], "position bigint"), shards)
    assert sorted(map(tuple, found.collect())) == [(0, "a", 0), (1, "a", 1), (2, "c", 0), (3, "c", 1), (4, "c", 2)]
