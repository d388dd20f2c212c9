"""Every query with SQL against DuckDB, and plans that are meant to hold at scale."""

import datetime
import decimal
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from tessella.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    b = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def explained(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def test_multi_key_scores_of_odd_rows_equal_sql(spark, tmp_path):
    made = [(k, [float((k * 7 + j * 3) % 11 - 5) / 3 for j in range(64)]) for k in (0, 1, 2, 50, 50, 99, 100)] + [(3, None), (150, None)]
    spark.createDataFrame(made, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["multi_key_scores"]).fetchall()
    got = catalog.queries()["multi_key_scores"](spark, str(tmp_path)).select("doc_id", "query_id", "score", "mean_score").collect()
    assert len(want) == 9 * 5 and sorted((tuple(map(plain, r)) for r in got), key=str) == sorted((tuple(map(plain, r)) for r in want), key=str)


def test_multi_key_scores_shuffle_no_pairs(spark, capsys):
    plan = explained(catalog.queries()["multi_key_scores"](spark, DATA), capsys)
    assert "Join" not in plan and plan.count("Exchange") == 2  # in the tree and in its details: documents alone, below the products
    assert plan.index("MapInArrow") < plan.index("Exchange")


def test_top_k_is_cut_before_the_shuffle(spark, capsys):
    assert explained(catalog.queries()["candidate_argmax_tie"](spark, DATA), capsys).count("Exchange") >= 1
    assert "WindowGroupLimit" in explained(catalog.queries()["stratified_sample"](spark, DATA), capsys)


def test_scans_read_only_their_columns(spark, capsys):
    plan = explained(catalog.queries()["semi_known"](spark, DATA), capsys)
    assert "PushedFilters: [IsNotNull(quality), EqualTo(quality,1)" in plan and "struct<doc_id:bigint>" in plan


def test_marginals_take_one_pass(spark, capsys):
    assert explained(catalog.queries()["marginals_grouping_sets"](spark, DATA), capsys).count("Scan parquet") <= 2


def test_bin_aggregate_has_no_forced_broadcast(spark, capsys):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in explained(catalog.queries()["bin_mean_abs_std"](spark, DATA), capsys)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pivot_and_modules_hold_the_whole_table(spark, tmp_path):
    from tessella.plans import catalog, tables

    spark.createDataFrame([("en", "src3"), ("en", "web"), ("fr", None)], "lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(60, [float(k) for k in range(70)])], "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = {r["topic"]: r.asDict() for r in catalog.queries()["pivot_topic_format"](spark, str(tmp_path)).collect()}
    assert rows["en"]["src3"] == rows["en"]["web"] == rows["fr"]["null"] == 1
    index, _ = tables.vectors(spark, str(tmp_path), keys=True)
    assert sorted(len(r["vec"]) for r in index.collect()) == [32, 38]


def odd_embeddings(spark, path, labels=True):
    """128 documents, eight of them queries: ids that come twice, no vectors, no labels."""
    made = [(k, [float((k * k * 7 + k * j * 3 + j) % 251 - 125) / 3 for j in range(64)], k % 10) for k in [*range(120), 50, 7, 100, 150]]
    made += [(121, None, 3), (200, None, 4), (122, [0.5] * 64, None), (250, [0.5] * 64, None)]
    spark.createDataFrame(made, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/embeddings.parquet/*.parquet'")
    return con


def odd_rows_equal_sql(spark, path, name):
    con = odd_embeddings(spark, path)
    found = con.execute(catalog.oracle_sql()[name])
    columns, want = [c[0] for c in found.description], found.fetchall()
    df = catalog.queries()[name](spark, str(path))
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(df.columns) == sorted(columns) and want
    assert sorted((tuple(map(plain, r)) for r in got), key=str) == sorted((tuple(map(plain, r)) for r in want), key=str)


def pairs_made(df):
    """Most rows that a part of the plan hands on, as Spark counted them when the query ran."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        rows = node.metrics().get("pythonNumRowsReceived")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return most


#: Queries on scores that hand on no row a pair: at most two rows a document, or so many a query.
NO_PAIRS = "wide_scores topic_marginals contrastive_bins correctness_diff bin_zscore score_bin_rank checked_topk score_stats zscore_zero_sigma dot_topk_global best_topic contrast_verdict".split()


@pytest.mark.parametrize("name", NO_PAIRS)
def test_query_on_scores_makes_no_pairs(spark, name):
    documents = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert pairs_made(catalog.queries()[name](spark, DATA)) <= 2 * documents


@pytest.mark.parametrize("name", [name for name in NO_PAIRS if name != "checked_topk"])
def test_query_on_scores_of_odd_rows_equals_sql(spark, tmp_path, name):
    odd_rows_equal_sql(spark, tmp_path, name)


@pytest.mark.parametrize("name", ["checked_topk"])
def test_equal_vectors_tie(spark, tmp_path, name):
    """Equal vectors have equal scores to the last bit, so they are ranked by their ids."""
    made = [(k, [math.sin((k if k % 50 == 0 else k % 3) * 64 + j) for j in range(64)]) for k in range(157)]
    spark.createDataFrame(made, "vec_id bigint, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    found = con.execute(catalog.oracle_sql()[name])
    columns, want = [c[0] for c in found.description], found.fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in catalog.queries()[name](spark, str(tmp_path)).collect()) == sorted(want)
