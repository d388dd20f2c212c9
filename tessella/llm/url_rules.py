"""URL filtering by listed rules and by association rules that FP-growth mines from labels.

Everything here is DataFrame and SQL functions and Spark's own FP-growth: no Python runs on a row.

A url's tokens are its host's labels, the words of its path and the keys of its query, each marked
with where it stands. Tokens that stand in the same labelled urls are one item, so that a long path that
urls share doesn't multiply combinations, and tokens of too few urls are left out. FP-growth finds
the combinations that are frequent among labelled urls together with the label "bad"; rules {tokens} -> bad,
of any length, are kept from a least support, confidence and lift on, and a rule that a shorter one
already covers is dropped. To match, each rule is indexed by
its rarest token: urls meet only rules whose rarest token they have, and then the whole combination
is compared.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize, salted_join, without

#: Least share of labelled urls that a combination and the label have; and how sure a rule is.
SUPPORT, CONFIDENCE, LIFT = 0.002, 0.7, 1.5
#: And how many urls that is at least.
URLS = 20
#: Mined rules that are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 100_000
BAD = "=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """The url's distinct tokens: ``h:`` host label, ``p:`` path word, ``q:`` query key."""
    words = F.split(F.translate(path(url), _UPPER, _LOWER), "[^a-z]+")
    keys = F.split(F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit("")), _UPPER, _LOWER), "&")
    keys = F.transform(keys, lambda x: F.regexp_extract(x, "^[a-z_-]+", 0))

    def marked(mark: str, found: Column) -> Column:
        return F.transform(F.filter(found, lambda w: F.length(w) > 0), lambda w: F.concat(F.lit(mark), w))

    return F.array_distinct(F.concat(marked("h:", F.split(host(url), r"\.")), marked("p:", words), marked("q:", keys)))


def listed(url_host: Column, url_path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule (text like ``net/``, verdict) that fits, or nulls. A
    rule fits its host and all subdomains, where the path begins with the rule's; of rules of the
    same length the first listed wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: -len(r[0]))[::-1]:
        cut = text.index("/")
        fits = ((url_host == text[:cut]) | url_host.endswith("." + text[:cut])) & url_path.startswith(text[cut:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """Rules (tokens, rarest, confidence, support) from ``labelled`` (url, bad boolean); rows with a
    null url or label don't count. Without labels there are no rules. Of tokens that stand in the same
    urls a rule names the smallest."""
    rows = labelled.where("url is not null and bad is not null").select(tokens(F.col("url")).alias("have"), "bad")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    schema = "tokens array<string>, rarest string, confidence double, support double"
    many = rows.count()
    if many < URLS:
        return labelled.sparkSession.createDataFrame([], schema)
    least = max(support, URLS / many)
    # Where a token stands, as a count and two sums of hashes of the rows.
    stands = [F.count("*").alias("n"), *[F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (0, 1)]]
    places = rows.select("row", F.explode("have").alias("t")).groupBy("t").agg(*stands).where(F.col("n") >= least * many)
    single = places.groupBy("n", "h0", "h1").agg(F.min("t").alias("t")).select("t", F.col("n").alias("freq"))  # 1 / least of a url's tokens at most
    held = rows.select("row", "bad", F.explode_outer("have").alias("t")).join(single.select("t", F.lit(True).alias("kept")), "t", "left")
    items = F.concat(F.collect_set(F.when(F.col("kept"), F.col("t"))), F.when(F.first("bad"), F.array(F.lit(BAD))).otherwise(F.expr("cast(array() as array<string>)")))
    baskets = materialize(held.groupBy("row").agg(items.alias("items")).select("items"))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence, numPartitions=labelled.sparkSession.sparkContext.defaultParallelism).fit(baskets)
    found = model.associationRules.where((F.element_at("consequent", 1) == BAD) & (F.col("lift") >= lift))
    found = found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    named = found.withColumn("t", F.explode("tokens")).join(single, "t").groupBy("tokens", "confidence", "support").agg(F.min_by("t", F.struct("freq", "t")).alias("rarest"))
    named = materialize(named.select("tokens", "rarest", "confidence", "support"))
    covered = named.alias("x").join(named.alias("y"), F.expr("array_contains(x.tokens, y.rarest) and size(y.tokens) < size(x.tokens) and size(array_except(y.tokens, x.tokens)) = 0"), "left_anti")
    return materialize(covered)


def judge(pages: DataFrame, rules: list[tuple[str, str]], mined: DataFrame) -> DataFrame:
    """``pages`` (url, further columns) with host, path, rule, verdict and mined (the tokens of the
    surest mined rule that fits, else null) in place of the url.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed.
    Where no listed rule fits, a url that a mined rule fits is blocked, any other is allowed. Rows
    that repeat are judged alike; an empty table gives no rows. The url of a row decides alone:
    further columns are kept, but give way to new ones of the same name.
    """
    kept = without(pages, "url", "host", "path", "rule", "verdict", "mined", "_listed", "_need", "_salt").columns
    kept = [f"`{c}`" for c in kept]
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    out = pages.select(*kept, "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    out = out.withColumns({"rule": rule, "_listed": verdict})
    many = mined.count()
    if many:
        index = mined.select(F.col("rarest").alias("t"), F.col("tokens").alias("need"), "confidence")
        open_urls = out.where("rule is null and url is not null").select("url", tokens(F.col("url")).alias("have")).distinct()
        hits = open_urls.withColumn("t", F.explode("have")).join(F.broadcast(index) if many <= BROADCAST_RULES else index, "t").where("size(array_except(need, have)) = 0")
        hits = hits.groupBy("url").agg(F.max(F.struct("confidence", "need")).alias("m")).select("url", F.col("m.need").alias("_need"))
        out = salted_join(out, materialize(hits), ["url"], "left")
    else:
        out = out.withColumn("_need", F.expr("cast(null as array<string>)"))
    return out.select(
        *kept,
        "host",
        "path",
        "rule",
        F.when(F.col("_listed").isNotNull(), F.col("_listed")).when(F.col("_need").isNotNull(), "block").otherwise("allow").alias("verdict"),
        F.when(F.col("_listed").isNull(), F.array_join("_need", " ")).alias("mined"),
    )
