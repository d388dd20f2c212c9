"""Numeric functions as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Fixed values.
TOKENS_PER_WORD = 1.35
EPSILON = 1e-10
LOG2_E = 1.4426950408889634


def tokens_rounded(words: Column) -> Column:
    """int(words * 1.35 + 0.5), which is 1 at least from one word on; without words 0. ``words`` stands
    once, so that what it takes to count them is done once."""
    return F.greatest(F.lit(0), F.floor(words * F.lit(TOKENS_PER_WORD) + F.lit(0.5))).cast("bigint")


def tokens_ceiled(words: Column) -> Column:
    """ceil(words * 1.35), which is 2 at least from one word on; without words 0. Differs from
    `tokens_rounded` on purpose."""
    return F.greatest(F.lit(0), F.ceil(words * F.lit(TOKENS_PER_WORD))).cast("bigint")


def tokens_truncated(words: Column) -> Column:
    """int(words * 1.35), for sums of words."""
    return F.floor(words * F.lit(TOKENS_PER_WORD)).cast("bigint")


def tokens_approximate(text: Column, num_tokens: Column | None = None) -> Column:
    """A given count, else a token for each four characters or part of them; blank texts 0."""
    n = F.length(text)
    own = F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4))).cast("bigint")
    return own if num_tokens is None else F.coalesce(num_tokens, own)


def tokens_of_record(estimate: Column, words: Column, ratio: Column | float, approximate: Column) -> Column:
    """A stored estimate, else words times a ratio, else the approximation, else null."""
    ratio = F.lit(ratio) if isinstance(ratio, float) else ratio
    return F.coalesce(estimate.cast("bigint"), F.floor(words * ratio).cast("bigint"), approximate)


def log_share_ratio(a: Column, b: Column) -> Column:
    return F.log2((a + F.lit(EPSILON)) / (b + F.lit(EPSILON)))


def log10_floor(x: Column) -> Column:
    return F.log10(F.greatest(x, F.lit(1.0)))


def half_even(x: Column, digits: int) -> Column:
    """round() as Python has it."""
    return F.bround(x, digits)


def half_away(x: Column, digits: int) -> Column:
    """round() by doubles, as DuckDB has it: ties away from zero. Spark's own goes through a decimal for
    each value, which takes longer than most of what is rounded here."""
    scale = 10.0**digits
    y = x * scale
    nearest = F.rint(y)
    found = F.when(F.abs(y - nearest) == 0.5, y + F.signum(y) * 0.5).otherwise(nearest) / scale
    return F.when(F.abs(y) == float("inf"), x).otherwise(found)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def selectivity(on_target: Column, off_target_mean: Column) -> Column:
    """|on| / mean |off|: null without others, infinite where these are 0 and the target isn't."""
    on = F.abs(on_target)
    return F.when(off_target_mean > 0, on / off_target_mean).when((off_target_mean == 0) & (on > 0), F.lit(float("inf")))


def candidate_scores(logits: Column, chars: Column, tokens: Column, size: Column, unconditioned: Column | None = None) -> dict[str, Column]:
    """Scores of a candidate: as it is, by character, by token, in bits by byte, and beyond what it
    has without its context."""
    one = F.lit(1)
    out = {"raw": logits, "per_character": logits / F.greatest(chars, one), "per_token": logits / F.greatest(tokens, one), "per_byte": -logits * LOG2_E / F.greatest(size, one)}
    return out | ({"unconditioned": logits - unconditioned} if unconditioned is not None else {})


@F.pandas_udf(DoubleType())
def two_sided_normal(z: pd.Series) -> pd.Series:
    """erfc(|z| / sqrt 2); SQL has no erfc."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x else float("nan"), na_action="ignore")
