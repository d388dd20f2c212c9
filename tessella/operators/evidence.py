"""Query evidence: probe contracts, candidate scores, stored metrics, compiled and rendered queries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import numbers

# Tasks and rows of each probe; how its reference is found; conditions and objectives.
TASKS = {
    "bbh_causal_judgement": {"bbh_causal_judgement": 187},
    "bbh_disambiguation_qa": {"bbh_disambiguation_qa": 250},
    "bbq": {"bbq": 58492},
    "ethics": {"ethics_commonsense": 3885, "ethics_deontology": 3596, "ethics_justice": 2704, "ethics_utilitarianism": 4807, "ethics_virtue": 4975},
    "mmlu_moral": {"mmlu_moral_scenarios": 895, "mmlu_moral_disputes": 346, "mmlu_philosophy": 311, "mmlu_business_ethics": 100},
    "negotiationtom": {"negotiationtom_desire": 14280, "negotiationtom_belief": 14280},
    "pub": {"pub_1": 2500, "pub_2": 2506, "pub_3": 2506, "pub_4": 2000, "pub_5": 2000, "pub_6": 2000, "pub_7": 1770, "pub_8": 1770, "pub_9": 1770, "pub_10": 2100, "pub_11": 1800, "pub_12": 2563, "pub_13": 1000, "pub_14": 457},
    "simpletom": {"simpletom_mental-state-qa": 1147, "simpletom_behavior-qa": 1147, "simpletom_judgment-qa": 1147},
    "tombench": {"tombench": 2860},
    "morables": {"morables": 709},
    "moralexceptqa_rbqa": {"moralexceptqa_rbqa": 148},
}
PARSED_PROBES = ("bbh_causal_judgement", "bbh_disambiguation_qa", "tombench")
ORDERED_TASKS = ("ethics_utilitarianism",)
CONSENSUS_PROBES = ("moralexceptqa_rbqa",)
REJECT_TIES = ("simpletom",)
OBJECTIVES = {"model_completion": ("completion_target", "joint_sequence"), "reference_answer": ("completion_target", "joint_sequence"), "prompt_only": ("prompt_next_token",)}
PRIMARY_RULE = "per_character"
RULES = ("raw", "per_character", "per_token", "per_byte", "unconditioned")


def probe_contracts(spark: SparkSession) -> DataFrame:
    """One row a task: probe, task, expected rows, reference policy and tie policy."""
    def policy(probe: str, task: str) -> str:
        return "ordering" if task in ORDERED_TASKS else "parsed" if probe in PARSED_PROBES else "consensus" if probe in CONSENSUS_PROBES else "explicit"

    rows = [(p, t, n, policy(p, t), "reject" if p in REJECT_TIES else "lowest_index") for p, tasks in TASKS.items() for t, n in tasks.items()]
    return spark.createDataFrame(rows, "probe string, task string, n_expected bigint, policy string, on_tie string")


def scored_candidates(rows: DataFrame) -> DataFrame:
    """Candidates (query_id, index, continuation, sum_logits, num_tokens, sum_logits_uncond) with their
    scores, a column a rule. Unconditioned scores are there for all candidates of a query or none."""
    s = numbers.candidate_scores(F.col("sum_logits"), F.length("continuation"), F.col("num_tokens"), F.octet_length("continuation"), F.col("sum_logits_uncond"))
    return rows.select(*rows.columns, *[s[r].alias(r) for r in RULES])


def incomplete_unconditioned(rows: DataFrame) -> DataFrame:
    n = F.count("sum_logits_uncond")
    return rows.groupBy("query_id").agg(n.alias("n_scored"), F.count("*").alias("n")).where("n_scored != 0 and n_scored != n")


def winning_sets(candidates: DataFrame) -> DataFrame:
    """(query_id, rule, winners): the indexes that reach the best score of each rule; the lowest is
    best for bits by byte. One pass: a candidate becomes a row a rule."""
    each = candidates.select("query_id", "index", F.explode(F.create_map(*[x for r in RULES for x in (F.lit(r), F.when(F.lit(r == "per_byte"), -F.col(r)).otherwise(F.col(r)))])).alias("rule", "value")).where("value is not null")
    best = each.groupBy("query_id", "rule").agg(F.max("value").alias("value"))
    return each.join(best, ["query_id", "rule", "value"]).groupBy("query_id", "rule").agg(F.sort_array(F.collect_list("index")).alias("winners"))


def metric_conflicts(stored: DataFrame, winners: DataFrame) -> DataFrame:
    """Stored predictions (query_id, rule, predicted, accuracy, gold_index) that aren't among the
    winners, or whose accuracy isn't that of the prediction."""
    joined = stored.join(winners, ["query_id", "rule"], "left")
    state = F.when(F.col("winners").isNull(), "no_evidence").when(~F.array_contains("winners", F.col("predicted")), "not_a_winner").when(F.col("accuracy") != F.when(F.col("predicted") == F.col("gold_index"), 1.0).otherwise(0.0), "accuracy_differs")
    return joined.withColumn("state", state).where("state is not null").drop("winners")


def reconstruction_conflicts(recorded: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Requests (native_id, doc_id, idx, context, continuation) that one side lacks or whose texts differ."""
    keys = ["native_id", "doc_id", "idx"]
    a = recorded.select(*keys, F.struct("context", "continuation").alias("a"))
    b = rebuilt.select(*keys, F.struct("context", "continuation").alias("b"))
    state = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "differs")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state")).where("state is not null")


def compile_queries(evidence: DataFrame, condition: str, objective: str, rule: str = PRIMARY_RULE) -> DataFrame:
    """Compiled queries of evidence (query_id, probe, task, prompt, completion, is_correct, reference):
    the target that the condition asks for, its source and the study role."""
    if objective not in OBJECTIVES.get(condition, ()):
        raise ValueError(f"no {objective} under {condition}")
    if condition != "model_completion" and rule != PRIMARY_RULE:
        raise ValueError("only model completions take another selection rule")
    if objective == "joint_sequence" and rule != PRIMARY_RULE:
        raise ValueError("a joint sequence takes one sensitivity axis")
    null = F.lit(None).cast("string")
    target = {"model_completion": F.col("completion"), "reference_answer": F.when(F.col("reference").isNotNull(), F.col("reference")).otherwise(F.raise_error(F.lit("a query has no reference"))), "prompt_only": null}[condition]
    source = {"model_completion": F.lit("base_completion"), "reference_answer": F.lit("benchmark_reference"), "prompt_only": null}[condition]
    role = "sensitivity" if objective == "joint_sequence" or rule != PRIMARY_RULE else "primary"
    return evidence.select(
        "query_id", "probe", "task", "prompt", target.alias("target"), source.alias("target_source"), F.lit(condition).alias("condition"), F.lit(objective).alias("objective"),
        F.lit(rule if condition == "model_completion" else None).cast("string").alias("selection_rule"), F.lit(role).alias("study_role"), F.col("is_correct").alias("base_completion_correct"),
    )


_SPANS = "array<struct<id:int,start:int,end:int>>"


def offsets(text: Column, tokenizer: str | None = None) -> Column:
    """Tokens of a text with their start and end in code points: those of a tokenizer file, without
    special tokens, or, without one, words (which have no id). Null stays null."""

    def found(x: str, held) -> list[dict]:
        if held is None:
            return [{"id": None, "start": m.start(), "end": m.end()} for m in re.finditer(r"\S+", x)]
        e = held.encode(x, add_special_tokens=False)
        return [{"id": i, "start": a, "end": b} for i, (a, b) in zip(e.ids, e.offsets, strict=True)]

    @F.pandas_udf(_SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = None
        if tokenizer is not None:
            from tokenizers import Tokenizer

            held = Tokenizer.from_file(tokenizer)
        for texts in batches:
            yield texts.map(lambda x: None if x is None else found(x, held))

    return run(text)


def rendered(compiled: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Compiled queries with the tokens of prompt and target, and a mask of those that are scored: the
    target's, all of a joint sequence, or the last token of a bare prompt."""
    border = F.length("prompt")
    mask = F.when(F.col("objective") == "joint_sequence", F.transform("offsets", lambda x: F.lit(True))).when(
        F.col("objective") == "prompt_next_token", F.transform("offsets", lambda x, i: i == F.size("offsets") - 1)
    ).otherwise(F.transform("offsets", lambda x: x["end"] > border))
    return compiled.withColumn("offsets", offsets(F.concat_ws("", "prompt", "target"), tokenizer)).withColumn("scored", mask)


def zip_conflicts(compiled: DataFrame, rendered_: DataFrame) -> DataFrame:
    """Places (ordinal) at which two ordered rosters (ordinal, query_id) don't name the same query."""
    a, b = compiled.select("ordinal", F.col("query_id").alias("compiled_id")), rendered_.select("ordinal", F.col("query_id").alias("rendered_id"))
    return a.join(b, "ordinal", "full_outer").where("not (compiled_id <=> rendered_id)")


def spans_contiguous(rows: DataFrame) -> DataFrame:
    """Rendered queries whose scored words aren't one run, or are none."""
    on = F.filter(F.transform("scored", lambda s, i: F.when(s, i)), lambda x: x.isNotNull())
    bad = (F.size(on) == 0) | (F.element_at(on, -1) - F.element_at(on, 1) + 1 != F.size(on))
    return rows.where(F.when(F.size(on) == 0, True).otherwise(bad)).select("query_id")


def resolve_query_file(benchmark: str, names: list[str], groups: dict[str, str]) -> str | None:
    """The query file of a benchmark: by its recorded group, else by exact stem, prefix, suffix or
    substring, in this order; among several the first by name."""
    stems = {n: re.sub(r"\.jsonl(\.zst)?$", "", n) for n in sorted(names)}
    fits = (lambda n, s: groups.get(n) == benchmark, lambda n, s: s == benchmark, lambda n, s: s.startswith(benchmark), lambda n, s: s.endswith(benchmark), lambda n, s: benchmark in s)
    for fit in fits:
        for name, stem in stems.items():
            if fit(name, stem):
                return name
    return None
