"""Query sets: candidates, references, rosters and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text

# Fixed values.
LABEL_PAD = -100


def contiguous(frame: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Whether each group's indexes are 0 .. n-1, each once, with its size."""
    out = frame.groupBy(*keys).agg(F.sort_array(F.collect_list(index)).alias("_i"))
    return out.select(*keys, F.size("_i").alias("n"), (F.transform("_i", lambda x: x.cast("bigint")) == F.sequence(F.lit(0), F.size("_i") - 1).cast("array<bigint>")).alias("contiguous"))


def select_candidate(candidates: DataFrame, score: str, lowest: bool = False, on_tie: str = "lowest_index") -> DataFrame:
    """The candidate (query_id, index, score) with the best score of each query. Ties go to the
    lowest index, or fail with ``on_tie`` "reject"."""
    s = F.col(score)
    by_score = Window.partitionBy("query_id").orderBy(s.asc() if lowest else s.desc(), "index")
    best = F.min(s) if lowest else F.max(s)
    every = Window.partitionBy("query_id")
    rows = candidates.withColumns({"_r": F.row_number().over(by_score), "_best": best.over(every)})
    rows = rows.withColumn("n_tied", F.count_if(s == F.col("_best")).over(every)).where("_r = 1").drop("_r", "_best")
    if on_tie == "reject":
        rows = rows.withColumn("index", F.when(F.col("n_tied") == 1, F.col("index")).otherwise(F.raise_error(F.lit("candidates tie"))))
    return rows


def correctness(selected: DataFrame, gold: DataFrame) -> DataFrame:
    return selected.join(gold, "query_id").withColumn("is_correct", F.col("index") == F.col("gold_index"))


def resolve_reference(frame: DataFrame) -> DataFrame:
    """reference_index by the row's policy: parsed (answer among choices), ordering (position of the
    marked one), consensus (share above one half) or explicit; null where it can't be resolved."""
    parsed = F.nullif(F.array_position(F.transform("choices", text.normalize_answer), text.normalize_answer(F.col("answer"))), F.lit(0)) - 1
    top = F.array_max("votes")
    consensus = F.when(top > F.lit(0.5) * F.aggregate("votes", F.lit(0.0), lambda a, x: a + x), F.array_position("votes", top) - 1)
    return frame.withColumn(
        "reference_index",
        F.when(F.col("policy") == "parsed", parsed).when(F.col("policy") == "ordering", F.nullif(F.array_position("marks", F.lit(True)), F.lit(0)) - 1).when(F.col("policy") == "consensus", consensus).when(F.col("policy") == "explicit", F.col("index")),
    )


def parse_answer(answer: Column, keys: Column, choices: Column) -> Column:
    """Index of the choice that a free answer names: by letter, by text, or either after "answer is";
    null if none or several fit."""
    def find(a: Column) -> Column:
        letter = F.array_position(F.transform(keys, F.lower), F.regexp_extract(a, r"^\(?([a-z]|choice_\d+)\)?[.):]?$", 1))
        words = F.transform(choices, text.normalize_answer)
        once = F.size(F.filter(words, lambda w: w == a)) == 1
        return F.coalesce(F.nullif(letter, F.lit(0)), F.when(once, F.array_position(words, a))) - 1

    whole = text.normalize_answer(answer)
    inner = text.normalize_answer(F.regexp_extract(whole, r"answer is:?\s*(.+)$", 1))
    return F.coalesce(find(whole), F.when(inner != "", find(inner))).cast("int")


def coverage(evidence: DataFrame, references: DataFrame, key: str = "query_id") -> DataFrame:
    """Keys that are missing, extra, or there more than once, of a join that has to be one to one."""
    a, b = evidence.groupBy(key).agg(F.count("*").alias("n_left")), references.groupBy(key).agg(F.count("*").alias("n_right"))
    rows = a.join(b, key, "full_outer").fillna(0, subset=["n_left", "n_right"])
    state = F.when(F.col("n_right") == 0, "missing").when(F.col("n_left") == 0, "extra").when((F.col("n_left") > 1) | (F.col("n_right") > 1), "duplicate")
    return rows.withColumn("state", state).where("state is not null")


def duplicates(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def roster_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often, with the side; empty if the rosters are equal as multisets."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def offset_pairs(frame: DataFrame, offset: int, key: str = "doc_id") -> DataFrame:
    """Rows joined with those whose key is ``offset`` larger (each once)."""
    other = frame.select((F.col(key) - offset).alias(key), F.col(key).alias("paired_id"))
    return frame.select(key).join(other, key)


def agreed(frame: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Groups whose values of a column differ."""
    return frame.groupBy(*keys).agg(F.count_distinct(column).alias("n_values")).where("n_values != 1")


def contract_gaps(frame: DataFrame, contract: DataFrame, key: str) -> DataFrame:
    """Row counts by key that differ from the contract (key, n_expected)."""
    rows = frame.groupBy(key).agg(F.count("*").alias("n_rows")).join(contract, key, "full_outer").fillna(0, subset=["n_rows", "n_expected"])
    return rows.where("n_rows != n_expected")


def probe_lookup(tasks: DataFrame, registry: DataFrame) -> DataFrame:
    """The probe of each task: by alias, else by name, else by core (registry: key, probe)."""
    out = tasks
    for k, column in enumerate(("task_alias", "task_name", "task_core")):
        out = out.join(F.broadcast(registry.select(F.col("key").alias(column), F.col("probe").alias(f"_p{k}"))), column, "left")
    return out.withColumn("probe", F.coalesce("_p0", "_p1", "_p2")).drop("_p0", "_p1", "_p2")


def query_id(native: Column, task: Column, doc: Column) -> Column:
    return F.concat_ws(":", text.escape_component(task), text.escape_component(native), doc.cast("string"))


def multiple_choice(rows: DataFrame) -> DataFrame:
    """Prompt, choices with keys, and label of rows (context, question, answerA .. answerC, label 1-3)."""
    answers = F.array("answerA", "answerB", "answerC")
    lines = F.transform(answers, lambda x, i: F.concat(F.char((i + 65).cast("bigint")), F.lit(". "), x))
    return rows.select(
        "query_id",
        F.concat_ws("\n", F.col("context"), F.concat(F.lit("Question: "), F.col("question")), F.array_join(lines, "\n"), F.lit("Answer:")).alias("prompt"),
        answers.alias("choices"),
        (F.col("label").cast("int") - 1).alias("label_index"),
        F.concat(F.lit(" "), F.char((F.col("label").cast("bigint") + 64))).alias("completion"),
    )


def conversation_prompts(turns: DataFrame) -> DataFrame:
    """Each conversation as one prompt, turns in order."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", F.size("t").alias("n_turns"), F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("prompt"))


def loss_labels(prompt_ids: Column, target_ids: Column, multiple: int = 8) -> tuple[Column, Column]:
    """(input ids, labels): the prompt's labels and the padding, up to a multiple, are -100."""
    n = F.size(prompt_ids) + F.size(target_ids)
    pad = F.pmod(-n, F.lit(multiple))
    ids = F.concat(prompt_ids, target_ids, F.array_repeat(F.lit(0), pad))
    return ids, F.concat(F.array_repeat(F.lit(LABEL_PAD), F.size(prompt_ids)), target_ids, F.array_repeat(F.lit(LABEL_PAD), pad))


def islands(spans: DataFrame, key: str) -> DataFrame:
    """Overlapping spans (start, end) of each key merged into groups."""
    w = Window.partitionBy(key).orderBy("start", "end")
    top = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_new", F.when(top.isNull() | (F.col("start") >= top), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def key_differences(left: Column, right: Column) -> Column:
    """Keys that only one of two maps has, or whose values differ, sorted."""
    keys = F.array_union(F.map_keys(left), F.map_keys(right))
    return F.array_sort(F.filter(keys, lambda k: ~left[k].eqNullSafe(right[k])))


def unexpected_keys(value: Column, allowed: list[str]) -> Column:
    return F.array_except(F.map_keys(value), F.array(*[F.lit(k) for k in allowed]))


def answered(rows: DataFrame, letters: dict[str, str], prefix: str) -> DataFrame:
    """Queries (prompt, completion, query_id, label) of rows (ordinal, prompt, answer, label); rows whose
    answer has no letter go, and leave their number unused."""
    return rows.withColumn("completion", text.lookup(letters, F.col("answer"))).where("completion is not null").select("prompt", "completion", F.concat(F.lit(f"{prefix}-"), "ordinal").alias("query_id"), "label")


def option_lines(prompt: Column) -> Column:
    """Key and text of the option lines of a prompt, in order."""
    keys = F.regexp_extract_all(prompt, F.lit(r"(?m)^([A-Z])[.)] .+$"), 1)
    texts = F.regexp_extract_all(prompt, F.lit(r"(?m)^[A-Z][.)] (.+)$"), 1)
    return F.zip_with(keys, texts, lambda k, t: F.struct(k.alias("key"), t.alias("text")))


def options_valid(prompt: Column, choices: Column) -> Column:
    """Whether the option lines are exactly the choices, keyed A, B, ..."""
    lines = option_lines(prompt)
    keys = F.transform(F.sequence(F.lit(0), F.size(choices) - 1), lambda i: F.char((i + 65).cast("bigint")))
    return (F.transform(lines, lambda x: x["text"]) == choices) & (F.transform(lines, lambda x: x["key"]) == keys)
