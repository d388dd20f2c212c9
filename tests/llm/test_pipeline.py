"""The corpus pipeline against a plain version, and the entry point with and without it."""

import random
import re
import subprocess
import sys
from pathlib import Path

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline
from tessella.llm import decontamination, span_dedup
from tests.llm.test_operators import LOWER, check_packing, edited, near_copies, plain_tiling, say, tile_spans

ROOT = Path(__file__).resolve().parents[2]


def inputs():
    rng = random.Random(11)
    items = [say(700 + k, 25) for k in range(4)]
    passages = [say(800 + k, 60) for k in range(3)]
    rows = []
    for k in range(60):
        t = say(900 + k, rng.randrange(30, 150))
        if k % 6 == 0:
            t += " " + rng.choice(passages)
        if k % 10 == 3:
            t += " " + rng.choice(items)
        if k % 9 == 5:
            t = edited(rows[0][1], rng, rng.randrange(4))
        rows.append((k, t))
    rows += [(60, rows[1][1]), (61, None), (62, "12 34 !!"), (63, ""), (64, "word")]
    return rows, list(enumerate(items))


def plain_pipeline(rows, items):
    rows = [(d, t) for d, t in rows if t and re.search(r"[^\W\d_]", t)]
    groups = near_copies(rows, 5, 80, 100)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    cut = tile_spans(rows, span_dedup.MIN_WORDS)
    words = lambda t: re.findall(r"[0-9a-z]+", t.translate(LOWER))
    least = decontamination.MIN_MATCH
    bad = lambda t: any(plain_tiling(words(x), words(t), least) >= decontamination.COVERAGE * len(words(x)) for _, x in items)
    return [(d, cut[d]) for d, _ in rows if not bad(cut[d])]


def test_pipeline_against_plain_version(spark, tmp_path):
    rows, items = inputs()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x") for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = plain_pipeline(rows, items)
    assert 30 < len(want) < 60
    held = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = corpus_pipeline.materialize(stage(spark, held, str(tmp_path)))
        assert held.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r["doc_id"], r["text"]) for r in held.collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in held.collect())
    padding, _ = check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), want, 1024)
    assert padding == 0


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("removed", [(), ("tessella/llm", "corpus_pipeline.py")])
def test_entry_with_and_without_the_subpackage(tmp_path, removed):
    def ignore(folder, names):
        return [n for n in names if n in (".git", "__pycache__", "tests") or str((Path(folder) / n).relative_to(ROOT)) in removed]

    import shutil

    shutil.copytree(ROOT, tmp_path / "copy", ignore=ignore)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 60 and int(out[1]) == (0 if removed else 11) and out[2] == "True"
