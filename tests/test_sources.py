"""Readers, writers and streams."""

import json

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tessella.sources import records, sinks
from tessella.streaming import events


def test_json_lines_plain_and_zstd(spark, tmp_path):
    lines = [json.dumps({"id": "a", "text": "x y"}, ensure_ascii=False), json.dumps({"id": "b", "text": "z", "metadata": {"k": "v"}})]
    (tmp_path / "p.jsonl").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "z.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress("\n".join(lines).encode()))
    for name in ("p.jsonl", "z.jsonl.zst"):
        got = {r["id"]: r for r in records.read_records(spark, str(tmp_path / name)).collect()}
        assert got["a"]["text"] == "x y" and got["b"]["metadata"] == {"k": "v"} and len(got) == 2
    (tmp_path / "bad.jsonl").write_text(lines[1] + "\n{broken\n")
    assert records.read_json_lines(spark, str(tmp_path / "bad.jsonl"), tolerant=True).count() == 1
    with pytest.raises(Exception):
        records.read_json_lines(spark, str(tmp_path / "bad.jsonl")).collect()


def test_manifest_folders(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "m/data"))
    spark.range(3).write.parquet(str(tmp_path / "n/deep/er"))
    assert records.read_manifest(spark, str(tmp_path / "m")).count() == 5
    assert records.read_manifest(spark, str(tmp_path / "n"), ["id"], recursive=True).count() == 3


def test_score_shards_by_position(spark, tmp_path):
    for name, scores, ids in (("s1", [[1, 2], [3, 4]], ["u0", "u1"]), ("s2", [[5, 6]], ["u2", "u3"]), ("s3", [[7, 8]], None)):
        np.save(tmp_path / f"{name}.npy", np.array(scores, np.float32))
        if ids:
            (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"id": i}) for i in ids) + "\n\n")
    scores, ids = records.read_score_shards(spark, str(tmp_path)), records.read_shard_ids(spark, str(tmp_path))
    assert scores.count() == 8
    got = records.attach_ids(scores, ids, strict=False).collect()
    assert sorted((r["doc_id"], r["query"], r["score"]) for r in got) == [("u0", 0, 1.0), ("u0", 1, 2.0), ("u1", 0, 3.0), ("u1", 1, 4.0)]
    with pytest.raises(Exception, match="differ in length"):
        records.attach_ids(scores, ids).collect()


def test_structured_scores_and_vectors(spark, tmp_path):
    dtype = [("score_0", "<f4"), ("written", "u1")]
    np.array([(1.5, 1), (2.5, 1)], np.dtype(dtype)).tofile(tmp_path / "scores.bin")
    assert sorted(r["score"] for r in records.read_structured_scores(spark, str(tmp_path), dtype).collect()) == [1.5, 2.5]
    np.save(tmp_path / "v.npy", np.eye(3, dtype=np.float32))
    assert sorted(r["vec"] for r in records.read_vectors(spark, str(tmp_path)).collect()) == [[0, 0, 1], [0, 1, 0], [1, 0, 0]]


def test_required_columns(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("label\ttopic\na\tb\n")
    assert records.read_required_csv(spark, str(tmp_path / "t.tsv"), ["label"], sep="\t").first()["topic"] == "b"
    with pytest.raises(ValueError, match="lacks"):
        records.read_required_csv(spark, str(tmp_path / "t.tsv"), ["seed"], sep="\t")


def test_writers(spark, tmp_path):
    frame = spark.range(25).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("text"), (F.col("id") % 2).alias("shard"))
    path = str(tmp_path / "o")
    sinks.write_json_lines(frame.coalesce(1), path, lines_per_file=10)
    assert len(list((tmp_path / "o").glob("part-*"))) == 3 and sinks.is_complete(spark, path)
    with pytest.raises(Exception):
        sinks.write_json_lines(frame, path)
    assert records.read_json_lines(spark, path).count() == 25
    assert sinks.write_unless_complete(frame, str(tmp_path / "p")) and not sinks.write_unless_complete(frame, str(tmp_path / "p"))
    sinks.write_shards(frame, str(tmp_path / "s"))
    assert sorted(x.name for x in (tmp_path / "s").glob("shard=*")) == ["shard=0", "shard=1"]
    sinks.write_small_csv(frame.limit(2), str(tmp_path / "c"))
    assert sinks.write_with_counts(frame, str(tmp_path / "w"), odd=F.count_if(F.col("shard") == 1)) == {"rows": 25, "odd": 12}
    assert records.consolidate({"b": frame, "a": frame}).count() == 50


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("event_id"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=(F.col("id") * 7).cast("int"))).alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = events.read_events(spark, str(tmp_path / "e"))
    events.run_to_table(events.windowed_sums(stream), "windows", str(tmp_path / "c1"), "complete")
    events.run_to_table(events.sessions(stream), "sess", str(tmp_path / "c2"), "complete")
    batch = spark.read.parquet(str(tmp_path / "e"))
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, events.windowed_sums(batch).collect()))
    assert sorted(map(tuple, spark.table("sess").collect())) == sorted(map(tuple, events.sessions(batch).collect()))


def test_grids(spark, tmp_path):
    from tessella.sources import grids

    (tmp_path / "a_perquery.csv").write_text("topic_label,format_label,median_influence,mean_influence,doc_count\nScience math,FAQ,1.0,9,3\nGames,faq,3.0,9,4\n")
    (tmp_path / "a.csv").write_text("topic_label,format_label,mean_score,doc_count\nx,y,7.0,1\n")
    (tmp_path / "b.csv").write_text("topic_label,format_label,mean_score,doc_count\ngames,faq,7.0,1\nhealth,faq,7.0,1\n")
    with pytest.warns(UserWarning, match="no grid of c"):
        rows = grids.read_grids(spark, str(tmp_path), ["a", "b", "c"]).collect()
    assert sorted((r["benchmark"], r["topic"], r["mean_score"], round(r["zscore"], 3)) for r in rows) == [
        ("a", "__label__games", 3.0, 0.707), ("a", "__label__science_math", 1.0, -0.707), ("b", "__label__games", 7.0, 0.0), ("b", "__label__health", 7.0, 0.0),
    ]


def test_hub_records_need_a_network(spark):
    from tessella.sources.remote import HubRecords

    spark.dataSource.register(HubRecords)
    with pytest.raises(Exception, match="repository and files"):
        spark.read.format("hub_records").load().collect()
    with pytest.raises(Exception, match="needs the datasets package"):
        spark.read.format("hub_records").option("repository", "r").option("files", "f").load().collect()


def test_score_folders_and_their_ids(spark, tmp_path):
    from tessella.sources import layout

    for query in ("queries_a", "queries_b"):
        for shard, values in (("s0", [1.0, 2.0]), ("s1", [3.0])):
            folder = tmp_path / "scores" / query / "web" / shard
            folder.mkdir(parents=True)
            np.save(folder / "scores.npy", np.array(values))
    (tmp_path / "scores" / "other").mkdir()
    (tmp_path / "scores" / "queries_a" / "note.txt").write_text("x")
    ids = tmp_path / "ids"
    ids.mkdir()
    (ids / "s0.jsonl").write_text('{"id": "d0"}\n\n{"id": "d1"}\n')
    (ids / "s1.jsonl").write_text('{"id": "d2"}\n')
    base = str(tmp_path / "scores")
    assert layout.query_folders(spark, base) == ["queries_a", "queries_b"]
    assert sorted((r["query"], r["shard"]) for r in layout.score_shards(spark, base).collect()) == [("queries_a", "s0"), ("queries_a", "s1"), ("queries_b", "s0"), ("queries_b", "s1")]
    assert sorted(map(tuple, layout.query_scores(spark, base, "queries_a", str(ids)).collect())) == [("d0", 1.0), ("d1", 2.0), ("d2", 3.0)]
    for bad in (lambda: layout.query_folders(spark, str(ids)), lambda: layout.query_folders(spark, str(tmp_path / "none")), lambda: layout.query_scores(spark, base, "queries_c", str(ids))):
        with pytest.raises(FileNotFoundError):
            bad()
    (ids / "s1.jsonl").write_text('{"id": "d2"}\n{"id": "d3"}\n')
    with pytest.raises(Exception, match="differ in length"):
        layout.query_scores(spark, base, "queries_a", str(ids)).collect()


def test_ids_of_an_index(spark, tmp_path):
    import pyarrow as pa

    from tessella.sources import layout

    assert layout.id_field(spark, str(tmp_path), "id") is None
    (tmp_path / "rows.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "b"}\n')
    (tmp_path / "index_config.json").write_text('{"data": {"dataset": "rows.jsonl"}}')
    found = layout.id_field(spark, str(tmp_path), "id")
    assert [r["value"] for r in found.orderBy("at").collect()] == ["a", "b"] and layout.id_field(spark, str(tmp_path), "n") is None
    (tmp_path / "data.hf").mkdir()
    with pa.OSFile(str(tmp_path / "data.hf" / "data-0.arrow"), "wb") as out, pa.ipc.new_stream(out, pa.schema([("id", pa.int64())])) as stream:
        stream.write_batch(pa.record_batch([pa.array([7, 8])], ["id"]))
        stream.write_batch(pa.record_batch([pa.array([9])], ["id"]))
    assert [r["value"] for r in layout.id_field(spark, str(tmp_path), "id").orderBy("at").collect()] == ["7", "8", "9"]
    (tmp_path / "index_config.json").write_text("not json")
    assert layout.id_field(spark, str(tmp_path), "other") is None


def test_masks_and_metadata(spark, tmp_path):
    from tessella.sources import layout

    (tmp_path / "mask.jsonl").write_text('{"is_correct": true}\n{}\n{"is_correct": false}\n')
    assert [r["is_correct"] for r in layout.read_masks(spark, str(tmp_path / "mask.jsonl")).orderBy("at").collect()] == [True, False, False]
    (tmp_path / "meta.jsonl").write_text('{"doc_id": "a", "v": 1}\n{"doc_id": null, "v": 2}\n{"doc_id": "a", "v": 3}\n{"doc_id": "b", "v": 4}\n')
    assert sorted(map(tuple, layout.read_metadata(spark, str(tmp_path / "meta.jsonl")).collect())) == [("a", 3), ("b", 4)]
