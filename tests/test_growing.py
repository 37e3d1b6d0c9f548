"""Byte ranges of growing files, against plain splitting; the stream over them."""

from __future__ import annotations

import io
import json
import random

import pytest
from meterbook.sources import growing, logs
from pyspark.sql import functions as F


def _text(rng: random.Random) -> bytes:
    return b"\n".join(bytes(rng.choice(b"ab\r \xc3") for _ in range(rng.choice([0, 0, 1, 3, 9, 40]))) for _ in range(rng.randrange(12)))


def test_ranges_share_out_all_lines(monkeypatch):
    rng = random.Random(2)
    for _ in range(400):
        monkeypatch.setattr(growing, "_BLOCK", rng.choice([1, 3, 16]))
        text, size = _text(rng), rng.randrange(1, 20)
        first = rng.choice([0, text.find(b"\n") + 1])
        found = [line for begin in range(first, len(text), size) for some in growing.lines_in(io.BytesIO(text), first, begin, min(begin + size, len(text)), len(text)) for line in some]
        expected = text[first:].split(b"\n")
        assert found == (expected if expected[-1] else expected[:-1])


def test_end_of_whole_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "_BLOCK", 4)
    path = tmp_path / "a[1].log"

    def end(text: bytes, start: int = 0) -> int:
        path.write_bytes(text)
        return growing.whole_end(str(path), start, len(text))

    assert (end(b""), end(b"a\nb\n"), end(b"a\nbcdefghij"), end(b"abcdefghij"), end(b"\n\nabcdefgh", 2)) == (0, 4, 2, 0, 2)
    whole, half = b'x\n{"a": "long enough"}', b'x\n{"a": "long enough"'
    assert (end(whole), end(half), end(b"[1, 2]"), end(b"12345"), end(b"{}", 1)) == (len(whole), 2, 6, 0, 1)
    assert end(b'{"a":' * 5000) == 0


def _object(i: int) -> str:
    return json.dumps({"model": f"m{i}", "pad": "é" * (i % 50)})


@pytest.fixture
def folder(tmp_path):
    """One file of many ranges and small ones with odd names."""
    at = tmp_path / "in [x]"
    (at / "deep").mkdir(parents=True)
    (at / "large.jsonl").write_text("".join(_object(i) + "\n" for i in range(3000)) + _object(3000)[:9])
    for i, name in enumerate(("c[1].jsonl", "a b{x}.LOG", "d*.txt", "deep/e?.ndjson", "deep/ü%20#.log")):
        (at / name).write_text("﻿" + _object(4000 + i) + "\r\n\n")
    (at / "f.bin").write_text("x\n")
    return at


EXPECTED = {f"m{i}" for i in [*range(3000), *range(4000, 4005)]}


def test_table_of_ranges(spark, folder):
    files = logs.changed_files(logs.listed_files(spark, str(folder).replace("[", "\\[").replace("]", "\\]")), spark.createDataFrame([], "path string, modified timestamp, offset long"))
    rows = growing.read_ranges(growing.with_ends(files, logs.LINES), 10_000)
    assert sorted(r.m for r in rows.select(F.get_json_object("value", "$.model").alias("m")).collect()) == sorted(EXPECTED)
    large = (folder / "large.jsonl").stat().st_size
    assert large // 10_000 <= rows.rdd.getNumPartitions() <= large // 10_000 + 8
    by_task = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert by_task < 3000 / 4


def test_batch_source(spark, folder):
    rows = growing.lines(spark, str(folder), logs.LINES, 10_000)
    assert sorted(r.m for r in rows.select(F.get_json_object("value", "$.model").alias("m")).collect()) == sorted(EXPECTED)
    assert rows.rdd.getNumPartitions() >= (folder / "large.jsonl").stat().st_size // 10_000


def test_stream_sees_growth(spark, folder, tmp_path):
    """Lines added to one file, one of them in two halves, a file that shrinks, and a restart in between."""
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"

    def run() -> list[str]:
        query = growing.line_stream(spark, str(folder), logs.LINES, 10_000).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)
        assert query.awaitTermination(120)
        return sorted(r.m for r in spark.read.schema("value string, path string").parquet(out).select(F.get_json_object("value", "$.model").alias("m")).collect())

    assert run() == sorted(EXPECTED)
    with (folder / "large.jsonl").open("a") as f:
        f.write(_object(3000)[9:])
    assert run() == sorted(EXPECTED | {"m3000"})
    with (folder / "large.jsonl").open("a") as f:
        f.write("\n" + _object(3001) + "\n" + _object(3002)[:5])
    (folder / "new.log").write_text(_object(5000) + "\n")
    assert run() == sorted(EXPECTED | {"m3000", "m3001", "m5000"})
    (folder / "c[1].jsonl").write_text('{"model": "again"}\n')
    assert run() == sorted(EXPECTED | {"m3000", "m3001", "m5000", "again"})
