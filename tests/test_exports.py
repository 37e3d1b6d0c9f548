"""CSV exports by byte ranges against one reading of the whole file."""

from __future__ import annotations

import csv
import io
import json
import random

import pytest
from meterbook.functions.dashboard import CSV_COLUMNS, CSV_REQUIRED
from meterbook.sources import exports, logs
from pyspark.sql import functions as F

HEADER = ",".join(f'"{c}"' for c in CSV_COLUMNS)


def _whole(data: bytes) -> list[dict]:
    rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8", "replace").removeprefix("\ufeff"), newline="")) if r]
    if not rows or not set(CSV_REQUIRED) <= set(rows[0]):
        return []
    return [{c: row[rows[0].index(c)] for c in CSV_COLUMNS if c in rows[0] and rows[0].index(c) < len(row)} for row in rows[1:]]


def _by_ranges(data: bytes, size: int) -> list[dict]:
    file, found, state = io.BytesIO(data), [], "S"
    for begin in range(0, len(data), size):
        end = min(begin + size, len(data))
        behind = exports.state_map(file, begin, end)[exports.STATES.index(state)]
        found += exports.records_in(file, begin, end, len(data), state, behind)
        state = behind
    return found


@pytest.mark.parametrize("seed", range(4))
def test_any_text_is_cut_as_it_is_read(seed, monkeypatch):
    """Random texts of what matters to a reader: quotes open, closed, doubled and stray, and every kind of line end."""
    monkeypatch.setattr(exports, "_BLOCK", 11)
    rng = random.Random(seed)
    for _ in range(150):
        body = "".join(rng.choices(['"', '""', ",", "\n", "\r\n", "\r", "a", "bé", " ", '"x\ny"', '5"'], [4, 1, 6, 4, 2, rng.choice([0, 1]), 6, 2, 1, 2, 1], k=rng.randrange(120)))
        before = rng.choice(["", "\ufeff", "\n\n", "\r\n"])
        data = (before + HEADER + rng.choice(["\n", "\r\n"]) + body).encode()
        expected = _whole(data)
        for size in (1, 7, 64, 1000):
            assert _by_ranges(data, size) == expected, (data, size)


def test_other_headers():
    shuffled = [*CSV_COLUMNS[::-1], "more"]
    data = (",".join(shuffled) + "\n" + ",".join(f"v{i}" for i in range(len(shuffled))) + "\nshort\n\n").encode()
    assert _by_ranges(data, 9) == _whole(data)
    assert _by_ranges(data, 9)[1] == {CSV_COLUMNS[-1]: "short"}
    for other in (b"", b"\n\n", b"a,b\n1,2\n", HEADER.encode()):
        assert _by_ranges(other, 3) == []


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    """Three files: one of 60 ranges with notes over several lines, a small one and one without an export's columns."""
    folder = tmp_path / "in"
    folder.mkdir()
    out = io.StringIO(newline="")
    writer = csv.writer(out)
    writer.writerow(CSV_COLUMNS)
    for i in range(6000):
        writer.writerow([f'{c} {i}, "quoted"\r\nand\n{i}' if j % 4 == 2 else f"{i}" for j, c in enumerate(CSV_COLUMNS)])
    texts = {"a [1].csv": out.getvalue(), "B.CSV": HEADER + "\r\n" + ",".join(["1"] * len(CSV_COLUMNS)), "c.csv": "a,b\n1,2\n", "d.csv": ""}
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode())
    files = logs.listed_files(spark, str(folder)).select("path", F.col("length").alias("stop"))
    size = len(texts["a [1].csv"]) // 60
    found = exports.read_exports(files, size).select("value", F.substring_index("path", "/", -1).alias("name"), F.spark_partition_id().alias("task")).collect()
    for name, text in texts.items():
        rows = sorted(r.value for r in found if r.name == name)
        assert rows == sorted(json.dumps(r) for r in _whole(text.encode()))
    big = [r for r in found if r.name == "a [1].csv"]
    assert len(big) == 6000 and len({r.task for r in big}) > 20
    assert max(sum(r.task == t for r in big) for t in {r.task for r in big}) < 1200
    assert logs.read_logs(spark, str(folder)).count() == 6001
    assert exports.read_exports(files.limit(0)).count() == 0
