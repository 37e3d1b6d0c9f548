from __future__ import annotations

import hashlib
import re

from meterbook.llm import fixity
from meterbook.llm.workspace import stored
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, file string, number string, digest string"


def _pages(spark, n=150):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>\r\nWARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\n" * (i % 5), "x", "x", "x") for i in range(n)]
    rows += [(3, None, None, "x", "x", "x"), (None, "u", "h", "x", "x", "x"), (None, None, None, "x", "x", "x"), (7, "http://x/7", rows[7][2], "x", "x", "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _laid(pages, ids=10):
    return stored(fixity.laid_out(pages, ids), "laid")


def test_layout(spark):
    rows = _laid(_pages(spark)).orderBy("file", "number").collect()
    at = {}
    for r in rows:
        assert r.offset == at.get(r.file, 0)
        at[r.file] = r.offset + r.length
    body = "<p>11</p>\r\nWARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\n"
    whole = "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:11>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: http://x/11\r\nContent-Type: text/html\r\nContent-Length: " + str(len(body)) + "\r\n\r\n" + body + "\r\n\r\n"
    assert next(r.digest for r in rows if r.page_id == 11) == hashlib.sha256(whole.encode()).hexdigest()


def test_locates_damage(spark):
    pages = _pages(spark)
    ours = _laid(pages)
    assert fixity.audit(ours, ours, 4).where("not intact").count() == 0
    other = F.when(F.col("page_id").isin(11, 148), F.lit("gone")).otherwise(F.col("html"))
    found = {r.page_id for r in fixity.audit(ours, _laid(pages.withColumn("html", other)), 4).where("not intact").collect()}
    # Records behind one whose length has changed lie at other offsets.
    assert found == {11, 12, 13, 14, 15, 16, 17, 18, 19, 148, 149}


def test_missing_records(spark):
    pages = _pages(spark)
    ours, theirs = _laid(pages), _laid(pages.where("page_id < 100 or page_id is null"))
    assert fixity.audit(ours, theirs, 4).where("not intact").count() == 50
    assert fixity.audit(ours, _laid(pages.limit(0)), 4).where("intact").count() == 0
    extra = fixity.audit(theirs, ours, 4).where("not intact").collect()
    assert {r.page_id for r in extra} == set(range(100, 150))
    assert {r.side for r in extra} == {"replica"}
    assert {r.side for r in fixity.audit(ours, theirs, 4).where("not intact").collect()} == {"records"}
    assert fixity.audit(_laid(pages.limit(0)), ours, 4).where("intact or side <> 'replica'").count() == 0


def test_trees_of_equal_height_and_unequal_shape(spark):
    """Fewer files, of which one is longer, once made a tree as high as that of more and shorter files."""

    def held(sizes):
        return stored(spark.createDataFrame([(f, n, n * 9, 9, f"{f}-{n}") for f, size in enumerate(sizes) for n in range(size)], "file long, number long, offset long, length long, digest string"), "held")

    for ours, theirs in (([5] * 6, [17, 5, 5, 5]), ([17, 5, 5, 5], [5] * 6), ([1], [9] * 9), ([3] * 5, [3] * 5)):
        found = {(r.file, r.number) for r in fixity.audit(held(ours), held(theirs), 4).where("intact").collect()}
        assert found == {(f, n) for f, size in enumerate(ours) for n in range(size) if f < len(theirs) and n < theirs[f]}


def test_files_round_trip(spark, tmp_path):
    pages = _pages(spark)
    fixity.write_warc(pages, f"{tmp_path}/warc", 10)
    columns = ["file", "number", "offset", "length", "digest"]
    key = lambda r: (r.file, r.number)
    found = sorted(fixity.read_warc(spark, f"{tmp_path}/warc").select(columns).collect(), key=key)
    assert found == sorted(_laid(pages).select(columns).collect(), key=key)


def test_declared_lengths(spark, tmp_path):
    """Records without a length, with a version line in their content, and with lengths that are too small or too large."""
    record = lambda head, content: f"WARC/1.0\r\n{head}\r\n\r\n{content}\r\n\r\n"
    held = "aaWARC/1.0\r\nbb"
    whole = [record("WARC-Type: x", "no length"), record(f"content-length: {len(held)}", held), record("Content-Length: 1", "too small"), record("Content-Length: 40", "too large") + record("Content-Length: 1", "z"), record("Content-Length: 0", "")]
    (tmp_path / "warc" / "file=3").mkdir(parents=True)
    (tmp_path / "warc" / "file=3" / "part.txt").write_bytes("".join(whole).encode())
    found = fixity.read_warc(spark, f"{tmp_path}/warc")
    starts = [sum(len(w) for w in whole[:i]) for i in range(len(whole))]
    expected = [(3, i, starts[i], len(w), hashlib.sha256(w.encode()).hexdigest()) for i, w in enumerate(whole)]
    assert sorted(tuple(r) for r in found.select("file", "number", "offset", "length", "digest").collect()) == expected
    # No window is given the bytes of a piece.
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    nodes = found._jdf.queryExecution().explainString(mode).split("\n\n")
    windows = [n for n in nodes if re.match(r"\s*\(\d+\) Window\b", n)]
    assert windows and not [n for n in windows if "piece#" in n]
