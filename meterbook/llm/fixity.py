"""Fixity audit of WARC replicas by Merkle trees.

Records are laid out in files; a leaf is the hash of one record's offset,
length and content digest. Every FANOUT leaves of a file, in offset order,
make a node, and so on up to the file; files make nodes in the same way up to
the root. Both replicas get trees of one shape, as high as the longest file
and the span of file numbers of the two need. Equal roots end the audit.
Otherwise only the children of mismatching nodes are compared, level by level,
down to the records.

Defined results: null html and url count as empty; a record is identified by
its file and its number in offset order; records without page_id are dealt by
the digest of their URL to NAMELESS files below 0; repeated rows are records of
their own; a replica without records has no root, and all records of the other
one are reported, whichever side it is. Columns other than
page_id, url and html are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterbook.llm.workspace import Scratch, scratch, stored

FANOUT = 16
FILE_IDS = 1000
#: Files for records without page_id.
NAMELESS = 4096
#: The date of records whose pages tell none.
NO_DATE = "1970-01-01T00:00:00Z"


def record(page_id: Column, url: Column, html: Column, date: str = NO_DATE) -> Column:
    """A page as the text of a WARC resource record."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def _file(file_ids: int) -> Column:
    nameless = -1 - F.conv(F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 3), 16, 10).cast("long") % NAMELESS
    return F.coalesce(F.floor(F.col("page_id") / file_ids).cast("long"), nameless).alias("file")


def laid_out(pages: DataFrame, file_ids: int = FILE_IDS) -> DataFrame:
    """page_id, file, number, offset, length, digest (SHA-256) of every page's record; file_ids consecutive ids share a file."""
    whole = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), _file(file_ids), F.octet_length(whole).cast("long").alias("length"), F.sha2(whole.cast("binary"), 256).alias("digest"))
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    return rows.select("page_id", "file", (F.row_number().over(order) - 1).cast("long").alias("number"), (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"), "length", "digest")


def write_warc(pages: DataFrame, path: str, file_ids: int = FILE_IDS) -> None:
    """Uncompressed WARC files, one folder file=N for each, records in offset order."""
    rows = pages.select(_file(file_ids), "page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("value"))
    rows = rows.repartition("file").sortWithinPartitions("file", "page_id", F.sha2(F.col("value").cast("binary"), 256))
    # A record's last line feed is what Spark's writer puts after each row.
    rows.select("file", F.substring("value", F.lit(1), F.length("value") - 1).alias("value")).write.partitionBy("file").text(path)


def _record_starts(table: pa.Table) -> pa.Table:
    """Follows a file's records from one to the next: a piece starts a record where the record before it ends by its declared length, or where none is declared."""
    table = table.sort_by("piece_number")
    number, due, numbers = -1, None, []
    for at, declared in zip(table.column("at").to_pylist(), table.column("declared").to_pylist(), strict=True):
        if due is None or at >= due:
            number, due = number + 1, at + declared if declared is not None else None
        numbers.append(number)
    return pa.table([table.column("file"), table.column("piece_number"), pa.array(numbers, pa.int64())], names=["file", "piece_number", "number"])


def read_warc(spark, path: str) -> DataFrame:
    """file, number, offset, length, digest of the records of files written by write_warc, whatever their content.

    Spark's reader splits files at every version line; a record's declared
    Content-Length then tells which pieces belong to it. Without one, or with
    one that is too small, a record ends at the next version line; one that is
    too large takes in the records up to there. Of a file only the pieces'
    lengths, not their bytes, go to one task.
    """
    version = "WARC/1.0\r\n"
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = spark.read.option("lineSep", version).text(path).select(F.col("file").cast("long"), F.col("value").cast("binary").alias("piece"), place.alias("place"))
    # Stored once: numbers of a plan that runs twice needn't agree.
    rows = stored(rows.where(F.octet_length("piece") > 0), "pieces")
    order = Window.partitionBy("file").orderBy("place")
    size = (F.octet_length("piece") + len(version)).cast("long")
    head = F.substring_index(F.col("piece").cast("string"), "\r\n\r\n", 1)
    content = F.regexp_extract(head, r"(?im)^Content-Length:[ \t]*([0-9]+)", 1)
    declared = F.when(content != "", len(version) + F.octet_length(head) + 8 + content.cast("long"))
    sizes = rows.select("file", "place", size.alias("size"), declared.alias("declared"))
    sizes = sizes.select("file", "place", F.row_number().over(order).alias("piece_number"), (F.sum("size").over(order) - F.col("size")).alias("at"), "declared")
    starts = sizes.select("file", "piece_number", "at", "declared").groupBy("file").applyInArrow(_record_starts, "file long, piece_number int, number long")
    numbered = sizes.select("file", "place", "piece_number").join(starts, ["file", "piece_number"])
    rows = rows.select("file", "place", "piece").join(numbered, ["file", "place"])
    pieces = F.sort_array(F.collect_list(F.struct("piece_number", F.concat(F.lit(version).cast("binary"), F.col("piece")).alias("bytes"))))
    whole = rows.groupBy("file", "number").agg(F.aggregate(pieces, F.lit(b""), lambda acc, x: F.concat(acc, x["bytes"])).alias("whole"))
    rows = whole.select("file", "number", F.octet_length("whole").cast("long").alias("length"), F.sha2("whole", 256).alias("digest"))
    order = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("file", "number", (F.sum("length").over(order) - F.col("length")).alias("offset"), "length", "digest")


def agreed_shape(first: DataFrame, second: DataFrame, fanout: int = FANOUT) -> list[str]:
    """The column that each level above the records divides, alike for both replicas: number until every file is one node, then file up to a common root."""
    both = first.select("file", "number").unionByName(second.select("file", "number"))
    ends = both.agg(*[f(c).alias(f"{name}_{c}") for c in ("number", "file") for name, f in (("low", F.min), ("high", F.max))]).first()
    shape = []
    for column in ("number", "file"):
        low, high = ends[f"low_{column}"], ends[f"high_{column}"]
        while low != high:
            shape.append(column)
            low, high = (x // fanout if x >= 0 else -(-x // fanout) for x in (low, high))
    return shape


def merkle_levels(records: DataFrame, shape: list[str], fanout: int, own: Scratch) -> list[DataFrame]:
    """Tables (file, number, hash) from leaves to root; the parent of a node divides the level's column of the shape by fanout."""
    leaf = F.sha2(F.concat_ws(":", "offset", "length", "digest"), 256)
    levels = [own.stored(records.select("file", "number", leaf.alias("hash")), "level")]
    for column in shape:
        levels.append(own.stored(_parents(levels[-1], column, fanout), "level"))
    return levels


def _parent(column: str, fanout: int) -> Column:
    """The quotient rounded towards 0, so that negative file numbers reach the root too."""
    return F.expr(f"{column} div {fanout}")


def _parent_key(column: str, fanout: int) -> list[Column]:
    """File and number of a node's parent."""
    return [_parent(c, fanout) if c == column else F.col(c) for c in ("file", "number")]


def _parents(level: DataFrame, column: str, fanout: int) -> DataFrame:
    children = F.sort_array(F.collect_list(F.struct("file", "number", "hash")))
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["file"].cast("string"), x["number"].cast("string"), x["hash"])), ",")
    return level.select(*[k.alias(f"k{i}") for i, k in enumerate(_parent_key(column, fanout))], "file", "number", "hash").groupBy(F.col("k0").alias("file"), F.col("k1").alias("number")).agg(F.sha2(joined(children), 256).alias("hash"))


def mismatches(first: list[DataFrame], second: list[DataFrame], shape: list[str], fanout: int, own: Scratch) -> DataFrame:
    """(file, number) of the records whose leaves differ or that one replica lacks. Both trees have the shape."""

    def differing(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.select("file", "number", F.col("hash").alias("ours")).join(b.select("file", "number", F.col("hash").alias("theirs")), ["file", "number"], "full")
        return both.where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("file", "number")

    wrong = differing(first[-1], second[-1])
    for level in range(len(shape) - 1, -1, -1):
        if wrong.isEmpty():
            return wrong
        parent_file, parent_number = _parent_key(shape[level], fanout)
        wanted = wrong.select(F.col("file").alias("pf"), F.col("number").alias("pn"))
        below = [x[level].withColumn("pf", parent_file).withColumn("pn", parent_number).join(wanted, ["pf", "pn"], "left_semi") for x in (first, second)]
        wrong = own.stored(differing(*below), "wrong") if level else differing(*below)
    return wrong


def audit(records: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The records of both sides, with side (both, records or replica) and intact: whether both hold the same bytes at the same place.

    Columns are those of records; where only the replica has a record, they are
    the replica's.
    """
    shape = agreed_shape(records, replica, fanout)
    with scratch() as own:
        ours, theirs = merkle_levels(records, shape, fanout, own), merkle_levels(replica, shape, fanout, own)
        wrong = stored(mismatches(ours, theirs, shape, fanout, own), "wrong")
    wrong = wrong.withColumn("wrong", F.lit(True))
    found = records.join(wrong, ["file", "number"], "left")
    found = found.join(replica.select("file", "number", F.lit(True).alias("twin")).join(wrong.select("file", "number"), ["file", "number"], "left_semi"), ["file", "number"], "left")
    found = found.withColumn("side", F.when(F.col("wrong") & F.col("twin").isNull(), "records").otherwise("both")).withColumn("intact", F.col("wrong").isNull()).drop("wrong", "twin")
    extra = replica.join(wrong.select("file", "number"), ["file", "number"], "left_semi").join(records.select("file", "number"), ["file", "number"], "left_anti")
    return found.unionByName(extra.withColumn("side", F.lit("replica")).withColumn("intact", F.lit(False)).select(*[c for c in found.columns if c in (*replica.columns, "side", "intact")]), allowMissingColumns=True)
