"""Exact n-gram Jaccard join through a token-group matrix.

A document's set holds its distinct word shingles. Documents with equal sets
form a class, and everything below works on classes.

1. Order. Shingles are ordered by how many documents hold them (for the most
   frequent ones; the others count as rare), then by hash. Two sets that are
   similar enough share a shingle among the first `n - ceil(t * n) + 1` of
   each, whatever the order; in this order these are rare ones.
2. Leaders. Each class is compared with the leader of some of its leading
   shingles: first the class whose shingles are the most common ones, then one
   drawn at random. Verified links connect families of near copies without
   comparing all their pairs.
3. Matrix. What is left are leading shingles shared by classes of different
   components. Similar classes are put into groups of bounded size, the
   columns of the token-group matrix. Of every class a fixed part of its
   shingles is stored as a compact set of 32-bit numbers; a group's cell is the
   union of these. What a query's compact set lacks in the union, it lacks in
   every member, which bounds the overlaps; the same is then asked of the single
   members. Only groups and members that pass are opened, that is, get their
   whole sets from the texts. Leaders are asked in the same way, as groups of
   one. Pairs inside one component need no comparison, as only components are
   asked for.

The bound is exact: shingles outside the fixed part, and different ones with
one number, count as shared. Every pair of classes that could link is either compared exactly or already in
one component, so the components are those of all links.

Shingles are 64-bit hashes; classes are 64-bit sums of mixed hashes.

Defined results: null text has no words; a text with fewer words than a
shingle is one shingle of its own length; a text without words has an empty
set and links with nothing; repeated rows give a row each; component_id of a
component whose doc_ids are all null is null; an empty table gives an empty
result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.llm import text as texts
from meterbook.llm.components import components
from meterbook.llm.frequent import most_frequent
from meterbook.llm.workspace import Scratch, scratch, stored

#: Most frequent shingles whose frequency is used for the order (16 bytes each in every task).
FREQUENT = 1 << 20
LEADER_ROUNDS = 2
#: Classes of a group and queries of a cell; one with more than GROUP_SHINGLES shingles counts as several.
GROUP_CLASSES = 64
CELL_QUERIES = 256
GROUP_SHINGLES = 1024
#: Assignments of classes to cells are broadcast up to this size and joined by shuffle beyond.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Similarity:
    """Shingles of `width` words; sets link when whole * intersection >= part * union."""

    width: int = 5
    part: int = 80
    whole: int = 100

    def least(self, n: np.ndarray) -> np.ndarray:
        """ceil(part / whole * n): the overlap that a set of n shingles needs."""
        return -(-n * self.part // self.whole)

    def link(self, overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.whole * overlap >= self.part * (a + b - overlap)

    @property
    def compact_bits(self) -> int:
        """A compact set takes one shingle in 2**bits: twice the share that two similar sets of one size may lack of each other."""
        lack = 2 * (self.whole - self.part) / (self.whole + self.part)
        return max(0, int(np.floor(-np.log2(lack)))) if lack > 0 else 6


@dataclass
class Sets:
    """codes[first[i]:first[i + 1]] are document i's distinct shingles in ascending order."""

    codes: np.ndarray
    first: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.sizes)

    def keys(self) -> np.ndarray:
        """A hash of each set; 0 for empty ones."""
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(texts.mix(self.codes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        keys = texts.mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.sizes.astype(np.uint64))
        return np.where(self.sizes > 0, np.maximum(keys, np.uint64(1)), np.uint64(0))

    def compact(self, bits: int) -> list[bytes]:
        """Of each set, the distinct upper halves of the shingles whose lowest bits are 0, in ascending order."""
        chosen = np.flatnonzero(self.codes & np.uint64((1 << bits) - 1) == 0)
        codes, owner = (self.codes[chosen] >> np.uint64(32)).astype(np.uint32), self.owner()[chosen]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
        codes, first = codes[new], np.searchsorted(owner[new], np.arange(len(self.first))).tolist()
        return [codes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]


def sets_of(column: pa.Array, width: int) -> Sets:
    words = texts.words_of(column, fold_case=True)
    count = np.diff(words.first)
    codes, _, owner = words.windows(width)
    codes, owner = [codes], [owner]
    for n in range(1, width):
        if (count == n).any():
            c, _, o = words.windows(n)
            short = count[o] == n
            codes.append(texts.mix(c[short] + np.uint64(n)))
            owner.append(o[short])
    codes, owner = np.concatenate(codes), np.concatenate(owner)
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    codes, owner = codes[new], owner[new]
    return Sets(codes, np.searchsorted(owner, np.arange(len(column) + 1)))


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def _once(keys: np.ndarray) -> np.ndarray:
    """Whether each key is the first of its kind and not of an empty set."""
    once = np.zeros(len(keys), bool)
    once[np.unique(keys, return_index=True)[1]] = True
    return once & (keys != 0)


def _features(rows: DataFrame, like: Similarity, screen: Screen) -> DataFrame:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.chunks(batch):
                sets = sets_of(part.column("text"), like.width)
                yield pa.record_batch([part.column("doc_id"), part.column("mark"), pa.array(sets.sizes), pa.array(texts.signed(sets.keys())), pa.array(screen.kept(sets), pa.binary())], ["doc_id", "mark", "n_shingles", "key", "compact"])

    return rows.mapInArrow(features, "doc_id long, mark long, n_shingles long, key long, compact binary")


def _frequent(rows: DataFrame, like: Similarity, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles by frequency, at most limit of them: those of all documents' heads (half as many again as can lead), and those that a task finds twice at once."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.chunks(batch):
                sets = sets_of(part.column("text"), like.width)
                sizes, owner = sets.sizes, sets.owner()
                head = (sizes - like.least(sizes) + 1) * 3 // 2 + 8
                rank = np.arange(len(owner)) - sets.first[owner]
                once = _once(sets.keys())[owner]
                values, counts = np.unique(sets.codes[once], return_counts=True)
                taken = (counts > 1) | np.isin(values, sets.codes[once & (rank < head[owner])], assume_unique=False)
                values, counts = values[taken], counts[taken]
                yield pa.record_batch([pa.array(texts.signed(values)), pa.array(counts)], ["value", "n"])

    return most_frequent(rows.select("text").mapInArrow(heads, "value long, n long"), 8, limit)


def _leading(rows: DataFrame, like: Similarity, limit: int) -> DataFrame:
    """(shingle, key, n, common): the leading shingles of every class, its size, and how common its shingles are (the mean logarithm of their frequencies, in hundredths)."""
    shared = rows.sparkSession.sparkContext.broadcast(_frequent(rows, like, limit))

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, weights = shared.value
        for batch in batches:
            for part in texts.chunks(batch):
                sets = sets_of(part.column("text"), like.width)
                keys, sizes, owner = sets.keys(), sets.sizes, sets.owner()
                taken = _once(keys)[owner]
                codes, owner = sets.codes[taken], owner[taken]
                weight = np.zeros(len(codes), np.int64)
                if len(values):
                    at = np.minimum(np.searchsorted(values, codes), len(values) - 1)
                    weight = np.where(values[at] == codes, weights[at], 0)
                common = np.bincount(owner, np.log2(1 + weight), len(sizes)) * 100 / np.maximum(sizes, 1)
                order = np.lexsort((codes, weight, owner))
                codes, owner = codes[order], owner[order]
                rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
                lead = rank < (sizes - like.least(sizes) + 1)[owner]
                yield pa.record_batch([pa.array(texts.signed(codes[lead])), pa.array(texts.signed(keys[owner[lead]])), pa.array(sizes.astype(np.int32)[owner[lead]]), pa.array(common.astype(np.int32)[owner[lead]])], ["shingle", "key", "n", "common"])

    return rows.select("text").mapInArrow(leading, "shingle long, key long, n int, common int")


def _matrix(members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The union of sets in ascending order, and a row for each of its entries with a column for each set."""
    union, at = np.unique(np.concatenate(members), return_inverse=True)
    matrix = np.zeros((len(union), len(members)), bool)
    matrix[at, np.repeat(np.arange(len(members)), [len(s) for s in members])] = True
    return union, matrix


def _hits(union: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The rows of the union that a set holds."""
    if not len(union):
        return np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(union, own), len(union) - 1)
    return place[union[place] == own]


def open_cell(query: np.ndarray, part: np.ndarray, sizes: np.ndarray, compact: list[np.ndarray], like: Similarity) -> np.ndarray:
    """Whether each query and each member of a cell may have a link to one of another part, by their compact sets."""
    members = np.flatnonzero(~query)
    may = np.zeros(len(query), bool)
    if not len(members) or not query.any():
        return may
    union, matrix = _matrix([compact[i] for i in members])
    held = np.array([len(compact[i]) for i in members])
    for q in np.flatnonzero(query).tolist():
        own, n = compact[q], int(sizes[q])
        hits = _hits(union, own)
        if n - (len(own) - len(hits)) < like.least(sizes[q : q + 1])[0]:
            continue  # what the query lacks in the union, it lacks in every member
        shared = matrix[hits].sum(axis=0, dtype=np.int64)
        overlap = np.minimum(n - len(own) + shared, sizes[members] - held + shared)
        passed = members[like.link(overlap, n, sizes[members]) & (part[members] != part[q])]
        may[passed] = True
        may[q] = len(passed) > 0
    return may


def compare_cell(keys: np.ndarray, query: np.ndarray, part: np.ndarray, sets: list[np.ndarray], like: Similarity) -> list[tuple[int, int]]:
    """(query's key, member's key): for each query of a cell, one link to each part in which it has any; parts are known to be connected."""
    members = np.flatnonzero(~query)
    if not len(members) or not query.any():
        return []
    sizes = np.array([len(s) for s in sets])
    union, matrix = _matrix([sets[i] for i in members])
    links = []
    for q in np.flatnonzero(query).tolist():
        hits = _hits(union, sets[q])
        if len(hits) < like.least(sizes[q : q + 1])[0]:
            continue
        overlap = matrix[hits].sum(axis=0, dtype=np.int64)
        linked = members[like.link(overlap, sizes[q], sizes[members]) & (part[members] != part[q])]
        linked = linked[np.unique(part[linked], return_index=True)[1]]
        links += [(int(keys[q]), k) for k in keys[linked].tolist()]
    return links


class Screen(Protocol):
    """What is kept of each set, which of its shingles lead it, and what that rules out."""

    def kept(self, sets: Sets) -> list[bytes]:
        """Of each set, what is stored for its class as `compact`."""

    def leading(self, rows: DataFrame, classes: DataFrame, limit: int) -> DataFrame:
        """(shingle, key, n, common) of every class: two similar sets share one. limit: most frequent values that order them."""

    def may(self, query: np.ndarray, part: np.ndarray, sizes: np.ndarray, kept: list[bytes]) -> np.ndarray:
        """Whether each query and each member of a cell may have a link to one of another part."""


@dataclass(frozen=True)
class CompactSets:
    """The screen of the token-group matrix."""

    like: Similarity

    def kept(self, sets: Sets) -> list[bytes]:
        return sets.compact(self.like.compact_bits)

    def leading(self, rows: DataFrame, classes: DataFrame, limit: int) -> DataFrame:
        return _leading(rows, self.like, limit)

    def may(self, query: np.ndarray, part: np.ndarray, sizes: np.ndarray, kept: list[bytes]) -> np.ndarray:
        return open_cell(query, part, sizes, [np.frombuffer(b, np.uint32) for b in kept], self.like)


def _opened(classes: DataFrame, cells: DataFrame, screen: Screen) -> DataFrame:
    """The rows of cells (cell, key, part, query) that the screen doesn't rule out."""

    def opened(table: pa.Table) -> pa.Table:
        may = screen.may(table.column("query").to_numpy(), table.column("part").to_numpy(), table.column("n").to_numpy(), table.column("compact").to_pylist())
        return table.select(["cell", "key", "part", "query"]).filter(pa.array(may))

    return cells.join(classes.select("key", "n", "compact"), "key").groupBy("cell").applyInArrow(opened, "cell long, key long, part long, query boolean")


def _verified(rows: DataFrame, classes: DataFrame, cells: DataFrame, like: Similarity, screen: Screen, broadcast_bytes: int, own: Scratch) -> DataFrame:
    """Links (a, b) found in cells (cell, key, part, query); whole sets are computed from one document of each class that is still in question."""
    wanted = own.stored(_opened(classes, cells, screen).groupBy("key").agg(F.first("part").alias("part"), F.collect_set(F.struct("cell", "query")).alias("cells")).join(classes.select("key", "doc_id", "mark"), "key"), "cells")
    size = wanted.agg(F.sum(96 + 40 * F.size("cells"))).first()[0] or 0
    chosen = wanted.select(F.col("doc_id").alias("w_id"), F.col("mark").alias("w_mark"), "key", "part", "cells")
    chosen = F.broadcast(chosen) if size <= broadcast_bytes else chosen.hint("merge")
    picked = rows.join(chosen, (F.col("mark") == F.col("w_mark")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("key", "part", "cells.cell", "cells.query", "text")

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.chunks(batch):
                sets = sets_of(part.column("text"), like.width)
                bodies = [sets.codes[a:b].tobytes() for a, b in zip(sets.first[:-1].tolist(), sets.first[1:].tolist(), strict=True)]
                of = np.repeat(np.arange(part.num_rows), part.column("cell").value_lengths().to_numpy())
                yield pa.record_batch([part.column("cell").flatten(), part.column("query").flatten(), part.column("key").take(pa.array(of)), part.column("part").take(pa.array(of)), pa.array([bodies[i] for i in of.tolist()], pa.binary())], ["cell", "query", "key", "part", "body"])

    def compare(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(b.as_py(), np.uint64) for b in table.column("body")]
        links = compare_cell(table.column("key").to_numpy(), table.column("query").to_numpy(), table.column("part").to_numpy(), sets, like)
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["a", "b"])

    return own.stored(picked.mapInArrow(ship, "cell long, query boolean, key long, part long, body binary").groupBy("cell").applyInArrow(compare, "a long, b long"), "links")


def _sizes_fit(like: Similarity, a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.lit(like.whole) * F.least(a, b).cast("long") >= F.lit(like.part) * F.greatest(a, b).cast("long")


def _with_component(df: DataFrame, found: DataFrame) -> DataFrame:
    return df.join(found.select(F.col("node").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))


def ngram_components(documents: DataFrame, like: Similarity = Similarity(), frequent: int = FREQUENT, rounds: int = LEADER_ROUNDS, broadcast_bytes: int = BROADCAST_BYTES, screen: Screen | None = None) -> DataFrame:  # noqa: B008
    """doc_id, mark (hash of the text), n_shingles, component, component_id of every document.

    component numbers the components (null for texts without words);
    component_id is the smallest doc_id of each.
    """
    rows, screen = _rows(documents), screen or CompactSets(like)
    with scratch() as own:
        features = own.stored(_features(rows, like, screen), "features")
        named = own.stored(_named_classes(rows, features, like, screen, frequent, rounds, broadcast_bytes, own), "named")
        some = features.where("n_shingles > 0").join(named, "key").select("doc_id", "mark", "n_shingles", "component", "component_id")
        none = features.where("n_shingles = 0").select("doc_id", "mark", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
        return stored(some.unionByName(none), "components")


def _named_classes(rows: DataFrame, features: DataFrame, like: Similarity, screen: Screen, frequent: int, rounds: int, broadcast_bytes: int, own: Scratch) -> DataFrame:
    """key, component, component_id of every class."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    classes = features.where("n_shingles > 0").groupBy("key").agg(first.alias("one"), F.first("n_shingles").alias("n"), F.first("compact").alias("compact"))
    classes = own.stored(classes.select("key", "n", "compact", "one.doc_id", "one.mark"), "classes")

    leading = own.stored(screen.leading(rows, classes, frequent), "leading")
    held = own.stored(leading.groupBy("shingle").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("shingle"), "held")
    lists = own.stored(leading.join(held, "shingle").distinct(), "lists")
    own.release(leading)

    spark = rows.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    found = spark.createDataFrame([], "node long, component long")
    for turn in range(rounds):
        placed = own.stored(_with_component(lists, found), "placed")
        # First the class whose shingles are the most common ones, as an original is among its copies; then one at random.
        order = F.struct(-F.col("common"), F.xxhash64("key")) if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "component", "key"))
        leaders = own.stored(placed.groupBy("shingle").agg(F.min(F.struct(order.alias("h"), "component", "key", "n")).alias("l"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("shingle", F.col("l.key").alias("leader"), F.col("l.component").alias("at"), F.col("l.n").alias("leader_n")), "leaders")
        pairs = placed.join(leaders, "shingle").where("component <> at").where(_sizes_fit(like, F.col("n"), F.col("leader_n"))).groupBy("key", "leader").agg(F.count(F.lit(1)).alias("shared"))
        pairs = own.stored(pairs.groupBy("key").agg(F.max(F.struct("shared", "leader")).alias("best")).select("key", F.col("best.leader").alias("leader")), "pairs")
        own.release(placed)
        own.release(leaders)
        slices = pairs.groupBy("leader").agg(F.expr(f"(count(1) + {CELL_QUERIES - 1}) div {CELL_QUERIES}").alias("slices"))
        slices = own.stored(slices, "slices")
        asked = pairs.join(slices, "leader").select(F.xxhash64("leader", F.pmod(F.xxhash64("key"), "slices")).alias("cell"), "key", F.col("key").alias("part"), F.lit(True).alias("query"))
        given = slices.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("s"), "leader").select(F.xxhash64("leader", "s").alias("cell"), F.col("leader").alias("key"), F.col("leader").alias("part"), F.lit(False).alias("query"))
        links = links.unionByName(_verified(rows, classes, asked.unionByName(given), like, screen, broadcast_bytes, own))
        found = components(links)
        own.tables.append(found)

    placed = own.stored(_with_component(lists, found), "placed")
    found = components(links.unionByName(_verified(rows, classes, _matrix_cells(placed, like, own), like, screen, broadcast_bytes, own)))
    own.tables.append(found)

    named = own.stored(_with_component(classes.select("key", "doc_id"), found), "named")
    least = own.stored(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return named.join(least, "component").select("key", "component", "component_id")


def one_of_each(documents: DataFrame, like: Similarity = Similarity(), broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:  # noqa: B008
    """documents with one row of each component, with all its columns: that of the smallest doc_id (null last).

    Of rows with that doc_id and text, the one whose columns come first as JSON
    stays. Texts without words all stay.
    """
    with scratch() as own:
        found = ngram_components(documents, like, broadcast_bytes=broadcast_bytes)
        own.tables.append(found)
        members = own.stored(found.where("component is not null").groupBy("component", "doc_id", "mark").agg(F.count(F.lit(1)).alias("rows")), "members")
        first = own.stored(members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")).select("component", F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark")), "first")
        judged = members.join(first, "component").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark")))
        judged = stored(judged.where("not stays or rows > 1").select(F.col("doc_id").alias("j_id"), F.col("mark").alias("j_mark"), "stays"), "judged")
    small = 40 * judged.count() <= broadcast_bytes
    judged = F.broadcast(judged) if small else judged.hint("merge")
    columns = [F.col(f"`{c}`") for c in documents.columns]
    rows = documents.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("m"))
    rows = rows.join(judged, (F.col("m") == F.col("j_mark")) & F.col("i").eqNullSafe(F.col("j_id")), "left")
    again = rows.where("stays").groupBy("i", "m").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows.where("stays is null").select("row.*").unionByName(again.select("row.*"))


def _matrix_cells(placed: DataFrame, like: Similarity, own: Scratch) -> DataFrame:
    """(cell, key, part, query) for all pairs of a class and a group that holds another component and shares a leading shingle with it.

    Large components are cut into groups; other classes are grouped with those
    that share their longest list. Long lists that start with the same class
    count as one list, so that near copies don't meet once for each shingle.
    """
    across = placed.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("key").alias("first"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    across = own.stored(across.select("shingle", "size", F.when(F.col("size") >= GROUP_CLASSES, F.xxhash64(F.lit("list"), "first")).otherwise(F.col("shingle")).alias("list")), "across")
    lists = placed.join(across, "shingle").groupBy("list", "key", "component", "n").agg(F.max("size").alias("size"))
    lists = own.stored(lists.withColumn("weight", F.greatest(F.lit(1.0), F.col("n") / GROUP_SHINGLES)), "lists")
    members = lists.groupBy("key", "component", "weight").agg(F.max(F.struct("size", "list"))["list"].alias("longest"))
    large = own.stored(placed.select("component", "key").distinct().groupBy("component").agg(F.count(F.lit(1)).alias("classes")).where(F.col("classes") >= GROUP_CLASSES), "large")
    members = members.join(large, "component", "left").withColumn("family", F.when(F.col("classes").isNull(), F.xxhash64(F.lit("list"), "longest")).otherwise(F.xxhash64(F.lit("component"), "component")))
    members = own.stored(members.select("key", "component", "weight", "family"), "members")
    families = own.stored(members.groupBy("family").agg(F.ceil(F.sum("weight") / GROUP_CLASSES).alias("slices")), "families")
    grouped = members.join(families, "family").select("key", "component", "weight", F.xxhash64("family", F.pmod(F.xxhash64("key"), "slices")).alias("group"))
    grouped = own.stored(grouped, "grouped")
    placed_groups = lists.join(grouped.select("key", "group"), "key")
    groups = own.stored(placed_groups.groupBy("list", "group").agg(F.min("component").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi")), "groups")
    # Of two components the greater one asks; sizes must allow the similarity.
    fits = (F.lit(like.whole) * F.col("hi").cast("long") >= F.lit(like.part) * F.col("n").cast("long")) & (F.lit(like.whole) * F.col("n").cast("long") >= F.lit(like.part) * F.col("lo").cast("long"))
    asked = lists.join(groups, "list").where((F.col("component") > F.col("c")) & fits).select("key", F.col("component").alias("part"), "weight", "group").distinct()
    asked = own.stored(asked, "asked")
    slices = own.stored(asked.groupBy("group").agg(F.ceil(F.sum("weight") / CELL_QUERIES).alias("slices")), "slices")
    queries = asked.join(slices, "group").select(F.xxhash64("group", F.pmod(F.xxhash64("key"), "slices")).alias("cell"), "key", "part", F.lit(True).alias("query"))
    opened = grouped.join(slices, "group").select("key", F.col("component").alias("part"), "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("s"))
    return queries.unionByName(opened.select(F.xxhash64("group", "s").alias("cell"), "key", "part", F.lit(False).alias("query")))
