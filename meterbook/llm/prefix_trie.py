"""The trie of conversation prefixes, with sums over its subtrees.

1. Each turn becomes a digest of its role and text where it is read, so that
   only digests and word counts are shuffled. In a partition sorted by
   conversation and turn, digests are chained: that of a prefix is the SHA-256
   of the digest before and of the turn. The chain is a stream, so a
   conversation of any length needs no more memory than a short one.
2. Conversations that end in the same prefix are equal; one of them stands for
   all, with their number. Its prefixes are exploded, and grouped by (depth,
   digest) they are the nodes.
3. A run of nodes with the same members is one segment: only its first node,
   where the number of members changes, is exploded to its ancestors, which are
   first nodes too. As each segment ends where conversations part or end, the
   pairs are at most about twice the distinct turns, however long conversations
   are. A node's own sums are those of its segment less what stands above it.

Turns are in the order of turn (null first), role and digest. Role and text
are empty where they are null.

Defined results: rows without conv_id are left out; repeated turns count as
many times as they stand there; a conversation without turns ends at the root;
an empty table has no nodes, not even a root. Columns other than conv_id, turn,
role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterbook.llm.native import WORD
from meterbook.llm.workspace import Scratch, scratch, stored

#: The digest of the root, which has no turns.
ROOT = hashlib.sha256(b"").digest()
#: Ids that differ by less may share a chunk of the list of a node's conversations: as many ids at most.
CHUNK_IDS = 1 << 16
_NODE = ["depth", "digest"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, words of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def whole(rows: DataFrame) -> DataFrame:
    """The turns of conversations as they are, for `trie`."""
    return rows.select("*", F.lit(True).alias("own"), F.lit(0).cast("long").alias("skip"))


def branched(rows: DataFrame, stride: int, most: int) -> DataFrame:
    """The turns of conversations whose first h turns are replaced by those of conversation c - c % stride; h is a hash of c below most.

    own tells a conversation's own turns from borrowed ones; of the own ones the
    first `skip` are to be left out.
    """
    base, h = F.col("conv_id") - F.col("conv_id") % stride, F.crc32(F.col("conv_id").cast("string")) % most
    borrows = F.col("conv_id") % stride != 0
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest"))
    heads = rows.where(~borrows).withColumn("place", place).where(F.col("place") < most).withColumnRenamed("conv_id", "base")
    ids = rows.select("conv_id").distinct().where(borrows & (h > 0)).select("conv_id", base.alias("base"), h.alias("h"))
    borrowed = ids.join(heads, "base").where("place <= h").select("conv_id", "turn", "role", "digest", "words", F.lit(False).alias("own"), F.lit(0).cast("long").alias("skip"))
    return rows.select("*", F.lit(True).alias("own"), F.when(borrows, h).otherwise(0).cast("long").alias("skip")).unionByName(borrowed)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each prefix of each conversation of a sorted partition; ends marks the whole conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("digest", pa.binary()), ("parent", pa.binary()), ("words", pa.int64()), ("ends", pa.bool_())])
    last: list | None = None
    left_out = 0
    for batch in batches:
        out = []
        for conv_id, own, skip, digest, words in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "own", "skip", "digest", "words")], strict=True):
            if last is None or last[0] != conv_id:
                if last is not None:
                    out.append((*last, True))
                last, left_out = [conv_id, 0, ROOT, None, 0], 0
            if own and left_out < skip:
                left_out += 1
                continue
            out.append((*last, False))
            last = [conv_id, last[1] + 1, hashlib.sha256(last[2] + digest).digest(), last[2], words]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*last, True), schema, strict=True)], schema=schema)


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, digest, parent, words (of the last turn), ends: every prefix of every conversation of `whole` or `branched`."""
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "own", F.col("turn").asc_nulls_first(), "role", "digest")
    return dealt.select("conv_id", "own", "skip", "digest", "words").mapInArrow(_chained, "conv_id long, depth int, digest binary, parent binary, words long, ends boolean")


def _ends_hashes(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids of the conversations that end at each node. The chunks of a node's list are hashed one after the other as they stream by."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for depth, digest, ids in zip(*[batch.column(c).to_pylist() for c in ("depth", "digest", "ids")], strict=True):
                if node == (depth, digest):
                    state.update(b",")
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (depth, digest), hashlib.sha256()
                state.update(ids.encode())
            yield _hash_rows(out)
        if node:
            yield _hash_rows([(*node, state.hexdigest())])

    chunks = rows.where("ends").groupBy(*_NODE, F.floor(F.col("conv_id") / CHUNK_IDS).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    return chunks.repartition(*_NODE).sortWithinPartitions(*_NODE, "chunk").select(*_NODE, "ids").mapInArrow(hashed, "depth int, digest binary, ends_sha256 string")


def _hash_rows(rows: list[tuple[int, bytes, str]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.string()), strict=True)], ["depth", "digest", "ends_sha256"])


def trie(rows: DataFrame) -> DataFrame:
    """Every node: depth, digest, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    n_leaves and saved_tokens are sums over the node's subtree: of childless
    nodes, and of the words of each node's last turn times its members but one.
    """
    with scratch() as own:
        return stored(_nodes(own.stored(prefixes(rows), "prefixes"), own), "trie")


def _nodes(chains: DataFrame, own: Scratch) -> DataFrame:
    different = own.stored(chains.where("ends").groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")), "different")
    total, least = different.agg(F.sum("copies"), F.min("conv_id")).first()
    result = "depth int, digest binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if total is None:
        return chains.sparkSession.createDataFrame([], result)

    # The root is every path's first node; it is put back at the end.
    paths = own.stored(chains.where("depth > 0").join(different.select("conv_id", "copies"), "conv_id"), "paths")
    nodes = paths.groupBy(*_NODE).agg(F.min("conv_id").alias("node"), F.sum("copies").alias("n_convs"))
    along = Window.partitionBy("conv_id").orderBy("depth")
    above, so_far = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, 0)
    root = F.lit(ROOT)
    marked = paths.join(nodes, _NODE).withColumn("weight", (F.col("n_convs") - 1) * F.col("words"))
    marked = marked.withColumn("head", F.col("n_convs") != F.coalesce(F.lag("n_convs").over(along), F.lit(total))).withColumn("above_node", F.coalesce(F.lag("node").over(along), F.lit(least))).withColumn("before", F.coalesce(F.sum("weight").over(above), F.lit(0)))
    at_head = F.last(F.when(F.col("head"), F.struct("depth", "digest", "before")), ignorenulls=True).over(so_far)
    marked = marked.withColumn("top", F.coalesce(at_head, F.struct(F.lit(0).alias("depth"), root.alias("digest"), F.lit(0).cast("long").alias("before"))))
    marked = own.stored(marked.select(*_NODE, "parent", "conv_id", "node", "above_node", "n_convs", "weight", "before", "head", "top", (F.col("ends") & (F.col("copies") == F.col("n_convs"))).alias("childless")), "marked")

    # A node is described by the path of its smallest member.
    spine = marked.where("conv_id = node")
    segments = spine.groupBy("top.depth", "top.digest").agg(F.first("node").alias("conv_id"), F.sum("weight").alias("saved"), F.max(F.col("childless").cast("long")).alias("leaves"))
    heads = marked.where("head").groupBy("conv_id").agg(F.collect_list(F.struct(*_NODE)).alias("heads"))
    held = F.concat(F.array(F.struct(F.lit(0).alias("depth"), root.alias("digest"))), F.coalesce("heads", F.array().cast("array<struct<depth: int, digest: binary>>")))
    pairs = segments.join(heads, "conv_id", "left").select(F.explode(F.filter(held, lambda a: a["depth"] <= F.col("depth"))).alias("a"), "saved", "leaves")
    sums = own.stored(pairs.groupBy(F.col("a.depth").alias("top_depth"), F.col("a.digest").alias("top_digest")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("n_leaves")), "sums")

    described = spine.select(*_NODE, F.col("node").alias("conv_id"), F.col("above_node").alias("parent_conv_id"), "n_convs", F.col("top.depth").alias("top_depth"), F.col("top.digest").alias("top_digest"), (F.col("before") - F.col("top.before")).alias("offset"))
    described = described.join(sums, ["top_depth", "top_digest"]).select(*_NODE, "conv_id", "parent_conv_id", "n_convs", "n_leaves", (F.col("saved") - F.col("offset")).alias("saved_tokens"))
    top = sums.where("top_depth = 0").agg(F.coalesce(F.max("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.max("saved"), F.lit(0)).alias("saved_tokens"))
    top = top.select(F.lit(0).alias("depth"), root.alias("digest"), F.lit(least).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total).cast("long").alias("n_convs"), "n_leaves", "saved_tokens")
    children = spine.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    found = described.unionByName(top).join(children, _NODE, "left").join(_ends_hashes(chains), _NODE, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(*_NODE, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
