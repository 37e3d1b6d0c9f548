"""Mixing sources to target weights by blocks drawn for output shards.

Every source's words are laid out in a pseudorandom order of its documents and
cut into blocks of a fixed number of words. Each output shard draws how many
of its slots go to each source (a multinomial draw with the targets as
weights). The slots of one source are numbered over all shards; number j is
mapped through the source's pseudorandom permutation of block indices, a new
one for every pass over the source, and joined with the blocks by index.
Draws beyond a source's target are dropped and what a source still lacks is
put into closing shards, so that every source meets its target to the word.

Sums over the buckets of a source and over the shards are taken in chunks, so no
task sees all of them. Only tables with one row a source, and the chunks' sums,
pass through one task.

Defined results: null text has no words; a null source is one source of its
own, after all others; documents without words are never taken; repeated rows
are documents of their own; null doc_id is a value like any other; an empty
table gives empty results. Columns other than doc_id, text and source are
ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterbook.llm.native import let, words
from meterbook.llm.workspace import stored

#: Documents in one bucket of the layout, over all sources.
BUCKET_ROWS = 512
#: Rows that one task sums up in order.
CHUNK_ROWS = 4096
#: Slots that one task makes.
TASK_SLOTS = 1 << 14
_ROUNDS = 24


@dataclass(frozen=True)
class Mixture:
    """sources: source, key, weight, source_size, target, take (whole words).
    slots: shard, source's key, epoch, block, length.
    documents: doc_id, source, key, size, copies, mark (hash of the text), lo (first word's place in the source).
    pieces: doc_id, source, mark, copy, epoch, shard, first (word in the document), n_words.
    """

    sources: DataFrame
    slots: DataFrame
    documents: DataFrame
    pieces: DataFrame


def repeating_weights(documents: DataFrame, pattern: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """(source, weight): sources by code point, null last, get the pattern's weights in turn."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    values = F.array(*[F.lit(float(x)) for x in pattern])
    return documents.select("source").distinct().select("source", F.get(values, (rank % len(pattern)).cast("int")).alias("weight"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _targets(sizes: DataFrame, weights: DataFrame, share: float, cap: float) -> DataFrame:
    """min(cap * size, level * weight), with the one level at which targets sum to share * all sizes."""
    totals = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    rows = totals.join(weights.select(_key(F.col("source")).alias("key"), F.col("weight").cast("double").alias("weight")), "key", "left")
    rows = rows.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0))
    rows = rows.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.when(F.col("weight") > 0, F.col("most") / F.col("weight")).otherwise(F.lit(float("inf"))))
    by_ratio = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weighed = F.when(F.col("weight") > 0, F.col("most")).otherwise(0.0)
    rows = rows.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    rows = rows.withColumn("full", F.coalesce(F.sum(weighed).over(by_ratio), F.lit(0.0))).withColumn("done", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
    left = F.col("all_weight") - F.col("done")
    rows = rows.withColumn("level", F.when((F.col("weight") > 0) & (left > 0), (share * F.col("all_size") - F.col("full")) / left))
    # The level holds from the first source whose cap is above it; if none is, all sources are at their caps.
    rows = rows.withColumn("level", F.coalesce(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key", "level"))).over(everything)["level"], F.lit(float("inf"))))
    target = F.when(F.col("weight") > 0, F.least(F.col("most"), F.greatest(F.lit(0.0), F.col("level") * F.col("weight")))).otherwise(0.0)
    return rows.select("source", "key", "weight", "source_size", target.alias("target"), F.round(target).cast("long").alias("take"))


def _sums_before(rows: DataFrame, key: str, place: str, value: Column) -> DataFrame:
    """rows with before: the sum of the value over rows of the same key at smaller places, which are distinct numbers from 0 on."""
    rows = rows.withColumn("chunk", F.expr(f"{place} div {CHUNK_ROWS}"))
    sums = rows.groupBy(key, "chunk").agg(F.sum(value).alias("sum"))
    sums = sums.select(key, "chunk", (F.sum("sum").over(Window.partitionBy(key).orderBy("chunk")) - F.col("sum")).alias("base"))
    inside = F.sum(value).over(Window.partitionBy(key, "chunk").orderBy(place)) - value
    return rows.withColumn("inside", inside).join(sums, [key, "chunk"]).withColumn("before", F.col("base") + F.col("inside")).drop("chunk", "inside", "base")


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0..size-1 by swap-or-not rounds: a bijection for every size and key."""

    def swap(x: Column, step: Column) -> Column:
        other = F.pmod(F.xxhash64(F.lit("pair"), step, *key) - x, size)
        heads = F.pmod(F.xxhash64(F.lit("coin"), step, F.greatest(x, other), *key), F.lit(2)) == 1
        return F.when(heads, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), index.cast("long"), swap)


def mix_sources(documents: DataFrame, weights: DataFrame, share: float = 1.5, cap: float = 2.0, block_words: int = 256, shard_slots: int = 4096, seed: int = 17) -> Mixture:
    """Takes share * (all words) from the sources by weight, at most cap times a source's words.

    weights: (source, weight), weights below or equal to 0 or missing take nothing.
    """
    if cap < 0 or share < 0 or block_words < 1 or shard_slots < 1:
        raise ValueError("share and cap must not be negative, block_words and shard_slots must be positive")
    sizes = documents.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("mark"))
    sizes = stored(sizes.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("copies")).withColumn("key", _key(F.col("source"))), "sizes")
    sources = stored(_targets(sizes, weights, share, cap), "targets")

    n_buckets = max(1, sizes.count() // BUCKET_ROWS)
    order = F.xxhash64(F.lit(seed), "doc_id", "mark", "size")
    placed = sizes.where("size > 0").withColumn("order", order).withColumn("bucket", F.pmod("order", F.lit(n_buckets)))
    span = F.col("size") * F.col("copies")
    base = _sums_before(placed.groupBy("key", "bucket").agg(F.sum(span).alias("words")), "key", "bucket", F.col("words")).select("key", "bucket", F.col("before").alias("base"))
    inside = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "source", "mark", "size")
    laid = placed.withColumn("before", F.sum(span).over(inside) - span).join(base, ["key", "bucket"])
    laid = stored(laid.select("doc_id", "source", "key", "size", "mark", "copies", (F.col("base") + F.col("before")).alias("lo")), "layout")

    slots = _slots(sources, block_words, shard_slots, seed)
    b = F.lit(block_words)
    covers = laid.withColumn("block", F.explode(F.sequence(F.expr(f"lo div {block_words}"), F.expr(f"(lo + size * copies - 1) div {block_words}"))))
    # Both sides grow with the corpus; an explode's size is not estimated, so the planner must not choose.
    joined = covers.join(slots.hint("merge"), ["key", "block"])
    starts = F.greatest(F.col("lo"), F.col("block") * b)
    stops = F.least(F.col("lo") + F.col("size") * F.col("copies"), F.col("block") * b + F.col("length"))
    joined = joined.withColumn("from", starts - F.col("lo")).withColumn("to", stops - F.col("lo")).where("`to` > `from`")
    joined = joined.withColumn("copy", F.explode(F.sequence(F.expr("`from` div size"), F.expr("(`to` - 1) div size"))))
    first = F.greatest(F.col("from"), F.col("copy") * F.col("size"))
    pieces = joined.select("doc_id", "source", "mark", "copy", "epoch", "shard", (first - F.col("copy") * F.col("size")).alias("first"), (F.least(F.col("to"), (F.col("copy") + 1) * F.col("size")) - first).alias("n_words"))
    return Mixture(sources, slots, sizes, pieces)


def _slots(sources: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    spark = sources.sparkSession
    b = block_words
    plan = sources.where("take > 0 and source_size > 0").select(
        "key", "source_size", "take", F.expr(f"source_size div {b}").alias("whole"), F.expr(f"(source_size + {b - 1}) div {b}").alias("blocks"), F.expr("take div source_size").alias("epochs"), F.expr("take % source_size").alias("rest")
    )
    plan = plan.withColumn("quota", F.col("epochs") * F.col("blocks") + F.expr(f"(rest + {b - 1}) div {b}"))
    plan = plan.withColumn("quota_lo", F.coalesce(F.sum("quota").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = stored(plan, "quotas")
    n = plan.agg(F.sum("quota")).first()[0] or 0
    # Each slot draws a number below n; the source whose quota's range holds it gets the slot.
    cell = max(1, shard_slots)
    ranges = plan.select("key", "quota", "quota_lo", F.explode(F.sequence(F.expr(f"quota_lo div {cell}"), F.expr(f"(quota_lo + quota - 1) div {cell}"))).alias("cell"))
    draws = spark.range(n).select(F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(max(1, n))).alias("v")).withColumn("cell", F.expr(f"v div {cell}"))
    drawn = draws.join(ranges, "cell").where("v >= quota_lo and v < quota_lo + quota")
    counts = stored(drawn.groupBy("shard", "key").agg(F.count("*").alias("n")), "draws")
    runs = _sums_before(counts, "key", "shard", F.col("n")).select("shard", "key", F.col("before").alias("j_lo"), (F.col("before") + F.col("n")).alias("j_hi"))
    got = counts.groupBy("key").agg(F.sum("n").alias("got"))
    closing = plan.join(got, "key", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("quota > got")
    lack = F.col("quota") - F.col("got")
    lack_lo = F.sum(lack).over(Window.orderBy("key")) - lack
    last = (n + shard_slots - 1) // shard_slots
    closing = closing.withColumn("lack_lo", lack_lo).withColumn("j_lo", F.explode(F.sequence("got", F.col("quota") - 1, F.lit(shard_slots).cast("long"))))
    shard = F.lit(last) + ((F.col("lack_lo") + F.col("j_lo") - F.col("got")) / shard_slots).cast("long")
    closing = closing.select(shard.alias("shard"), "key", "j_lo", F.least(F.col("j_lo") + shard_slots, "quota").alias("j_hi"))
    numbered = runs.unionByName(closing).join(plan, "key").withColumn("j_hi", F.least("j_hi", "quota")).where("j_hi > j_lo")
    # Runs of at most shard_slots slots become rows of their own, so they are dealt out before.
    numbered = numbered.repartition(max(1, -(-n // TASK_SLOTS)), "key", "j_lo")
    numbered = numbered.withColumn("j", F.explode(F.sequence("j_lo", F.col("j_hi") - 1))).withColumn("epoch", F.expr("j div blocks")).withColumn("i", F.expr("j % blocks"))
    # A source's short last block comes last in every pass.
    block = F.when(F.col("i") < F.col("whole"), permuted(F.col("i"), F.col("whole"), F.lit(seed), F.col("key"), F.col("epoch"))).otherwise(F.col("i"))
    size = F.least(F.lit(b), F.col("source_size") - F.col("i") * b)
    length = F.when(F.col("epoch") < F.col("epochs"), size).otherwise(F.least(size, F.col("rest") - F.col("i") * b))
    return numbered.select("shard", "key", "epoch", block.alias("block"), length.alias("length"))


def taken_words(mixture: Mixture) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    taken = mixture.pieces.groupBy("doc_id", "source", "mark", "copy").agg(F.sum("n_words").alias("taken"))
    rows = mixture.documents.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    same = [rows[c].eqNullSafe(taken[c]) for c in ("doc_id", "source", "mark", "copy")]
    rows = rows.join(taken, same, "left").select(rows["doc_id"], rows["key"], "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    return rows.join(mixture.sources.select("key", "source_size", "target"), "key").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(documents: DataFrame, mixture: Mixture) -> DataFrame:
    """The mixed corpus, with the columns of documents: one row for each document and pass that takes any of its words.

    A row holds the words taken in that pass, in order, with the white space
    after each; if all are taken, the text is unchanged.
    """
    ranges = mixture.pieces.groupBy("doc_id", "source", "mark", "copy", "epoch").agg(F.sort_array(F.collect_list(F.struct("first", "n_words"))).alias("ranges"), F.sum("n_words").alias("n_taken"))
    counted = mixture.documents.select("doc_id", "source", "mark", "copies", "size")
    same = [ranges[c].eqNullSafe(counted[c]) for c in ("doc_id", "source", "mark")]
    wanted = ranges.join(counted, same).select(ranges["doc_id"].alias("w_id"), ranges["source"].alias("w_source"), ranges["mark"].alias("w_mark"), "copy", "ranges", "n_taken", "size", "copies")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.xxhash64("text").alias("row_mark"))
    own = lambda t: t["row"]["doc_id"].eqNullSafe(F.col("w_id")) & t["row"]["source"].eqNullSafe(F.col("w_source")) & (t["row_mark"] == F.col("w_mark"))
    picked = rows.join(wanted.where("copies = 1"), own(rows)).select("row", "ranges", "n_taken", "size")
    repeated = counted.where("copies > 1 and size > 0").select(F.col("doc_id").alias("w_id"), F.col("source").alias("w_source"), F.col("mark").alias("w_mark"))
    if not repeated.isEmpty():
        # Rows with one doc_id, source and text are numbered as copies, after equal rows are counted.
        equal = rows.join(repeated, own(rows), "left_semi").groupBy("row", "row_mark").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("row.doc_id", "row.source", "row_mark").orderBy(F.xxhash64("row"), F.to_json("row")))
        equal = equal.withColumn("lo", upto - F.col("n")).withColumn("number", F.explode(F.sequence("lo", F.col("lo") + F.col("n") - 1)))
        picked = picked.unionByName(equal.join(wanted.where("copies > 1"), own(equal) & (F.col("number") == F.col("copy"))).select("row", "ranges", "n_taken", "size"))
    tokens = F.regexp_extract_all(F.col("row.text"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    part = let(tokens, lambda w: F.array_join(F.flatten(F.transform("ranges", lambda r: F.slice(w, (r["first"] + 1).cast("int"), r["n_words"].cast("int")))), ""))
    text = F.when(F.col("n_taken") == F.col("size"), F.col("row.text")).otherwise(part)
    return picked.select(F.col("row").withField("text", text).alias("row")).select("row.*")
