"""Mixing sources to target weights by a low-discrepancy schedule.

The points of the golden-ratio sequence, mapped through the cumulative target
weights, say which source each slot of the mix takes from: every prefix of the
schedule holds each source in its share, without a random generator. Slots are
ranked per source, and slot r of a source takes its block r modulo the number
of blocks. Blocks are equal runs of tokens of the source's documents in
shuffled order, so a long document spans blocks and short ones share one.

Only DataFrame functions run here. A source may hold any part of all rows: its
documents are shuffled by the md5 of id and text and numbered by shards of that
md5, whose number follows the rows, its slots by segments of the schedule, so no
task holds a source. The table of sources, of one short row each, is ordered in one
task. The order depends on the rows' contents alone: a rerun agrees, whatever
order or partitions the rows come in.

Nulls: a null source is a source of its own, after all others; a null text has
size 0; a null id goes as the text `null`. Repeated rows count one by one; which
of rows alike in id, text and source has which `taken` is the same to all.
Documents of size 0 take part in no block and are returned with 0 taken. An
empty table gives an empty result. Extra columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.words import document_key, shard_digits, word_count
from meshlark.operators.cluster import materialize
from meshlark.operators.ranks import sharded_running

BLOCK_TOKENS = 128
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
GOLDEN = 2654435769  # 2^32 divided by the golden ratio
SEGMENT = 16384
SLICES = 1024


def source_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, source_id, source_size, weight, target.

    docs: source, size. Resharing what capped sources leave over until none is
    above its cap ends where each source has the lesser of its cap and a common
    level times its weight. With the sources sorted by cap/weight the capped
    ones come first; of the levels that a source left with can bear, the highest
    is the one at which no more sources are capped than need be.
    Only one row per source passes through the unpartitioned windows.
    """
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cases = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_id") - 1) % len(weights) + 1).cast("int"))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sources.withColumn("source_id", F.row_number().over(order)).withColumn("weight", cases)
    sources = sources.withColumn("cap", F.col("source_size") * float(most)).withColumn("all_words", F.sum("source_size").over(every) * share)
    steps = Window.orderBy(F.col("cap") / F.col("weight"), "source_id")
    earlier, later = steps.rowsBetween(Window.unboundedPreceding, -1), steps.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    sources = sources.withColumn("level", (F.col("all_words") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every)
    sources = sources.withColumn("held", F.coalesce(level, F.lit(float("inf"))))
    return sources.select("source", "source_id", "source_size", "weight", F.least(F.col("cap"), F.col("held") * F.col("weight")).alias("target"))


def golden(t: Column) -> Column:
    """32-bit golden-ratio point of index t, in products that stay below 2^49."""
    high = GOLDEN * 65536 % 2**32
    return (t % 65536 * GOLDEN + F.floor(t / 65536) % 65536 * high) % 2**32


def document_offsets(docs: DataFrame, digits: int = 2) -> DataFrame:
    """docs plus `start`: tokens of the source's shuffled documents before it. docs: source_id, key, size; digits: of the key, for a shard."""
    docs = docs.withColumn("shard", F.substring("key", 1, digits))
    return sharded_running(docs, ["source_id"], "shard", [F.col("key")], F.col("size"), "start").drop("shard")


def schedule(sources: DataFrame, block_tokens: int = BLOCK_TOKENS, most: int = MOST) -> DataFrame:
    """The mix as slots: slot, source_id, rank, block, epoch.

    A source needs target / size passes over its blocks, the last of which is
    short, and that many slots; shares and number of slots follow. A slot whose rank lies beyond `most` passes over the source is void: the
    points can overshoot a capped source by a slot or two.
    """
    spark = sources.sparkSession
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needs = sources.where("target > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_tokens))
    needs = needs.withColumn("need", F.col("target") * F.col("blocks") / F.col("source_size"))
    bounds = needs.withColumn("sum", F.sum("need").over(every)).withColumn("high", F.round(F.sum("need").over(running) / F.col("sum") * 2**32).cast("long"))
    bounds = bounds.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("source_id")), F.lit(0)).cast("long")).where("low < high")
    bounds = bounds.select("source_id", "low", "high", "blocks")
    wide = 2**32 // SLICES
    bounds = bounds.withColumn("slice", F.explode(F.sequence(F.floor(F.col("low") / wide), F.floor((F.col("high") - 1) / wide))))
    total = needs.agg(F.coalesce(F.ceil(F.round(F.sum("need"), 6)), F.lit(0)).alias("n")).first()["n"]
    slots = spark.range(total).withColumnRenamed("id", "slot").withColumn("point", golden(F.col("slot")))
    slots = slots.withColumn("slice", F.floor(F.col("point") / wide)).join(bounds, "slice").where("low <= point and point < high")
    slots = slots.withColumn("segment", F.floor(F.col("slot") / SEGMENT))
    ranked = sharded_running(slots.select("slot", "source_id", "blocks", "segment"), ["source_id"], "segment", [F.col("slot")], F.lit(1), "rank")
    ranked = ranked.where(F.col("rank") < most * F.col("blocks"))
    return ranked.select("slot", "source_id", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch"))


def block_pieces(placed: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document (of positive size) and block it reaches into: block, piece (tokens of it in that block)."""
    first, last = F.floor(F.col("start") / block_tokens), F.floor((F.col("start") + F.col("size") - 1) / block_tokens)
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last)))
    low, high = F.greatest(F.col("start"), F.col("block") * block_tokens), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_tokens)
    return pieces.withColumn("piece", high - low)


def mix(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken, key.

    docs: doc_id, text, source; other columns are left aside. The scan and the
    word counts happen once: sizes are written to the shared folder.
    """
    key = document_key(F.col("doc_id"), F.col("text"))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"))
    sized = materialize(sized, "mix-sizes", counted=True)
    sources = materialize(source_targets(sized, weights, share, most), "mix-sources")
    named = sources.select(F.col("source").alias("source_name"), "source_id", "source_size", "target")
    named_rows = sized.join(named, F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name")
    placed = document_offsets(named_rows.where("size > 0"), shard_digits(sized))
    takes = schedule(sources, block_tokens, most).groupBy("source_id", "block").agg(F.count(F.lit(1)).alias("times"))
    pieces = block_pieces(placed, block_tokens).join(takes, ["source_id", "block"], "left")
    columns = ["doc_id", "source", "size", "source_size", "target", "key"]
    taken = F.coalesce(F.sum(F.col("piece") * F.col("times")), F.lit(0)).alias("taken")
    whole = pieces.groupBy("source_id", "start", *columns).agg(taken).select(*columns, "taken")
    return whole.unionByName(named_rows.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))
