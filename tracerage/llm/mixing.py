"""Mixing sources to target weights by a low-discrepancy schedule (operator 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GROUP, WORD, doc_columns, hash_order, materialise, range_slot, running_sum

#: 2**32 times the square of the golden ratio's inverse, odd: multiples of it modulo 2**32 are
#: golden-ratio points, exact in 64-bit integers.
GOLDEN = 1640531527
POINTS = 1 << 32


def word_count(text: str = "text"):
    """Words of a text, without Python: ends of words are counted after all other characters go."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``.

    Sources by code point, null last, weigh ``weights`` in turn and share ``total`` of all words.
    A target stops at ``most`` times its source's size and the excess goes to the others by weight,
    until none is above. That has a closed form: with sources in order of size over weight, a
    source is at its most while the level of those after it would exceed its own.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", turn).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.lit(float(total)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    # The level of the first source that isn't full holds for all after it.
    final = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * final.getField("level")))
    return rows.withColumn("target", share).select("source", "source_size", "weight", "target")


def block_pieces(docs: DataFrame, plan: DataFrame, block: int) -> DataFrame:
    """``source, block, doc, epoch, words``: the shuffled stream of each source cut into equal blocks.

    A source's documents stand in order of a hash, once and then once again; blocks of ``block``
    words are cut from that, up to the target. Only its last block may be shorter.
    """
    quotas = plan.select(F.col("source").alias("s"), "source_size", F.round("target").cast("long").alias("quota"), "slots")
    rows = docs.join(quotas, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("slot", range_slot("order", "slots")).drop("slots")
    rows = running_sum(rows.withColumn("group", F.coalesce("source", F.lit(""))).withColumn("no_source", F.col("source").isNull()), ["group", "no_source"], ["slot", "order", "doc"], "size", "at")
    rows = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch"))
    rows = rows.withColumn("from", F.col("at") + F.col("epoch") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), "quota")).where("to > from")
    rows = rows.withColumn("block", F.explode(F.sequence(F.expr(f"from div {block}"), F.expr(f"(to - 1) div {block}"))))
    words = F.least("to", (F.col("block") + 1) * block) - F.greatest("from", F.col("block") * block)
    return rows.select("group", "no_source", "block", "doc", "epoch", words.alias("words"))


def schedule(plan: DataFrame, block: int, slots: int) -> DataFrame:
    """``group, no_source, rank, position``: which block comes when.

    The i-th golden-ratio point falls into a source's share of cumulative targets; the slot is the
    source's next block. Ranks are counted within ranges of positions and over them. Sources whose
    share comes out some blocks short (the points' discrepancy) get these at the end; slots beyond
    a source's last block stay empty.
    """
    spark = plan.sparkSession
    w = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.col("target") / F.sum("target").over(Window.partitionBy())
    shares = plan.where("target > 0").withColumn("share", share).withColumn("hi", F.sum("share").over(w)).withColumn("lo", F.coalesce(F.lag("hi").over(w), F.lit(0.0)))
    shares = shares.select(F.coalesce("source", F.lit("")).alias("group"), F.col("source").isNull().alias("no_source"), (F.col("lo") * POINTS).alias("lo"), (F.col("hi") * POINTS).alias("hi"), "blocks", F.row_number().over(w.orderBy(F.desc("hi"))).alias("top"))
    shares = shares.withColumn("hi", F.when(F.col("top") == 1, F.lit(float(POINTS))).otherwise(F.col("hi"))).drop("top")
    # Shares by the 1024 cells that they touch: an equi-join finds the point's share.
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / (POINTS >> 10)), F.least(F.floor(F.col("hi") / (POINTS >> 10)), F.lit(1023)))))
    points = spark.range(slots).select(F.col("id").alias("position"), F.expr(f"((id + 1) % {POINTS} * {GOLDEN}) % {POINTS}").alias("point"))
    points = points.withColumn("cell", F.expr(f"point div {POINTS >> 10}"))
    taken = points.join(cells, "cell").where("point >= lo and point < hi").select("group", "no_source", "blocks", "position", F.expr(f"position div {GROUP}").alias("slot"), F.lit(1).alias("one"))
    ranked = running_sum(taken, ["group", "no_source"], ["slot", "position"], "one", "rank").select("group", "no_source", "rank", "position", "blocks")
    have = taken.groupBy("group", "no_source").agg(F.count("*").alias("have"))
    short = shares.join(have, ["group", "no_source"], "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < blocks")
    tail = short.select("group", "no_source", F.explode(F.sequence(F.col("have"), F.col("blocks") - 1)).alias("rank"), F.lit(slots).cast("long").alias("position"))
    return ranked.where("rank < blocks").drop("blocks").unionByName(tail.withColumn("rank", F.col("rank").cast("long")))


def mix(docs: DataFrame, block: int = 256, seed: int = 0, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """``(documents, mix)``.

    documents: ``row, doc_id, size, source_size, target, taken``, one row for each document.
    mix: ``position, source, doc (= row), epoch, words``: the pieces of the mix in order of position.

    Deterministic in the rows and the seed. Repeated rows are documents of their own: ``row`` holds
    the doc_id, the source, a hash of the text and the number among rows equal in these, so it
    names one row whatever its hash. A null text has no words; a null source is a source. Sources without words
    have target 0. An empty table gives empty tables. Other columns are ignored.
    """
    rows = doc_columns(docs, "doc_id", "text", "source").select("source", word_count().alias("size"), key_of(seed))
    rows = numbered(materialise(rows, "mix-sizes")).withColumn("row", F.struct("key", "twin")).withColumn("doc_id", F.col("key.doc_id"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(sizes, weights, total, most).join(sizes.select("source", "n").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumn("blocks", F.ceil(F.round("target") / block)).withColumn("slots", F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP)).cast("long"))
    plan = materialise(plan, "mix-plan")
    slots = plan.agg(F.sum(F.col("blocks")).alias("n")).first()["n"] or 0
    stream = rows.select("source", "size", hash_order("row", F.lit(seed)).alias("order"), F.col("row").alias("doc")).where("size > 0")
    pieces = block_pieces(stream, plan.drop("n", "blocks", "weight"), block)
    mixed = pieces.join(schedule(plan, block, slots).withColumnRenamed("rank", "block"), ["group", "no_source", "block"])
    mixed = mixed.select("position", F.when(~F.col("no_source"), F.col("group")).alias("source"), "doc", "epoch", "words")
    taken = mixed.groupBy("doc").agg(F.sum("words").alias("taken"))
    out = rows.join(plan.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).join(taken, F.col("row") == F.col("doc"), "left")
    return out.select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), mixed


def key_of(seed: int):
    """What tells documents apart, beside their number among equals. Nulls are equal within a struct."""
    doc_id, text, source = F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")
    return F.struct(doc_id.alias("doc_id"), source.alias("source"), F.xxhash64(text, F.lit(seed)).alias("content")).alias("key")


def numbered(rows: DataFrame) -> DataFrame:
    """Stored ``rows`` with ``twin``: their number, from 0, among rows of the same ``key``.

    Only keys that come again are numbered, within partitions and over them, so that one row
    repeated any number of times is spread over tasks. Which of them gets which number is open.
    """
    again = materialise(rows.groupBy("key").count().where("count > 1").select("key"), "mix-repeated-keys")
    if again.limit(1).count() == 0:
        return rows.withColumn("twin", F.lit(0).cast("long"))
    single = rows.join(again, "key", "leftanti").withColumn("twin", F.lit(0).cast("long"))
    several = materialise(rows.join(again, "key").withColumn("slot", F.spark_partition_id()).withColumn("one", F.lit(1)), "mix-repeated")
    several = running_sum(several, ["key"], ["one"], "one", "twin").drop("slot", "one")
    return materialise(single.unionByName(several), "mix-numbered")


def mixed_documents(docs: DataFrame, block: int = 256, seed: int = 0) -> DataFrame:
    """All columns of ``docs``: the mix as whole documents.

    A document comes once for each epoch of which the mix takes at least half of its words, so a
    source is within half a document of its target. Documents without words don't come. Doc_ids of
    any integer type, columns of any name and repeated rows (each a document of its own; those with
    equal doc_id, source and text share their copies evenly) are kept; an empty table gives an
    empty table. Texts are shuffled once, to meet their number of copies.
    """
    documents, _ = mix(docs, block, seed)
    first = F.least("taken", "size")
    copies = (2 * first >= F.col("size")).cast("int") + (2 * (F.col("taken") - first) >= F.col("size")).cast("int")
    wanted = documents.select("row.key", F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"))
    wanted = wanted.groupBy("key").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).where("copies > 0")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), key_of(seed))
    chosen = whole.join(wanted, "key")
    several = chosen.where("n > 1")
    rows = chosen.where("n = 1").withColumn("own", F.col("copies"))
    if wanted.where("n > 1").limit(1).count():
        several = numbered(materialise(several, "mix-repeated-documents"))
        rows = rows.unionByName(several.withColumn("own", F.expr("copies div n + int(twin < copies % n)")).drop("twin"))
    return rows.where("own > 0").select("whole", F.explode(F.sequence(F.lit(1), F.col("own").cast("int")))).select("whole.*")
