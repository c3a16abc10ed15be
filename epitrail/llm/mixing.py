"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epitrail.llm.common import saved, table, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Words of a slot. The number of slots grows with the corpus.
SLOT = 64
#: Fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Cells of [0, 1) by which slots meet the sources' intervals, and slots that are ranked in one piece.
CELLS, CHUNK = 1024, 1 << 16


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``: words of each row (null text: 0)."""
    return docs.select("doc_id", "source", word_count("text").alias("size"))


def targets(measured: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` for each source; null is a source of its own.

    Sources in code point order, null last, get the weights in turn. Targets share the sum of all sizes by
    weight, but stop at ``epochs`` times the source's size; the excess is shared again among the rest. With
    r = limit / weight, the sources with the smallest r are full first: a source is full if the level at which
    all from it on share what is left reaches its r. One row a source, so the windows are small.
    """
    by_source = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("n", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    )
    ranked = ranked.withColumn("most", (F.col("source_size") * epochs).cast("double")).withColumn("r", F.col("most") / F.col("weight"))
    fill = Window.orderBy("r", "n")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("r", "n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    filled = ranked.withColumn("level", level).withColumn("full", F.col("r") <= F.col("level"))
    open_level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return filled.select(
        "source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * open_level).alias("target")
    )


def _stream(measured: DataFrame) -> DataFrame:
    """``doc_id, source, size, start``: where each document starts in its source's shuffled stream of words.

    The order is that of the md5 of doc_id and size. Each source is summed in 4,096 parts by the first digits of the md5, so a
    hot source is no single task.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")))
    rows = measured.withColumn("key", key).withColumn("part", F.substring("key", 1, 3))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = inner.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return joined.select("doc_id", "source", "size", (F.col("start") + F.col("base")).alias("start"))


def schedule(goals: DataFrame, slot: int = SLOT) -> DataFrame:
    """``source, rank, at``: the slots of the mix; slot of rank r takes the words from ``slot * r`` on of its source's stream.

    Point i is the fractional part of (i + 1/2) times the golden ratio and belongs to the source in whose share of [0, 1) it lies; the
    points of a source, in order, are its slots, and ``at`` is the place in the mix. Shares are sums of targets; there is a point for each
    ``slot`` words of the mix. A source gets as many slots as its target needs: where its share has some points more, they are
    left out, and where it has less, as a small source may have none at all, slots follow at the end, source by source. No two slots
    share a place.
    """
    total = goals.agg(F.sum("target")).first()[0] or 0.0
    n_points = -(-int(round(total)) // slot)
    upto = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source, here and in targets
    shares = goals.where("target > 0").withColumn("high", F.sum("target").over(upto) / F.lit(total or 1.0))
    shares = shares.withColumn("low", F.coalesce(F.lag("high").over(upto), F.lit(0.0)))
    shares = shares.withColumn("high", F.when(F.lead("low").over(upto).isNull(), 2.0).otherwise(F.col("high")))
    slots = F.expr(f"(cast(round(target) AS BIGINT) + {slot - 1}) div {slot}")
    shares = shares.select(F.col("source").alias("s"), "low", "high", slots.alias("slots"))
    cells = shares.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1))))
    )
    ids = goals.sparkSession.range(n_points).withColumn("x", (F.col("id") + 0.5) * GOLDEN)
    points = ids.select("id", (F.col("x") - F.floor("x")).alias("x")).withColumn("cell", F.floor(F.col("x") * CELLS))
    met = points.join(cells, "cell").where("x >= low AND x < high").select("s", "id", "slots", F.expr(f"id div {CHUNK}").alias("chunk"))
    # ranks chunk by chunk, so that a source's points are no single task
    counts = met.groupBy("s", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("s").alias("bs"), F.col("chunk").alias("bc"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("id")) - 1
    ranked = met.withColumn("nth", nth).join(bases, F.col("s").eqNullSafe(F.col("bs")) & (F.col("chunk") == F.col("bc")))
    ranked = ranked.select(F.col("s").alias("source"), (F.col("base") + F.col("nth")).alias("rank"), F.col("id").alias("at"), "slots").where("rank < slots").drop("slots")
    have = counts.groupBy("s").agg(F.sum("n").alias("n")).withColumnRenamed("s", "hs")
    lacking = shares.join(have, F.col("s").eqNullSafe(F.col("hs")), "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < slots")
    earlier = Window.orderBy(F.col("s").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    lacking = lacking.withColumn("first", F.lit(n_points) + F.coalesce(F.sum(F.col("slots") - F.col("n")).over(earlier), F.lit(0)))
    more = lacking.select(F.col("s").alias("source"), "n", "first", F.explode(F.sequence(F.col("n"), F.col("slots") - 1)).alias("rank"))
    return ranked.unionByName(more.select("source", "rank", (F.col("first") + F.col("rank") - F.col("n")).alias("at")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = MAX_EPOCHS, slot: int = SLOT) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, n_slots, places`` of each row of ``docs``.

    ``taken``: words of the row that the mix takes, repeats counted; at most ``epochs`` times its size. A source's slots take its stream of
    shuffled documents block by block, again from the start when it ends, until the target is reached, so that the taken words of a
    source are its target to the word, however small it is. ``places``: for each pass through the source's stream, the place in the mix of
    the slot where the row begins, null if the pass does not take it; ``n_slots``: slots that hold some of it, pass by pass. Rows without
    words take none. Repeated rows are separate rows. An empty table gives no rows. A text of any length counts by its words. The result
    depends on the rows alone, not on their order or partitions. Other columns, of whatever name, take no part.
    """
    measured = saved(sizes(docs), "sizes")
    goals = saved(targets(measured, weights, epochs), "targets")
    goal = goals.withColumnRenamed("source", "g")
    plan = schedule(goals, slot).select(F.col("source").alias("s"), "rank", "at")
    stream = _stream(measured.where("size > 0")).join(goal, F.col("source").eqNullSafe(F.col("g"))).withColumn("words", F.round("target").cast("long"))
    # where the document lies in the stream, once an epoch, cut at the target; and the blocks there
    passes = stream.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    begin = F.col("start") + F.col("epoch") * F.col("source_size")
    passes = passes.withColumn("begin", begin).where("begin < words").withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("words")))
    pieces = passes.withColumn("b", F.explode(F.sequence(F.expr(f"begin div {slot}"), F.expr(f"(end - 1) div {slot}"))))
    length = F.least(F.col("end"), (F.col("b") + 1) * slot) - F.greatest(F.col("begin"), F.col("b") * slot)
    met = pieces.select("doc_id", "source", "size", "start", "epoch", "b", length.alias("length"))
    met = met.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("rank")))
    places = F.array(*(F.min(F.when(F.col("epoch") == e, F.col("at"))) for e in range(epochs)))
    taken = met.groupBy("doc_id", "source", "size", "start").agg(F.sum("length").alias("taken"), F.count("*").alias("n_slots"), places.alias("places"))
    given = taken.select(*(F.col(c).alias(f"t_{c}") for c in ("source", "start", "taken", "n_slots", "places")))
    rows = stream.join(given, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("start") == F.col("t_start")), "left")
    names, zero = ("doc_id", "source", "size", "source_size", "target"), F.lit(0).cast("long")
    untouched = F.array_repeat(F.lit(None).cast("long"), epochs)
    none = measured.where("size = 0").join(goal, F.col("source").eqNullSafe(F.col("g")))
    none = none.select(*names, zero.alias("taken"), zero.alias("n_slots"), untouched.alias("places"))
    some = rows.select(*names, F.coalesce("t_taken", zero).alias("taken"), F.coalesce("t_n_slots", zero).alias("n_slots"), F.coalesce("t_places", untouched).alias("places"))
    return some.unionByName(none)


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = MAX_EPOCHS, slot: int = SLOT) -> DataFrame:
    """The documents of the mix (:func:`mix`), in the order of the schedule: each once for every whole time that it is taken.

    Of what is left, a last row has the first words, with single spaces; at most one document of each source is cut. A row stands where the
    slot that it begins in stands, so every stretch of the written table holds about the sources' shares.
    """
    keys = {"_d": F.coalesce("doc_id", F.lit(0)), "_s": F.coalesce("source", F.lit("")), "_n": F.concat(F.col("doc_id").isNull().cast("string"), F.col("source").isNull().cast("string"))}

    def numbered(df: DataFrame, order) -> DataFrame:
        """Rows that share doc_id, source and size, numbered."""
        nth = F.row_number().over(Window.partitionBy(*keys, "_size").orderBy(order))
        return df.withColumns(keys).withColumn("_nth", nth)

    taken = numbered(mix(docs, weights, epochs, slot).withColumnRenamed("size", "_size"), F.desc("taken")).where("taken > 0")
    taken = taken.select(*keys, "_size", "_nth", F.col("taken").alias("_taken"), "places")
    taken = taken.withColumnRenamed("places", "_places")
    both = numbered(docs.withColumn("_size", word_count("text")), "text").join(taken, [*keys, "_size", "_nth"])
    whole, rest = F.expr("cast(_taken div _size as int)"), F.col("_taken") % F.col("_size")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, 1, rest.cast("int")), " ")
    copies = F.concat(F.array_repeat(F.col("text"), whole), F.when(rest > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    out = both.select("*", F.posexplode(copies).alias("_pass", "_copy")).withColumns(
        {"text": F.col("_copy"), "n_chars": F.length("_copy").cast("long"), "_place": F.get("_places", F.col("_pass"))}
    )
    return out.orderBy("_place", "doc_id", "_nth").select(*docs.columns)


def op6_mixing_sources(spark, sf_dir: str) -> DataFrame:
    """Also ``first_slot``, the first place of the row in the mix (null: not taken), and ``n_slots``."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_min("places").alias("first_slot"), "n_slots")
