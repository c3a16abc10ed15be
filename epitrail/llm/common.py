"""What the operators of this subpackage share: shared-folder tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, as in tests, a local session gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="epitrail-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: With this setting Spark removes a query's shuffle files as the query ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the lineage, survives lost executors, leaves no shuffle files."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`saved`; nothing may read it afterwards."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def connected_components(edges: DataFrame) -> DataFrame:
    """Distributed union-find by alternating large and small stars.

    ``edges``: columns ``src`` and ``dst`` of one orderable type; nulls and loops are ignored. Returns
    ``node, component`` for every node with an edge, component being the smallest node reachable. No
    rows for an empty table. Each round is written to the shared folder; the number of rounds grows
    with the logarithm of a component's size.
    """
    pair = edges.where(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("child"), F.least("src", "dst").alias("parent")
    )
    stars = saved(pair.distinct(), "stars")
    while True:
        # a forest of stars: each child has one parent, and no parent is a child
        parents = stars.select(F.col("parent").alias("node"), F.lit(0).alias("up"))
        seen = stars.select(F.col("child").alias("node"), F.lit(1).alias("up")).unionByName(parents)
        odd = seen.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("low")).where(
            (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("low") == 0))
        )
        if odd.isEmpty():
            break
        both = stars.select(F.col("child").alias("u"), F.col("parent").alias("v")).unionByName(
            stars.select(F.col("parent").alias("u"), F.col("child").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.inline(
                F.array(
                    F.struct(F.col("u").alias("child"), F.col("m").alias("parent")),
                    F.struct(F.col("v").alias("child"), F.col("m").alias("parent")),
                )
            )
        )
        new = saved(small.where(F.col("child") != F.col("parent")).distinct(), "stars")
        discard(stars)
        stars = new
    roots = stars.select("parent").distinct()
    return stars.select(F.col("child").alias("node"), F.col("parent").alias("component")).unionByName(
        roots.select(F.col("parent").alias("node"), F.col("parent").alias("component"))
    )


def word_count(text: Column | str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


#: Longs of a sketch: 64 bits each.
SKETCH = 32


def places(sorted_with_points: str, points: list[int]) -> Column:
    """Where each of some ascending points falls in a sorted array of longs, given the two sorted together.

    Points spread over all longs: the upper half is looked for from the end, so that a search passes a quarter of the array, not half of it.
    """
    back = F.reverse(sorted_with_points)
    from_start = lambda p: F.array_position(sorted_with_points, p).cast("int") - 1
    from_end = lambda p: F.size(back) - F.array_position(back, p).cast("int")
    return F.array(*((from_start if 2 * j < len(points) else from_end)(p) - j for j, p in enumerate(points)))


def sketched(sets: DataFrame) -> DataFrame:
    """``nid, n, s`` of the sets ``nid, h``, ``h`` being an array of hashes.

    ``n`` is the size; each element flips one bit of the sketch ``s``, an array of longs. Common elements flip the same bits, so two sketches differ in at most as
    many bits as the sets in elements. Elements of one long of the sketch stand together in order.
    """
    long = lambda x: F.lit(x).cast("long")
    zeros = lambda n: F.array_repeat(long(0), n)
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).alias("w"), long(0).alias("bits"))

    def step(acc: Column, x: Column) -> Column:
        w = (F.shiftright(x, 65 - SKETCH.bit_length()) + SKETCH // 2).cast("int")
        bit = F.call_function("shiftleft", long(1), x.bitwiseAND(long(63)).cast("int"))
        same = F.struct(acc["out"].alias("out"), acc["w"].alias("w"), acc["bits"].bitwiseXOR(bit).alias("bits"))
        full = F.concat(acc["out"], F.array(acc["bits"]), zeros(w - acc["w"] - 1))
        return F.when(w == acc["w"], same).otherwise(F.struct(full.alias("out"), w.alias("w"), bit.alias("bits")))

    words = F.aggregate("h", start, step, lambda acc: F.concat(acc["out"], F.array(acc["bits"]), zeros(SKETCH - 1 - acc["w"])))
    ordered = sets.select("nid", F.sort_array(F.array_distinct("h")).alias("h"))
    return ordered.select("nid", F.size("h").alias("n"), words.alias("s"))


def may_resemble(a: str, b: str, similarity: float) -> Column:
    """Whether two sketched sets can have this Jaccard similarity: an exact bound, which leaves out no pair that has it."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = [F.bit_count(F.get(f"{a}.s", F.lit(i)).bitwiseXOR(F.get(f"{b}.s", F.lit(i)))) for i in range(SKETCH)]
    differ = sum(bits[1:], bits[0])
    return (F.least(n, m) >= F.greatest(n, m) * similarity) & (differ <= (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def with_hubs(keyed: DataFrame) -> DataFrame:
    """``key, nid, n, hub, hub_n, members`` of the keys that several have: ``hub`` is the smallest nid of the key, ``members`` how many have it.

    ``keyed``: ``key, nid, n``, ``n`` being the size of the set, or more of its figures. One shuffle; most keys are nobody else's. The rows of a large key pass
    through one task in order, and spill there.
    """
    span = Window.partitionBy("key")
    several = keyed.withColumns({"hub": F.min("nid").over(span), "members": F.count("*").over(span)}).where("members > 1")
    hub_n = F.max(F.when(F.col("nid") == F.col("hub"), F.col("n"))).over(span)
    return several.withColumn("hub_n", hub_n).select("key", "nid", "n", "hub", "hub_n", "members")


def sizes_allow(similarity: float):
    """A test of two figures ``n``, the sizes of two sets: whether they allow the similarity."""
    return lambda n, m: F.least(n, m) >= F.greatest(n, m) * similarity


def _may_meet(fits) -> Column:
    """Whether a row of :func:`with_hubs` is no hub and its figures allow that it resembles the hub."""
    return (F.col("nid") != F.col("hub")) & fits(F.col("n"), F.col("hub_n"))


def compared(shared: DataFrame, fits) -> DataFrame:
    """``nid`` of the sets of ``shared`` (:func:`with_hubs`) that :func:`similar_components` may bring together: a pair's figures can decide alone."""
    some = F.when(_may_meet(fits), F.array("nid", "hub")).when(F.col("members") > 2, F.array("nid"))
    return shared.select(F.explode(some).alias("nid")).distinct()


def unmet_pairs(apart: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """``src, dst``: the pairs that share a key of ``apart``, are in different parts, have not met as a key's hub, and whose sketches allow the similarity.

    ``apart``: ``key, nid, hub, part, largest``. A pair becomes one row, whatever the number of its common keys: it is made in the smallest of them.
    """
    keys = apart.groupBy("nid").agg(F.collect_set("key").alias("keys"))
    split = apart.where("nid != hub").join(sketches.join(keys, "nid"), "nid")
    a, b = split.where("part != largest").alias("a"), split.alias("b")
    once = (F.col("b.part") == F.col("b.largest")) | (F.col("a.nid") < F.col("b.nid"))
    here = F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("a.key")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.part") != F.col("b.part")) & once & may_resemble("a", "b", similarity) & here)
    return met.select(F.least("a.nid", "b.nid").alias("src"), F.greatest("a.nid", "b.nid").alias("dst"))


def similar_components(shared: DataFrame, sketch, similar, similarity: float, fits=None) -> DataFrame:
    """``nid, component`` of the sets that resemble another: the smallest nid that a chain of similar pairs reaches, among the pairs that share a key.

    ``shared``: see :func:`with_hubs`; ``sketch``: gives the sketches of the sets whose ``nid`` a table lists; ``similar``: keeps those
    pairs ``src, dst`` that are; both are asked about sets of :func:`compared` only. ``fits``: whether the figures ``n`` of two sets allow that they
    resemble each other, by default their sizes. Within a key, all meet the hub. Those of keys with three or
    more that still are in different components then meet each other, but only pairs whose sketches allow the similarity become rows,
    are brought together and compared. So no pair that matters is left out; a large group of copies costs one comparison each, and
    one of variants that resemble each other less than is asked for costs the comparison of two sketches a pair.
    """
    near = saved(similar(shared.where(_may_meet(fits or sizes_allow(similarity))).select(F.col("hub").alias("src"), F.col("nid").alias("dst")).distinct()), "near")
    first = saved(connected_components(near), "components").withColumnsRenamed({"node": "nid", "component": "part"})

    labelled = shared.where("members > 2").select("key", "nid", "hub").join(first, "nid", "left").withColumn("part", F.coalesce("part", "nid"))
    parts = labelled.groupBy("key", "part").agg(F.count("*").alias("n"))
    largest = parts.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.count("*").alias("parts"))
    apart = saved(labelled.join(largest.where("parts > 1").select("key", "largest"), "key"), "apart")
    sketches = saved(sketch(apart.where("nid != hub").select("nid").distinct()), "sketches")
    more = saved(similar(unmet_pairs(apart, sketches, similarity)), "more")

    # components of components
    part = lambda side: first.select(F.col("nid").alias(side), F.col("part").alias(f"{side}_part"))
    joined = more.join(part("src"), "src", "left").join(part("dst"), "dst", "left")
    second = connected_components(joined.select(F.coalesce("src_part", "src").alias("src"), F.coalesce("dst_part", "dst").alias("dst")))
    second = saved(second, "second").select(F.col("node").alias("part"), "component")
    alone = second.select(F.col("part").alias("nid"), "component").join(first, "nid", "left_anti")
    named = first.join(second, "part", "left").select("nid", F.coalesce("component", "part").alias("component")).unionByName(alone)
    final = saved(named, "final")
    for used in (near, first, apart, sketches, more, second):
        discard(used)
    return final
