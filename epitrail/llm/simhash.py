"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64-bit SimHashes of three-word shingles. For radius r, bit i gets a vector of r + 1 bits,
and table v of the 2^(r+1) - 1 tables keeps the bits whose vector has an odd product with v. The bits in which two
fingerprints within the radius differ have a common orthogonal v, so some table hides all of them: every such pair
meets in some bucket.

At a Jaccard similarity of 0.8, fingerprints differ in about ten bits, too many for tables. Where near copies by
similarity are asked for (:func:`without_near_copies`), MinHash keys of five-word shingles find candidates beside the
tables, and the exact similarity decides on all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from random import Random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epitrail.llm.common import compared, connected_components, discard, saved, similar_components, sizes_allow, sketched, table, with_hubs

BITS = 64
SEED = 42
#: Near copies: least Jaccard similarity of sets of shingles of this many words.
SIMILARITY, COPY_SHINGLE = 0.8, 5
#: A pair at the threshold shares a MinHash key with probability 1 - (1 - 0.8^4)^16 = 0.9998.
BANDS, ROWS = 16, 4


def shingle_hashes(data: bytes | None, shingle: int = 3):
    """Hashes of a UTF-8 text's shingles in order; a text of fewer words is one, one without words has none."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = data.lower().split() if data else []
    if len(words) < shingle:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    else:
        hashes = [xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]
    return np.array(hashes, dtype="<u8")


def fingerprint(data: bytes | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of a UTF-8 text. A null text, like one without words, has fingerprint 0."""
    return _majority(shingle_hashes(data, shingle))


def _majority(array) -> int:
    """The bits that most of the hashes have."""
    import numpy as np

    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(array), 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(array[at : at + (1 << 16)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(array)).tolist())


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, version, fp`` of each row of ``docs``: a hash of the text, and the fingerprint as a signed long."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column("data")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(fps)], ["doc_id", "version", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), F.col("text").cast("binary").alias("data"))
    return rows.mapInArrow(run, f"doc_id {kind}, version long, fp long")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def covering_masks(radius: int, seed: int = SEED) -> list[int]:
    """The bits that each table keeps."""
    deal = [1 + i % ((2 << radius) - 1) for i in range(BITS)]
    Random(seed).shuffle(deal)
    return [sum(1 << i for i, x in enumerate(deal) if (x & v).bit_count() % 2) for v in range(1, 2 << radius)]


def near_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """``src, dst``: links that connect all distinct fingerprints ``fp`` within ``radius`` (even) of each other.

    Inside a bucket two fingerprints within the radius have a centre, within half of it from both, that differs
    from them only in bits that the table hides; and whatever shares a centre is within the radius. So each
    fingerprint in a shared bucket goes to its centres (1 + hidden bits for radius 2), and each centre links its
    few members to the smallest. No pairs of a bucket are formed, so large buckets need no cap.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    masks = covering_masks(radius)
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(signed(m)).alias("mask")) for t, m in enumerate(masks)))
    rows = fps.select("fp").distinct().select("fp", F.inline(tables)).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    shared = rows.groupBy("t", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("t", "key")
    flips = [
        F.array(*(F.lit(signed(sum(1 << i for i in c))) for n in range(radius // 2 + 1) for c in combinations(hidden, n)))
        for hidden in ([i for i in range(BITS) if not m >> i & 1] for m in masks)
    ]
    centres = rows.join(shared, ["t", "key"], "left_semi").select(
        "t", "fp", F.explode(F.element_at(F.array(*flips), F.col("t") + 1)).alias("flip")
    )
    groups = (
        centres.groupBy("t", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
        .agg(F.min("fp").alias("src"), F.collect_set("fp").alias("all"))
        .where(F.size("all") > 1)
    )
    links = groups.select("src", F.explode("all").alias("dst")).where("src != dst")
    return links.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius).distinct()


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` of each row of ``docs``.

    ``component_id`` is the smallest doc_id whose fingerprint can be reached over links of at most ``radius``
    differing bits. Rows with equal fingerprints are linked; null and empty texts share fingerprint 0. A null
    doc_id is never the smallest unless its component has no other. An empty table gives no rows. All shingles of a
    text of any length vote. Other columns, of whatever name, take no part.
    """
    fps = saved(fingerprints(docs), "fingerprints")
    rooted = _roots(fps, radius)
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(classes, "root").select("fp", "component_id")
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")


def _roots(fps: DataFrame, radius: int, *more) -> DataFrame:
    """``fp, least, root``: the smallest doc_id and the component of each distinct fingerprint."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), *more)
    roots = connected_components(near_links(fps, radius)).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")


def _places(docs: DataFrame) -> dict:
    return {"_none": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)), "_version": F.xxhash64("text")}


def _first():
    """The smallest place among rows: a null doc_id is the largest."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("version").alias("v"))).alias("first")


def _only(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``first`` of ``stay``."""
    stay = stay.select(F.col("first.none").alias("_none"), F.coalesce("first.id", F.lit(0)).alias("_id"), F.col("first.v").alias("_version"))
    keys = _places(docs)
    own = docs.withColumns(keys).join(stay, list(keys), "left_semi")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_version"))
    return own.withColumn("_nth", nth).where("_nth = 1").select(*docs.columns)


def deduplicated(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One row of each component of ``docs``, all columns: that of the smallest doc_id, null being the largest.

    Of rows with one doc_id, that whose text has the smallest hash stays; of equal rows, one.
    """
    fps = saved(fingerprints(docs), "fingerprints")
    return _only(docs, _roots(fps, radius, _first()).groupBy("root").agg(F.min("first").alias("first")))


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, version, nid, n, keys`` of each row: ``nid`` is a hash of its words, ``n`` how many shingles it has, ``keys`` what near copies share."""
    masks = covering_masks(2)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        points = np.arange(BANDS, dtype=np.uint64) * np.uint64((1 << 64) // BANDS)
        for batch in batches:
            nids, sizes, keys = [], [], []
            for x in batch.column("data"):
                data = x.as_py()
                array = shingle_hashes(data, shingle)
                nids.append(xxh64_intdigest(b" ".join((data or b"").lower().split()), SEED))
                fp, distinct = _majority(array), np.unique(array)
                sizes.append(len(distinct))
                if not len(array):
                    keys.append([])
                    continue
                at = (np.searchsorted(distinct, points)[:, None] + np.arange(ROWS)) % len(distinct)
                own = [xxh64_intdigest(row.tobytes(), j) for j, row in enumerate(distinct[at])]
                own += [xxh64_intdigest((fp & m).to_bytes(8, "little"), BANDS + t) for t, m in enumerate(masks)]
                keys.append([signed(k) for k in own])
            columns = [pa.array(map(signed, nids), pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), *columns], ["doc_id", "version", "nid", "n", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), F.col("text").cast("binary").alias("data"))
    return rows.mapInArrow(run, f"doc_id {kind}, version long, nid long, n int, keys array<long>")


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``nid, grams``: the set of shingle hashes of each row of ``nid, data``."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            grams = [np.unique(shingle_hashes(x.as_py(), shingle)).view(np.int64) for x in batch.column("data")]
            yield pa.RecordBatch.from_arrays([batch.column("nid"), pa.array(grams, pa.list_(pa.int64()))], ["nid", "grams"])

    return texts.mapInArrow(run, "nid long, grams array<long>")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = COPY_SHINGLE) -> DataFrame:
    """``doc_id, version, root`` of each row of ``docs``; rows have one ``root`` if a chain of near copies joins them.

    Near copies are texts whose sets of shingles of so many words have at least this Jaccard similarity; words
    are compared in lower case. Texts without words, and null texts, are copies of each other.
    """
    rows = saved(_signatures(docs, shingle), "signatures")
    texts = rows.groupBy("nid").agg(_first(), F.first("n").alias("n"), F.first("keys").alias("keys"))
    shared = saved(with_hubs(texts.select(F.explode("keys").alias("key"), "nid", "n")), "keys")

    wanted = texts.join(compared(shared, sizes_allow(similarity)), "nid", "left_semi")
    wanted = wanted.select("nid", F.col("first.none").alias("_none"), F.coalesce("first.id", F.lit(0)).alias("_id"), F.col("first.v").alias("_version"))
    keys = _places(docs)
    found = docs.withColumns(keys).join(wanted, list(keys)).select("nid", F.col("text").cast("binary").alias("data"))
    sets = saved(_shingle_sets(found, shingle).groupBy("nid").agg(F.first("grams").alias("grams")), "sets")  # rows may repeat

    sketch = lambda nids: sketched(sets.join(nids, "nid").select("nid", F.col("grams").alias("h")))

    def similar(pairs: DataFrame) -> DataFrame:
        one, two = (sets.select(F.col("nid").alias(k), F.col("grams").alias(g)) for k, g in (("src", "ga"), ("dst", "gb")))
        common = pairs.join(one, "src").join(two, "dst").select("src", "dst", F.size("ga").alias("n"), F.size("gb").alias("m"), F.size(F.array_intersect("ga", "gb")).alias("c"))
        return common.where(F.col("c") >= (F.col("n") + F.col("m") - F.col("c")) * similarity).select("src", "dst")

    roots = similar_components(shared, sketch, similar, similarity)
    named = saved(rows.join(roots, "nid", "left").select("doc_id", "version", F.coalesce("component", "nid").alias("root")), "roots")
    for used in (rows, shared, sets, roots):
        discard(used)
    return named


def without_near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = COPY_SHINGLE) -> DataFrame:
    """One row of each group that :func:`near_copies` joins, all columns; which, as in :func:`deduplicated`."""
    return _only(docs, near_copies(docs, similarity, shingle).groupBy("root").agg(_first()).select("first"))


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
