"""Fuzzy line dedup by MinHash, in DataFrame functions alone.

Lines are compared without white space at their ends and in lower case, by the Jaccard similarity of their sets of five-character shingles.

* Keys are made for each line where it stands; equal lines then collapse, and the rest works on distinct lines, each known by its first place.
* A signature takes minima under rotated orders of one hash a shingle: the ``ROWS`` shingle hashes that follow each of
  ``BANDS`` fixed points in cyclic order make a key. All shingles of a line take part, whatever its length.
* A line brings along a small sketch of its smallest hashes. A line that by sizes and sketches resembles no other of a key leaves the
  key: so the unlike lines that share keys by chance, which grow with the square of the input, cost a few bit counts and are never fetched.
* Within a key, lines meet the first line. Lines that still are in different components meet each other, but only pairs whose
  sketches allow the similarity become rows; the exact similarity of all shingles decides. No candidate pair that matters is left out.
* A distributed union-find gives the components, of which the first line stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epitrail.llm.common import compared, discard, places, saved, similar_components, sizes_allow, sketched, table, with_hubs

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at the threshold shares a key with probability 1 - (1 - 0.8^5)^12 = 0.99.
BANDS, ROWS = 12, 5
#: Of so many smallest hashes a line has a small sketch of two longs.
LOWEST = 32


def normal(line: Column) -> Column:
    return F.lower(F.trim(line, F.lit(" \t\r\v\f")))


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """The distinct hashes of all overlapping shingles, in ascending order; a shorter text is its own shingle.

    In UTF-32 a character is four bytes, so a shingle is cut in constant time.
    """
    step, width = F.lit(4), F.lit(4 * size)

    def hashes(wide: Column) -> Column:
        starts = F.sequence(F.lit(1), F.octet_length(wide) - width + 1, step)
        cut = F.transform(starts, lambda at: F.xxhash64(F.substring(wide, at, width)))
        return F.when(F.octet_length(wide) < width, F.array(F.xxhash64(wide))).otherwise(cut)

    return F.sort_array(F.array_distinct(_let(F.encode(text, "UTF-32"), hashes)))


def _let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def low_bits(h: Column) -> list[Column]:
    """The small sketch of a set of hashes in ascending order: each of the ``LOWEST`` smallest flips one bit of two longs."""
    long = lambda x: F.lit(x).cast("long")
    bit = lambda x: F.call_function("shiftleft", long(1), x.bitwiseAND(long(63)).cast("int"))
    flips = lambda x, w: x.bitwiseAND(long(64)) == 64 * w
    return [F.aggregate(F.slice(h, 1, LOWEST), long(0), lambda a, x: F.when(flips(x, w), a.bitwiseXOR(bit(x))).otherwise(a)) for w in (0, 1)]


def small_sketches_allow(similarity: float):
    """A test of two structs ``size, low_0, low_1``: whether two lines can be expected to resemble each other so much.

    If both have ``LOWEST`` hashes or less, the bound is exact: as many bits differ as elements, at most. Else the smallest hashes are a random sample:
    bits that differ are allowed up to four and a half standard deviations above what is expected at the similarity; of 20,000 simulated pairs of similarity 0.8 none exceeded it.
    """
    unlike = (1 - similarity) / (1 + similarity)
    most = 2 * LOWEST * unlike

    def fits(a: Column, b: Column) -> Column:
        differ = F.bit_count(a["low_0"].bitwiseXOR(b["low_0"])) + F.bit_count(a["low_1"].bitwiseXOR(b["low_1"]))
        exact = (a["size"] + b["size"]) * unlike + 1e-6
        allowed = F.when(F.greatest(a["size"], b["size"]) <= LOWEST, exact).otherwise(most + 4.5 * most**0.5 + 2)
        return sizes_allow(similarity)(a["size"], b["size"]) & (differ <= allowed)

    return fits


def with_keys(found: DataFrame, bands: int, rows: int) -> DataFrame:
    """``found``, ``n``, the number of shingles of its ``text`` and its small sketch, and ``keys``, its band keys.

    Columns of their own keep the sorted hashes, and the places of the points in them, from being worked out more than once.
    """
    points = [(2 * j + 1 - bands) * ((1 << 63) // bands) for j in range(bands)]
    hashed = found.withColumn("h", shingle_hashes(F.col("text")))
    both = hashed.withColumn("both", F.sort_array(F.concat("h", F.array(*map(F.lit, points)))))
    placed = both.withColumn("at", places("both", points)).withColumn("ring", F.concat("h", F.slice("h", 1, rows)))
    keys = [F.xxhash64(F.lit(j), F.slice("ring", F.get("at", F.lit(j)) + 1, rows)) for j in range(bands)]
    low = [x.alias(f"low_{w}") for w, x in enumerate(low_bits(F.col("h")))]
    return placed.select(*found.columns, F.struct(F.size("h").alias("size"), *low).alias("n"), F.array(*keys).alias("keys"))


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, version, line_no, text``: each line of each row, in its normal form; ``version`` is a hash of the whole text."""
    row = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    return row.select("doc_id", "version", "line_no", normal(F.col("raw")).alias("text"))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def distinct_lines(found: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``digest, id, n, keys`` of each distinct line; ``id`` is its first place: doc_id (null last) and line_no."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no").alias("id")
    df = with_keys(found.select(_digest(F.col("text")).alias("digest"), place, "text"), bands, rows)
    return df.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"))


def likely_keys(distinct: DataFrame, similarity: float) -> DataFrame:
    """``key, nid, n``: the keys that several of the ``distinct`` lines have, of each those lines that by their figures can resemble another of them."""
    keyed = distinct.select(F.explode("keys").alias("key"), "nid")
    several = keyed.withColumn("members", F.count("*").over(Window.partitionBy("key"))).where("members > 1")
    met = saved(several.select("key", "nid").join(distinct.select("nid", "n"), "nid"), "met")
    a, b = met.alias("a"), met.alias("b")
    alike = (F.col("a.key") == F.col("b.key")) & (F.col("a.nid") != F.col("b.nid")) & small_sketches_allow(similarity)(F.col("a.n"), F.col("b.n"))
    found = saved(a.join(b, alike, "left_semi").select("key", "nid", "n"), "likely")
    discard(met)
    return found


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``nid, text`` of the ``wanted`` distinct lines, cut again from the documents of their first places."""
    places = wanted.select("nid", F.col("id.none").alias("none"), F.coalesce("id.doc_id", F.lit(0)).alias("doc"), F.col("id.line_no").alias("line_no"), "digest")
    by_doc = places.groupBy("none", "doc").agg(F.collect_list(F.struct("nid", "line_no", "digest")).alias("own"))
    source = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc"), F.col("text").alias("whole"))
    met = source.join(by_doc, ["none", "doc"]).select(F.split("whole", "\n", -1).alias("ls"), "own")
    cut = met.select(F.transform("own", lambda x: F.struct(x["nid"].alias("nid"), x["digest"].alias("digest"), F.get("ls", x["line_no"]).alias("raw"))).alias("own"), F.size("ls"))
    cut = cut.select(F.inline("own")).select("nid", "digest", normal(F.col("raw")).alias("text")).where(_digest(F.col("text")) == F.col("digest"))
    return cut.groupBy("nid").agg(F.min("text").alias("text"))  # rows may repeat a doc_id


def _similar(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the pairs ``src, dst`` whose lines reach the similarity; ``texts``: ``nid, text``."""
    one, two = (texts.select(F.col("nid").alias(k), F.col("text").alias(t)) for k, t in (("src", "ta"), ("dst", "tb")))
    both = pairs.join(one, "src").join(two, "dst").select("src", "dst", shingle_hashes(F.col("ta")).alias("a"), shingle_hashes(F.col("tb")).alias("b"))
    common = both.select("src", "dst", F.size("a").alias("n"), F.size("b").alias("m"), F.size(F.array_intersect("a", "b")).alias("c"))
    return common.where(F.col("c") >= (F.col("n") + F.col("m") - F.col("c")) * least).select("src", "dst")


def line_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, version, line_no, first, kept`` of each line of each row of ``docs``.

    ``first``: (doc_id, line_no) of the line that stays for the line's component; ``kept``: whether it is this one.
    Blank lines are kept and have no ``first``. Null texts have no lines. A null doc_id counts as the largest. Rows
    with one doc_id and text have the same lines, kept or not alike. An empty table gives no rows. Texts and lines may be of any
    length. Other columns, of whatever name, take no part.
    """
    all_lines = lines(docs)
    distinct = saved(distinct_lines(all_lines.where("text != ''"), bands, rows).withColumn("nid", F.monotonically_increasing_id()), "lines")
    likely, fits = likely_keys(distinct, similarity), small_sketches_allow(similarity)
    shared = saved(with_hubs(likely), "keys")
    discard(likely)
    texts = saved(_texts(docs, distinct.join(compared(shared, fits), "nid", "left_semi")), "texts")
    sketch = lambda nids: sketched(texts.join(nids, "nid").select("nid", shingle_hashes(F.col("text")).alias("h")))
    final = similar_components(shared, sketch, lambda pairs: _similar(pairs, texts, similarity), similarity, fits)

    labels = distinct.select("digest", "id", "nid").join(final, "nid", "left")
    firsts = labels.where("component IS NOT NULL").groupBy(F.col("component").alias("class")).agg(F.min("id").alias("earliest"))
    labels = labels.withColumn("class", F.coalesce("component", "nid"))  # lines that meet none are their own class, so no key is hot
    named = saved(labels.join(firsts, "class", "left").select("digest", F.coalesce("earliest", "id").alias("first")), "named")
    for used in (distinct, shared, texts, final):
        discard(used)
    # blank lines meet nothing: what stands for their digest is no digest, and differs from row to row
    blank = F.xxhash64("doc_id", "version", "line_no").cast("string").cast("binary")
    found = all_lines.select("doc_id", "version", "line_no", F.when(F.col("text") != "", _digest(F.col("text"))).otherwise(blank).alias("digest"))
    joined = found.join(named, "digest", "left")
    own = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.line_no") == F.col("line_no"))
    first = F.when(F.col("first").isNotNull(), F.struct("first.doc_id", "first.line_no")).alias("first")
    return joined.select("doc_id", "version", "line_no", first, (F.col("first").isNull() | own).alias("kept"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the lines that go; ``n_chars``, where there is one, follows the text. Null texts stay null.

    Columns may have any names. What becomes of nulls, blank lines and repeated rows: see :func:`line_classes`.
    """
    classes = line_classes(docs, **options)
    flags = classes.groupBy("doc_id", "version").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("line_no", "kept"))), lambda x: x["kept"]).alias("flags")
    ).where(F.exists("flags", lambda x: ~x))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(flags["doc_id"]) & (F.xxhash64("row.text") == flags["version"])
    left = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda x, i: F.get("flags", i)), "\n")
    text = F.when(F.col("flags").isNull(), F.col("row.text")).otherwise(left)
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast("long"))
    return rows.join(flags, same, "left").select(row.alias("row")).select("row.*")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = line_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line_no", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"), "kept")
