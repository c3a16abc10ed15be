"""Periodic runs of words, by bit-parallel lags.

The word ids of a text are laid out as bit planes: big integers, bit i of plane b being bit b of the id of word i. For a lag q,
a plane XOR itself shifted by q has a one wherever the two words differ in that bit; the OR over all planes marks the mismatches. A run of period q
and length l is a stretch of l - q zeros. ANDs of the matches with themselves, shifted by 1, 2, 4 and so on, leave just the starts of
stretches that are long enough; hardly any lag has some, and most are given up after the first planes.

Short texts try every lag up to a third of their words. A long text (:data:`FILTERED`) first finds which lags can have a run: a run whose
smallest period q lies in (2^(k-1), 2^k] holds the same 2^k words at each q-th place, and nowhere between. So only distances
from a sequence of 2^k words to its last occurrence are lags worth a look, found for all k by doubling: no more than some multiple of the
square root of the text's length, so that the work does not grow with the square of a text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epitrail.llm.common import WORD, table

#: A run has this many words at least, and so many periods.
LEAST, PERIODS = 24, 3
#: Words from which the lags are filtered first. Either way finds the same.
FILTERED = 8192
#: Planes that are read before the first look whether a long stretch is left.
FIRST_PLANES = 3
#: Bytes of text that go out in one batch.
BATCH = 8 << 20


def planes(ids) -> list[int]:
    """Bit planes of an array of ids, the low bit first; one plane at least."""
    import numpy as np

    bits = max(1, int(ids.max()).bit_length())
    return [int.from_bytes(np.packbits(((ids >> b) & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(bits)]


def stretch_starts(match: int, length: int) -> int:
    """The bits of ``match`` from which ``length`` ones stand in a row."""
    have = 1
    while match and 2 * have <= length:
        match &= match >> have
        have *= 2
    return match & (match >> (length - have)) if length > have else match


def stretches(ones: int, n: int) -> Iterator[tuple[int, int]]:
    """(first, last) of the stretches of ones among the low ``n`` bits."""
    import numpy as np

    bits = np.unpackbits(np.frombuffer(ones.to_bytes(n // 8 + 1, "little"), dtype=np.uint8), bitorder="little")
    edges = np.flatnonzero(np.diff(bits, prepend=0, append=0)).tolist()
    return zip(edges[::2], (e - 1 for e in edges[1::2]))


def likely_lags(ids, periods: int = PERIODS) -> list[int]:
    """The lags that can be smallest periods of runs, in ascending order: distances between a sequence of 2^k words and its last occurrence."""
    import numpy as np

    n, span, found = len(ids), 1, set()
    rank = ids.astype(np.int64)
    while span < n:
        order = np.argsort(rank, kind="stable")
        same = np.flatnonzero(rank[order[1:]] == rank[order[:-1]])
        gaps = np.unique(order[same + 1] - order[same])
        found.update(gaps[(2 * gaps > span) & (gaps <= span) & (gaps <= n // periods)].tolist())
        if not len(same):
            break
        # ranks of twice as many words
        _, rank = np.unique(rank[:-span] * (int(rank.max()) + 1) + rank[span:], return_inverse=True)
        span *= 2
    return sorted(found)


def runs_of(ids, least: int = LEAST, periods: int = PERIODS, filtered: int = FILTERED) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of an array of word ids, by start, then period.

    A run is a stretch of consecutive words with smallest period q and at least max(least, periods * q) words that no neighbouring word extends
    keeping period q. A stretch that a lag finds has a smaller period if it lies in a run of a proper divisor of the lag.
    """
    n = len(ids)
    if n < max(least, periods):
        return []
    rows, by_period = planes(ids), {}
    for q in likely_lags(ids, periods) if n >= filtered else range(1, n // periods + 1):
        length = max(least, periods * q)
        if length > n:
            break
        match, wanted = (1 << (n - q)) - 1, length - q
        for at in range(0, len(rows), FIRST_PLANES):
            mismatch = 0
            for plane in rows[at : at + FIRST_PLANES]:
                mismatch |= plane ^ (plane >> q)
            match &= ~mismatch
            starts = stretch_starts(match, wanted)
            if not starts:
                break
        if not starts:
            continue
        smaller = [by_period[d] for d in by_period if q % d == 0]
        own = [(s, e + wanted - 1 + q) for s, e in stretches(starts, n)]  # first and last word
        own = [run for run in own if not any(_inside(run, other) for other in smaller)]
        if own:
            by_period[q] = own
    return sorted((s, e - s + 1, q) for q, own in by_period.items() for s, e in own)


def _inside(run: tuple[int, int], others: list[tuple[int, int]]) -> bool:
    """Whether one of the ``others``, which are in order, holds the run."""
    i = bisect_right(others, (run[0], 1 << 62)) - 1
    return i >= 0 and others[i][1] >= run[1]


def dropped(found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """[first, end) of the words that some run contains after its first period, in order, joined where they overlap."""
    out: list[tuple[int, int]] = []
    for first, end in sorted((s + q, s + length) for s, length, q in found):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, periods: int = PERIODS, filtered: int = FILTERED) -> DataFrame:
    """``<id>, n_words, runs, collapsed`` of each row: its runs as an array of (start, length, period), and the words that stay, joined by one space.

    Words are runs of anything but ASCII white space, numbered from 0. One period of each run stays. Null, empty and blank texts have no
    words, no runs and an empty ``collapsed``. Repeated rows are judged alike; ties do not arise, as a run is its start and period. An
    empty table gives no rows. Texts are read whole, whatever their length; a task holds one at a time. Other columns, of whatever name, take no part.
    No shuffle.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        word = re.compile(WORD)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def batch_of(ids, counts, runs, kept):
            return pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.string())], ["id", "n_words", "runs", "collapsed"])

        for batch in batches:
            first, size, counts, runs, kept = 0, 0, [], [], []
            for i, text in enumerate(batch.column("text")):
                words = word.findall(text.as_py() or "")
                number: dict[str, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
                found = runs_of(ids, least, periods, filtered)
                for a, b in reversed(dropped(found)):
                    del words[a:b]
                counts.append(len(ids))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                kept.append(" ".join(words))
                size += len(kept[-1])
                if size >= BATCH or i == len(batch) - 1:
                    yield batch_of(batch.column("id").slice(first, i + 1 - first), counts, runs, kept)
                    first, size, counts, runs, kept = i + 1, 0, [], [], []

    kind = docs.schema[id_column].dataType.simpleString()
    out = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )
    return out.withColumnRenamed("id", id_column)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; ties to the smallest start, then period. Null without runs.

    Fractions are compared crosswise, in decimals that hold any product of two longs.
    """
    wide = lambda x: x.cast("decimal(19,0)")

    def better(best: Column, run: Column) -> Column:
        more, as_much = wide(run["length"]) * wide(best["period"]), wide(best["length"]) * wide(run["period"])
        return F.when(best.isNull() | (more > as_much), run).otherwise(best)  # runs come by start, then period

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text as the query wants it: of one id in ten, by crc32, words from some place on repeat with some period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        word = lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p))
        return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(words, word), " "))

    once = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), planted)  # words are cut once
    return F.when(h % 10 == 0, F.get(once, F.lit(0))).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Per document: ``doc_id, n_runs``, the strongest run's ``start, length, period, exponent_milli``, ``runs_sha256, collapsed_sha256``, ``n_words``.

    A null doc_id has no decimal form, so its text is taken as it is.
    """
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", repeated_tail(F.col("doc_id"), F.col("text")).alias("text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
