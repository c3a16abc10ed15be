"""Removal of repeated byte strings by suffix arrays and longest-previous-factor arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller id; the first
document keeps it. Suffix arrays need strings that can match to meet in one task, without moving all text there:

1. Documents are dealt into chunks. Every window of ``length`` bytes picks the smallest hash among its grams, so equal
   windows pick equal hashes, wherever they stand. Runs of windows with one pick number about a sixteenth of the bytes.
2. Chunks send 32 bits of each pick to buckets, and hear which picks other chunks have too.
3. Runs with such picks, or with picks of two documents of the chunk, go to buckets as contexts: the bytes that
   the run's windows cover. A chunk sends equal contexts once, with the smallest document that has them.
4. A bucket collapses equal contexts, builds the suffix array of those whose pick has several, and takes each
   suffix's previous and next suffix of a smaller document. The longest previous factor is the longer match of the
   two; windows for which it reaches ``length`` are reported back, as a bit mask a context.
5. Chunks cut the reported windows out of their documents.

A pick that more than ``hot`` chunks have goes to the buckets window by window, dealt by the window's own bytes; a
passage of every document then costs one row a chunk and window, and its surroundings fill no single bucket.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitrail.llm.common import table

LENGTH = 50
GRAM = 20
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 32 << 20
HOT = 256
SLAB = 1 << 19
LAST = (1 << 63) - 1


def gram_hashes(data, gram: int):
    """A 64-bit hash of the ``gram`` bytes from each position."""
    import numpy as np

    base = 0x9E3779B97F4A7C15
    power = lambda n: np.uint64(pow(base, n, 1 << 64))
    byte = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)
    size, h = 1, byte[data]
    have = {1: h}
    while 2 * size <= gram:
        h = h[:-size] * power(size) + h[size:]
        size *= 2
        have[size] = h
    done = size
    for n in sorted(have, reverse=True):
        if done + n <= gram:
            tail = have[n][done : done + len(data) - done - n + 1]
            h = h[: len(tail)] * power(n) + tail
            done += n
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x, width: int):
    import numpy as np

    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(data, owner, length: int, gram: int):
    """(pick, first window, windows) of each run: neighbouring windows of one document with one pick, ``width`` at most."""
    import numpy as np

    width, total = length - gram + 1, len(data) - length + 1
    picks, starts, counts = [], [], []
    for s in range(0, max(total, 0), SLAB):
        e = min(total, s + SLAB)
        pick = sliding_min(gram_hashes(data[s : e + length - 1], gram), width)
        own = owner[s:e]
        fine = own == owner[s + length - 1 : e + length - 1]
        new = np.ones(e - s, dtype=bool)
        new[1:] = (pick[1:] != pick[:-1]) | (own[1:] != own[:-1]) | (fine[1:] != fine[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, e - s))
        at, size = at[fine[at]], size[fine[at]]
        parts = -(-size // width)
        which = np.repeat(np.arange(len(at)), parts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        picks.append(pick[at][which] * np.uint64(0x94D049BB133111EB))
        starts.append(s + at[which] + nth * width)
        counts.append(np.minimum(width, size[which] - nth * width))
    if not picks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(picks), np.concatenate(starts), np.concatenate(counts)


def bucket_of(pick, buckets: int):
    import numpy as np

    return (((pick >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


class Chunk:
    """The documents of a chunk, in order of id and text, as one array of bytes."""

    def __init__(self, rows, length: int, gram: int):
        import numpy as np

        ids, texts = rows.column("key").to_pylist(), rows.column("data").to_pylist()
        order = sorted(range(len(rows)), key=lambda i: (ids[i], texts[i]))
        self.order, self.length = order, length
        self.texts = [texts[i] for i in order]
        self.ids = np.array([ids[i] for i in order], dtype=np.int64)
        self.ends = np.cumsum([len(t) for t in self.texts])
        self.data = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        self.owner = np.repeat(np.arange(len(order), dtype=np.int32), [len(t) for t in self.texts])
        self.pick, self.start, self.count = runs(self.data, self.owner, length, gram)

    def picks(self, buckets: int):
        """The distinct picks in order, and the bounds of each bucket's."""
        import numpy as np

        pick = np.unique(self.pick)
        return pick, np.searchsorted(bucket_of(pick, buckets), np.arange(buckets + 1))

    def contexts(self, replies, buckets: int):
        """Number the distinct contexts to send: (bytes, bucket, short pick, smallest document) of each number; and the number, start and document of each occurrence."""
        import numpy as np

        pick, bounds = self.picks(buckets)
        shared, hot = np.zeros(len(pick), dtype=bool), np.zeros(len(pick), dtype=bool)
        for b, kind, bits in replies:
            n = bounds[b + 1] - bounds[b]
            (shared, hot)[kind][bounds[b] : bounds[b + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8))[:n].astype(bool)
        which = np.searchsorted(pick, self.pick)
        doc = self.ids[self.owner[self.start]] if len(self.start) else np.zeros(0, np.int64)
        low, high = np.full(len(pick), LAST), np.full(len(pick), -LAST - 1)
        np.minimum.at(low, which, doc)
        np.maximum.at(high, which, doc)
        wanted = (shared | (low != high))[which]
        which, start, count, doc = which[wanted], self.start[wanted], self.count[wanted], doc[wanted]
        times = np.where(hot[which], count, 1)
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        which, start, count, doc, single = (np.repeat(x, times) for x in (which, start, count, doc, hot[which]))
        start, count = start + nth, np.where(single, 1, count)
        raw, number, first = self.data.tobytes(), {}, []
        ids = np.zeros(len(start), dtype=np.int64)
        for i, (s, e) in enumerate(zip(start.tolist(), (start + count + self.length - 1).tolist())):
            text = raw[s:e]
            n = number.get(text)
            if n is None:
                n = number[text] = len(first)
                first.append(i)
            ids[i] = n
        least = np.full(len(first), LAST)
        np.minimum.at(least, ids, doc)
        code = pick[which[first]] if first else np.zeros(0, np.uint64)
        for n, text in enumerate(number):
            if single[first[n]]:
                code[n] = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big")
        return list(number), bucket_of(code, buckets), (code & np.uint64(0xFFFFFFFF)).astype(np.uint32), least, ids, start, count, doc


def previous_smaller(values):
    """Index of the nearest smaller value before each, or -1, by pointer jumping."""
    import numpy as np

    at = np.arange(len(values)) - 1
    todo = np.flatnonzero(at >= 0)
    while len(todo):
        todo = todo[(at[todo] >= 0) & (values[at[todo]] >= values[todo])]
        at[todo] = at[at[todo]]
    return at


def long_previous_factors(contexts: list[bytes], docs, length: int):
    """(context, window) of the windows whose longest previous factor, in a smaller document, has ``length`` bytes or more."""
    import numpy as np

    data = np.frombuffer(b"".join(contexts) + bytes(2 * length + 16), dtype=np.uint8)
    sizes = np.array([len(c) for c in contexts])
    windows = sizes - length + 1
    context = np.repeat(np.arange(len(contexts)), windows)
    window = np.arange(len(context)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = (np.cumsum(sizes) - sizes)[context] + window
    # ranks of the strings of ``size`` bytes: the first eight at once, then prefix doubling, the last step overlapping
    rank, size = np.zeros(len(data) - 7, dtype=np.uint64), min(8, length)
    for i in range(size):
        rank = (rank << np.uint64(8)) | data[i : len(data) - 7 + i]
    while size < length:
        _, rank = np.unique(rank, return_inverse=True)
        step = min(size, length - size)
        low, high = (rank[at], rank[at + step]) if size + step == length else (rank[:-step], rank[step:])
        rank = (low << 32) | high
        size += step
    if length <= 8:
        rank = rank[at]
    doc = docs[context]
    suffixes = np.lexsort((doc, rank))  # the suffix array, as deep as matters
    value, order = doc[suffixes], rank[suffixes]
    before = previous_smaller(value)
    after = len(value) - 1 - previous_smaller(value[::-1])[::-1]
    factor = (before >= 0) & (order[before] == order)
    fits = after < len(value)
    factor[fits] |= order[after[fits]] == order[fits]
    found = suffixes[factor]
    return context[found], window[found]


def _send(docs: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    def run(key, rows):
        import numpy as np
        import pyarrow as pa

        pick, bounds = Chunk(rows, length, gram).picks(buckets)
        own = np.flatnonzero(np.diff(bounds)).tolist()
        short = [pick[bounds[b] : bounds[b + 1]].astype("<u4").tobytes() for b in own]
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(own), pa.int64()), "bucket": pa.array(own, pa.int64()), "picks": pa.array(short, pa.binary())})

    return docs.groupBy("chunk").applyInArrow(run, "chunk long, bucket long, picks binary")


def _meet(sent: DataFrame, hot: int) -> DataFrame:
    """Which of each chunk's picks another chunk has too, and which more than ``hot`` chunks have."""

    def run(key, rows):
        import numpy as np
        import pyarrow as pa

        chunks = rows.column("chunk").to_pylist()
        own = [np.frombuffer(x.as_py(), "<u4") for x in rows.column("picks")]
        _, place, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        times = np.split(counts[place], np.cumsum([len(x) for x in own])[:-1])
        out = []
        for kind, least in ((0, 2), (1, hot + 1)):
            for chunk, n in zip(chunks, times):
                bits = n >= least
                if bits.any():
                    out.append((chunk, key[0].as_py(), kind, np.packbits(bits).tobytes()))
        columns = list(zip(*out)) or [[]] * 4
        return pa.table({n: pa.array(list(c), t) for n, c, t in zip(("chunk", "bucket", "kind", "a"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))}).append_column("b", pa.nulls(len(out), pa.binary()))

    return sent.groupBy("bucket").applyInArrow(run, REPLY)


REPLY = "chunk long, bucket long, kind long, a binary, b binary"


def _replies(rows):
    return [r for r in zip(*(rows.column(n).to_pylist() for n in ("bucket", "kind", "a"))) if r[1] < 2]


def _describe(docs: DataFrame, replies: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    def run(key, rows, replies):
        import numpy as np
        import pyarrow as pa
        import zstandard

        names = ("chunk", "bucket", "numbers", "picks", "docs", "sizes", "texts")
        out = [[] for _ in names]
        if len(rows):
            texts, bucket, short, least, *_ = Chunk(rows, length, gram).contexts(_replies(replies), buckets)
            press = zstandard.ZstdCompressor(level=1).compress
            order = np.argsort(bucket, kind="stable")
            present, starts = np.unique(bucket[order], return_index=True)
            for b, own in zip(present.tolist(), np.split(order, starts[1:])) if len(order) else ():
                own_texts = [texts[i] for i in own]
                parts = (own.astype("<u4").tobytes(), short[own].tobytes(), press(least[own].astype("<i8").tobytes()), np.array([len(t) for t in own_texts], "<u2").tobytes(), press(b"".join(own_texts)))
                for column, x in zip(out, (key[0].as_py(), b, *parts)):
                    column.append(x)
        return pa.table({n: pa.array(c, pa.int64() if i < 2 else pa.binary()) for i, (n, c) in enumerate(zip(names, out))})

    both = docs.groupBy("chunk").cogroup(replies.groupBy("chunk"))
    return both.applyInArrow(run, "chunk long, bucket long, numbers binary, picks binary, docs binary, sizes binary, texts binary")


def _resolve(described: DataFrame, length: int) -> DataFrame:
    """The windows of each chunk's contexts that a smaller document has: numbers and bit masks."""

    def run(key, rows):
        import numpy as np
        import pyarrow as pa
        import zstandard

        chunks = rows.column("chunk").to_pylist()
        open_ = zstandard.ZstdDecompressor().decompress
        known, ids, numbers, picks, docs = {}, [], [], [], []
        for n, p, d, s, t in zip(*(rows.column(x).to_pylist() for x in ("numbers", "picks", "docs", "sizes", "texts"))):
            text, at, own = open_(t), 0, []
            for size in np.frombuffer(s, "<u2").tolist():
                own.append(known.setdefault(text[at : at + size], len(known)))
                at += size
            ids.append(np.array(own))
            numbers.append(np.frombuffer(n, "<u4"))
            picks.append(np.frombuffer(p, "<u4"))
            docs.append(np.frombuffer(open_(d), "<i8"))
        every, all_docs, texts = np.concatenate(ids), np.concatenate(docs), list(known)
        first = np.full(len(texts), LAST)
        np.minimum.at(first, every, all_docs)
        pick = np.zeros(len(texts), np.int64)
        pick[every] = np.concatenate(picks)
        _, back, counts = np.unique(pick, return_inverse=True, return_counts=True)
        several = np.flatnonzero(counts[back] > 1)
        several = several[np.argsort(pick[several], kind="stable")]
        mask = np.zeros(len(texts), np.int64)
        at = 0
        while at < len(several):  # slabs of whole picks bound the memory of the suffix array
            end = min(len(several), at + (1 << 15))
            while end < len(several) and pick[several[end]] == pick[several[end - 1]]:
                end += 1
            part = several[at:end]
            context, window = long_previous_factors([texts[i] for i in part], first[part], length)
            np.bitwise_or.at(mask, part[context], np.int64(1) << window)
            at = end
        full = (np.int64(1) << (np.array([len(t) for t in texts]) - length + 1)) - 1
        out = []
        for chunk, own, number, doc in zip(chunks, ids, numbers, docs):
            bits = np.where(doc > first[own], full[own], mask[own])
            hit = bits > 0
            if hit.any():
                out.append((chunk, key[0].as_py(), 2, number[hit].tobytes(), bits[hit].astype("<i8").tobytes()))
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(list(c), t) for n, c, t in zip(("chunk", "bucket", "kind", "a", "b"), columns, kinds)})

    return described.groupBy("bucket").applyInArrow(run, REPLY)


def _cut(docs: DataFrame, replies: DataFrame, length: int, gram: int, buckets: int, kind: str, texts: bool) -> DataFrame:
    def run(key, rows, replies):
        import numpy as np
        import pyarrow as pa

        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        out = [[] for _ in names]
        if len(rows):
            chunk = Chunk(rows, length, gram)
            _, _, _, least, ids, start, count, doc = chunk.contexts(_replies(replies), buckets)
            mask = np.zeros(len(least), np.int64)
            for k, a, b in zip(*(replies.column(n).to_pylist() for n in ("kind", "a", "b"))):
                if k == 2:
                    mask[np.frombuffer(a, "<u4")] = np.frombuffer(b, "<i8")
            bits = np.where(doc > least[ids], (np.int64(1) << count) - 1, mask[ids]) if len(ids) else np.zeros(0, np.int64)
            change = np.zeros(len(chunk.data) + 1, np.int32)
            for w in range(int(count.max()) if len(count) else 0):
                at = start[(bits >> w) & 1 == 1] + w
                np.add.at(change, at, 1)
                np.add.at(change, at + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            original = rows.column("doc_id").to_pylist()
            begin = 0
            for i, end in zip(chunk.order, chunk.ends.tolist()):
                cut, text = gone[begin:end], chunk.data[begin:end]
                removed = int(cut.sum())
                spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if removed else 0
                kept = text[~cut].tobytes() if removed else text.tobytes()
                for column, x in zip(out, (original[i], end - begin, removed, spans, hashlib.sha256(kept).hexdigest(), kept if texts else None)):
                    column.append(x)
                begin = end
        types = (rows.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, out, types)})

    both = docs.groupBy("chunk").cogroup(replies.groupBy("chunk"))
    return both.applyInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT, texts: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of each row of ``docs``.

    ``kept``: the remaining bytes (null unless ``texts``), which need not be whole UTF-8 characters. Strings are judged
    on the input. Null texts are empty; a null doc_id counts as larger than any other; rows that repeat a doc_id do
    not remove each other's bytes. An empty table gives no rows. Texts are read whole, whatever their length, one row
    in one piece. Other columns, of whatever name, take no part.
    """
    if not gram <= length <= gram + 62:
        raise ValueError("gram must be at most length, and length at most gram + 62")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(1, -(-total // chunk_bytes)), max(1, -(-total // bucket_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"),  # by the text too: null and repeated ids may be many
    )
    met = _meet(_send(dealt, length, gram, buckets), hot)
    resolved = _resolve(_describe(dealt, met, length, gram, buckets), length)
    return _cut(dealt, met.unionByName(resolved), length, gram, buckets, kind, texts)


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("kept")
