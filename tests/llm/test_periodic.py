import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest

from epitrail.llm import periodic
from epitrail.llm.common import WORD
from tests.llm.helpers import awkward, documents, empty


def brute_runs(words):
    """Straight from the definition: every period, every place, smallest periods by trial."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            if j > i and length >= max(24, 3 * q):
                run = words[start : start + length]
                if not any(run[d:] == run[:-d] for d in range(1, q)):
                    out.append((start, length, q))
            i = j + 1
    return sorted(out)


def rewritten(doc_id, text):
    words = re.findall(WORD, text or "")
    if doc_id is None:
        return words
    h = crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = rewritten(doc_id, text)
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *figures, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)), len(words))


def sequences():
    rng = random.Random(3)
    out = [[], [1], [1] * 23, [1] * 24, [1] * 200, [1, 2] * 12, [1, 2, 3, 4] * 6 + [1, 2], list(range(8)) * 3, list(range(9)) * 3, [0, 1] * 20 + [1, 0] * 20]
    for _ in range(300):
        some = []
        while len(some) < rng.randint(1, 400):
            base = [rng.randint(0, rng.choice([1, 2, 5, 300])) for _ in range(rng.randint(1, 40))]
            some += base * rng.choice([1, 1, 2, 3, 4, 9]) + base[: rng.randint(0, len(base))]
            if rng.random() < 0.3:  # one word changed
                some[rng.randrange(len(some))] = 7
        out.append(some)
    nested = [1, 2] * 13 + [3]
    return [*out, nested * 4, (nested * 3 + [9]) * 3]


@pytest.mark.parametrize("filtered", [0, 1 << 60])
def test_runs_match_the_definition(filtered):
    seen = 0
    for words in sequences():
        want = brute_runs(words)
        seen += len(want)
        assert periodic.runs_of(np.array(words, dtype=np.int64), filtered=filtered) == want
    assert seen > 200


def test_stretches():
    bits = "0111011110000011111111"[::-1]
    ones = int(bits, 2)
    assert list(periodic.stretches(ones, len(bits))) == [(1, 3), (5, 8), (14, 21)]
    for length in range(1, 10):
        starts = [i for i in range(len(bits)) if all(ones >> (i + k) & 1 for k in range(length))]
        assert periodic.stretch_starts(ones, length) == sum(1 << i for i in starts)


def test_long_text_does_not_grow_with_the_square():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 5000, 1_000_000)
    ids[200_000:500_000] = np.tile(ids[200_000:275_000], 4)
    ids[700_000:700_300] = np.tile(ids[700_000:700_003], 100)
    found = periodic.runs_of(ids)
    assert (700_000, 3) in {(s, q) for s, _, q in found} and (200_000, 75_000) in {(s, q) for s, _, q in found}
    assert len(periodic.likely_lags(ids)) < 3000


def query(spark, df, folder):
    df.write.parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in periodic.op12_periodic_runs(spark, str(folder)).collect()), key=str)


def test_query(spark, tmp_path):
    df = documents(spark, 200)
    want = sorted((expected(r.doc_id, r.text) for r in df.collect()), key=str)
    assert sum(r[1] for r in want) > 8
    assert query(spark, df, tmp_path) == want


def test_awkward(spark, tmp_path):
    ring = " ".join(["one", "two", "three"] * 5000)
    more = [(i, ring, "en", "a", 1) for i in (20, 20, 21)] + [(22, "x " * 40_000, None, None, None)]
    df = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    for name in ("runs", "collapsed", "id", "n_words", "best", "start"):
        df = df.withColumn(name, df.lang)
    short = [r for r in df.collect() if len(r.text or "") < 10_000]
    out = query(spark, df, tmp_path)
    assert len(out) == df.count()
    for r in short:
        assert expected(r.doc_id, r.text) in out
    by_id = {r[0]: r for r in out}
    assert by_id[22][1:6] == (1, 0, 40_000, 1, 40_000_000)
    assert sum(r[0] == 20 for r in out) == 2


def test_repeated_row_many_times(spark, tmp_path):
    one = spark.createDataFrame([(5, "la la la " * 20)], "doc_id long, text string")
    df = one.crossJoin(spark.range(3000)).select("doc_id", "text")
    assert set(query(spark, df, tmp_path)) == {expected(5, "la la la " * 20)}


def test_empty(spark, tmp_path):
    assert query(spark, empty(spark), tmp_path) == []
    assert periodic.periodic_runs(empty(spark)).collect() == []
