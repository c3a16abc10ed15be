import hashlib

import pytest

from epitrail.llm import suffix
from tests.llm.helpers import awkward, documents, empty


def brute(rows, length):
    last = (1 << 63) - 1
    first = {}
    rows = [(i, (t or "").encode()) for i, t in rows]
    for i, b in rows:
        key = last if i is None else i
        for w in range(len(b) - length + 1):
            s = b[w : w + length]
            first[s] = min(first.get(s, last), key)
    out = []
    for i, b in rows:
        key = last if i is None else i
        gone = bytearray(len(b))
        for w in range(len(b) - length + 1):
            if first[b[w : w + length]] < key:
                gone[w : w + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted((tuple(r)[:5] for r in suffix.remove_repeats(df, **kw).collect()), key=str)


@pytest.mark.parametrize("kw", [{}, {"chunk_bytes": 3000, "bucket_bytes": 2000}, {"chunk_bytes": 1500, "bucket_bytes": 4000, "hot": 3}, {"chunk_bytes": 900, "bucket_bytes": 900, "hot": 0}])
def test_matches_brute_force(spark, kw):
    df = documents(spark, 80)
    want = brute([(r.doc_id, r.text) for r in df.collect()], 50)
    assert sum(r[2] for r in want) > 1000
    assert got(df, **kw) == want


@pytest.mark.parametrize("length,gram", [(10, 4), (30, 8), (50, 32)])
def test_other_lengths(spark, length, gram):
    df = documents(spark, 30, seed=4)
    assert got(df, length=length, gram=gram, chunk_bytes=2000, bucket_bytes=1000) == brute([(r.doc_id, r.text) for r in df.collect()], length)


def test_periodic_and_multibyte(spark):
    rows = [(i, "ab" * (30 + i) + "é" * (i * 7) + "Nd, " * (i * 20)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, chunk_bytes=500, bucket_bytes=500) == brute(rows, 50)


def test_awkward(spark):
    df = awkward(spark)
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()], 50)


def test_empty(spark):
    assert got(empty(spark)) == []


def test_previous_smaller():
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 300):
        v = rng.integers(0, 9, n)
        want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(n)]
        assert suffix.previous_smaller(v).tolist() == want
