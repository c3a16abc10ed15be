import random
from collections import Counter, defaultdict

import pytest
from xxhash import xxh64_intdigest

from epitrail.llm import simhash
from tests.llm.helpers import COLORS, awkward, documents, empty, prose


def brute_fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: list of (doc_id, fingerprint)."""
    up = {f: f for _, f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = list(up)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 2:
                up[find(a)] = find(b)
    least = defaultdict(lambda: float("inf"))
    for d, f in fps:
        if d is not None:
            least[find(f)] = min(least[find(f)], d)
    return [(d, f, least[find(f)]) for d, f in fps]


def test_matches_brute_force(spark):
    rng = random.Random(8)
    base = [prose(rng, 150) for _ in range(30)]
    rows = []
    for i in range(200):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(COLORS).upper() + "É"
        rows.append((i, " ".join(w) if i % 17 else rng.choice([None, "", "a b"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect())
    want = sorted(brute_components([(d, brute_fingerprint(t)) for d, t in rows]))
    assert found == want
    assert max(Counter(x[2] for x in want).values()) > 3


def test_links_of_dense_fingerprints(spark):
    """Chains and clusters of fingerprints within two bits, far more than meet by chance."""
    rng = random.Random(4)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                x ^= 1 << b
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    from epitrail.llm.common import connected_components

    got = dict(connected_components(simhash.near_links(df)).collect())
    parts = defaultdict(set)
    for x in fps:
        parts[got.get(simhash.signed(x), simhash.signed(x))].add(x)
    want = defaultdict(set)
    for x, _, c in brute_components([(x, x) for x in fps]):
        want[c].add(x)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want.values()))


def test_covering():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m & (1 << i | 1 << j) for m in masks)
    with pytest.raises(ValueError):
        simhash.near_links(None, 3)


def test_awkward_and_empty(spark):
    df = awkward(spark)
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == df.count()
    by = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == 4 and by[6] == by[7] == 6
    assert {r.component_id for r in rows if r.doc_id is None} == {1, 4}
    kept = sorted(r.doc_id for r in simhash.deduplicated(df).collect())
    assert kept == [-9, 1, 4, 6, 8]
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.deduplicated(empty(spark)).count() == 0


def test_query_columns(spark, tmp_path):
    documents(spark, 20).write.parquet(f"{tmp_path}/documents.parquet")
    df = simhash.op4_simhash_near_dedup(spark, str(tmp_path))
    assert df.columns == ["doc_id", "fingerprint", "component_id"] and all(len(r.fingerprint) == 16 for r in df.collect())


def brute_copies(texts):
    """Component of each text by the exact Jaccard similarity of five-word shingles of all pairs."""
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    sets, up = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                r, s = find(a), find(b)
                up[max(r, s)] = min(r, s)
    return [find(x) for x in range(len(texts))]


def test_near_copies_match_brute_force_jaccard(spark):
    rng = random.Random(12)
    texts = [None, "", " ", "a b", "A  b", "a b c"]
    for n in [20, 60] * 10 + [200] * 25 + [500] * 10:
        base = [f"{rng.choice(COLORS)}{rng.randrange(500)}" for _ in range(n)]
        texts.append(" ".join(base))
        for edits in (1, max(1, n // 100), n // 50, n // 40, n // 25):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(n)] = f"edit{rng.randrange(10_000)}"
            texts.append(" ".join(words))
        texts.append(" ".join([*base, "one", "more"]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_copies(texts)
    roots = {r.doc_id: r.root for r in simhash.near_copies(df).collect()}
    least = {}
    for d in sorted(roots):
        least.setdefault(roots[d], d)
    found = [least[roots[d]] for d in range(len(texts))]
    assert len(set(want)) < 0.6 * len(texts)
    assert sum(a != b for a, b in zip(found, want)) <= 0.005 * len(texts)
    import corpus_pipeline

    docs = df.selectExpr("doc_id", "text", "'en' as lang", "'a' as source", "length(text) as n_chars")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()) == sorted(set(found))
