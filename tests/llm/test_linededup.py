import random

from epitrail.llm import linededup
from epitrail.llm.common import connected_components
from tests.llm.helpers import COLORS, awkward, empty, prose


def grams(t):
    t = t.strip(" \t\r\v\f").lower()
    return {t[i : i + 5] for i in range(len(t) - 4)} if len(t) >= 5 else {t}


def brute(rows):
    """Component of each (doc_id, line_no) by comparing all pairs."""
    places = [((i, k), grams(line)) for i, t in rows if t is not None for k, line in enumerate(t.split("\n")) if line.strip(" \t\r\v\f")]
    up = {p: p for p, _ in places}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(places)):
        for b in range(a):
            x, y = places[a][1], places[b][1]
            if len(x & y) >= 0.8 * len(x | y):
                r, s = find(places[a][0]), find(places[b][0])
                up[max(r, s)] = min(r, s)
    return {p: find(p) for p, _ in places}


def got(df):
    return {(r.doc_id, r.line_no): tuple(r.first) for r in linededup.line_classes(df).collect() if r.first}


def test_matches_brute_force(spark):
    rng = random.Random(3)
    base = [prose(rng, rng.randint(1, 60)) for _ in range(40)]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(COLORS)
            lines.append(rng.choice(["", "  "]) + " ".join(words) + rng.choice(["", "\r"]))
        rows.append((i, "\n".join(lines + [""] * (i % 3))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, found = brute(rows), got(df)
    assert found.keys() == want.keys()
    assert len(set(want.values())) < len(want) * 0.8
    assert sum(found[p] != want[p] for p in want) <= 0.005 * len(want)


def test_long_lines_with_edits_at_word_starts(spark):
    rng = random.Random(14)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = []
    for low, high, n in [(2, 10, 60)] * 60 + [(8, 12, 40)] * 60:
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)]
        order, edited, base = rng.sample(range(n), n), list(words), grams(" ".join(words))
        for i in order:  # as many edits as 0.8 allows
            kept = edited[i]
            edited[i] = rng.choice(['"' + kept, rng.choice(letters) + kept[1:]])
            other = grams(" ".join(edited))
            if len(base & other) < 0.8 * len(base | other):
                edited[i] = kept
                break
        texts += [" ".join(words), " ".join(edited)]
    assert min(map(len, texts)) >= 300
    rows = list(enumerate(texts))
    want, found = brute(rows), got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(set(want.values())) == len(texts) // 2
    assert sum(found[p] != want[p] for p in want) <= 0.02 * len(texts) // 2


def test_repetitive_lines_of_different_lengths(spark):
    """Equal shingle sets, whatever the lengths."""
    texts = [("- " * n)[:length] for n, length in ((100, 199), (200, 399))] + [("ha " * n)[:length] for n, length in ((60, 179), (150, 449))]
    rows = list(enumerate(texts))
    want = brute(rows)
    assert sorted(want.values()) == [(0, 0), (0, 0), (2, 0), (2, 0)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    words = prose(rng, 60).split()
    rows = []
    for i in range(400):
        w = list(words)
        for _ in range(i % 4):
            w[rng.randrange(60)] = rng.choice(COLORS)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert set(got(df).values()) == {(0, 0)}


def test_awkward(spark):
    df = awkward(spark)
    rows = linededup.line_classes(df).collect()
    kept = {(r.doc_id, r.line_no, r.kept) for r in rows}
    assert (6, 0, True) in kept and (7, 0, False) in kept
    assert (4, 0, True) in kept and (5, 0, False) in kept and (None, 0, False) in kept
    assert {(2, 0, True), (3, 0, True), (3, 1, True)} <= kept
    out = {(r.doc_id, r.text, r.n_chars) for r in linededup.deduplicated(df).collect()}
    assert (1, None, None) in out and (7, "", 0) in out and (3, "   \n\t ", 6) in out and len(linededup.deduplicated(df).columns) == len(df.columns)


def test_empty(spark):
    assert linededup.line_classes(empty(spark)).count() == 0


def test_deduplicated_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "one line of text that is here\n\nanother one"), (2, "intro of two\none line of text that is here\n")], "doc_id long, text string").selectExpr("*", "length(text) as n_chars")
    out = dict(linededup.deduplicated(df).select("doc_id", "text").collect())
    assert out == {1: "one line of text that is here\n\nanother one", 2: "intro of two\n"}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 1)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            r, s = find(a), find(b)
            up[max(r, s)] = min(r, s)
    want = {x: find(x) for x in list(up)}
    assert dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()) == want


def test_sketches_leave_out_no_similar_pair(spark):
    from pyspark.sql import functions as F

    from epitrail.llm.common import may_resemble, sketched

    rng, sets = random.Random(9), []
    for i in range(60):
        base = [rng.getrandbits(64) - (1 << 63) for _ in range(rng.choice([1, 5, 40, 300, 1500]))]
        for _ in range(3):
            edits = rng.randint(0, max(1, len(base) // 4))
            sets.append(set(base[edits:]) | {rng.getrandbits(64) - (1 << 63) for _ in range(rng.randint(0, edits))})
    sets = [s for s in sets if s]
    made = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "nid long, h array<long>")
    sk = sketched(made).cache()
    assert {r.nid: r.n for r in sk.collect()} == {i: len(s) for i, s in enumerate(sets)}
    pairs = sk.alias("a").join(sk.alias("b"), (F.col("a.nid") < F.col("b.nid")) & may_resemble("a", "b", 0.8)).select("a.nid", "b.nid").collect()
    passed = {tuple(p) for p in pairs}
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert alike and alike <= passed
    assert len(passed) < 4 * len(alike)


def test_family_of_variants_that_resemble_the_first_too_little(spark):
    """Links between two variants of a large group, neither of which resembles its first line."""
    rng = random.Random(21)
    base = prose(rng, 60).split()
    texts = [" ".join(base)]
    for i in range(150):  # each changes 9 words of the base; some pairs of them share most changes
        if i % 10 == 1:
            w = texts[-1].split()
            w[rng.randrange(60)] = rng.choice(COLORS)
        else:
            w = list(base)
            for k in rng.sample(range(60), 9):
                w[k] = rng.choice(COLORS) + rng.choice("qvwxyz")
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    want, found = brute(rows), got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 10 <= sum(a != b for (a, _), (b, _) in want.items()) <= 60
    assert sum(found[p] != want[p] for p in want) <= 1


def test_pair_recall_by_length(spark):
    """Pairs of similarity 0.80 to 0.85 at all lengths, edits anywhere: at least 0.95 are joined."""
    rng = random.Random(33)
    letters = "abcdefghijklmnopqrstuvwxyz      "
    for length, pairs in ((50, 200), (300, 200), (1_300, 100), (10_000, 20)):
        texts = []
        while len(texts) < 2 * pairs:
            one = "x" + "".join(rng.choice(letters) for _ in range(length - 2)) + "x"
            two, a, b = list(one), grams(one), set()
            goal = rng.uniform(0.8, 0.83)
            for at in rng.sample(range(1, length - 1), length - 2):
                kept, two[at] = two[at], rng.choice(letters[:26])
                b = grams("".join(two))
                if len(a & b) < goal * len(a | b):
                    two[at] = kept
                    break
                if length >= 10_000 and len(a & b) > 0.9 * len(a | b):
                    for more in rng.sample(range(1, length - 1), 20):
                        two[more] = rng.choice(letters[:26])
            b = grams("".join(two))
            if 0.8 <= len(a & b) / len(a | b) <= 0.85:
                texts += [one, "".join(two)]
        found = got(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        joined = sum(found[2 * i, 0] == found[2 * i + 1, 0] for i in range(pairs))
        assert joined >= 0.95 * pairs, (length, joined)


def test_deduplicated_stands_any_column_name(spark):
    df = awkward(spark)
    for name in ("version", "flags", "row", "first", "kept", "_version", "digest", "nid"):
        df = df.withColumn(name, df.text)
    out = linededup.deduplicated(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert {(r.doc_id, r.text, r.version == r.row) for r in out.where("doc_id = 7").collect()} == {(7, "", True)}


def test_pairs_of_several_keys_become_one_row(spark):
    """Variants that share many keys: each pair is made once, and none with a hub, which has met all."""
    from epitrail.llm.common import sketched, unmet_pairs

    rng = random.Random(4)
    base = [rng.getrandbits(60) for _ in range(100)]
    sets = {nid: base[:95] + [rng.getrandbits(60) for _ in range(5)] for nid in range(1, 9)}
    keys = {key: [0, *range(1 + key % 2, 9)] for key in (7, 8, 9, 10)}
    apart = [(key, nid, 0, nid if nid > 5 else 0, 0) for key, members in keys.items() for nid in members]
    sketches = sketched(spark.createDataFrame(list(sets.items()), "nid long, h array<long>"))
    pairs = unmet_pairs(spark.createDataFrame(apart, "key long, nid long, hub long, part long, largest long"), sketches, 0.8)
    want = [(a, b) for a in range(1, 9) for b in range(max(a, 5) + 1, 9)]
    assert sorted(map(tuple, pairs.collect())) == want


def test_saved_leaves_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    from epitrail.llm.common import CLEANUP, discard, saved

    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in files.mkString("\n").split("\n") if "/shuffle_" in f}

    before, setting = held(), spark.conf.get(CLEANUP)
    made = saved(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), "counts")
    left = held() - before
    assert made.count() == 700 and not left and spark.conf.get(CLEANUP) == setting
    discard(made)


def test_small_sketches_leave_out_no_similar_pair(spark):
    from pyspark.sql import functions as F

    rng, sets = random.Random(12), []
    for size in [1, 2, 4, 5, 9, 20, 31, 32, 33, 46, 100, 300, 1500] * 6:
        base = [rng.getrandbits(64) - (1 << 63) for _ in range(size)]
        off = int(size * rng.uniform(0, 0.111))
        sets += [base, base[off:] + [rng.getrandbits(64) - (1 << 63) for _ in range(off)], [rng.getrandbits(64) - (1 << 63) for _ in range(size)]]
    low = [x.alias(f"low_{w}") for w, x in enumerate(linededup.low_bits(F.col("h")))]
    made = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "nid long, h array<long>")
    made = made.select("nid", F.struct(F.size("h").alias("size"), *low).alias("n")).cache()
    a, b = made.alias("a"), made.alias("b")
    fits = linededup.small_sketches_allow(0.8)(F.col("a.n"), F.col("b.n"))
    passed = {tuple(p) for p in a.join(b, (F.col("a.nid") < F.col("b.nid")) & fits).select("a.nid", "b.nid").collect()}
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
    assert len(alike) >= len(sets) // 3 and alike <= passed
    assert len(passed) < 2 * len(alike)


def test_lines_that_share_keys_by_chance_are_not_fetched(spark, monkeypatch):
    """With one hash a key, unlike lines share keys; only texts of those that may resemble another are cut and compared."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(150)]
    texts += [t + " and more" for t in texts[:10]]
    sizes, saved = {}, linededup.saved

    def counted(df, name):
        out = saved(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(linededup, "saved", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.first.doc_id for r in linededup.line_classes(df, rows=1).collect()}
    assert found == {i: i % 150 for i in range(160)}
    assert 20 <= sizes["texts"] <= 30


def test_places_of_points(spark):
    """As by bisection; only the lower half of the points is looked for from the start."""
    from bisect import bisect

    from pyspark.sql import functions as F

    from epitrail.llm.common import places

    rng = random.Random(6)
    for n in (1, 2, 5, 12):
        points = [(2 * j + 1 - n) * ((1 << 63) // n) for j in range(n)]
        sets = [sorted(rng.getrandbits(64) - (1 << 63) for _ in range(size)) for size in (1, 2, 7, 40, 900)]
        df = spark.createDataFrame([(h, sorted(h + points)) for h in sets], "h array<long>, both array<long>").select("h", places("both", points).alias("at"))
        assert all(r["at"] == [bisect(r.h, p) for p in points] for r in df.collect())
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("array_position(both") == (n + 1) // 2 and plan.count("array_position(reverse(") == n // 2
