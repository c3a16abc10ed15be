from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from epitrail.llm import mixing, queries
from tests.llm.helpers import awkward, documents, empty


def plain_targets(sizes):
    """Sharing by weight again and again, as stated."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] >= 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_takes(spark):
    rows = []
    for s, n, k in (("tiny", 2, 5), ("big", 300, 40), ("mid", 60, 30), (None, 20, 10), ("zero", 3, 0)):
        rows += [(len(rows) + i, s, " ".join(["w"] * (k + i % 7 if k else 0))) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = plain_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6
        assert taken[s] == round(target[s])
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    coarse = mixing.mix(df, slot=1000).collect()  # how wide slots are is no matter for what is taken
    words = lambda rows: sorted(str((r.doc_id, r.size, r.source_size, r.target, r.taken)) for r in rows)
    assert words(out) == words(coarse)


def test_small_sources_beside_a_large_one(spark):
    """Slots of many words: every source still comes to its target."""
    rows = []
    for s, n, k in (("huge", 400, 100), ("tiny", 3, 7), ("a little", 5, 20), (None, 4, 10), ("zero", 2, 0)):
        rows += [(len(rows) + i, " ".join(["w"] * k), None, s, 2 * k) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken, target = defaultdict(int), {}
    for r in mixing.mix(df, slot=700).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert dict(taken) == {s: round(t) for s, t in target.items()} and taken["tiny"] == 63
    words = defaultdict(int)
    for r in mixing.mixed_documents(df, slot=700).collect():
        words[r.source] += len(r.text.split())
    assert dict(words) == {s: n for s, n in taken.items() if n}


def test_documents_of_the_mix(spark):
    df = documents(spark, 50)
    taken = {r.doc_id: r for r in mixing.mix(df).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    words = defaultdict(int)
    for r in mixing.mixed_documents(df).collect():
        own = r.text.split()
        assert own == texts[r.doc_id].split()[: len(own)] and r.n_chars == len(r.text)
        words[r.doc_id] += len(own)
    assert dict(words) == {d: r.taken for d, r in taken.items() if r.taken}


def test_awkward_and_empty(spark):
    df = awkward(spark)
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count() and all(r.taken <= 3 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert sum(len(r.text.split()) for r in out.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


def test_many_small_sources(spark):
    """Each of 60 sources comes to its target, though most are smaller than a slot."""
    rows = [(i, " ".join(["w"] * (1 + i % 4)), f"s{i % 60:02d}" if i % 3 else "large") for i in range(240)] + [(1000 + i, " ".join(["w"] * 500), "large") for i in range(40)]
    taken, target = defaultdict(int), {}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(target) > 40 and dict(taken) == {s: round(t) for s, t in target.items()}


def test_schedule_is_even(spark, monkeypatch):
    """Every stretch of the mix has about its share of slots of each source; ranks have no gaps; chunks don't matter."""
    goals = spark.createDataFrame([("a", 10_000, 5_000.0), ("b", 10_000, 3_000.0), (None, 10_000, 2_000.0), ("tiny", 1, 3.0)], "source string, source_size long, target double")
    out = [(r.source, r["rank"], r["at"]) for r in mixing.schedule(goals, slot=10).collect()]
    share = {"a": 0.5, "b": 0.3, None: 0.2}
    for s, n in (("a", 500), ("b", 300), (None, 200), ("tiny", 1)):
        own = sorted((k, at) for x, k, at in out if x == s)
        assert [k for k, _ in own] == list(range(n)) and [at for _, at in own] == sorted(at for _, at in own)
    for start in range(0, 900, 50):
        for s, p in share.items():
            assert abs(sum(start <= at < start + 100 for x, _, at in out if x == s) - 100 * p) <= 4
    monkeypatch.setattr(mixing, "CHUNK", 37)
    assert sorted(map(str, out)) == sorted(str((r.source, r["rank"], r["at"])) for r in mixing.schedule(goals, slot=10).collect())


NAMES = ("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def written_out(spark, folder):
    """Documents of a hot source, of sources smaller than a slot, without a source, without words."""
    rows = [(i, " ".join(["w"] * (i * 37 % 301)), None, ["hot", "hot", "b", None, "zz"][i % 5], 0) for i in range(300)]
    rows += [(1000 + i, "three short words", None, f"t{i}", 17) for i in range(7)] + [(2000, None, None, "none", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return sorted(map(str, con.sql(queries.OP6_SQL).select(*NAMES).fetchall()))


def test_query_against_sql(spark, tmp_path):
    want = written_out(spark, tmp_path)
    got = mixing.op6_mixing_sources(spark, str(tmp_path))
    assert tuple(got.columns) == NAMES and sorted(str(tuple(r)) for r in got.collect()) == want


def test_plain_ranks_would_not_do(spark, tmp_path, monkeypatch):
    """The result is the schedule's: slots dealt source by source give other rows."""
    want = written_out(spark, tmp_path)
    real = mixing.schedule

    def plain(goals, slot=mixing.SLOT):
        return real(goals, slot).withColumn("at", F.row_number().over(Window.orderBy("source", "rank")).cast("long") - 1)

    monkeypatch.setattr(mixing, "schedule", plain)
    assert sorted(str(tuple(r)) for r in mixing.op6_mixing_sources(spark, str(tmp_path)).collect()) != want


@pytest.mark.parametrize("parts", [1, 7])
def test_rows_stand_in_the_order_of_the_schedule(spark, parts):
    """Every stretch of the mix holds about the sources' shares, and slots of a source follow its stream."""
    rows = [(i, " ".join(["w"] * 60), None, "abc"[min(i % 6, 2)], 119) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)
    out = [r.source for r in mixing.mixed_documents(df).collect()]
    share = {s: out.count(s) / len(out) for s in "abc"}
    for start in range(0, len(out) - 150, 50):
        for s, p in share.items():
            assert abs(out[start : start + 100].count(s) - 100 * p) <= 6
    mixed = mixing.mix(df).collect()
    places = [p for r in mixed for p in r.places if p is not None]
    assert all(r.n_slots >= sum(p is not None for p in r.places) for r in mixed) and len(places) == len(out)
