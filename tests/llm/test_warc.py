import base64
import hashlib
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from epitrail.llm import warc
from epitrail.llm.common import new_path

SCHEMA = "page_id long, url string, html string"


def brute(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of (page_id, url, html); of fully equal rows one is the response."""
    full = [(i, u, (h or "").encode()) for i, u, h in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    out, given = [], set()
    for i, u, b in full:
        best = max((r for r in full if r[2] == b), key=key)
        response = len(b) < least or (key(best) == key((i, u, b)) and b not in given)
        if response:
            given.add(b)
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else best[0]))
    return sorted(out, key=str)


def pages(spark, n=200, seed=2):
    rng = random.Random(seed)
    bodies = [f"<p>{rng.random()}</p>é漢\r\n\r\nWARC/1.1\r\n" * rng.randint(0, 400) for _ in range(n // 3)]
    rows = [(i, f"http://a.example/{i}?q= é\r\nX: y", rng.choice(bodies)) for i in range(n)]
    rows += [(n + 1, None, None), (n + 2, None, ""), (None, None, "x"), (None, "u", "x"), (n + 3, "u", "x"), (5, "v", "twice"), (5, "v", "twice"), (5, "w", "twice"), (6, "v", "twice")]
    return spark.createDataFrame(rows, SCHEMA)


def told(records):
    return sorted((tuple(r) for r in records.select(warc.page_id_of(F.col("record_id")), "payload_bytes", "payload_digest", "record_type", warc.page_id_of(F.col("refers_to_id"))).collect()), key=str)


@pytest.mark.parametrize("kw,small", [({}, 20_000), ({"frame": 1}, 20_000), ({"frame": 5000, "bundle": 20_000}, 0), ({"least": 100}, 20_000)])
def test_round_trip(spark, monkeypatch, kw, small):
    monkeypatch.setattr(warc, "SMALL", small)  # payloads of several pages: broadcast or not
    df = pages(spark)
    folder = new_path(spark, "warc")
    index = warc.write_bundles(df, folder, **kw)
    records = warc.read_bundles(index)
    assert told(records) == brute([tuple(r) for r in df.collect()], kw.get("least", 0))
    rows = records.collect()
    assert len({r.record_id for r in rows}) == len(rows) == df.count()
    # every page's text comes back, a revisit's by the record that it names
    payload = {r.record_id: r.payload for r in rows}
    back = sorted((str(warc_id(r)), payload[r.refers_to_id if r.record_type == "revisit" else r.record_id]) for r in rows)
    assert back == sorted((str(r.page_id), (r.html or "").encode()) for r in df.collect())


def warc_id(r):
    part = r.record_id.split("/")[1]
    return None if part == "null" else int(part)


def test_fetch_reads_the_records_asked_for(spark):
    df = pages(spark)
    index = warc.write_bundles(df, new_path(spark, "warc"), frame=4000)
    records = {r.record_id: r for r in warc.read_bundles(index).collect()}
    some = spark.createDataFrame([(i,) for i in sorted(records)[::10]] * 2, "record_id string")
    got = warc.fetch(index, some).collect()
    assert len(got) == len(sorted(records)[::10]) and all(records[r.record_id] == r for r in got)


def test_bundles_are_plain_zstandard(spark):
    df = pages(spark)
    index = warc.write_bundles(df, new_path(spark, "warc"), frame=3000)
    files = [r.file for r in index.select("file").distinct().collect()]
    n = 0
    for file in files:
        store, at = warc.opened(file)
        data = store.open_input_file(at).read()
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        o = 0
        while o < len(whole):
            _, _, o = warc.parse_record(whole, o)
            n += 1
    assert n == df.count()
    # an index entry names the frame and the place in it
    entry = index.where("frame > 0 AND offset > 0").first()
    store, at = warc.opened(entry.file)
    with store.open_input_file(at) as source:
        first, packed = warc.read_seek_table(source, source.size())[entry.frame]
        frame = zstandard.ZstdDecompressor().decompress(source.read_at(packed, first))
    headers, _, end = warc.parse_record(frame, entry.offset)
    assert headers["warc-record-id"] == f"<{entry.record_id}>" and end - entry.offset == entry.length


def test_damage_is_an_error():
    record = warc.record_bytes("tag:x", "response", "u", None, "A" * 32, 3, b"abc")
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(*warc.parse_record(record)[:2])
    with pytest.raises(ValueError, match="does not end"):
        warc.parse_record(record.replace(b"\r\nabc\r\n", b"\r\nabcd\r\n"))


def test_base32(spark):
    words = ["", "a", "é漢", "x" * 1000]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", warc.base32_sha1(F.col("w").cast("binary")).alias("d"))
    assert all(r.d == base64.b32encode(hashlib.sha1(r.w.encode()).digest()).decode() for r in df.collect())


def query(spark, df, folder):
    df.write.parquet(f"{folder}/pages.parquet")
    return sorted((tuple(r) for r in warc.op13_warc_bundles(spark, str(folder)).collect()), key=str)


def test_query_with_clashing_columns(spark, tmp_path):
    df = pages(spark, 60)
    want = brute([tuple(r) for r in df.collect()])
    for name in ("payload", "digest", "n", "first", "copies", "kind", "best", "record_id", "file"):
        df = df.withColumn(name, F.lit("clash"))
    assert query(spark, df, tmp_path) == want


def test_copies_beyond_a_block_and_long_pages(spark, tmp_path):
    many = spark.range(9000).select(F.lit(7).cast("long").alias("page_id"), F.lit("u").alias("url"), F.lit("<p>").alias("html"))
    group = spark.range(100, 3100).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("<b>").alias("html"))
    long = spark.createDataFrame([(9, "u", "y" * 5_000_000)], SCHEMA)
    out = query(spark, many.unionByName(group).unionByName(long), tmp_path)
    assert len(out) == 12_001
    assert [r for r in out if r[3] == "response"] == sorted((r for r in out if r[0] in (9, 3099) or r[0] == 7 and r[4] is None), key=str)
    assert {r[4] for r in out if r[3] == "revisit"} == {7, 3099} and sum(r[0] == 7 for r in out) == 9000


def test_empty(spark, tmp_path):
    assert query(spark, spark.createDataFrame([], SCHEMA), tmp_path) == []
