import random
from collections import defaultdict
from zlib import crc32

import numpy as np
from tokenizers import Tokenizer

from epitrail.llm import packing, tokencount
from epitrail.llm.common import new_path
from tests.llm.helpers import awkward, documents, empty


def ids_of(text, tokenizer=Tokenizer.from_file(packing.tokenizer_path())):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def check(rows, texts, window=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids = np.array([*ids_of(text), 0], dtype="<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and 0 < r.length <= window
            assert r.ids_crc32 == crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return by_sequence


def test_round_trip(spark):
    df = documents(spark, 60)
    long = spark.createDataFrame([(1000, "word " * 5000, "en", "a", 1), (1001, "é   ！ \x1c x\n\n  y \x85 'll 12³ ñ", "en", "a", 1)], df.schema)
    df = df.unionByName(long)
    rows = packing.pack(df, shard=20).collect()
    sequences = check(rows, {r.doc_id: r.text for r in df.collect()})
    padding = sum(1024 - sum(r.length for r in own) for own in sequences.values())
    assert padding < 1024 * 5


def test_awkward_and_empty(spark):
    rows = packing.pack(awkward(spark)).collect()
    assert sum(r.start == 0 for r in rows) == 12
    assert {(r.length, r.doc_tokens) for r in rows if r.doc_id in (1, 2)} == {(1, 1)}
    once = [r for r in rows if r.doc_id not in (4, None)]
    check_texts = {r.doc_id: r.text for r in awkward(spark).collect() if r.doc_id not in (4, None)}
    for doc, text in check_texts.items():
        assert sum(r.length for r in once if r.doc_id == doc) == len(ids_of(text)) + 1
    assert packing.pack(empty(spark)).count() == 0


def test_best_fit_against_plain_search():
    rng = random.Random(2)
    for _ in range(20):
        lengths = sorted((rng.randint(1, 64) for _ in range(rng.randint(0, 200))), reverse=True)
        placed = packing.best_fit_decreasing(lengths, 64)
        left = []
        for n, (sequence, offset) in zip(lengths, placed):
            fitting = [r for r in left if r >= n]
            if fitting:
                assert left[sequence] == min(fitting) and offset == 64 - left[sequence]
            else:
                assert sequence == len(left) and offset == 0
                left.append(64)
            left[sequence] -= n


def test_token_counts(spark):
    df = documents(spark, 40).unionByName(spark.createDataFrame([(99, "a <|endoftext|> b", "en", "a", 1), (98, "", "en", "a", 0), (97, None, None, None, None)], documents(spark, 1).schema))
    folder = new_path(spark, "tokens")
    manifest = tokencount.write_token_files(df.repartition(3), folder)
    plain = Tokenizer.from_file(packing.tokenizer_path())
    plain.encode_special_tokens = True
    want = {r.doc_id: len(ids_of(r.text, plain)) for r in df.collect()}
    for block in (7, 64, 1 << 20):
        found = tokencount.count_tokens(spark, folder, block=block).join(manifest, ["file", "ordinal"]).collect()
        assert {r.doc_id: r.n_tokens for r in found} == want and len(found) == len(want) and all(r.terminated for r in found)


def test_unterminated_file(spark, tmp_path):
    np.array([5, 6, 50256, 50256, 7, 8, 9, 50256, 1, 2], dtype="<u2").tofile(tmp_path / "a.bin")
    np.array([], dtype="<u2").tofile(tmp_path / "b.bin")
    np.array([3] * 50, dtype="<u2").tofile(tmp_path / "c.bin")
    for block in (1, 3, 100):
        rows = sorted(tuple(r) for r in tokencount.count_tokens(spark, f"file://{tmp_path}", block=block).collect())
        assert rows == [("a.bin", 0, 2, True), ("a.bin", 1, 0, True), ("a.bin", 2, 3, True), ("a.bin", 3, 2, False), ("c.bin", 0, 50, False)]


def test_long_white_space(spark):
    """A million blanks run the fast reader's pattern out of stack; the tokenizer reads them."""
    from tokenizers import Tokenizer

    from epitrail.llm import packing, tokencount

    blank = "a" + " " * 1_000_000
    df = spark.createDataFrame([(1, blank), (2, "<|endoftext|>" + blank)], "doc_id long, text string")
    own = Tokenizer.from_file(packing.tokenizer_path())
    n = {1: len(own.encode(blank, add_special_tokens=False).ids) + 1}
    rows = packing.pack(df).where("doc_id = 1").collect()
    assert sum(r.length for r in rows) == n[1] == rows[0].doc_tokens
    encode = packing.Encoder(packing.tokenizer_path(), plain=True)
    assert 50256 not in np.frombuffer(encode("<|endoftext|>" + blank), dtype="<u4")
    assert tokencount.dtype_of() == "<u2" and tokencount.dtype_of(end_id=70_000) == "<u4"


def test_token_counts_of_odd_tables(spark, tmp_path):
    from epitrail.llm import packing, tokencount
    from tests.llm.helpers import awkward, empty

    own = packing.Encoder(packing.tokenizer_path(), plain=True)
    odd = awkward(spark)
    odd = odd.unionByName(odd.where("doc_id = 8"))
    for name, df in (("odd", odd), ("none", empty(spark))):
        folder = f"{tmp_path}/{name}"
        manifest = tokencount.write_token_files(df, folder)
        for block in (1000, 1 << 20):
            got = tokencount.count_tokens(spark, folder, block=block).join(manifest, ["file", "ordinal"])
            want = sorted((str(r.doc_id), len(own(r.text)) // 4) for r in df.collect())
            assert sorted((str(r.doc_id), r.n_tokens) for r in got.collect()) == want


def test_repeated_rows_and_books_are_dealt_over_shards(spark):
    """A row repeated many times and a book of many windows: no shard gets much more than its pieces, and each id lies in one place."""
    from collections import Counter

    rows = [(1, "one and the same", "en", "a", 16)] * 600 + [(2, "some words of a book " * 30_000, "en", "a", 630_000)]
    df = spark.createDataFrame(rows, documents(spark, 1).schema).repartition(4)
    got = packing.pack(df, shard=50).collect()
    book = sorted((r.start, r.length) for r in got if r.doc_id == 2)
    assert [s for s, _ in book] == list(range(0, book[-1][0] + 1, packing.WINDOW)) and len(book) > 100
    shards = Counter(r.sequence_id >> 32 for r in got if r.length < packing.WINDOW)
    assert len(shards) >= 10 and max(shards.values()) <= 100 and sum(shards.values()) in (600, 601)
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= packing.WINDOW
