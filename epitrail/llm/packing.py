"""Packing documents into fixed-length token sequences by best-fit decreasing.

Documents are tokenised whole and end with an end id. Documents longer than a sequence are first cut into full
windows, which are sequences of their own; what is left of each document is placed, longest first, in the open
sequence with the least room that still holds it. What is left of documents, a piece each at most, is dealt row by row into shards of about ``SHARD``
pieces; full windows, which need no packing, are numbered by themselves, those of a task's documents together. So a shard's size is bounded,
however long documents are and however often one is repeated, and padding stays small.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitrail.llm.common import table

WINDOW = 1024
END_ID = 0
SHARD = 8192
#: The usual split of byte-level BPE into pre-tokens.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, by the byte-level BPE of a tokenizers file.

    A second reader of the same vocabulary merges several times faster and gives the same ids. It is used only if the file says that it
    splits texts in the usual way, normalises nothing and adds nothing; and the tokenizer itself reads texts with strings of special
    tokens, unless these are ``plain`` text, and texts that the second reader can't, as those with a million blanks in a row.
    """

    def __init__(self, path: str, plain: bool = False):
        import json
        from pathlib import Path

        import tiktoken
        from tokenizers import Tokenizer

        said = json.loads(Path(path).read_text("utf-8"))
        special = {t["content"] for t in said["added_tokens"]}
        if plain:  # without them in its list, the tokenizer takes their strings for text
            said["added_tokens"] = []
        self.tokenizer = Tokenizer.from_str(json.dumps(said))
        self.special = [] if plain else sorted(special)
        model, split = said["model"], said["pre_tokenizer"] or {}
        usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not said["normalizer"] and not said["post_processor"]
        self.fast = None
        if not usual or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return
        # bytes that can't be printed stand in the vocabulary as the code points from 256 on, in order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in model["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast and not any(s in text for s in self.special):
            try:
                return bytes(self.fast.encode_to_tiktoken_buffer(text, set()))
            except ValueError:  # its pattern ran out of stack; the tokenizer reads the text
                pass
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class Room:
    """Open sequences by the room that is left, in a segment tree that finds the tightest that holds a length."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length``, or None."""
        node = length + self.leaves
        if self.count[node]:
            return length
        while node > 1:  # up until a right-hand neighbour has some, then down its left side
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None

    def take(self, room: int) -> int:
        self._change(room, -1)
        return self.open[room].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each length, the lengths in descending order."""
    room, placed, sequences = Room(window), [], 0
    for n in lengths:
        tight = room.tightest(n)
        if tight is None:
            tight, sequence = window, sequences
            sequences += 1
        else:
            sequence = room.take(tight)
        placed.append((sequence, window - tight))
        if tight > n:
            room.add(tight - n, sequence)
    return placed


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: the windows of each document and what is left of it."""
    path = path or tokenizer_path()

    def run(batches: Iterator) -> Iterator:
        from zlib import crc32

        import pyarrow as pa

        encode, end = Encoder(path), end_id.to_bytes(4, "little")
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = memoryview(encode(text.as_py()) + end)
                n = len(ids) // 4
                for s in range(0, n, window):
                    at.append(i)
                    start.append(s)
                    length.append(min(window, n - s))
                    crc.append(crc32(ids[4 * s : 4 * (s + window)]))
                    total.append(n)
            columns = [batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, shard: int = SHARD) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, a row a piece.

    A null or empty text is the end id alone. Repeated rows are separate documents. Sequence ids are unique, not
    consecutive: shard * 2^32 + number in the shard. The packing depends on the rows and how they lie in partitions: pieces of a shard are
    ordered by length and content, so reruns over the same files agree. An empty table gives no rows. A text of any length is read whole, as
    one; its full windows are sequences of their own. Other columns, of whatever name, take no part.
    """
    cut = pieces(docs, path, window, end_id)
    shards = max(1, -(-docs.count() // shard))
    kind = docs.schema["doc_id"].dataType.simpleString()
    row = F.xxhash64("doc_id", "ids_crc32", F.monotonically_increasing_id())  # a row may be repeated many times
    whole = F.lit(shards) + F.spark_partition_id()
    cut = cut.withColumn("shard", F.when(F.col("length") == window, whole).otherwise(F.pmod(row, F.lit(shards))).cast("long"))

    def run(key, rows):
        import pyarrow as pa

        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        placed, base = best_fit_decreasing(rows.column("length").to_pylist(), window), key[0].as_py() << 32
        rows = rows.append_column("sequence_id", pa.array([base + s for s, _ in placed], pa.int64()))
        return rows.append_column("offset", pa.array([o for _, o in placed], pa.int64())).drop_columns(["shard"])

    columns = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return cut.groupBy("shard").applyInArrow(run, columns)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
