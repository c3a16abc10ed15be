"""Quality rules with line sequence labelling.

A linear-chain conditional random field with two labels, content and boilerplate, scores the lines of a text; Viterbi
decoding picks the best labelling, and the share of words in content lines decides whether the text stays. The field
is trained here by stochastic gradient descent on the log-likelihood.

Training labels are those of lines, not of documents. A labelled document says what most of its lines are. Against that stand:
a line that many documents hold between other neighbours, or that its own document repeats, is boilerplate in a good document too; a line that
also stands in a good document, or that looks like lines of good documents by far, is content in a poor one too, and the other way round.
So sequences change labels, and the field learns how.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitrail.llm.common import discard, saved, table

#: At most so many labelled documents of each class train the field: those with the smallest hashes of doc_id.
SAMPLE = 1024
#: A line that stands between so many different pairs of neighbours, over all documents, is boilerplate.
SHARED = 5
#: Lines of sampled documents up to which their hashes are broadcast to count these neighbours.
BROADCAST_LINES = 200_000
#: Words with evidence of their own, at most, and how often each must be met.
EVIDENCE, LEAST_MET = 20_000, 5
#: Log odds from which a line's looks overrule its document.
SURE = math.log(19)
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_CONTENT_SHARE = 0.5

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER, _LETTERS, _DIGITS = (x.encode() for x in (string.ascii_uppercase, string.ascii_letters, string.digits))
_LETTERS += bytes(range(0x80, 0x100))

#: Each feature cuts a line's figure at these bounds; a line has one active cell per feature.
CUTS = {
    "symbols a word": (0.0, 0.1, 0.5),
    "upper-case share": (0.15, 0.5),
    "bars a word": (0.0, 0.3),
    "exclamation marks a word": (0.0, 0.3),
    "letter share": (0.5, 0.8),
    "digit share": (0.0, 0.1),
    "words": (3, 9),
    "repeated neighbours": (0.0, 0.2),
    "ends a sentence": (0,),
    "seen before": (0,),
    "word evidence": (-1.0, -0.3, 0.3),
}
_STARTS = [sum(len(c) + 1 for c in list(CUTS.values())[:i]) for i in range(len(CUTS))]
CELLS = sum(len(c) + 1 for c in CUTS.values())
_CUTS = list(zip(_STARTS, CUTS.values()))


def cells(line: bytes, words: list[bytes], seen: bool, evidence: dict[bytes, float]) -> list[int]:
    """The active feature cells of a line that has words; ``evidence``: log odds of words for content."""
    n, size = len(words), len(line)
    letters = size - len(line.translate(None, _LETTERS))
    marks = size - len(line.translate(None, SPACE)) if size else 0
    figures = (
        (size - len(line.translate(None, SYMBOLS))) / n,
        (size - len(line.translate(None, _UPPER))) / max(letters, 1),
        line.count(b"|") / n,
        line.count(b"!") / n,
        letters / max(size - marks, 1),
        (size - len(line.translate(None, _DIGITS))) / max(size - marks, 1),
        n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        words[-1][-1:] in b".!?:;\"')",
        seen,
        sum(evidence.get(w, 0.0) for w in words) / n if evidence else 0.0,
    )
    out = []
    for value, (start, cuts) in zip(figures, _CUTS):
        for cut in cuts:
            if value <= cut:
                break
            start += 1
        out.append(start)
    return out


def text_lines(data: bytes) -> list[tuple[bytes, list[bytes], bool]]:
    """Each line that has a word: the line, its words, whether it equals an earlier one."""
    seen: set[bytes] = set()
    out = []
    for line in data.split(b"\n"):
        if words := line.split():
            out.append((line, words, line in seen))
            seen.add(line)
    return out


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that the text has twice or more."""
    import numpy as np

    if len(words) <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    n = len(words) - width + 1
    key, base = ids[:n], len(number)
    for i in range(1, width):
        key = key * len(number) + ids[i : i + n]
        base *= len(number)
        if base * len(number) >= 1 << 62:  # number the windows so far anew, so that keys stay exact
            values, key = np.unique(key, return_inverse=True)
            base = len(values)
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit, covered = np.isin(key, twice), np.zeros(len(words), dtype=bool)
    for i in range(width):
        covered[i : i + n] |= hit
    return int(covered.sum())


@dataclass
class Field:
    """Scores of (cell, label), (label, label) steps and first labels; label 1 is content."""

    emit: list[tuple[float, float]]
    step: tuple[tuple[float, float], tuple[float, float]]
    first: tuple[float, float]
    evidence: dict[bytes, float] = field(default_factory=dict)

    def label(self, lines: list[tuple[bytes, list[bytes], bool]]) -> list[int]:
        return self.viterbi([cells(*x, self.evidence) for x in lines])

    def viterbi(self, lines: list[list[int]]) -> list[int]:
        """The best labelling."""
        (s00, s01), (s10, s11) = self.step
        back, a, b = [], *self.first
        for i, active in enumerate(lines):
            e0 = e1 = 0.0
            for c in active:
                x, y = self.emit[c]
                e0 += x
                e1 += y
            if i:
                p0, p1 = a + s00 < b + s10, a + s01 <= b + s11
                a, b = (b + s10 if p0 else a + s00) + e0, (b + s11 if p1 else a + s01) + e1
                back.append((p0, p1))
            else:
                a, b = a + e0, b + e1
        at = int(b >= a)
        out = [at]
        for p in reversed(back):
            at = int(p[at])
            out.append(at)
        return out[::-1] if lines else []


def _add(x: float, y: float) -> float:
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


def fit(sequences: list[tuple[list[list[int]], list[int]]], epochs: int = 8, rate: float = 0.2, decay: float = 1e-4, seed: int = 5) -> Field:
    """Stochastic gradient ascent on the log-likelihood, by the forward-backward sums of each sequence."""
    from random import Random

    emit, step, first = [[0.0, 0.0] for _ in range(CELLS)], [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0]
    rng, sequences, t = Random(seed), [s for s in sequences if s[0]], 0
    total = max(1, epochs * len(sequences))
    for _ in range(epochs):
        rng.shuffle(sequences)
        for lines, labels in sequences:
            lr = rate * (1 - t / total) / math.sqrt(len(lines))
            t += 1
            scores = [[sum(emit[c][y] for c in active) for y in (0, 1)] for active in lines]
            ahead = [[first[y] + scores[0][y] for y in (0, 1)]]
            for s in scores[1:]:
                ahead.append([_add(ahead[-1][0] + step[0][y], ahead[-1][1] + step[1][y]) + s[y] for y in (0, 1)])
            behind = [[0.0, 0.0]]
            for s in reversed(scores[1:]):
                behind.append([_add(step[y][0] + s[0] + behind[-1][0], step[y][1] + s[1] + behind[-1][1]) for y in (0, 1)])
            behind.reverse()
            z = _add(*ahead[-1])
            moves = [[0.0, 0.0], [0.0, 0.0]]
            for i, (active, label) in enumerate(zip(lines, labels)):
                p1 = math.exp(min(0.0, ahead[i][1] + behind[i][1] - z))
                gap = (label - p1) * lr
                for c in active:
                    emit[c][1] += gap - decay * emit[c][1] * lr
                    emit[c][0] -= gap + decay * emit[c][0] * lr
                if not i:
                    first[1] += gap
                    first[0] -= gap
                else:
                    moves[labels[i - 1]][label] += 1
                    for a in (0, 1):
                        for b in (0, 1):
                            moves[a][b] -= math.exp(min(0.0, ahead[i - 1][a] + step[a][b] + scores[i][b] + behind[i][b] - z))
            for a in (0, 1):
                for b in (0, 1):
                    step[a][b] += lr * moves[a][b]
    return Field([tuple(x) for x in emit], tuple(map(tuple, step)), tuple(first))


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``doc_id, quality, text``: one row of each of at most ``2 * sample`` labelled documents that have a text, the same at each run.

    Of rows with one doc_id, that whose text has the smallest hash. Labels of documents that are not there take nobody's place.
    """
    picked = None
    labels = labels.where("quality IN (0, 1)").join(docs.where(F.col("text").isNotNull()).select("doc_id"), "doc_id", "left_semi")
    for quality in (0, 1):
        some = labels.where(F.col("quality") == quality).groupBy("doc_id").agg(F.lit(quality).alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    picked = picked.groupBy("doc_id").agg(F.min("quality").alias("quality"))  # at most 2 * sample ids
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def _shared_lines(docs: DataFrame, sampled: DataFrame) -> set[int]:
    """Hashes of the sample's lines that stand between :data:`SHARED` or more different pairs of neighbours in all documents.

    Copies of a document keep the neighbours of its lines, so they are no evidence.
    """
    hashes = F.transform(F.split("text", "\n", -1), lambda x: F.xxhash64(x))
    own = sampled.select(F.explode(hashes).alias("h")).distinct()
    if own.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        own = F.broadcast(own)
    rows = docs.where(F.col("text").isNotNull()).select(hashes.alias("hs"))
    pairs = F.transform("hs", lambda h, i: F.struct(h.alias("h"), F.xxhash64(F.get("hs", i - 1), F.get("hs", i + 1)).alias("between")))
    met = rows.select(pairs.alias("p"), F.size("hs")).select(F.inline("p")).join(own, "h").distinct()
    return {r.h for r in met.groupBy("h").count().where(F.col("count") >= SHARED).select("h").collect()}  # lines of the sample


def _word_evidence(sampled: DataFrame) -> dict[bytes, float]:
    """Log odds of words in good against poor documents of the sample: the :data:`EVIDENCE` strongest."""
    words = F.array_distinct(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    met = sampled.select("quality", F.explode(words).alias("w")).groupBy("w").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("poor"))
    both = sampled.agg(F.coalesce(F.sum("quality"), F.lit(0)), F.coalesce(F.sum(1 - F.col("quality")), F.lit(0))).first()
    if not all(both):
        return {}
    odds = F.ln((F.col("good") + 0.5) / (both[0] + 1.0)) - F.ln((F.col("poor") + 0.5) / (both[1] + 1.0))
    rows = met.where(F.col("good") + F.col("poor") >= LEAST_MET).select("w", odds.alias("odds")).orderBy(F.desc(F.abs("odds")), "w").limit(EVIDENCE).collect()
    return {r.w.encode(): float(r.odds) for r in rows}


def _line_rows(sampled: DataFrame, evidence: dict[bytes, float]) -> list:
    """``doc_id, quality, hashes, cells, seen`` of each sampled document: figures of its lines, made where the texts are."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            hashes, active, seen = [], [], []
            for x in batch.column("data"):
                lines = text_lines(x.as_py())
                hashes.append([(h := xxh64_intdigest(line, 42)) - ((h >> 63) << 64) for line, _, _ in lines])
                active.append([c for x in lines for c in cells(*x, evidence)])
                seen.append([x[2] for x in lines])
            columns = [pa.array(hashes, pa.list_(pa.int64())), pa.array(active, pa.list_(pa.int32())), pa.array(seen, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *columns], ["doc_id", "quality", "hashes", "cells", "seen"])

    kind = sampled.schema["doc_id"].dataType.simpleString()
    rows = sampled.select("doc_id", F.col("quality").cast("int"), F.col("text").cast("binary").alias("data"))
    made = rows.mapInArrow(run, f"doc_id {kind}, quality int, hashes array<bigint>, cells array<int>, seen array<boolean>")
    return sorted(made.collect(), key=lambda r: (str(r.doc_id), r.quality))  # figures of at most 2 * sample documents


def line_labels(documents: list[tuple[int, list[int], list[list[int]], list[bool]]], shared: set[int]) -> list[list[int]]:
    """Training labels of the lines of documents (quality, hashes, cells, seen before), by the evidence that the module names."""
    good = {h for quality, hashes, _, _ in documents if quality for h in hashes}
    count = [[1.0] * CELLS, [1.0] * CELLS]
    lines = [1.0, 1.0]
    for quality, hashes, active, seen in documents:
        for h, line, again in zip(hashes, active, seen):
            y = int(quality and h not in shared and not again)
            lines[y] += 1
            for c in line:
                count[y][c] += 1
    odds = [math.log(count[1][c] / (lines[1] + 1) * (lines[0] + 1) / count[0][c]) for c in range(CELLS)]
    out = []
    for quality, hashes, active, seen in documents:
        looks = [sum(odds[c] for c in line) for line in active]
        if quality:
            labels = [int(h not in shared and not again and x > -SURE) for h, again, x in zip(hashes, seen, looks)]
        else:
            labels = [int(h not in shared and not again and (h in good or x > SURE)) for h, again, x in zip(hashes, seen, looks)]
            if all(labels):  # nothing tells why the document is poor
                labels = [0] * len(labels)
        out.append(labels)
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from ``labels`` (doc_id, quality) of documents; what labels their lines, see above.

    Null texts and null doc_ids take no part. Without labelled documents all lines are content.
    """
    sampled = saved(_sampled(docs, labels, sample), "labelled")
    evidence = _word_evidence(sampled)
    rows = _line_rows(sampled, evidence)
    shared = _shared_lines(docs, sampled)
    discard(sampled)
    width = len(CUTS)
    documents = [(r.quality, r.hashes, [r.cells[i : i + width] for i in range(0, len(r.cells), width)], r.seen) for r in rows]
    made = fit([(d[2], y) for d, y in zip(documents, line_labels(documents, shared))])
    made.evidence = evidence
    return made


def judged(data: bytes | None, field: Field, min_share: float = MIN_CONTENT_SHARE) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_words."""
    data = data or b""
    words = data.split()
    lines = text_lines(data)
    n, repeated = len(words), repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    labels = field.label(lines)
    content = sum(len(x[1]) for x, label in zip(lines, labels) if label)
    return (
        n,
        len(data.translate(None, _CONTINUATION + SPACE)),
        len(data) - len(data.translate(None, SYMBOLS)),
        sum(x[2] for x in lines),
        repeated,
        failed,
        not failed and content >= min_share * n,
        content,
    )


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long"


def quality(docs: DataFrame, field: Field, min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """``doc_id``, the base figures, ``kept`` and ``content_words`` of each row of ``docs``, repeated rows too.

    Null and empty texts have no words and fail. Texts of any length are read whole. An empty table gives no rows; other columns take no part.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.bool_() if x.endswith("boolean") else pa.int64() for x in COLUMNS.split(", ")]
        names = [x.split()[0] for x in COLUMNS.split(", ")]
        for batch in batches:
            rows = [judged(x.as_py(), field, min_share) for x in batch.column("data")]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("data")).mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


def labelled_lines(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, line_no, content`` of each line that has a word, ``line_no`` counting all lines of the text from 0."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, number, content = [], [], []
            for i, x in enumerate(batch.column("data")):
                data = x.as_py() or b""
                numbers = [n for n, line in enumerate(data.split(b"\n")) if line.split()]
                at += [i] * len(numbers)
                number += numbers
                content += map(bool, field.label(text_lines(data)))
            columns = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(number, pa.int64()), pa.array(content, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line_no", "content"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("data")).mapInArrow(run, f"doc_id {kind}, line_no long, content boolean")


def op5_line_labelling(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, train(docs, table(spark, sf_dir, "labels")))
