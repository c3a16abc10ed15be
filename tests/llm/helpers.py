"""Small tables with the awkward cases that every operator must stand."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLORS = "red blue green amber violet cyan coral ivory olive pearl slate umber teal rose plum mint lime gold jade ruby".split()


def prose(rng, n):
    return " ".join(rng.choice(COLORS) + rng.choice("abcdefgh") for _ in range(n))


def documents(spark, n=60, seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(n)]
    shared = prose(rng, 25)
    rows = []
    for i in range(n):
        text = base[i]
        if i % 6 == 0:
            text = base[i // 2]
        if i % 5 == 0:
            text = text[: len(text) // 2] + "\n" + shared + "\n" + text[len(text) // 2 :]
        if i % 9 == 0:
            text = text.replace("red", "rouge é", 1)
        rows.append((i, text, ["en", "fr", None][i % 3], ["a", "b", None, "hot", "hot", "hot"][i % 6], len(text)))
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, "   \n\t ", "en", "a", 6),
        (4, "same text here for all of us to see again and again, my dear friend of old", "en", "a", 10),
        (4, "same text here for all of us to see again and again, my dear friend of old", "en", "a", 10),
        (5, "same text here for all of us to see again and again, my dear friend of old", None, None, None),
        (None, "same text here for all of us to see again and again, my dear friend of old", "fr", "b", 10),
        (None, None, None, None, None),
        (6, long, "en", "a", len(long)),
        (7, long, "en", "b", len(long)),
        (8, "été à la plage 漢字 🙂 <|endoftext|> x", "fr", "b", 30),
        (-9, "!!! 123 ### $$$", "fr", "b", 15),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "data", "chunk", "size", "fp", "shard", "words", "s", "line", "taken", "score"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
