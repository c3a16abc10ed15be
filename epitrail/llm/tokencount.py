"""Token counts of documents in flat, unindexed token files.

A token file is nothing but little-endian token ids; an end-of-document id follows each document. Files are cut into
blocks of equal size, whatever documents they cross. Each block is searched for the end id at once; a prefix scan over
three figures a block then numbers the documents of a file and carries open documents from block to block.

Folders are on any file system that pyarrow opens, object stores and HDFS among them; ``s3a`` and ``dbfs`` names are translated.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epitrail.llm.common import discard, new_path, saved, table
from epitrail.llm.packing import Encoder, tokenizer_path

END_ID = 50_256
#: Ids of a block.
BLOCK = 1 << 20


def dtype_of(path: str | None = None, end_id: int = END_ID) -> str:
    """How wide ids are in a file: 16 bits if each id of the vocabulary fits, else 32."""
    from tokenizers import Tokenizer

    most = Tokenizer.from_file(path or tokenizer_path()).get_vocab_size(with_added_tokens=True)
    return "<u2" if max(most - 1, end_id) < 1 << 16 else "<u4"


def opened(uri: str):
    """The pyarrow file system of a URI that Spark gives, and the path in it."""
    from pyarrow import fs

    for spark, plain in (("s3a://", "s3://"), ("s3n://", "s3://"), ("dbfs:/", "file:///dbfs/")):
        if uri.startswith(spark):
            uri = plain + uri[len(spark) :]
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write one flat file a partition into ``folder``, a URI that executors share; return ``doc_id, file, ordinal``.

    A null or empty text is the end id alone. Special tokens' strings in a text are ordinary text. A file appears
    under its name only when it is whole, so tasks may be repeated.
    """
    path = path or tokenizer_path()
    dtype = dtype_of(path, end_id)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, end = Encoder(path, plain=True), np.array([end_id], dtype=dtype).tobytes()
        task = TaskContext.get()
        name = f"tokens-{task.partitionId():05d}.bin"
        store, at = opened(folder)
        part, n = f"{at}/_{name}.{task.taskAttemptId()}", 0
        with store.open_output_stream(part) as out:
            for batch in batches:
                for text in batch.column("text"):
                    out.write(np.frombuffer(encode(text.as_py()), dtype="<u4").astype(dtype).tobytes() + end)
                rows = len(batch)
                columns = [batch.column("doc_id"), pa.array([name] * rows, pa.string()), pa.array(range(n, n + rows), pa.int64())]
                n += rows
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "file", "ordinal"])
        store.move(part, f"{at}/{name}")

    conf = docs.sparkSession._jsc.hadoopConfiguration()
    place = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(conf).mkdirs(place)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return saved(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, file string, ordinal long"), "manifest")


def count_tokens(spark: SparkSession, folder: str, end_id: int = END_ID, block: int = BLOCK, dtype: str = "<u2") -> DataFrame:
    """``file, ordinal, n_tokens, terminated``: a row a document of the ``*.bin`` files in ``folder``.

    ``ordinal`` counts a file's documents from 0; ``n_tokens`` leaves out the end id. Ids after the last end id are a
    document that is not ``terminated``. Empty files, and folders without any, give no rows. Files may be of any length: a task
    holds a block at a time, and the scan over a file's blocks sees three figures of each.
    """
    import numpy as np

    width = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_]*.bin").load(folder).select("path", "length")
    blocks = files.where("length > 0").select("path", F.explode(F.expr(f"sequence(0L, (length - 1) div {block * width})")).alias("block"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for path, b in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist()):
                store, at = opened(path)
                with store.open_input_file(at) as source:
                    ids = np.frombuffer(source.read_at(block * width, b * block * width), dtype=dtype)
                ends = np.flatnonzero(ids == end_id)
                lengths = np.diff(ends, prepend=-1) - 1
                last = int(ends[-1]) if len(ends) else -1
                names = ["path", "block", "size", "last", "lengths"]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([b]), pa.array([len(ids)]), pa.array([last]), pa.array([lengths], pa.list_(pa.int64()))], names)

    dealt = blocks.repartition("path", "block")
    scanned = saved(dealt.mapInArrow(run, "path string, block long, size long, last long, lengths array<long>"), "scanned")
    by_block = Window.partitionBy("path").orderBy("block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    # first ordinal of the block, and ids since the last end id before it
    base = F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")
    last_end = F.max(F.when(F.col("last") >= 0, F.col("block") * block + F.col("last"))).over(before)
    carry = F.col("block") * block - F.coalesce(last_end + 1, F.lit(0))
    final = F.lead("block").over(by_block).isNull()
    summary = scanned.select("path", "block", "last", F.size("lengths").alias("n"))
    prefix = summary.select("path", "block", base.alias("base"), carry.alias("carry"), final.alias("final"))
    rest = F.when(F.col("last") < 0, F.col("carry") + F.col("size")).otherwise(F.col("size") - F.col("last") - 1)
    stitched = scanned.join(prefix, ["path", "block"]).withColumn("rest", F.when(F.col("final"), rest).otherwise(F.lit(0)))
    closed = F.transform("lengths", lambda x, i: F.struct((F.col("base") + i).alias("ordinal"), (x + F.when(i == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("terminated")))
    left = F.struct((F.col("base") + F.size("lengths")).alias("ordinal"), F.col("rest").alias("n_tokens"), F.lit(False).alias("terminated"))
    rows = stitched.withColumn("docs", F.when(F.col("rest") > 0, F.concat(closed, F.array(left))).otherwise(closed))
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.inline("docs"))


def op8_separator_scan(spark, sf_dir: str) -> DataFrame:
    """Tokenise ``documents`` into flat files, then count from the files alone; the manifest only names the rows.

    A row a document, repeated rows too: ``doc_id, file, ordinal, n_tokens``. Null and empty texts have no tokens; an empty table gives no
    rows; other columns take no part.
    """
    folder = new_path(spark, "tokens")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder)
    counted = count_tokens(spark, folder, dtype=dtype_of()).join(manifest.hint("merge"), ["file", "ordinal"])
    counted = saved(counted.select("doc_id", "file", "ordinal", "n_tokens"), "counts")
    discard(manifest)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return counted
