"""Web archives (WARC) in seekable Zstandard bundles.

A bundle is one file. Its records stand in independent Zstandard frames of about ``FRAME`` bytes, and a skippable frame at its end holds the sizes
of all frames (the seekable format: any Zstandard reader can still read the whole file). A record is known by its id, and the index says in
which bundle and frame it lies and where in the unpacked frame, so one record costs one small read of the footer and one of a frame.

Records with equal payloads are stored once: one is the response, the others are revisits that name it.

Folders are on any file system that pyarrow opens. A task writes bundles under names of its own and only those of tasks that succeeded are in the
index, so tasks may be repeated and executors lost.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epitrail.llm.common import discard, new_path, saved, table
from epitrail.llm.tokencount import opened

#: Unpacked bytes from which a frame is closed, packed bytes from which a bundle is, and frames that one read task takes.
FRAME, BUNDLE, READ = 1 << 20, 1 << 30, 16
LEVEL = 3
#: Rows of one page that are one row of the writer's input at most, and payloads that several pages have that are broadcast at most.
COPIES, SMALL = 4096, 20_000
#: Fixed values of the seekable format: magic numbers of a skippable frame and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed values of WARC 1.1.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "tag:epitrail,2026:page"
DATE = "1970-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

INDEX = "record_id string, file string, frame long, offset long, length long"
RECORDS = "record_id string, record_type string, target_uri string, refers_to_id string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of binary data in upper-case base 32, as WARC writes it: 160 bits are 32 letters."""
    digest = F.sha1(data)
    letters = []
    for i in range(0, 40, 5):  # five hex digits are four letters
        value = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer of a bundle: (packed, unpacked) bytes of each frame, in a skippable frame."""
    entries = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries)) + entries


def read_seek_table(source, size: int) -> list[tuple[int, int]]:
    """(first byte, packed bytes) of each frame of an open bundle of ``size`` bytes."""
    n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seekable bundle")
    width = 12 if flags & 0x80 else 8  # with checksums
    entries = source.read_at(n * width, size - 9 - n * width)
    at, frames = 0, []
    for i in range(n):
        packed, _ = struct.unpack_from("<II", entries, i * width)
        frames.append((at, packed))
        at += packed
    return frames


def header_text(value: str | None) -> str:
    """A header's value on one line: white space and control characters are percent-encoded."""
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "")


def record_bytes(record_id: str, kind: str, uri: str | None, refers_to: str | None, digest: str, payload_bytes: int, payload: bytes, date: str = DATE) -> bytes:
    """One record. A revisit has the HTTP headers of its page and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {header_text(uri) or 'about:blank'}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record that begins at a byte of unpacked data."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no record at byte {at}")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    first = end + 4
    last = first + int(headers["content-length"])
    if data[last : last + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at byte {at} does not end where it says")
    return headers, data[first:last], last + 4


def parsed(headers: dict, block: bytes) -> tuple:
    """The columns of ``RECORDS``. A payload that does not match its digest is an error."""
    from base64 import b32encode
    from hashlib import sha1

    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    http, _, body = block.partition(b"\r\n\r\n")
    said = next(int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.lower() == b"content-length")
    name = headers["warc-record-id"].strip("<>")
    if kind == "response" and (len(body) != said or b32encode(sha1(body).digest()).decode() != digest):
        raise ValueError(f"{name}: the payload does not match its digest")
    refers = headers.get("warc-refers-to")
    return name, kind, headers["warc-target-uri"], refers and refers.strip("<>"), digest, said, body if kind == "response" else None


class Bundle:
    """A bundle that is being written."""

    def __init__(self, uri: str, frame: int = FRAME, level: int = LEVEL):
        import zstandard

        self.uri, self.frame = uri, frame
        store, at = opened(uri)
        self.out = store.open_output_stream(at, compression=None)  # not packed again, as the name would have it
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self.open, self.sizes, self.packed = bytearray(), [], 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame, offset in the unpacked frame and length of the record."""
        if self.open and len(self.open) + len(record) > self.frame:
            self.close_frame()
        place = len(self.sizes), len(self.open), len(record)
        self.open += record
        return place

    def close_frame(self) -> None:
        if self.open:
            packed = self.packer.compress(bytes(self.open))
            self.out.write(packed)
            self.sizes.append((len(packed), len(self.open)))
            self.packed += len(packed)
            self.open = bytearray()

    def close(self) -> None:
        self.close_frame()
        self.out.write(seek_table(self.sizes))
        self.out.close()


def planned(pages: DataFrame, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """What is to be written: ``record_id, kind, uri, refers_to, digest, payload_bytes, payload, first, copies``; and the table of shared payloads, to be discarded after.

    Of equal payloads of at least ``least`` bytes the record with the largest page_id (then url, then the first copy) is the response. Pages
    whose payload is theirs alone are written where they are read. Of the others only responses keep their payload; those that agree in page_id and url
    too become one row with a number of ``copies`` from number ``first`` on, so that a page that comes up often is combined before it moves.
    """
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    place = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", F.col("url").isNotNull().alias("named"), "url")
    common = saved(rows.groupBy("digest").agg(F.max(place).alias("best"), F.count("*").alias("n")).where("n > 1").select("digest", "best"), "warc-common")
    few = len(common.select("digest").limit(SMALL + 1).collect()) <= SMALL
    met = rows.join(F.broadcast(common) if few else common, "digest", "left")
    name = lambda i, u: F.concat_ws("/", F.lit(ID_PREFIX), F.coalesce(i.cast("string"), F.lit("null")), "digest", F.hex(F.xxhash64(u)))
    size = F.octet_length("payload").cast("long").alias("payload_bytes")
    alone = met.where("best IS NULL").select(
        name(F.col("page_id"), F.col("url")).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("uri"), F.lit(None).cast("string").alias("refers_to"),
        "digest", size, "payload", F.lit(0).cast("long").alias("first"), F.lit(1).cast("long").alias("copies"),
    )
    short = F.octet_length("payload") < least
    first = F.col("best.page_id").eqNullSafe(F.col("page_id")) & F.col("best.url").eqNullSafe(F.col("url"))
    shared = met.where("best IS NOT NULL").select("page_id", "url", "digest", "best", short.alias("short"), (short | first).alias("own"), size, F.when(short | first, F.col("payload")).alias("payload"))
    once = shared.groupBy("page_id", "url", "digest", "best", "short", "own", "payload_bytes").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
    blocks = once.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("first"))
    refers = F.when(~F.col("short"), F.concat(name(F.col("best.page_id"), F.col("best.url")), F.lit("/0")))
    copied = blocks.select(
        name(F.col("page_id"), F.col("url")).alias("record_id"), F.when(F.col("own"), "response").otherwise("revisit").alias("kind"), F.col("url").alias("uri"), refers.alias("refers_to"),
        "digest", "payload_bytes", F.when((F.col("first") == 0) | F.col("short"), F.col("payload")).alias("payload"), "first", F.least(F.col("n") - F.col("first"), F.lit(COPIES)).alias("copies"),
    )
    return alone.unionByName(copied), common


def write_bundles(pages: DataFrame, folder: str, least: int = 0, frame: int = FRAME, bundle: int = BUNDLE, level: int = LEVEL) -> DataFrame:
    """Write a record a row of ``pages`` (``page_id, url, html``) into bundles in ``folder``, a URI; return their index, :data:`INDEX`.

    A null html is an empty payload; a null url is ``about:blank``; a null page_id counts as the smallest. Repeated rows are records of their own,
    numbered in their ids: the first is the response, the others revisit it. Where payloads are shorter than ``least``, each record is a response. Payloads of
    any length stand whole in one frame. An empty table gives no files and no rows. Other columns take no part.
    """

    def run(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa

        part, out = None, []

        def index() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["record_id", "file", "frame", "offset", "length"])

        for batch in batches:
            for row in range(len(batch)):
                name, kind, uri, refers, digest, size, payload, first, copies = (batch.column(c)[row].as_py() for c in range(9))
                for n in range(first, first + copies):
                    if part is None:
                        part = Bundle(f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.zst", frame, level)
                    own = "response" if refers is None else kind if n == 0 else "revisit"
                    place = part.add(record_bytes(f"{name}/{n}", own, uri, refers, digest, size, payload or b""))
                    out.append((f"{name}/{n}", part.uri, *place))
                    if part.packed + len(part.open) >= bundle:
                        part.close()
                        part = None
                    if len(out) >= 10_000:
                        yield index()
        if part is not None:
            part.close()
        if out:
            yield index()

    spark = pages.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    plan, common = planned(pages, least)
    index = saved(plan.mapInArrow(run, INDEX), "warc-index")
    discard(common)
    return index


def _read(frames: DataFrame, wanted: bool) -> DataFrame:
    """:data:`RECORDS` of the frames ``file, frame``; if ``wanted``, only those at the places listed in ``offsets``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["record_id", "record_type", "target_uri", "refers_to_id", "payload_digest", "payload_bytes", "payload"]
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(len(batch)):
                file, numbers = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                store, at = opened(file)
                with store.open_input_file(at) as source:
                    places = read_seek_table(source, source.size())
                    for k, number in enumerate(numbers):
                        first, packed = places[number]
                        data = unpacker.decompress(source.read_at(packed, first))
                        if wanted:
                            found = [parse_record(data, o)[:2] for o in batch.column(2)[i][k].as_py()]
                        else:
                            found, o = [], 0
                            while o < len(data):
                                headers, block, o = parse_record(data, o)
                                found.append((headers, block))
                        columns = zip(*(parsed(*x) for x in found))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return frames.mapInArrow(run, RECORDS)


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the bundles that an index names, :data:`RECORDS`; a response has its payload, whose digest is checked.

    The frames of a bundle are read by as many tasks as they need; a task unpacks one frame at a time.
    """
    frames = index.groupBy("file").agg(F.max("frame").alias("last"))
    groups = frames.select("file", F.explode(F.expr(f"sequence(0L, last, {READ}L)")).alias("first"), "last")
    dealt = groups.repartition("file", "first")
    return _read(dealt.select("file", F.expr(f"sequence(first, least(last, first + {READ - 1}))").alias("frames")), False)


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose ids the table ``wanted`` (``record_id``) lists, once each: only their frames are read."""
    places = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    by_frame = places.groupBy("file", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    return _read(by_frame.select("file", F.array("frame").alias("frames"), F.array("offsets").alias("offsets")), True)


def page_id_of(record_id: Column) -> Column:
    """The page_id in a record's id."""
    return F.split(record_id, "/")[1].try_cast("long")


def op13_warc_bundles(spark, sf_dir: str) -> DataFrame:
    """Write ``pages`` into bundles, then tell from the bundles alone: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    folder = new_path(spark, "warc")
    index = write_bundles(table(spark, sf_dir, "pages"), folder)
    found = read_bundles(index)
    told = saved(
        found.select(
            page_id_of(F.col("record_id")).alias("page_id"),
            "payload_bytes",
            "payload_digest",
            "record_type",
            page_id_of(F.col("refers_to_id")).alias("refers_to"),
        ),
        "warc-records",
    )
    discard(index)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return told
