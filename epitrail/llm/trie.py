"""A prefix trie of conversations, family by family first.

Conversations of one family share their base's first turns. The turns of a base and of its family's conversations meet by the base's id (one shuffle of
digests; texts stay where they are), and are read in order of their place: a family's conversations are rebuilt and its small trie is built level by level, from a
sorted stream, so that a task holds one turn of each of a family's conversations at a time, however long these are. Only the combined nodes of
families are shuffled then, and merged by a 128-bit digest of the path; nodes that many families have, the root first, are combined before they move.

Sums over subtrees go the same way back: a node's figures are sent to the one family that has its smallest member, which adds them up from its deepest level to the root;
as each node counts in one family alone, adding up what the families say gives the sums of the whole trie.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epitrail.llm.common import discard, saved, table, word_count

#: Conversations of a family have ids that give the same multiple of this; and a conversation takes fewer than ``SHARES`` turns of its base.
FAMILY, SHARES = 20, 4
ROOT = bytes(16)
#: Rows of an output batch; and the power of two of the ids that a row lists at most, when the members that end at a node are put in order.
BATCH, LISTED = 8192, 12

NODES = (
    "family long, key binary, parent_key binary, depth long, conv_id long, n_convs long, words long, childless boolean, "
    "text_conv_id long, text_turn long, ends array<long>"
)


def base_of(conv_id: Column, family: int = FAMILY) -> Column:
    """The id of a conversation's base; the remainder has the sign of the id, as in SQL."""
    return conv_id - conv_id % family


def _digest() -> Column:
    """16 bytes of the SHA-256 of role and text, null being empty; the length of the role says where the text begins."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))


def turns(conversations: DataFrame, family: int = FAMILY) -> DataFrame:
    """``family, n, conv_id, digest, words`` of each turn, in one partition a family, sorted by family, n and conv_id; n counts a conversation's turns from 0.

    Turns are ordered by ``turn``, null first, and where it ties by the digest of role and text; null role and text are empty.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        base_of(F.col("conv_id").cast("long"), family).alias("family"), F.col("conv_id").cast("long").alias("conv_id"), "turn", _digest().alias("digest"), word_count("text").alias("words")
    )
    order = Window.partitionBy("family", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    numbered = rows.repartition("family").withColumn("n", F.row_number().over(order).cast("long") - 1)
    return numbered.select("family", "n", "conv_id", "digest", "words").sortWithinPartitions("family", "n", "conv_id")


class Node:
    __slots__ = ("key", "parent", "depth", "conv", "n", "words", "childless", "place", "ends")

    def __init__(self, key, parent, depth, words, place):
        self.key, self.parent, self.depth, self.words, self.place = key, parent, depth, words, place
        self.conv, self.n, self.childless, self.ends = None, 0, True, []

    def meet(self, conv: int) -> None:
        self.n += 1
        self.conv = conv if self.conv is None else min(conv, self.conv)


def family_trie(family: int, rows: Iterable[tuple], shares: int = SHARES) -> Iterator[Node]:
    """The nodes of a family's trie, level by level.

    ``rows``: (n, conv_id, digest, words) of the family's turns, by n. A conversation begins with the first crc32 % ``shares`` turns of the
    base, if it has so many, and goes on with its own after its first crc32 % ``shares``. As these are fewer than ``shares``, a turn's depth is known once the first ``shares``
    turns of all are read, and no level needs turns that come more than ``shares`` places later.
    """
    from hashlib import blake2b
    from zlib import crc32

    rows, head, late = iter(rows), [], []
    for row in rows:
        if row[0] >= max(1, shares - 1):
            late.append(row)
            break
        head.append(row)
    base = [(family, n, digest, words) for n, conv, digest, words in head if conv == family]
    convs = sorted({row[1] for row in (*head, *late)})
    taken = {c: crc32(str(c).encode()) % shares for c in convs}
    lent = {c: min(taken[c], len(base)) for c in convs}
    pending: dict[int, list[tuple]] = {}
    for c in convs:
        for i in range(lent[c]):
            pending.setdefault(i + 1, []).append((c, *base[i]))

    root = Node(ROOT, None, 0, 0, (None, None))
    for c in convs:
        root.meet(c)
    current, level = dict.fromkeys(convs, root), [root]

    def below(depth: int) -> tuple[dict, list]:
        """Where conversations stand at this depth, and its nodes; those that have no turn there end above."""
        found, made = {}, {}
        for c, *place, digest, words in pending.pop(depth, ()):
            above = current[c]
            above.childless = False
            node = made.get((above.key, digest))
            if node is None:
                key = blake2b(above.key + digest, digest_size=16).digest()
                node = made[above.key, digest] = Node(key, above.key, depth, words, tuple(place))
            node.meet(c)
            found[c] = node
        for c, node in current.items():
            if c not in found:
                node.ends.append(c)
        return found, list(made.values())

    depth = 0
    for source in (head, late, rows):
        for n, c, digest, words in source:
            while depth < n - shares + 1:  # the level after this one can get no more turns
                depth += 1
                current, made = below(depth)
                yield from level
                level = made
            if n >= taken[c]:
                pending.setdefault(n - taken[c] + lent[c] + 1, []).append((c, c, n, digest, words))
    while level:
        depth += 1
        current, made = below(depth)
        yield from level
        level = made


def _rows(batches: Iterator) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(rows: Iterator[tuple], schema: str) -> Iterator:
    import pyarrow as pa

    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)

    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield batch()
            held = []
    if held:
        yield batch()


def family_nodes(conversations: DataFrame, family: int = FAMILY, shares: int = SHARES) -> DataFrame:
    """:data:`NODES`: the nodes of each family's trie. ``ends``: its conversations that end there; ``text_conv_id, text_turn``: where the node's last turn stands."""

    def run(batches: Iterator) -> Iterator:
        def nodes() -> Iterator[tuple]:
            for base, rows in groupby(_rows(batches), itemgetter(0)):
                for x in family_trie(base, (row[1:] for row in rows), shares):
                    yield base, x.key, x.parent, x.depth, x.conv, x.n, x.words, x.childless, *x.place, sorted(x.ends)

        return _batches(nodes(), NODES)

    return turns(conversations, family).mapInArrow(run, NODES)


SUMS = "key binary, parent_key binary, depth long, conv_id long, n_convs long, words long, text_conv_id long, text_turn long, n_leaves long, saved_tokens long"


def _subtree_sums(nodes: DataFrame, family: int) -> DataFrame:
    """:data:`SUMS`: the families' nodes with sums over their subtrees, of those nodes that the family counts."""
    merged = nodes.groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("words").alias("words"), F.min("childless").alias("childless"))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in "parent_key binary, conv_id long, n_convs long, words long, text_conv_id long, text_turn long".split(", "))]
    leaf, saves = F.col("childless").cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    counted = merged.select(base_of(F.col("conv_id"), family).alias("family"), "depth", "key", *none, leaf, saves)
    own = nodes.select("family", "depth", "key", "parent_key", "conv_id", "n_convs", "words", "text_conv_id", "text_turn", F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
    # levels from the deepest up; a node's own row before the figures that it is sent
    dealt = own.unionByName(counted).repartition("family").sortWithinPartitions("family", F.desc("depth"), "key", F.col("conv_id").isNull())

    def run(batches: Iterator) -> Iterator:
        def sums() -> Iterator[tuple]:
            for _, rows in groupby(_rows(batches), itemgetter(0)):
                deeper: dict[bytes, tuple[int, int]] = {}
                for depth, level in groupby(rows, itemgetter(1)):
                    here: dict[bytes, tuple[int, int]] = {}
                    for key, parts in groupby(level, itemgetter(2)):
                        node, *sent = parts
                        leaves, saved_tokens = deeper.get(key, (0, 0))
                        for x in sent:
                            leaves, saved_tokens = leaves + x[-2], saved_tokens + x[-1]
                        up = here.get(node[3], (0, 0))
                        here[node[3]] = up[0] + leaves, up[1] + saved_tokens
                        yield key, node[3], depth, *node[4:9], leaves, saved_tokens
                    deeper = here

        return _batches(sums(), SUMS)

    return dealt.mapInArrow(run, SUMS)


def _ends(nodes: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of the nodes at which some conversation ends.

    A node's ids are put in order in pieces of at most 2^``LISTED``; the pieces of a node are then read in order, one at a time, by one digest.
    """
    ids = nodes.select("key", F.explode("ends").alias("id")).withColumn("piece", F.shiftright("id", LISTED))
    pieces = ids.groupBy("key", "piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("listed"))

    def run(batches: Iterator) -> Iterator:
        def digests() -> Iterator[tuple]:
            from hashlib import sha256

            for key, rows in groupby(_rows(batches), itemgetter(0)):
                digest = None
                for row in rows:
                    if digest is None:
                        digest = sha256(row[2].encode())
                    else:
                        digest.update(b"," + row[2].encode())
                yield key, digest.hexdigest()

        return _batches(digests(), "key binary, ends_sha256 string")

    return pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "piece", "listed").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, shares: int = SHARES) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations, a row each.

    ``key`` (16 bytes of the path), ``depth, conv_id`` (smallest member), ``parent_key, parent_conv_id`` (root: null), ``n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``, and ``text_conv_id, text_turn``: a place where the node's last turn stands (see :func:`with_texts`; root: null).

    Conversation c begins with the first h turns of conversation c - c % ``family``, h being crc32(c) % ``shares``, and goes on with its own turns after its
    first h; with ``shares`` = 1 conversations are taken as they are. A conversation without a base, or shorter than h, may lose all turns; it is a
    member of the root. Null role and text are empty; a null turn comes first; turns that tie in ``turn`` are ordered by their contents, and repeated rows
    are turns of their own. Rows without a conv_id belong to no conversation and take no part. An empty table gives no rows, not even a root. Texts of any
    length are digested whole. Other columns, of whatever name, take no part.
    """
    nodes = saved(family_nodes(conversations, family, shares), "family-nodes")
    place = F.min(F.struct("text_conv_id", "text_turn"))
    summed = _subtree_sums(nodes, family).groupBy("key", "parent_key", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), place.alias("place")
    )
    merged, ended = saved(summed, "trie"), saved(_ends(nodes), "ends")
    discard(nodes)
    children = merged.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children"))
    full = merged.join(children, "key", "left").join(ended, "key", "left")
    # last, so that the children of the root and of other hot nodes can be read in parts
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return full.join(parents, "parent_key", "left").select(
        "key", "depth", "conv_id", "parent_key", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "place.text_conv_id", "place.text_turn",
    )


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The ``nodes`` with ``role, text`` of their last turns (root: null)."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), _digest().alias("digest"))
    placed = rows.withColumn("n", F.row_number().over(order).cast("long") - 1).select(F.col("conv_id").alias("text_conv_id"), F.col("n").alias("text_turn"), "role", "text")
    return nodes.join(placed, ["text_conv_id", "text_turn"], "left").select(*nodes.columns, "role", "text")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    nodes = prefix_trie(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
