"""Approximate nearest neighbours by low-dimensional stable projections in kd-trees.

For the largest inner product, vectors get a coordinate that gives all the same norm, so that the nearest by Euclidean
distance is the one with the largest product. Gaussian (2-stable) projections to a few dimensions are indexed by a
kd-tree. A query walks the tree's small leaves in order of projected distance and verifies their vectors. A vector at
distance d has a squared projected distance of d^2 times a chi-square variable; a vector, and in the end the walk, is passed over when
it is so far in projection that, by this distribution, a vector nearer than the k-th found would be nearer with probability ``sure``.

Vectors of like norms, at most twice the smallest, share a bin, so that a few large ones don't flatten the rest. A bin is cut into cells by a
coarse kd-tree over a bounded sample's projections; every vector is dealt to its cell, and a cell of more than a block's vectors, as one that holds many copies,
into blocks by row. A query first searches the block that it falls into itself, in each bin. The k-th product found there, the boxes of all cells and the same stopping test
then tell which other blocks it visits, and only what is no worse comes back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epitrail.llm.common import discard, saved, table

K = 20
PROJECTED = 12
SURE = 0.9
LEAF = 64
#: Vectors of a block at most, about; a task holds one block at a time.
INDEX_BLOCK = 16_384
#: Vectors at most, about, whose projections come to the driver to cut cells from. Every vector is indexed.
CELL_SAMPLE = 65_536
#: Cells at most. Their boxes, two numbers a projected dimension, are sent to all executors; beyond this a cell has several blocks.
MOST_CELLS = 32_768
#: Rounding errors of squared projected distances, in squared radii: copies of a neighbour are not passed over.
SLACK = 1e-9
#: Queries that are searched together.
TOGETHER = 256
SEED = 3


def chi_square_quantile(p: float, m: int) -> float:
    """By Wilson and Hilferty."""
    a = 2 / (9 * m)
    return m * (1 - a + NormalDist().inv_cdf(p) * a**0.5) ** 3


def projection(width: int, projected: int = PROJECTED):
    import numpy as np

    return np.random.default_rng(SEED).normal(size=(width + 1, projected))


def projected_vectors(vectors, radius: float, matrix):
    """Projections of vectors that got a coordinate which gives all of them the norm ``radius``."""
    import numpy as np

    extra = np.sqrt(np.maximum(radius**2 - (vectors**2).sum(axis=1), 0))
    return np.column_stack([vectors, extra]) @ matrix


def projected_queries(queries, radius: float, matrix):
    """Projections of queries at the norm ``radius``."""
    import numpy as np

    norms = np.sqrt((queries**2).sum(axis=1))
    return np.column_stack([queries * (radius / norms)[:, None], np.zeros(len(queries))]) @ matrix


def box_distances(at, low, high):
    """Squared distance of each point from each box."""
    import numpy as np

    bound = np.zeros((len(at), len(low)))
    for j in range(at.shape[1]):
        x = at[:, j, None]
        bound += np.maximum(np.maximum(low[None, :, j] - x, x - high[None, :, j]), 0) ** 2
    return bound


def reaches(kth, norms, radius: float, limit: float):
    """The squared projected distance beyond which no vector with a larger product than the k-th is expected; infinite without a k-th."""
    import numpy as np

    with np.errstate(invalid="ignore"):
        distance = 2 * radius * (radius - kth / norms)
    return np.where(np.isfinite(kth), limit * np.maximum(distance, 0) + SLACK * radius**2, np.inf)


class Index:
    """A kd-tree over the projections of one block's vectors, which are in ascending order of their ids."""

    def __init__(self, vectors, radius: float, projected: int = PROJECTED, leaf: int = LEAF):
        import numpy as np

        self.vectors, self.radius = vectors, radius
        self.matrix = projection(vectors.shape[1], projected)
        self.points = projected_vectors(vectors, radius, self.matrix)
        self.squares = (self.points**2).sum(axis=1)
        self.leaves, todo = [], [np.arange(len(vectors))]
        while todo:
            ids = todo.pop()
            if len(ids) <= leaf:
                self.leaves.append(np.sort(ids))
                continue
            own = self.points[ids]
            wide = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            half = len(ids) // 2
            cut = np.argpartition(own[:, wide], half)
            todo += [ids[cut[half:]], ids[cut[:half]]]
        self.low = np.array([self.points[x].min(axis=0) for x in self.leaves])
        self.high = np.array([self.points[x].max(axis=0) for x in self.leaves])

    def search(self, queries, own, k: int = K, sure: float = SURE, floor=None):
        """For each query the positions of about the k best, -1 standing for none, their products, and how many vectors were verified.

        ``own``: two arrays, the first position of the query's own id and the one after the last. ``floor``: products that k candidates elsewhere
        are known to reach, so that worse ones need not be found.
        """
        import numpy as np

        n, m = len(queries), self.points.shape[1]
        norms = np.sqrt((queries**2).sum(axis=1))
        at = projected_queries(queries, self.radius, self.matrix)
        square = (at**2).sum(axis=1)
        bound = box_distances(at, self.low, self.high)
        order = np.argsort(bound, axis=1, kind="stable")
        limit = chi_square_quantile(sure, m)
        best, score, verified = np.full((n, k), -1, dtype=np.int64), np.full((n, k), -np.inf), np.zeros(n, dtype=np.int64)
        known = np.full(n, -np.inf) if floor is None else floor
        reach = reaches(known, norms, self.radius, limit)  # the squared projected distance beyond which vectors are passed over
        active, start, step, widest = np.arange(n), 0, 2, max(map(len, self.leaves))
        while len(active) and start < len(self.leaves):
            end = min(len(self.leaves), start + step)
            near = order[active, start:end]
            ids, got = (np.full((len(active), end - start, widest), x) for x in (-1, -np.inf))
            for leaf in np.unique(near):
                row, slot = np.nonzero(near == leaf)
                own_ids, who = self.leaves[leaf], active[row]
                far = square[who][:, None] + self.squares[own_ids][None, :] - 2 * (at[who] @ self.points[own_ids].T)
                take = (far <= reach[who][:, None]) & ~((own_ids[None, :] >= own[0][who][:, None]) & (own_ids[None, :] < own[1][who][:, None]))
                q, v = np.nonzero(take)
                ids[row[q], slot[q], v] = own_ids[v]
                got[row[q], slot[q], v] = np.einsum("nd,nd->n", queries[who[q]], self.vectors[own_ids[v]])
                verified += np.bincount(who[q], minlength=n)
            ids = np.concatenate([best[active], ids.reshape(len(active), -1)], axis=1)
            got = np.concatenate([score[active], got.reshape(len(active), -1)], axis=1)
            # the k best: those from the k-th product on, ties by position, which is in ascending order of ids
            q, v = np.nonzero((got >= np.partition(got, got.shape[1] - k, axis=1)[:, [got.shape[1] - k]]) & (ids >= 0))
            ids, got = ids[q, v], got[q, v]
            order_now = np.lexsort((ids, -got, q))
            nth = np.arange(len(q)) - np.searchsorted(q, np.arange(len(active)))[q]
            ids, got, kept = ids[order_now], got[order_now], nth < k
            best[active], score[active] = -1, -np.inf
            best[active[q[kept]], nth[kept]], score[active[q[kept]], nth[kept]] = ids[kept], got[kept]
            reach[active] = reaches(np.maximum(score[active, k - 1], known[active]), norms[active], self.radius, limit)
            start, step = end, 2 * step
            if start < len(self.leaves):
                active = active[bound[active, order[active, start]] <= reach[active]]
        return best, score, verified


def valid(embeddings: DataFrame) -> DataFrame:
    """``vec_id, v, norm``: finite vectors that are neither null nor zero, as wide as they came: floats stay floats."""
    wide = "float" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "double"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column("v")), 0)
            batch, lengths = batch.filter(pc.greater(lengths, 0)), lengths.to_numpy()
            lengths = lengths[lengths > 0]
            if not len(lengths):
                continue
            flat = np.abs(batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float))  # nulls become NaN
            starts = np.cumsum(lengths) - lengths
            fine = np.logical_and.reduceat(np.isfinite(flat), starts)
            top = np.where(fine, np.maximum.reduceat(flat, starts), 0)  # by the largest component, so that no square overflows
            fine &= top > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                norm = top * np.sqrt(np.add.reduceat((flat / np.repeat(top, lengths)) ** 2, starts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm)], ["vec_id", "v", "norm"]).filter(pa.array(fine))

    rows = embeddings.where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{wide}>").alias("v"))
    return rows.mapInArrow(run, f"vec_id long, v array<{wide}>, norm double")


def matrix_of(column, width: int):
    """An Arrow column of lists as a matrix; zeros follow shorter lists."""
    import numpy as np

    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def norm_bins(rows: DataFrame) -> tuple[list[tuple[int, int, int, float]], int]:
    """``(lowest, highest, n, radius)`` of each bin, which holds whole binary orders of norms, and the longest vector's length.

    Neighbouring orders share a bin if its largest norm is at most twice its smallest; so vectors normalised to about 1 are not torn apart.
    """
    order = F.floor(F.log2("norm")).cast("int").alias("o")
    found = rows.groupBy(order).agg(F.count("*").alias("n"), F.min("norm").alias("low"), F.max("norm").alias("high"), F.max(F.size("v")).alias("width")).orderBy("o").collect()  # at most as many as a double has exponents
    bins, low = [], 0.0
    for r in found:
        if bins and r.high <= 2 * low:
            bins[-1] = (bins[-1][0], r.o, bins[-1][2] + r.n, r.high)
        else:
            bins.append((r.o, r.o, r.n, r.high))
            low = r.low
    return bins, max((r.width for r in found), default=0)


def cut_cells(points, parts: int, first: int) -> tuple[list[tuple[int, float, int, int]], int]:
    """A kd-tree of about ``parts`` cells, numbered from ``first``, and the number after the last.

    Nodes: (dimension, cut, node below the cut, node from it on), or (-1, 0, cell, 0). Points that are all the same are one cell.
    """
    import numpy as np

    nodes, todo, cell = [None], [(0, np.arange(len(points)), parts)], first
    while todo:
        at, ids, parts = todo.pop()
        own = points[ids]
        wide = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(ids) else 0
        x = own[:, wide]
        if parts < 2 or len(ids) < 2 or x.min() == x.max():
            nodes[at] = (-1, 0.0, cell, 0)
            cell += 1
            continue
        half = parts // 2
        nth = len(ids) * half // parts
        cut = np.partition(x, nth)[nth]
        if cut == x.min():
            cut = x[x > cut].min()
        nodes[at] = (wide, float(cut), len(nodes), len(nodes) + 1)
        todo += [(len(nodes), ids[x < cut], half), (len(nodes) + 1, ids[x >= cut], parts - half)]
        nodes += [None, None]
    return nodes, cell


def cells_of(nodes, points):
    """The cell of each point."""
    import numpy as np

    out, todo = np.zeros(len(points), dtype=np.int64), [(0, np.arange(len(points)))]
    while todo:
        node, ids = todo.pop()
        if not len(ids):
            continue
        wide, cut, low, high = nodes[node]
        if wide < 0:
            out[ids] = low
            continue
        below = points[ids, wide] < cut
        todo += [(low, ids[below]), (high, ids[~below])]
    return out


@dataclass
class Layout:
    """Where vectors are: of each bin its radius, tree and cells (``starts[i]`` to ``starts[i + 1]``); of each cell its box, first block and number of blocks."""

    width: int
    radius: list[float]
    trees: list[list[tuple[int, float, int, int]]]
    starts: list[int]
    low: object = None
    high: object = None
    first: object = None
    parts: object = None
    blocks: int = 0

    def homes(self, queries, names):
        """The block of each bin that each query falls into: queries x bins."""
        import numpy as np

        matrix, out = projection(self.width), []
        for radius, tree in zip(self.radius, self.trees):
            cell = cells_of(tree, projected_queries(queries, radius, matrix))
            out.append(self.first[cell] + names % self.parts[cell])
        return np.column_stack(out)

    def visits(self, queries, names, kth, limit: float):
        """The blocks, but the homes, that the stopping test leaves to each query: positions of queries, and blocks."""
        import numpy as np

        matrix, norms = projection(self.width), np.sqrt((queries**2).sum(axis=1))
        who, blocks = [], []
        for i, radius in enumerate(self.radius):
            own = slice(self.starts[i], self.starts[i + 1])
            bound = box_distances(projected_queries(queries, radius, matrix), self.low[own], self.high[own])
            q, cell = np.nonzero(bound <= reaches(kth, norms, radius, limit)[:, None])
            cell += self.starts[i]
            parts = self.parts[cell]
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            who.append(np.repeat(q, parts))
            blocks.append(np.repeat(self.first[cell], parts) + nth)
        who, blocks = np.concatenate(who), np.concatenate(blocks)
        other = ~(self.homes(queries, names)[who] == blocks[:, None]).any(axis=1)
        return who[other], blocks[other]


def laid_out(rows: DataFrame, size: int | None = None) -> tuple[DataFrame, Layout]:
    """``vec_id, v, b`` of all ``rows`` (``vec_id, v, norm``), ``b`` being blocks of about ``size`` vectors, and their layout."""
    size = size or INDEX_BLOCK
    bins, width = norm_bins(rows)
    order = F.floor(F.log2("norm")).cast("int")
    which = F.coalesce(*(F.when(order.between(low, high), i) for i, (low, high, _, _) in enumerate(bins)), F.lit(0)).alias("bin")
    layout = Layout(width, [x[3] for x in bins], [], [0])
    total = sum(x[2] for x in bins)

    def project(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            of, vectors, matrix = batch.column("bin").to_numpy(), matrix_of(batch.column("v"), layout.width), projection(layout.width)
            points = np.zeros((len(of), PROJECTED))
            for i in np.unique(of):
                points[of == i] = projected_vectors(vectors[of == i], layout.radius[i], matrix)
            yield pa.RecordBatch.from_arrays([batch.column("bin"), pa.array(list(points), pa.list_(pa.float64()))], ["bin", "point"])

    import numpy as np

    sample = rows if total <= CELL_SAMPLE else rows.sample(CELL_SAMPLE / total, SEED)
    many = any(n > size for _, _, n, _ in bins)
    drawn = sample.select(which, "v").mapInArrow(project, "bin int, point array<double>").collect() if many else []  # CELL_SAMPLE or about as many
    points = [[] for _ in bins]
    for r in drawn:
        points[r.bin].append(r.point)
    for own, (_, _, n, _) in zip(points, bins):
        parts = max(1, min(-(-n // size), MOST_CELLS * n // total))
        nodes, after = cut_cells(np.array(own).reshape(len(own), PROJECTED), parts, layout.starts[-1])
        layout.trees.append(nodes)
        layout.starts.append(after)

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matrix = projection(layout.width)
        for batch in batches:
            of, vectors = batch.column("bin").to_numpy(), matrix_of(batch.column("v"), layout.width)
            cell = np.zeros(len(of), dtype=np.int64)
            for i in np.unique(of):
                cell[of == i] = cells_of(layout.trees[i], projected_vectors(vectors[of == i], layout.radius[i], matrix))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "bin", "row")), pa.array(cell)], ["vec_id", "v", "bin", "row", "cell"])

    wide = rows.schema["v"].dataType.simpleString()
    row = F.xxhash64("vec_id", F.monotonically_increasing_id()).alias("row")  # rows of one vec_id may be many
    placed = saved(rows.select("vec_id", "v", which, row).mapInArrow(place, f"vec_id long, v {wide}, bin int, row long, cell long"), "cells")

    def boxes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matrix, met = projection(layout.width), {}
        for batch in batches:
            of, cells, vectors = batch.column("bin").to_numpy(), batch.column("cell").to_numpy(), matrix_of(batch.column("v"), layout.width)
            for cell in np.unique(cells):
                own = cells == cell
                at = projected_vectors(vectors[own], layout.radius[of[own][0]], matrix)
                n, low, high = met.get(cell, (0, np.inf, -np.inf))
                met[cell] = n + len(at), np.minimum(low, at.min(axis=0)), np.maximum(high, at.max(axis=0))
        flat = [(cell, j, n, low[j], high[j]) for cell, (n, low, high) in met.items() for j in range(PROJECTED)]
        columns = [pa.array(list(x), kind) for x, kind in zip(zip(*flat) if flat else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cell", "j", "n", "low", "high"])

    told = placed.select("bin", "cell", "v").mapInArrow(boxes, "cell long, j long, n long, low double, high double")
    count = layout.starts[-1]
    layout.low, layout.high = np.full((count, PROJECTED), np.inf), np.full((count, PROJECTED), -np.inf)
    layout.parts = np.zeros(count, dtype=np.int64)
    for r in told.groupBy("cell", "j").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():  # cells x dimensions
        layout.low[r.cell, r.j], layout.high[r.cell, r.j], layout.parts[r.cell] = r.low, r.high, -(-r.n // size)
    layout.parts = np.maximum(layout.parts, 1)  # a cell that the sample alone knows
    layout.first = np.cumsum(layout.parts) - layout.parts
    layout.blocks = int(layout.parts.sum())
    numbers = rows.sparkSession.createDataFrame([(i, int(a), int(p)) for i, (a, p) in enumerate(zip(layout.first, layout.parts))], "cell long, first long, parts long")
    dealt = placed.join(F.broadcast(numbers), "cell")  # at most about MOST_CELLS
    return dealt.select("vec_id", "v", (F.col("first") + F.pmod("row", "parts")).cast("int").alias("b")), layout


def blocks_of(rows: DataFrame, size: int | None = None) -> tuple[DataFrame, int]:
    """``vec_id, v, b`` and the number of blocks; see :func:`laid_out`."""
    index, layout = laid_out(rows, size)
    return index, layout.blocks


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, is_query=None, k: int = K, sure: float = SURE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for each query, all other rows being candidates.

    ``is_query``: a condition on vec_id; by default it is divisible by 20. Equal scores go to the smaller vec_id. A
    repeated vec_id is one query, whose candidates are the rows of other ids. Vectors that are null, zero or have null or non-finite
    components take no part; shorter vectors count as if zeros followed. An empty table gives no rows. Other columns take no part.
    """
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    rows = saved(valid(embeddings), "vectors")
    index, layout = laid_out(rows)
    discard(rows)
    if not layout.blocks:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = index.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    limit = chi_square_quantile(sure, PROJECTED)
    shared = embeddings.sparkSession.sparkContext.broadcast(layout)  # at most about MOST_CELLS boxes

    def go_home(batches: Iterator) -> Iterator:
        yield from _routed(batches, shared.value, None)

    def go_on(batches: Iterator) -> Iterator:
        yield from _routed(batches, shared.value, limit)

    routed = f"vec_id long, v {index.schema['v'].dataType.simpleString()}, b int, kth double"
    home = searched(index, queries.withColumn("kth", F.lit(None).cast("double")).mapInArrow(go_home, routed), layout, k, sure)
    if layout.blocks == len(layout.radius):  # the homes are all there is
        return _best(home, k)
    home = saved(_best(home, k), "homes")
    kth = home.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    more = searched(index, queries.join(kth, "vec_id", "left").mapInArrow(go_on, routed), layout, k, sure)
    return _best(home.drop("rank").unionByName(more), k)


def _routed(batches: Iterator, layout: Layout, limit: float | None) -> Iterator:
    """Queries to their homes, or, with the ``limit`` of the stopping test, to the other blocks that they visit."""
    import numpy as np
    import pyarrow as pa

    step = max(1, (1 << 21) // layout.starts[-1])
    for whole in batches:
        for begin in range(0, len(whole), step):
            batch = whole.slice(begin, step)
            queries, names = matrix_of(batch.column("v"), layout.width), batch.column("vec_id").to_numpy()
            if limit is None:
                homes = layout.homes(queries, names)
                who, blocks = np.repeat(np.arange(len(names)), homes.shape[1]), homes.ravel()
            else:
                kth = batch.column("kth").to_numpy(zero_copy_only=False).astype(float)
                who, blocks = layout.visits(queries, names, np.where(np.isnan(kth), -np.inf, kth), limit)
            for at in range(0, len(who), 8192):
                rows, to = pa.array(who[at : at + 8192]), blocks[at : at + 8192].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(rows), batch.column("v").take(rows), pa.array(to), batch.column("kth").take(rows)], ["vec_id", "v", "b", "kth"])


def searched(index: DataFrame, asked: DataFrame, layout: Layout, k: int, sure: float) -> DataFrame:
    """``query_id, vec_id, score``: in each block what is found for those that are asked there (``vec_id, v, b, kth``), no worse than ``kth``."""
    width = layout.width
    # in each block the vectors come first, in order of their ids; then the queries stream
    both = index.withColumns({"kth": F.lit(None).cast("double"), "asks": F.lit(0)}).unionByName(asked.withColumn("asks", F.lit(1)))
    dealt = both.repartition(min(4 * layout.blocks + 1, 1 << 15), "b").sortWithinPartitions("b", "asks", "vec_id")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        block, ids, vectors, tree = None, [], [], None
        for batch in batches:
            keys = batch.column("b").to_numpy().astype(np.int64) * 2 + batch.column("asks").to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for at, to in zip([0, *cuts], [*cuts, len(keys)]):
                b, asks = divmod(int(keys[at]), 2)
                part = batch.slice(at, to - at)
                if b != block:
                    block, ids, vectors, tree = b, [], [], None
                if not asks:
                    ids.append(part.column("vec_id").to_numpy())
                    vectors.append(matrix_of(part.column("v"), width))
                    continue
                if tree is None:
                    ids, vectors = (np.concatenate(x) if x else np.zeros((0, *shape)) for x, shape in ((ids, ()), (vectors, (width,))))
                    tree = Index(vectors, float(np.sqrt((vectors**2).sum(axis=1)).max())) if len(ids) else False
                if tree is False:
                    continue
                asked, names = matrix_of(part.column("v"), width), part.column("vec_id").to_numpy()
                least = part.column("kth").to_numpy(zero_copy_only=False).astype(float)
                least[np.isnan(least)] = -np.inf
                for i in range(0, len(names), TOGETHER):
                    who = names[i : i + TOGETHER]
                    own = np.searchsorted(ids, who), np.searchsorted(ids, who, side="right")
                    floor = least[i : i + TOGETHER]
                    best, score, _ = tree.search(asked[i : i + TOGETHER], own, k, sure, floor)
                    q, slot = np.nonzero((best >= 0) & (score >= floor[:, None]))
                    columns = [pa.array(who[q]), pa.array(ids[best[q, slot]]), pa.array(score[q, slot])]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    return dealt.select("b", "asks", "vec_id", "v", "kth").mapInArrow(run, "query_id long, vec_id long, score double")


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
