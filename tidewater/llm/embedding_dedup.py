"""Embedding near-dedup with spherical-cap filters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.cluster import broadcast_if_small, components, cut
from tidewater.llm.vectors import matrix, norms, rotation, usable

LARGE = 8192  # members of a cell that one task compares at once; larger cells are split into a grid
TILE = 2048  # members whose products with as many others are in memory
SPAN = 256  # filters that differ in their last codeword only make a cell, so many at most


@dataclass(frozen=True)
class CapFilters:
    """Directions that are products of one codeword a block, and how far a vector must lean to exceed one."""

    d: int
    sizes: tuple[int, ...]  # codewords of each block
    bar: float
    seed: int

    def books(self) -> tuple[np.ndarray, list[np.ndarray]]:
        rng = np.random.default_rng(self.seed)
        books = []
        for part, size in zip(np.array_split(np.arange(self.d), len(self.sizes)), self.sizes):
            words = rng.standard_normal((size, len(part)))
            # blocks weigh by their width, so that a whole direction has length one
            books.append(words / np.linalg.norm(words, axis=1, keepdims=True) * math.sqrt(len(part) / self.d))
        return rotation(self.d, self.seed), books

    def cells(self, number: np.ndarray) -> np.ndarray:
        """The cell of each filter: filters of much the same direction, side by side in number."""
        if len(self.sizes) == 1:
            return number
        last = self.sizes[-1]
        return number // last * -(-last // SPAN) + number % last // SPAN


def plan_filters(n: int, d: int, cosine: float, members: int = 48, missed: float = 1e-3, seed: int = 3) -> CapFilters:
    """Filters for ``n`` vectors: about ``members`` random vectors exceed one, whatever ``n`` is.

    The number of directions is such that two vectors at the cosine share one but for a share
    ``missed`` of pairs, by the bivariate normal that inner products nearly follow; twice as many
    are taken, as product directions aren't independent.
    """
    normal = NormalDist()
    share = min(0.04, members / max(1, n))
    z = min(normal.inv_cdf(1 - share), 0.75 * math.sqrt(d))  # in few dimensions caps that small would hold nothing
    steps = np.linspace(z, z + 8, 2000)
    density = np.exp(-(steps**2) / 2) / math.sqrt(2 * math.pi)
    beyond = np.array([1 - normal.cdf((z - cosine * x) / math.sqrt(1 - cosine**2)) for x in steps])
    both = float((density * beyond).sum() * (steps[1] - steps[0]))
    total = 2 * -math.log(missed) / both
    blocks = 1
    while blocks < d and total ** (1 / blocks) > (256 if blocks == 1 else 2048):
        blocks += 1
    size = max(2, math.ceil(total ** (1 / blocks)))
    return CapFilters(d, (size,) * blocks, z / math.sqrt(d), seed)


def decode(rows: np.ndarray, turn: np.ndarray, books: list[np.ndarray], bar: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and filter numbers of all directions that unit vectors exceed, block by block.

    Partial sums that can't reach the bar even with the best codewords of the blocks to come
    are dropped before the next block, so not all products are formed.
    """
    turned = rows @ turn
    parts = np.array_split(np.arange(rows.shape[1]), len(books))
    leans = [turned[:, p] @ b.T for p, b in zip(parts, books)]
    rest = [np.zeros(len(rows))]  # the most that the blocks after each one can add
    for lean in leans[:0:-1]:
        rest.append(rest[-1] + lean.max(axis=1))
    row, number, reached = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for lean, more in zip(leans, rest[::-1]):
        total = reached[:, None] + lean[row]
        at, word = np.nonzero(total + more[row][:, None] >= bar)
        number, reached, row = number[at] * lean.shape[1] + word, total[at, word], row[at]
    return row, number


def _smaller_shared(lists: list[np.ndarray], others: list[np.ndarray], number: int) -> np.ndarray:
    """Whether two members also share a filter of a smaller number, for all pairs."""
    mine, theirs = [x[x < number] for x in lists], [x[x < number] for x in others]
    seen = np.unique(np.concatenate([*mine, *theirs]))
    if not len(seen):
        return np.zeros((len(lists), len(others)), bool)

    def flags(own: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(own), len(seen)), np.float32)
        out[np.repeat(np.arange(len(own)), [len(x) for x in own]), np.searchsorted(seen, np.concatenate(own))] = 1
        return out

    return flags(mine) @ flags(theirs).T > 0


def _forest(linked: np.ndarray) -> np.ndarray:
    """Edges that hold together what a square matrix of links holds together: each member with its root."""
    free, edges = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if free[root]:
            front = np.zeros(len(linked), bool)
            front[root] = True
            free[root] = False
            while front.any():
                front = linked[front].any(axis=0) & free
                free &= ~front
                edges += [(root, x) for x in np.flatnonzero(front)]
    return np.array(edges, np.int64).reshape(-1, 2)


class _Members:
    def __init__(self, table: pa.Table, width: str):
        self.ids = table.column("id").to_numpy()
        self.times = table.column("times").to_numpy()
        self.rows = matrix([np.frombuffer(x, width) for x in table.column("raw").to_pylist()])
        self.norms = norms(self.rows)
        self.unit = (self.rows / self.norms[:, None]).astype(np.float32)
        self.cells = [np.frombuffer(x, np.int64) for x in table.column("cells").to_pylist()]

    def part(self, at: int) -> "_Members":
        made, here = object.__new__(_Members), slice(at, at + TILE)
        made.ids, made.times, made.rows, made.norms, made.unit, made.cells = (x[here] for x in (self.ids, self.times, self.rows, self.norms, self.unit, self.cells))
        return made


def _linked(a: _Members, b: _Members, cosine: float) -> np.ndarray:
    """Which pairs reach the cosine; where single precision can't tell, the plain formula in double precision decides."""
    near = a.unit @ b.unit.T
    linked = near >= cosine
    unsure = np.flatnonzero(np.abs(near - np.float32(cosine)).ravel() < max(1e-5, 2.4e-7 * a.unit.shape[1]))
    for k in range(0, len(unsure), 1 << 14):
        i, j = np.divmod(unsure[k : k + (1 << 14)], len(b.ids))
        linked[i, j] = (a.rows[i] * b.rows[j]).sum(axis=1) / (np.sqrt((a.rows[i] ** 2).sum(axis=1)) * np.sqrt((b.rows[j] ** 2).sum(axis=1))) >= cosine
    return linked


def _compare(a: _Members, b: _Members, cell: int, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links within a cell, each pair only where the cell is the smallest that it shares: (id, links), (id, id)."""
    linked = _linked(a, b, cosine)
    if same:
        np.fill_diagonal(linked, False)
    keep_a, keep_b = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    linked = linked[np.ix_(keep_a, keep_b)]
    if linked.size:
        linked &= ~_smaller_shared([a.cells[i] for i in keep_a], [b.cells[i] for i in keep_b], cell)
    if not linked.any():
        return np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
    ids, others = a.ids[keep_a], b.ids[keep_b]
    counts = [np.stack([ids, linked @ b.times[keep_b]], axis=1)]
    if same:  # the same members on both sides
        edges = ids[_forest(linked)]
    else:
        counts.append(np.stack([others, linked.T @ a.times[keep_a]], axis=1))
        n = len(ids)
        square = np.zeros((n + len(others),) * 2, bool)
        square[:n, n:], square[n:, :n] = linked, linked.T
        edges = np.concatenate([ids, others])[_forest(square)]
    counts = np.concatenate(counts)
    return counts[counts[:, 1] > 0], edges.reshape(-1, 2)


def embedding_groups(vectors: DataFrame, cosine: float = 0.9, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Link vectors whose cosine reaches ``cosine`` and name the groups that links make.

    Equal vectors count once, with how often they occur.  Every other vector is decoded, block by
    block, to the filters of all spherical caps that it lies in: the caps' directions are structured
    products.  Filters that differ in their last codeword only make a cell, and a vector goes once
    to each of its cells, as wide as it came, where it meets all others there.  Cells with many
    members are split into a grid of smaller comparisons, none left out.  Pairs are verified by
    exact cosines; a pair counts in the smallest cell that it shares, so counts need no list of
    pairs, and each comparison passes on only a spanning forest of its links.  Pairs are missed
    with a small chance, never invented.  Two hashes of 64 bits stand for a vector where equal
    ones are looked for.

    Returns ``_id``, ``_n_links`` (other vectors linked directly), ``_component`` (the smallest id
    that links reach, itself included) and ``_kept`` (whether that is its own id), one row for
    each input row.  Vectors that are null, zero or hold null or non-finite components link with
    nothing, and so do rows without an id, whose component is null.  Only vectors of equal
    length link.  Rows that repeat an id with other vectors share its component.
    """
    narrow = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if narrow else "array<double>").alias("v"))
    good, width = F.col("id").isNotNull() & usable("v"), "float32" if narrow else "float64"
    keyed = named.where(good).withColumn("one", F.xxhash64("v")).withColumn("two", F.xxhash64(F.lit(1), "v"))
    classes = cut(keyed.groupBy("one", "two").agg(F.first("v").alias("v"), F.min("id").alias("id"), F.count(F.lit(1)).alias("times")))
    widths = classes.groupBy(F.size("v").alias("d")).count().collect()  # a row for each vector length
    plans = {r["d"]: plan_filters(r["count"], r["d"], cosine, seed=seed) for r in widths}

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for whole in batches:
            for batch in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                vs = batch.column(0).to_pylist()
                dims = np.array([len(v) for v in vs])
                for d in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == d)
                    rows = matrix([vs[i] for i in at])
                    turn, books = made.setdefault(d, plans[d].books())
                    row, number = decode(rows / norms(rows)[:, None], turn, books, plans[d].bar)
                    row, cell = np.unique(np.stack([row, plans[d].cells(number)]), axis=1)
                    lists = np.split(cell, np.searchsorted(row, np.arange(1, len(at))))
                    own, raw = batch.take(pa.array(at)), [np.array(vs[i], width).tobytes() for i in at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), d), pa.int32()), pa.array(cell, pa.int64()), own.column(1).take(pa.array(row)), own.column(2).take(pa.array(row)),
                         pa.array([raw[i] for i in row], pa.binary()), pa.array([lists[i].tobytes() for i in row], pa.binary())],
                        ["d", "cell", "id", "times", "raw", "cells"],
                    )

    leaning = classes.select("v", "id", "times").mapInArrow(lean, "d int, cell long, id long, times long, raw binary, cells binary")
    sizes = leaning.groupBy("d", "cell").count()
    large = cut(sizes.where(F.col("count") > LARGE).select("d", "cell", F.ceil(F.col("count") / LARGE).cast("int").alias("blocks")))
    placed = (
        leaning.join(broadcast_if_small(large, 100_000), ["d", "cell"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .select("d", "cell", "low", "high", "own", "id", "times", "raw", "cells")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cell, low, high = (table.column(c)[0].as_py() for c in ("cell", "low", "high"))
            side = table.column("own").to_numpy()
            first = _Members(table.filter(pa.array(side == low)), width)
            second = first if low == high else _Members(table.filter(pa.array(side == high)), width)
            for i in range(0, len(first.ids), TILE):
                for j in range(i if low == high else 0, len(second.ids), TILE):
                    same = low == high and i == j
                    part = first.part(i)
                    counts, edges = _compare(part, part if same else second.part(j), cell, cosine, same)
                    a, b = np.concatenate([counts[:, 0], edges[:, 0]]), np.concatenate([counts[:, 0], edges[:, 1]])
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate([counts[:, 1], np.zeros(len(edges), np.int64)]))], ["a", "b", "links"])

        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("d", "cell", "low", "high")], axis=1)
            ends = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            begin = 0
            for end in ends.tolist():
                if end - begin > 1:
                    yield from one(table.slice(begin, end - begin))
                begin = end
            rest = table.slice(begin).combine_chunks()
        if rest is not None and rest.num_rows > 1:
            yield from one(rest)

    keys = ["d", "cell", "low", "high"]
    seen = cut(placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "a long, b long, links long").groupBy("a", "b").agg(F.sum("links").alias("links")))
    links = seen.where("a = b").select(F.col("a").alias("node"), "links")
    grouped = components(seen.where("a <> b").select("a", "b"))
    facts = (
        classes.select("one", "two", F.col("id").alias("node"), "times")
        .join(links, "node", "left")
        .join(grouped, "node", "left")
        .select("one", "two", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("component"))
    )
    joined = keyed.select("id", "one", "two").join(facts, ["one", "two"]).select("id", "n", "component")
    alone = named.where(~good).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    return joined.unionByName(alone).select(
        F.col("id").alias("_id"), F.col("n").alias("_n_links"), F.col("component").alias("_component"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("_kept")
    )
