"""Approximate nearest neighbours with randomly rotated one-bit codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.vectors import cosines, matrix, rotation, usable

PLANES = 6  # bits of a rotated query's components


def _padded(d: int) -> int:
    return -(-d // 64) * 64


def encode(rows: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-bit codes, packed in 64-bit words, and each code's inner product with its vector."""
    d = len(turn)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    turned = np.pad(unit, ((0, 0), (0, d - unit.shape[1]))) @ turn
    bits = turned > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64), np.abs(turned).sum(axis=1) / np.sqrt(d)


class Codes:
    """A block of codes, word by word, with what every estimate needs of them."""

    def __init__(self, packed: list[bytes], own: np.ndarray):
        self.words = np.ascontiguousarray(np.frombuffer(b"".join(packed), np.uint64).reshape(len(packed), -1).T)
        self.ones = sum(np.bitwise_count(w).astype(np.int64) for w in self.words)
        self.inverse = 1 / own
        self.spread = np.sqrt(np.maximum(0, 1 - own**2) / max(1, 64 * len(self.words) - 1)) * self.inverse


class Query:
    """A query's rotated components on a grid of 2**PLANES steps, as bit planes."""

    def __init__(self, row: np.ndarray, turn: np.ndarray):
        d = len(turn)
        turned = np.pad(row / np.linalg.norm(row), (0, d - len(row))) @ turn
        self.low = turned.min()
        self.step = max((turned.max() - self.low) / (2**PLANES - 1), 1e-300)
        grid = np.rint((turned - self.low) / self.step).astype(np.int64)
        self.planes = [np.packbits((grid >> j) & 1, bitorder="little").view(np.uint64) for j in range(PLANES)]
        self.total, self.root = self.low * d + self.step * grid.sum(), np.sqrt(d)

    def estimate(self, codes: Codes, sure: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines with coded vectors and how far off they may be, ``sure`` deviations out."""
        weighted = np.zeros(len(codes.ones), np.int32)
        for j, plane in enumerate(self.planes):
            for word, own in zip(codes.words, plane):
                weighted += np.bitwise_count(word & own).astype(np.int32) << j
        product = (2 * (self.low * codes.ones + self.step * weighted) - self.total) / self.root
        return product * codes.inverse, sure * (codes.spread + self.step / np.sqrt(12) * codes.inverse)


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores of different ids, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    if len(order) > k:
        first = np.unique(ids[order], return_index=True)[1]
        order = order[np.sort(first)]
    return order[:k]


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, sure: float = 3.5, block: int = 16_384, queries_block: int = 4_096,
    seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """For each row that ``is_query`` chooses, its ``k`` nearest other rows by cosine.

    Every vector is rotated at random and kept as one bit for each component with its code's
    inner product.  A query's inner products with all codes are estimated from popcounts, each
    with an error bound; vectors whose upper bound reaches the k-th best lower bound are reranked
    by the exact cosine.  Queries meet the codes in blocks: a grid of ``block`` vectors by
    ``queries_block`` queries, cut finely enough to use all tasks; each cell keeps k rows a query.

    Returns ``query_id``, ``rank`` (int from 1), ``vec_id`` and ``score``, nearest first, ties to
    the smaller id.  Vectors that are null, zero, or hold null or non-finite components, and rows
    without an id, take no part.  Only vectors of equal length are compared.  Rows that repeat an
    id are one candidate with its best score, never a neighbour of their own id; a query id that
    repeats is answered by its best scores.  Fewer candidates than k give fewer rows.
    """
    tasks = max(1, vectors.sparkSession.sparkContext.defaultParallelism)
    good = vectors.where(F.col(id_col).isNotNull() & usable(vector_col)).select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    id_type = good.schema["id"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            vs = batch.column(1).to_pylist()
            codes, owns = [b""] * len(vs), [0.0] * len(vs)
            raw = [np.array(v, np.float64).tobytes() for v in vs]
            dims = np.array([len(v) for v in vs])
            for d in np.unique(dims).tolist():
                turn = turns.setdefault(d, rotation(_padded(d), seed))
                at = np.flatnonzero(dims == d)
                code, own = encode(matrix([vs[i] for i in at]), turn)
                for i, c, o in zip(at.tolist(), code, own.tolist()):
                    codes[i], owns[i] = c.tobytes(), o
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(dims, pa.int32()), pa.array(raw, pa.binary()), pa.array(codes, pa.binary()), pa.array(owns, pa.float64()), batch.column(2)],
                ["id", "d", "raw", "code", "own", "q"],
            )

    indexed = good.mapInArrow(index, f"id {id_type}, d int, raw binary, code binary, own double, q boolean")
    n, n_queries = good.agg(F.count(F.lit(1)), F.count_if("q")).first()
    high, wide = max(1, -(-n // block), min(3 * tasks, n // 1024)), max(1, -(-n_queries // queries_block))
    dealt = lambda many: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    data = indexed.withColumn("row", dealt(high)).withColumn("col", every(wide)).drop("q")
    asked = indexed.where("q").withColumn("col", dealt(wide)).withColumn("row", every(high)).select("id", "d", "raw", "row", "col")

    def search(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(data) and len(asked):
            d = int(asked["d"].iloc[0])
            turn = rotation(_padded(d), seed)
            rows = matrix([np.frombuffer(x, np.float64) for x in data["raw"]])
            codes, ids = Codes(data["code"].tolist(), data["own"].to_numpy()), data["id"].to_numpy()
            repeats = len(np.unique(ids)) < len(ids)
            for query_id, raw in zip(asked["id"], asked["raw"]):
                row = matrix([np.frombuffer(raw, np.float64)])[0]
                about, error = Query(row, turn).estimate(codes, sure)
                other = ids != query_id
                low = np.where(other, about - error, -np.inf)
                bar = np.partition(low, -k)[-k] if len(low) > k else -np.inf
                if repeats and len(low) > k:  # the bar is that of k different ids
                    best = pd.Series(low).groupby(ids).max().nlargest(k)
                    bar = best.iloc[-1] if len(best) == k else -np.inf
                chosen = np.flatnonzero(other & (about + error >= bar))
                scores = cosines(row, rows[chosen])
                best = _top(ids[chosen], scores, k)
                found.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[chosen][best], "score": scores[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    cells = data.groupBy("row", "col", "d").cogroup(asked.groupBy("row", "col", "d")).applyInPandas(search, f"query_id {id_type}, vec_id {id_type}, score double")
    best = cells.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
