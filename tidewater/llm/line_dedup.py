"""Line dedup with two Bloom filters."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.cluster import broadcast_if_small, cut
from tidewater.llm.words import slices

BLANK = b" \t\n\x0b\x0c\r"
SEGMENT = 1 << 16  # bytes of a filter that are merged as one row
FAN_IN = 32  # rows merged at once, however many partitions there are
CHUNK = 1 << 17  # hashes gathered before a filter takes them
BITS = 1 << 29  # of a filter, at most: 64 MB
HOT = 100_000  # holders of a key to a task, about


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The stripped, A-Z lower-cased line, or None if it has fewer than ``min_chars`` code points."""
    key = line.strip(BLANK)
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key.lower()  # of bytes: only A-Z


def line_keys(text: bytes, min_chars: int) -> set[bytes]:
    """The different keys of a text."""
    keys = {line_key(line, min_chars) for line in text.split(b"\n")}
    keys.discard(None)
    return keys


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    return np.concatenate([hashes & np.uint64(bits - 1), (mixed >> np.uint64(20)) & np.uint64(bits - 1)]).astype(np.int64)


def _add(filter_: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    at = _positions(hashes, bits)
    np.bitwise_or.at(filter_, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _has(filter_: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = _positions(hashes, bits)
    found = (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    return (found[: len(hashes)] & found[len(hashes) :]).astype(bool)


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [b"" if x is None else x for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _hash_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little")


def twice_seen(docs: DataFrame, text_col: str, min_chars: int, bits: int) -> np.ndarray:
    """The filter of line keys that at least two documents may hold, merged over all partitions.

    A partition keeps two filters of ``bits`` bits: keys seen in a document, and keys seen again
    in another.  Merging ors both, and what two once-seen filters share counts as twice seen.
    Filters travel as packed segments, so what moves follows the lines, not the filter's size.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        once, twice, held, n = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8), [], 0

        def flush() -> None:
            if held:
                seen, counts = np.unique(np.concatenate(held), return_counts=True)
                _add(twice, seen[(counts > 1) | _has(once, seen, bits)], bits)
                _add(once, seen, bits)
                held.clear()

        for batch in slices(batches):
            for text in _texts(batch, "text"):
                keys = {_hash_of(_digest(k)) for k in line_keys(text, min_chars)}
                if keys:
                    held.append(np.fromiter(keys, np.uint64, len(keys)))
                    n += len(keys)
                    if n >= CHUNK:
                        flush()
                        n = 0
        flush()
        slot = TaskContext.get().partitionId()
        for k in range(0, bits // 8, SEGMENT):
            if once[k : k + SEGMENT].any():
                yield pa.RecordBatch.from_pylist(
                    [{"segment": k // SEGMENT, "slot": slot, "once": zlib.compress(once[k : k + SEGMENT], 1), "twice": zlib.compress(twice[k : k + SEGMENT], 1)}],
                    pa.schema([("segment", pa.int32()), ("slot", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]),
                )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(SEGMENT, np.uint8), np.zeros(SEGMENT, np.uint8)
        for o, t in zip(pdf["once"], pdf["twice"]):
            o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
            twice[: len(o)] |= t | (once[: len(o)] & o)
            once[: len(o)] |= o
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "slot": pdf["slot"].iloc[:1] // FAN_IN, "once": [zlib.compress(once, 1)], "twice": [zlib.compress(twice, 1)]})

    schema = "segment int, slot int, once binary, twice binary"
    slots, parts = docs.rdd.getNumPartitions(), docs.select(F.col(text_col).alias("text")).mapInArrow(build, schema)
    while slots > FAN_IN:
        parts = parts.groupBy("segment", F.floor(F.col("slot") / FAN_IN).alias("merged")).applyInPandas(merge, schema)
        slots = -(-slots // FAN_IN)
    parts = parts.groupBy("segment").applyInPandas(merge, schema)
    found = np.zeros(bits // 8, np.uint8)
    for row in parts.select("segment", "twice").toLocalIterator():  # one filter of a fixed size
        piece = np.frombuffer(zlib.decompress(bytes(row["twice"])), np.uint8)[: len(found) - row["segment"] * SEGMENT]
        found[row["segment"] * SEGMENT : row["segment"] * SEGMENT + len(piece)] |= piece
    return found


def dedup_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, bits: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Drop lines that many documents share from all of them but the one with the largest id.

    A line's key is the line without blanks at its ends and with A-Z lower-cased.  Keys of at
    least ``min_chars`` code points that at least ``min_docs`` documents hold lose all their
    lines, except in the largest id that holds them.  Returns the columns of ``docs`` with the
    text changed, and ``_n_lines`` (before dropping) and ``_n_dropped``.

    Two Bloom filters (once and twice seen) choose suspects.  They have 16 bits, or ``bits`` in
    all, for each line of the input, as a count says, but 2**29 at most, as every task gets them.
    Only suspected keys, as 128-bit digests, are shuffled for exact counting; only documents with
    a suspected line are shuffled to meet their drops.  A filter that is too small for its input
    makes more suspects and never changes the result: at worst all digests are shuffled once.

    Null or empty text is one empty line and comes back as an empty text.  Rows that repeat an
    id count as one document; a null id is a document that is never the largest.
    """
    context = docs.sparkSession.sparkContext
    min_chars = max(1, min_chars)
    if bits is None:
        lines = docs.agg(F.sum(F.length(text_col) - F.length(F.replace(text_col, F.lit("\n"))) + 1)).first()[0] or 0
        bits = min(BITS, max(1 << 20, 1 << (16 * lines - 1).bit_length()))
    twice = context.broadcast(twice_seen(docs, text_col, min_chars, bits))
    names = list(docs.columns)
    text_at = names.index(text_col)

    def suspected(text: bytes) -> list[bytes]:
        keys = [_digest(k) for k in line_keys(text, min_chars)]
        if not keys:
            return keys
        hits = _has(twice.value, np.fromiter(map(_hash_of, keys), np.uint64, len(keys)), bits)
        return [k for k, hit in zip(keys, hits) if hit]

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), _texts(batch, "text")):
                own = suspected(text)
                ids += [doc] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(keys, pa.binary())], ["id", "key"])

    id_type = docs.schema[id_col].dataType.simpleString()
    found = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(suspects, f"id {id_type}, key binary").distinct())
    shared = cut(found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs))
    salted = shared.withColumn("salts", F.ceil(F.col("n") / HOT))  # keys that very many documents hold spread over tasks
    hot = broadcast_if_small(salted.where("salts > 1").select("key", "salts"), 100_000)
    drops = (
        found.join(hot, "key", "left").withColumn("salt", F.coalesce(F.expr("pmod(xxhash64(id), salts)"), F.lit(0).cast("long"))).drop("salts")
        .join(salted.select("key", "keeper", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt")), ["key", "salt"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias("_line_id")).agg(F.collect_list("key").alias("_line_drops"))  # at most a document's lines
    )

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = _texts(batch, text_col)
            new = [pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()), pa.array([bool(suspected(t)) for t in texts], pa.bool_())]
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == text_at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, *new], [*names, "_n_lines", "_line_suspect"])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_dropped, texts = [], []
            drops = batch.column(batch.schema.get_field_index("_line_drops")).to_pylist()
            for text, drop in zip(_texts(batch, text_col), drops):
                lines, drop = text.split(b"\n"), set(drop or ())
                kept = [x for x in lines if (k := line_key(x, min_chars)) is None or _digest(k) not in drop] if drop else lines
                n_dropped.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == text_at else batch.column(i) for i in range(len(names) + 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_dropped, pa.int64())], [*names, "_n_lines", "_n_dropped"])

    counted = T.StructType([*docs.schema.fields, T.StructField("_n_lines", T.LongType())])
    flagged = docs.mapInArrow(flag, T.StructType([*counted.fields, T.StructField("_line_suspect", T.BooleanType())]))
    clean = flagged.where("not _line_suspect").drop("_line_suspect").withColumn("_n_dropped", F.lit(0).cast("long"))
    # a merge join parts the two Python steps: in one stage each task would hold two workers
    met = flagged.where("_line_suspect").drop("_line_suspect").join(drops.hint("merge"), F.col(id_col).eqNullSafe(F.col("_line_id")), "left").drop("_line_id")
    return clean.unionByName(met.mapInArrow(rewrite, T.StructType([*counted.fields, T.StructField("_n_dropped", T.LongType())])))
