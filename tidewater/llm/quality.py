"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.cluster import broadcast_if_small, cut
from tidewater.llm.words import slices

ORDER = 4  # characters of 16 bits in a 64-bit number
BLOCK = 1 << 24  # bytes of text that share one slice of the model
GRAMS = 200_000  # n-grams to a task, about
EDGE = 2  # stands before a text
NONE, FIT, LIMITS = 0, 1, 2  # what a document is for: to be scored only, for the model's counts, for the limits
PARTS = 4  # one of so many parts of the trusted documents sets limits
_BLANKS = re.compile(r"\s+")


def grams(text: str | None) -> np.ndarray:
    """The text's character 4-grams, one for each character: blanks joined, lower case.

    Characters beyond 16 bits share the numbers of the private-use area.
    """
    text = _BLANKS.sub(" ", (text or "").lower()).strip()
    chars = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    chars = np.where(chars > 0xFFFF, np.uint64(0xE000) + chars % np.uint64(0x1900), chars)
    padded = np.concatenate([np.full(ORDER - 1, EDGE, np.uint64), chars])
    out = np.zeros(len(chars), np.uint64)
    for i in range(ORDER):
        out = (out << np.uint64(16)) | padded[i : i + len(chars)]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Small batches, each with the number of its block: a run of rows of one partition."""
    from pyspark import TaskContext

    block, chars = TaskContext.get().partitionId() << 24, 0
    for batch in slices(batches):
        yield block, batch
        chars += batch.column(text_at).nbytes
        if chars > BLOCK:
            block, chars = block + 1, 0


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    own, place = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
    return own, np.bincount(place, weights=np.concatenate([n for _, n in held]), minlength=len(own)).astype(np.int64)


def _gathered(docs: DataFrame) -> DataFrame:
    """One row for each block: its rows, its different 4-grams and how often each occurs in trusted text, packed."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, held, waiting = None, [], [], 0
        pack = zstandard.ZstdCompressor(3).compress
        # rows are written twice, to be cut and to meet the model; copies lie far apart
        closely = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(9, enable_ldm=True, window_log=25)).compress

        def row() -> pa.RecordBatch:
            own, n = _merged(held) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows[0].schema) as out:
                for x in rows:
                    out.write_batch(x)
            packed = [closely(sink.getvalue().to_pybytes()), pack(own.tobytes()), pack(n.tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([now]), *[pa.array([x]) for x in packed]], ["block", "rows", "own", "times"])

        for block, batch in _blocks(batches, 1):
            if block != now and rows:
                yield row()
                rows, held, waiting = [], [], 0
            now = block
            rows.append(batch)
            for text, part in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = grams(text)
                if len(own):
                    held.append((own, np.full(len(own), part == FIT)))
                    waiting += len(own)
            if waiting > 1 << 20:
                held, waiting = [_merged(held)], 0
        if rows:
            yield row()

    return cut(docs.mapInArrow(gather, "block long, rows binary, own binary, times binary"))


def _unpacked(gathered: DataFrame) -> DataFrame:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, own, times in zip(*[c.to_pylist() for c in batch.columns]):
                own, times = (np.frombuffer(zstandard.decompress(x), np.int64) for x in (own, times))
                for k in range(0, len(own), 1 << 16):
                    part = own[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part), pa.array(times[k : k + len(part)])], ["block", "g", "times"])

    return gathered.mapInArrow(unpack, "block long, g long, times long")


def _suffix(g: str, n: int) -> Column:
    """The last n - 1 characters of an n-gram."""
    return F.col(g).bitwiseAND(F.lit((1 << 16 * (n - 1)) - 1))


def kneser_ney(counted: DataFrame) -> DataFrame:
    """``(g, logp)`` for every 4-gram ``g`` of ``counted``, from the ``times`` each occurs in trusted text.

    Interpolated modified Kneser-Ney: raw counts at the highest order and of n-grams that begin a
    text, counts of different left neighbours of the others, three discounts for each order from
    counts of counts, and the uniform distribution under the lowest.  All joins are on the n-gram or its context, both hashed over
    the cluster; only four counts of counts an order reach the driver.
    """
    seen, wanted = {ORDER: counted.where("times > 0").select("g", F.col("times").alias("c"))}, {ORDER: counted.select("g")}
    for n in range(ORDER - 1, 0, -1):
        begins = F.shiftrightunsigned("g", 16 * (n - 1)).bitwiseAND(F.lit(0xFFFF)) == EDGE  # nothing else stands before it
        lower = seen[n + 1].groupBy(_suffix("g", n + 1).alias("g")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("raw"))
        seen[n] = cut(lower.select("g", F.when(begins, F.col("raw")).otherwise(F.col("kinds")).alias("c")), GRAMS)
        wanted[n] = cut(wanted[n + 1].select(_suffix("g", n + 1).alias("g")).distinct(), GRAMS)
    kinds = wanted[1].count() + 1
    p = wanted[1].select("g", F.lit(1.0 / kinds).alias("p"))
    for n in range(1, ORDER + 1):
        n1, n2, n3, n4 = (float(x or 0) for x in seen[n].agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first())
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        cuts = [min(k, max(0.05 * k, k - (k + 1) * y * after / now)) if now else 0.5 * k for k, now, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        less = F.when(F.col("c") == 1, cuts[0]).when(F.col("c") == 2, cuts[1]).otherwise(cuts[2])
        context = (lambda n: F.shiftrightunsigned("g", 16) if n > 1 else F.lit(0).cast("long"))(n)
        around = seen[n].groupBy(context.alias("context")).agg(F.sum("c").alias("total"), F.sum(less).alias("freed"))
        lower = p.select(F.col("g").alias("suffix"), F.col("p").alias("below"))
        here = wanted[n].withColumn("context", context).withColumn("suffix", F.col("g") if n == 1 else _suffix("g", n))
        if n == ORDER:
            here = counted.select("g", F.col("times").alias("c")).withColumn("context", context).withColumn("suffix", _suffix("g", n))
        else:
            here = here.join(seen[n], "g", "left")
        p = cut(
            here.join(around, "context", "left").join(lower, "suffix")
            .select("g", F.coalesce((F.when(F.col("c") > 0, F.col("c") - less).otherwise(0.0) + F.col("freed") * F.col("below")) / F.col("total"), F.col("below")).alias("p")),
            GRAMS,
        )
    return p.select("g", F.log("p").cast("float").alias("logp"))


def perplexities(docs: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id``, ``lang``, ``part``, ``n`` (characters scored) and ``perplexity`` (null without characters) of each row.

    ``part`` is FIT for the documents that the model counts.  Blocks of documents stand for their different 4-grams, so counts, not occurrences, are
    shuffled: to the shards that add them, and back as the block's slice of the model, which the
    block's packed rows meet.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(part, F.lit(NONE)).alias("part"), F.col(lang_col).alias("lang"))
    # many small partitions would make many small blocks
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plain = plain.coalesce(max(size // BLOCK + 1, docs.sparkSession.sparkContext.defaultParallelism))
    gathered = _gathered(plain)
    blocks = _unpacked(gathered.select("block", "own", "times"))
    model = kneser_ney(cut(blocks.groupBy("g").agg(F.sum("times").alias("times")), GRAMS))
    slices_of = blocks.select("block", "g").join(model, "g").select("block", "g", "logp")
    id_type = plain.schema["id"].dataType.simpleString()

    def score(block: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(model["g"].to_numpy())
        known, logp = model["g"].to_numpy()[order], model["logp"].to_numpy()[order].astype(np.float64)
        out = []
        for packed in block["rows"]:
            rows = pa.ipc.open_stream(zstandard.decompress(packed)).read_all()
            sizes, found = [], []
            for text in rows.column("text").to_pylist():
                own = grams(text).view(np.int64)
                sizes.append(len(own))
                found.append(float(np.exp(-logp[np.searchsorted(known, own)].mean())) if len(own) else None)
            ids = pd.Series(rows.column("id").to_pylist(), dtype=object)
            out.append(pd.DataFrame({"id": ids, "lang": rows.column("lang").to_pylist(), "part": rows.column("part").to_pylist(), "n": sizes, "perplexity": pd.array(found, "Float64")}))
        return pd.concat(out)

    blocks = gathered.select("block", "rows").groupBy("block").cogroup(slices_of.groupBy("block"))
    return blocks.applyInPandas(score, f"id {id_type}, lang string, part int, n long, perplexity double")


def classify_quality(
    docs: DataFrame, labels: DataFrame, low: float = 0.001, high: float = 0.99, slack: float = 1.1,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Keep documents whose perplexity is usual for trusted text of their language.

    Trusted are documents that ``labels`` (``doc_id``, ``quality``, ``toxic``) calls good and not
    toxic.  The hash of their text parts them: three of four parts are what the model counts, the
    fourth, which it hasn't seen, sets the limits.  Each language's limits are quantiles of the
    perplexities there, widened by ``slack``: above, text is unlike the trusted one; below, it
    repeats itself.  A language without documents in that part, or a null language, takes the
    quantiles of all of them.

    Returns ``_id``, ``_lang``, ``_n`` (characters scored), ``_perplexity``, ``_low``, ``_high`` and
    ``_kept``.  Null and empty texts have a null perplexity and aren't kept.  Without any
    document that sets limits there are none and every text with characters is kept.  Rows that repeat are
    scored each; repeated labels trust an id if any of them does.
    """
    trusted = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").alias("_trusted_id")).distinct()
    marked = docs.select(id_col, text_col, lang_col).join(broadcast_if_small(trusted, 1_000_000), F.col(id_col) == F.col("_trusted_id"), "left")
    held_out = F.pmod(F.xxhash64(F.lit(31), F.col(text_col)), F.lit(PARTS)) == 0
    part = F.when(F.col("_trusted_id").isNull(), NONE).when(held_out, LIMITS).otherwise(FIT)
    scored = cut(perplexities(marked, part, id_col, text_col, lang_col))
    limits = lambda: (F.percentile_approx("perplexity", low, 10_000) / slack, F.percentile_approx("perplexity", high, 10_000) * slack)
    good = scored.where((F.col("part") == LIMITS) & F.col("perplexity").isNotNull())
    overall = good.agg(*limits()).first()
    by_lang = good.where("lang is not null").groupBy(F.col("lang").alias("of")).agg(*[x.alias(name) for x, name in zip(limits(), ("low", "high"))])
    return scored.join(broadcast_if_small(by_lang, 10_000), F.col("lang") == F.col("of"), "left").select(
        F.col("id").alias("_id"), F.col("lang").alias("_lang"), F.col("n").alias("_n"), F.col("perplexity").alias("_perplexity"),
        *[F.coalesce(name, F.lit(x).cast("double")).alias(f"_{name}") for name, x in zip(("low", "high"), overall)],
    ).withColumn("_kept", F.col("_perplexity").isNotNull() & F.coalesce(F.col("_perplexity").between(F.col("_low"), F.col("_high")), F.lit(True)))
