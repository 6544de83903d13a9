"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.cluster import broadcast_if_small, cut

WORD = r"[^\x20\x09-\x0D]+"


def _key(seed: int, id_: Column, text: Column) -> Column:
    """A hash-random key of 60 bits: the first 15 hexadecimal digits of an MD5, as other engines have it too."""
    parts = [F.coalesce(x.cast("string"), F.lit("")) for x in (id_, text)]
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), parts[0], F.lit(":"), parts[1]).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(stats: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Adds ``rank`` and ``target`` to one row per source with ``source`` and ``source_size``.

    Sources in code-point order (null last) take the weights in turn and share ``share`` times
    the total size.  No target exceeds ``cap`` times its source: sorted by the level at which
    a source is full, the full ones come first, so prefix sums find the common level of the rest.
    The frame has a row for each source, so its windows stay small.
    """
    everything, ordered = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    full_first = Window.orderBy("level", "rank")
    before = full_first.rowsBetween(Window.unboundedPreceding, -1)
    rest_words = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    return (
        stats.withColumn("rank", F.row_number().over(ordered))
        .withColumn("weight", weight)
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("level", F.col("most") / F.col("weight"))
        .withColumn("common", rest_words / rest_weight)
        .withColumn("full", F.col("level") <= F.col("common"))
        .withColumn("level_left", F.min(F.when(~F.col("full"), F.struct("level", "rank", "common"))).over(everything)["common"])
        .withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("level_left") * F.col("weight")))
        .drop("weight", "most", "level", "common", "full", "level_left")
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    keep: Sequence[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Decide how many words of each document a weighted mix of the sources takes.

    Every row gets a hash-random key; keys order the rows of a source, distributed prefix sums
    of their sizes place each row on the source's line, and the line, repeated in epochs, is cut
    at the source's exact budget (the target's whole words).  Key ranges of about the square
    root of a source's rows are the unit of work, so a source with a third of all rows is spread
    over many tasks; only range totals meet in one window per source.

    Returns the columns named by ``keep`` (all by default) and ``_source_rank``, ``_size``,
    ``_source_size``, ``_target``, ``_taken`` (long words, repeats counted) and ``_copies``
    (whole documents: epochs that begin the document before the budget ends).

    Null text has size 0 and is never taken; a null source is a source of its own, last in
    order; repeated rows and null ids are rows like others; an empty table gives no rows.
    Input columns that begin with ``_mix_`` are not allowed; names such as ``size`` do not clash.
    """
    keep = list(docs.columns if keep is None else keep)
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(source_col).alias("_mix_source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        _key(seed, F.col(id_col), F.col(text_col)).alias("_mix_key"),
    )
    if text_col not in keep:
        keyed = cut(keyed)  # narrow rows, read three times below
    stats = keyed.groupBy(F.col("_mix_source").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("source_size"))
    targets = cut(
        source_targets(stats, weights, share, cap).select(
            F.col("source").alias("_mix_of"),
            F.col("rank").alias("_source_rank"),
            F.col("source_size").alias("_source_size"),
            F.col("target").alias("_target"),
            F.ceil(F.sqrt("n") / 4).alias("_mix_ranges"),
        )
    )
    placed = (
        keyed.join(broadcast_if_small(targets, 100_000), F.col("_mix_source").eqNullSafe(F.col("_mix_of")))
        .withColumn("_mix_range", F.least(F.floor(F.col("_mix_key") / F.lit(2.0**60) * F.col("_mix_ranges")), F.col("_mix_ranges") - 1))
        .drop("_mix_source", "_mix_of", "_mix_ranges")
    )
    totals = placed.groupBy("_source_rank", "_mix_range").agg(F.sum("_size").alias("words"))
    earlier = Window.partitionBy("_source_rank").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_source_rank", "_mix_range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("_mix_offset"))
    inside = Window.partitionBy("_source_rank", "_mix_range").orderBy("_mix_key", F.col("_size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.when(F.col("_source_size") > 0, F.col("_source_size")))).otherwise(0)
    return (
        placed.join(totals, ["_source_rank", "_mix_range"])
        .withColumn("_mix_before", F.col("_mix_offset") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
        .withColumn("_mix_epochs", epochs)
        .withColumn("_mix_left", F.floor("_target") - F.col("_mix_epochs") * F.col("_source_size") - F.col("_mix_before"))
        .withColumn("_taken", F.col("_mix_epochs") * F.col("_size") + F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_mix_left"))))
        .withColumn("_copies", F.when(F.col("_size") > 0, F.col("_mix_epochs") + F.when(F.col("_mix_left") > 0, 1).otherwise(0)).otherwise(0))
        .select(*[F.col(f"`{c}`") for c in keep], "_source_rank", "_size", "_source_size", "_target", "_taken", "_copies")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as its source's budget takes it, with the columns of ``docs``."""
    planned = mix_sources(docs, **options)
    repeated = planned.where("_copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
