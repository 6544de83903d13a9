"""Secret scans with multipart credential linking, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.cluster import cut

# The base kinds in the order in which they are listed, and what each must reach.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",  # a run that is too short holds no longer one
    "hex": r"[0-9a-f]{24,}",
}
# Weak candidates: alone they say little, so they count only beside a complementary part.
PARTS = {
    "identifier": r"(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{8,}|(?i:client_?id|account_?id|user_?name|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}",
    "key": r"[A-Za-z0-9+/_=-]{32,}",
    "endpoint": r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3)://[^\x20\x09-\x0D\"'<>]{4,}",
}
KINDS = [*BASE, *PARTS]
NEEDED = {"access": "AKIA", "endpoint": "://"}  # texts without it hold no match
SECRETS, PARTNERS = ["assign", "key", "hex"], ["access", "identifier", "endpoint"]


def _accepted(kind: Column, match: Column) -> Column:
    """Whether a match counts: long enough a value, or a key that mixes cases and digits."""
    return (
        F.when(kind == "assign", F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6)
        .when(kind == "key", match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]"))
        .otherwise(True)
    )


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches, or null for a text that can't hold any."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.contains(NEEDED[kind]), found) if kind in NEEDED else found


def _buckets(begin: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(begin / width), F.floor(end / width)))


def find_secrets(docs: DataFrame, reach: int = 200, text_col: str = "text") -> DataFrame:
    """Spans of secrets in every whole text, with weak parts that complete each other.

    Base kinds are reported wherever they match.  Parts of a multipart credential (access
    identifiers, secrets, endpoints) are reported only if a secret and an identifier or an
    endpoint lie within ``reach`` code points of each other: an interval join on the row and on
    position buckets as wide as the scope, so a text with very many parts is compared only
    within neighbouring buckets.

    Returns the columns of ``docs`` without the text, and ``_spans``: an array of
    (start, rank of kind, kind, end, base) by start, then kind; code points, end exclusive.
    Null and empty texts have no spans; each of repeated rows gets its own.
    """
    others = [c for c in docs.columns if c != text_col]
    found = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("_own"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        *[_matches(F.coalesce(F.col(text_col), F.lit("")), k, p).alias(f"_m_{k}") for k, p in (BASE | PARTS).items()],
    )
    # what stands before each match gives its place
    gaps = {k: F.when(F.size(f"_m_{k}") > 0, F.transform(F.split("_text", p, -1), F.length)) for k, p in (BASE | PARTS).items()}
    kept = cut(
        found.select(
            "_row", "_own",
            *[
                F.when(F.size(f"_m_{k}") > 0, F.zip_with(f"_m_{k}", F.slice(gaps[k], 1, F.size(f"_m_{k}")), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))).alias(k)
                for k in KINDS
            ],
        )
    )
    rows = None
    for rank, kind in enumerate(KINDS):
        own = kept.where(F.col(kind).isNotNull()).select("_row", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.posexplode(kind).alias("at", "found"))
        rows = own if rows is None else rows.unionByName(own)
    before = Window.partitionBy("_row", "rank").orderBy("at")
    end = F.sum(F.col("found.gap") + F.length("found.match")).over(before)
    spans = cut(
        rows.withColumn("end", end.cast("long"))
        .withColumn("start", F.col("end") - F.length("found.match"))
        .where(_accepted(F.col("kind"), F.col("found.match")))
        .select("_row", "start", "rank", "kind", "end", (F.col("rank") < len(BASE)).alias("base"))
    )
    parts = spans.select("_row", "start", "rank", "kind", "end")
    secrets = parts.where(F.col("kind").isin(SECRETS)).withColumn("bucket", _buckets(F.col("start") - reach, F.col("end") + reach, reach))
    partners = parts.where(F.col("kind").isin(PARTNERS)).withColumn("bucket", _buckets(F.col("start"), F.col("end"), reach))
    linked = secrets.alias("s").join(
        partners.alias("p"),
        [
            F.col("s._row") == F.col("p._row"),
            F.col("s.bucket") == F.col("p.bucket"),
            F.col("p.start") <= F.col("s.end") + reach,
            F.col("p.end") >= F.col("s.start") - reach,
            # a key that is part of an address or an identifier doesn't complete it
            (F.col("p.end") <= F.col("s.start")) | (F.col("p.start") >= F.col("s.end")),
        ],
    )
    weak = (
        linked.select(F.col("s._row").alias("_row"), F.explode(F.array(F.struct("s.start", "s.rank", "s.kind", "s.end"), F.struct("p.start", "p.rank", "p.kind", "p.end"))).alias("x"))
        .select("_row", "x.*")
        .where(F.col("rank") >= len(BASE))
        .distinct()
        .withColumn("base", F.lit(False))
    )
    reported = (
        spans.where("base").unionByName(weak)
        .groupBy(F.col("_row").alias("_of"))
        .agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "base"))).alias("_spans"))
    )
    return kept.join(reported, F.col("_row") == F.col("_of"), "left").select(
        *[F.col("_own").getField(c).alias(c) for c in others],
        F.coalesce("_spans", F.expr("cast(array() as array<struct<start: bigint, rank: int, kind: string, end: bigint, base: boolean>>)")).alias("_spans"),
    )


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
