"""Backup, restore and comparison of tables."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.scalar import digest
from tidewater.sources.engine import Engine
from tidewater.sources.introspect import ForeignKey, in_key_order, keep_facts, read_table, table_filter


def checksum(frame: DataFrame) -> dict[str, str | int]:
    """Rows and a digest of their multiset: a sum, so neither order nor partitions matter."""
    pieces = [F.conv(F.substring(digest(*frame.columns), at, 12), 16, 10).cast("decimal(38,0)") for at in (1, 13, 25)]
    row = frame.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(p), F.lit(0)).alias(f"s{k}") for k, p in enumerate(pieces)]).first()
    return {"rows": row["n"], "digest": "-".join(str(row[f"s{k}"]) for k in range(3))}


def backup(engine: Engine, folder: str, tables: Iterable[str] | None = None, globs: str = "") -> dict:
    """Write tables as Parquet, a folder each, and a manifest of their schemas, keys and checksums.

    Partitions write in parallel; the manifest is written last, by Spark, so the folder may lie
    in any store, and a folder without one is no whole backup.
    """
    accepts, manifest = table_filter(globs), {"version": 1, "tables": {}}
    for name in tables if tables is not None else engine.names():
        if not accepts(name):
            continue
        frame = engine.frame(name)
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")
        info = read_table(engine, name)
        manifest["tables"][name] = {
            "schema": frame.schema.jsonValue(),
            "primary_key": list(info.primary_key),
            "required": [c.name for c in info.columns if not c.nullable],
            "foreign_keys": [[list(k.columns), k.to_table, list(k.to_columns)] for k in info.foreign_keys],
        } | checksum(engine.spark.read.schema(frame.schema).parquet(f"{folder}/{name}"))
    text = engine.spark.createDataFrame([(json.dumps(manifest),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{folder}/_manifest")
    return manifest


def read_manifest(engine: Engine, folder: str) -> dict:
    return json.loads(engine.spark.read.text(f"{folder}/_manifest").first()["value"])


def restore(engine: Engine, folder: str, globs: str = "", as_tables: bool = False) -> list[str]:
    """Read a backup's tables into the engine, or into catalog tables, in the order of their keys.

    A table whose rows or digest differ from the manifest is an error.
    """
    manifest, accepts = read_manifest(engine, folder)["tables"], table_filter(globs)
    wanted = [n for n in manifest if accepts(n)]
    for name in wanted:
        kept = manifest[name]
        frame = engine.spark.read.schema(T.StructType.fromJson(kept["schema"])).parquet(f"{folder}/{name}")
        if (found := checksum(frame)) != {k: kept[k] for k in ("rows", "digest")}:
            raise ValueError(f"{name}: the backup holds {found}, its manifest says {kept['rows']} rows, {kept['digest']}")
        keys = [ForeignKey(name, tuple(c), to, tuple(t)) for c, to, t in kept["foreign_keys"]]
        engine.constraints[name] = engine.constraints.get(name, {}) | {"primary_key": tuple(kept["primary_key"]), "required": tuple(kept.get("required", ())), "foreign_keys": keys}
        engine.register(name, frame)
    ordered = [t.name for t in in_key_order([read_table(engine, n) for n in wanted])]
    if as_tables:
        for name in ordered:
            frame = engine._frames.pop(name)
            engine.replace(name, frame)
            keep_facts(engine, name)
    return ordered


def compare(left: DataFrame, right: DataFrame, ignore: Iterable[str] = ()) -> DataFrame:
    """Rows, as digests, that one side holds more often: ``digest``, ``left_rows``, ``right_rows``.

    One pass over both sides: digests are counted before anything is joined.
    """
    if set(left.columns) - set(ignore) != set(right.columns) - set(ignore):
        raise ValueError("the sides have different columns")
    columns = sorted(set(left.columns) - set(ignore))
    side = lambda frame, sign: frame.select(digest(*columns).alias("digest"), F.lit(sign).alias("side"))
    counted = side(left, 0).unionByName(side(right, 1)).groupBy("digest").agg(F.count_if(F.col("side") == 0).alias("left_rows"), F.count_if(F.col("side") == 1).alias("right_rows"))
    return counted.where("left_rows <> right_rows")


def compare_backups(engine: Engine, left: str, right: str, ignore: Iterable[str] = ()) -> DataFrame:
    """For each table of two backups: its state and how many rows only one side holds.

    States are ``same``, ``different``, ``different columns`` (all rows of each side count as only
    its own), ``only left`` and ``only right``.  Two empty backups give no rows.
    """
    a, b = (read_manifest(engine, x)["tables"] for x in (left, right))
    out = engine.spark.createDataFrame([], "name string, state string, only_left long, only_right long")
    for name in sorted({*a, *b}):
        columns = [{f["name"] for f in side[name]["schema"]["fields"]} - set(ignore) if name in side else None for side in (a, b)]
        if columns[0] == columns[1]:
            found = compare(*[_backed_up(engine, folder, side, name) for folder, side in ((left, a), (right, b))], ignore)
            more = lambda x, y: F.coalesce(F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0))), F.lit(0))
            found = found.agg(more("left_rows", "right_rows").alias("only_left"), more("right_rows", "left_rows").alias("only_right"))
            state = F.when((F.col("only_left") == 0) & (F.col("only_right") == 0), "same").otherwise("different")
            part = found.select(F.lit(name).alias("name"), state.alias("state"), "only_left", "only_right")
        else:
            state = "different columns" if None not in columns else "only left" if name in a else "only right"
            rows = [side[name]["rows"] if name in side else 0 for side in (a, b)]
            part = engine.spark.createDataFrame([(name, state, *rows)], out.schema)
        out = out.unionByName(part)
    return out


def _backed_up(engine: Engine, folder: str, manifest: dict, name: str) -> DataFrame:
    return engine.spark.read.schema(T.StructType.fromJson(manifest[name]["schema"])).parquet(f"{folder}/{name}")


def examples(left: DataFrame, right: DataFrame, ignore: Iterable[str] = (), most: int = 10) -> DataFrame:
    """Rows that one side holds more often, ``most`` digests of each side at most: ``side``, ``digest`` and the columns."""
    found = compare(left, right, ignore)
    columns = sorted(set(left.columns) - set(ignore))
    out = None
    for name, frame, more in (("left", left, "left_rows > right_rows"), ("right", right, "right_rows > left_rows")):
        few = found.where(more).orderBy("digest").select("digest").limit(most)
        own = frame.select(digest(*columns).alias("digest"), *columns).join(F.broadcast(few), "digest", "left_semi")  # ``most`` rows
        own = own.dropDuplicates(["digest"]).select(F.lit(name).alias("side"), "digest", *columns)
        out = own if out is None else out.unionByName(own)
    return out
