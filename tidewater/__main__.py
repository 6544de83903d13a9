"""``python -m tidewater``: back up, restore, compare, list and query the tables of a Parquet folder, and migrate the catalog's.

Migration commands take ``--migrations module``: an importable module whose ``MIGRATIONS`` is a
list of ``Migration`` and whose ``RELEASES``, if it has any, names versions.
"""

from __future__ import annotations

import argparse
import glob
import importlib
import os

from tidewater.plans.generate import record_source
from tidewater.plans.migrate import Migrations
from tidewater.sources.backup import backup, compare_backups, examples, restore
from tidewater.sources.engine import Engine, session
from tidewater.sources.introspect import read_schema, table_filter

COMMANDS = {
    "backup": ["folder"], "restore": ["folder"], "diff": ["left", "right"], "examples": ["left", "right", "table"], "tables": [], "records": [], "exec": ["sql"],
    "list-pending": [], "status": [], "preview": [], "migrate": [], "apply": ["version"], "rollback": ["version"], "rollback-to": ["version"], "mark": ["version"],
    "verify": [], "rewrite-checksums": [], "hard-reset": [],
}
UP_TO = ("preview", "migrate", "list-pending")


def _until(text: str | None) -> str | int | None:
    return int(text) if text and text.isdigit() else text


def migrate(migrations: Migrations, command: str, version: int | None, until: str | int | None) -> None:
    if command == "list-pending":
        for m in migrations.pending(until):
            print(m.version, m.title)
    elif command == "status":
        for s in migrations.status():
            state = "pending" if s.applied_at is None else "applied " + s.applied_at.isoformat(" ", "seconds")
            print(s.version, s.title, state + {True: "", False: ", checksum differs", None: "" if s.applied_at is None else ", unknown"}[s.matches], sep="\t")
    elif command == "preview":
        print(*migrations.preview(until), sep=";\n")
    elif command == "migrate":
        migrations.apply(until, visit=lambda m: print("applied", m.version, m.title))
    elif command == "apply":
        migrations.apply_one(version)
        print("applied", version)
    elif command == "rollback":
        migrations.revert(version)
        print("reverted", version)
    elif command == "rollback-to":
        for v in migrations.revert_to(version):
            print("reverted", v)
    elif command == "mark":
        migrations.mark_applied(version)
    elif command == "verify":
        if changed := migrations.verify():
            raise SystemExit("checksums differ: " + ", ".join(map(str, changed)))
    elif command == "rewrite-checksums":
        print(*migrations.rewrite_checksums(), sep="\n")
    else:
        migrations.hard_reset()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidewater", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--tables", help="folder of <name>.parquet tables")
    parser.add_argument("--filter", default="", help="comma-separated globs of tables")
    parser.add_argument("--migrations", help="module of migrations")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, more in COMMANDS.items():
        sub = commands.add_parser(name)
        for x in more:
            sub.add_argument(x, type=int if x == "version" else str)
        if name in UP_TO:
            sub.add_argument("--until", help="a version or the name of a release")
    given = parser.parse_args(args)
    engine = Engine(session(), given.tables)
    if given.tables:
        engine.view(*[os.path.basename(p)[:-8] for p in sorted(glob.glob(f"{given.tables}/*.parquet"))])
    accepts = table_filter(given.filter)
    if given.command == "backup":
        for name, kept in backup(engine, given.folder, globs=given.filter)["tables"].items():
            print(name, kept["rows"], kept["digest"])
    elif given.command == "restore":
        print(*restore(engine, given.folder, given.filter, as_tables=True), sep="\n")
    elif given.command == "diff":
        compare_backups(engine, given.left, given.right).show(truncate=False)
    elif given.command == "examples":
        examples(*[engine.spark.read.parquet(f"{folder}/{given.table}") for folder in (given.left, given.right)]).show(truncate=False)
    elif given.command == "exec":
        engine.sql(given.sql).show(truncate=False)
    elif given.command == "records":
        print(record_source(read_schema(engine, accepts)))
    elif given.command == "tables":
        for t in read_schema(engine, accepts):
            print(t.name, *[f"{c.name} {c.type.ddl()}" for c in t.columns], sep="\n  ")
    else:
        if not given.migrations:
            parser.error(f"{given.command} needs --migrations")
        module = importlib.import_module(given.migrations)
        migrations = Migrations(engine, releases=dict(getattr(module, "RELEASES", {}))).register(*module.MIGRATIONS)
        migrate(migrations, given.command, getattr(given, "version", None), _until(getattr(given, "until", None)))


if __name__ == "__main__":
    main()
