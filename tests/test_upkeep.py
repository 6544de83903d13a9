"""Types, backups, schemas, migrations, background work and scalar functions."""

import datetime as dt
import decimal
import uuid

import pytest
from pyspark.sql import functions as F

from tidewater import Engine
from tidewater.functions import scalar, types
from tidewater.plans import ddl
from tidewater.plans.generate import record_source
from tidewater.plans.migrate import Migration, Migrations, fold
from tidewater.sources.backup import backup, compare, compare_backups, examples, restore
from tidewater.sources.introspect import ForeignKey, Index, foreign_keys_from, foreign_keys_to, in_key_order, read_schema, read_table, table_filter
from tidewater.streaming.futures import Background, logged

ALL = ddl.CreateTable("every_type").primary_key("id", types.Bigint, auto=True)
for _name, _type in {
    "tiny": types.Tinyint, "small": types.Smallint, "number": types.Integer, "real4": types.Real(24), "real8": types.Real(), "flag": types.Bool,
    "letters": types.Char(4), "wide": types.NChar(4), "short": types.Varchar(10), "wider": types.NVarchar(10), "long": types.Text(), "guid": types.Guid,
    "day": types.Date, "moment": types.DateTime, "stamp": types.Timestamp, "price": types.Decimal(10, 2), "raw": types.Binary(4), "bytes": types.VarBinary(9),
}.items():
    ALL = ALL.column(_name, _type)


def test_every_type_round_trips(spark):
    spark.sql("DROP TABLE IF EXISTS every_type")
    e = Engine(spark)
    ALL.apply(e)
    row = {
        "id": 1, "tiny": 1, "small": 2, "number": 3, "real4": 0.5, "real8": 0.1, "flag": True, "letters": "ab  ", "wide": "cd  ", "short": "é'\"", "wider": "日本", "long": "x" * 10000,
        "guid": uuid.UUID(int=5), "day": dt.date(2024, 2, 29), "moment": dt.datetime(2024, 1, 1, 12, 0, 0, 123456), "stamp": dt.datetime(1999, 12, 31), "price": decimal.Decimal("12.34"),
        "raw": b"\x00\xff", "bytes": b"",
    }
    e.append_rows("every_type", [row, {"id": 2}])
    back = e.frame("every_type").orderBy("id").collect()
    assert back[0].asDict() == row | {"guid": str(row["guid"])} and all(v is None for k, v in back[1].asDict().items() if k != "id")
    info = read_table(e, "every_type")
    assert {c.name: c.type for c in info.columns}["price"] == types.Decimal(10, 2) and info.primary_key == ("id",)
    assert [c.type for c in ddl.plan_of_table(info).columns] == [c.type for c in ALL.columns]
    assert e.table("every_type").field("id").where("moment", row["moment"]).where("guid", row["guid"]).all().count() == 1


def test_literals_as_text(spark):
    values = [None, True, 5, 2**70, 1.5, decimal.Decimal("1.20"), "a'\\\"\n", b"\x01", dt.date(2020, 1, 2), dt.datetime(2020, 1, 2, 3, 4, 5), dt.time(1, 2, 3), uuid.UUID(int=1)]
    for v in values:
        back = spark.sql(f"SELECT {types.sql_text(v)} AS v").first()["v"]
        assert (bytes(back) if isinstance(v, bytes) else back) == (str(v) if isinstance(v, uuid.UUID) else v)
    with pytest.raises(TypeError):
        types.sql_text(object())


def test_backup_restore_and_comparison(engine, tmp_path):
    engine.constraints["people"] = {"foreign_keys": [ForeignKey("people", ("dept",), "depts", ("id",))]}
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    kept = backup(engine, a, ["people", "depts", "nothing"])
    assert {n: t["rows"] for n, t in kept["tables"].items()} == {"people": 5, "depts": 3, "nothing": 0}
    fresh = Engine(engine.spark)
    assert restore(fresh, a) == ["depts", "nothing", "people"]
    assert compare(fresh.frame("people"), engine.frame("people")).isEmpty() and foreign_keys_to(fresh, "depts") == foreign_keys_from(fresh, "people")
    fresh.register("people", fresh.frame("people").where("id > 1").unionByName(fresh.frame("people").where("id = 2")))
    backup(fresh, b, ["people", "depts"])
    found = {r["name"]: (r["state"], r["only_left"], r["only_right"]) for r in compare_backups(engine, a, b).collect()}
    assert found == {"people": ("different", 1, 1), "depts": ("same", 0, 0), "nothing": ("only left", 0, 0)}
    assert compare(engine.frame("people"), fresh.frame("people").drop("name"), ["name"]).count() == 2
    engine.frame("people").limit(1).write.mode("append").parquet(f"{a}/people")
    with pytest.raises(ValueError, match="people"):
        restore(Engine(engine.spark), a, "people")


def test_filters_of_tables():
    accepts = table_filter("sales.ord*, log?")
    assert [accepts(n) for n in ("sales.orders", "orders", "logs", "log", "x.logs")] == [True, False, True, False, True]
    assert table_filter("")("anything")


def test_schema_order_and_generated_records(engine):
    engine.constraints["people"] = {"primary_key": ("id",), "foreign_keys": [ForeignKey("people", ("dept",), "depts", ("id",)), ForeignKey("people", ("boss",), "people", ("id",))]}
    engine.constraints["depts"] = {"primary_key": ("id",), "required": ("name",)}
    seen = []
    tables = read_schema(engine, lambda n: n in ("people", "depts"), lambda t: seen.append(t.name))
    assert seen == ["depts", "people"] and [t.name for t in in_key_order(tables[::-1])] == ["depts", "people"]
    text = record_source(tables)
    made: dict = {}
    exec(text, made)  # noqa: S102
    assert made["People"].belongs(made["Depts"]).columns == ("dept",) and made["Depts"].relations["people_by_dept"].of == "People"


def test_migrations(spark):
    e = Engine(spark)
    for t in ("schema_migrations", "city", "town", "log"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    m = Migrations(e)
    first = Migration(1, "cities", (ddl.CreateTable("city").primary_key("id", types.Bigint).required("name", types.Varchar(20)), ddl.InsertRow("city", {"id": 1, "name": "Ur"})), (ddl.DropTable("city"),))
    second = Migration(3, "size", (ddl.AddColumn("city", ddl.Column("size", types.Integer, default=5)), ddl.UpdateRows("city", {}, expressions={"size": "size + 1"})), (ddl.DropColumn("city", "size"),), (1,))
    third = Migration(2, "log", (ddl.CreateTable("log").timestamps(), ddl.CreateIndex(Index("i", "log", ("created_at",)))), None, (3,))
    m.register(first, second, third).release("one", 1)
    assert [x.version for x in m.ordered()] == [1, 3, 2] and len(m.preview("one")) == 2
    assert m.apply("one") == [1] and m.apply() == [3, 2] and m.pending() == []
    assert e.frame("city").first().asDict() == {"id": 1, "name": "Ur", "size": 6}
    assert [s.matches for s in m.status()] == [True] * 3 and m.verify() == []
    with pytest.raises(ValueError):
        m.revert(2)
    with pytest.raises(ValueError, match="depends"):
        m.revert(1) if 3 in m._history() else None
    m.known[3] = Migration(3, "size", (*second.up, ddl.RawSql("SELECT 1")), second.down, (1,))
    assert m.verify() == [3] and m.rewrite_checksums() == [3] and m.verify() == []
    ddl.RenameColumn("city", "name", "title").apply(e)
    ddl.AlterColumn("city", "size", types.Bigint).apply(e)
    ddl.RenameTable("city", "town").apply(e)
    ddl.DeleteRows("town", ddl.Where().where("id", 9)).apply(e)
    assert e.frame("town").first().asDict() == {"id": 1, "title": "Ur", "size": 6} and dict(e.frame("town").dtypes)["size"] == "bigint"
    for bad in ([Migration(1, "x", ())], [Migration(9, "x", (), depends=(8,))]):
        with pytest.raises(ValueError):
            Migrations(e).register(first, *bad).ordered()
    with pytest.raises(ValueError, match="circle"):
        Migrations(e).register(Migration(1, "a", (), depends=(2,)), Migration(2, "b", (), depends=(1,))).ordered()


def test_folding():
    steps = [
        Migration(1, "a", (ddl.CreateTable("t").primary_key("id", types.Bigint).column("x", types.Integer), ddl.CreateTable("gone"), ddl.InsertRow("gone", {"a": 1}))),
        Migration(2, "b", (ddl.AddColumn("t", ddl.Column("y", types.Text())), ddl.RenameColumn("t", "x", "z"), ddl.AlterColumn("t", "z", types.Bigint, True), ddl.DropTable("gone"))),
        Migration(3, "c", (ddl.DropColumn("t", "y"), ddl.CreateIndex(Index("i", "t", ("z",))), ddl.RenameTable("t", "u"), ddl.InsertRow("u", {"id": 1}))),
    ]
    table, index, row = fold(steps)
    assert table.table == "u" and [(c.name, c.type, c.required) for c in table.columns] == [("id", types.Bigint, False), ("z", types.Bigint, True)]
    assert index.index.table == "u" and row.table == "u"


def test_folding_follows_names_everywhere():
    steps = (
        ddl.CreateTable("a").primary_key("id", types.Bigint).column("x", types.Integer),
        ddl.CreateTable("b").primary_key("id", types.Bigint).foreign_key("a_id", types.Bigint, "a", "id").composite_foreign_key(("a_id", "id"), "a", ("id", "x")),
        ddl.CreateIndex(Index("ix", "a", ("x",))),
        ddl.InsertRow("a", {"id": 1, "x": 2}),
        ddl.RenameColumn("a", "x", "y"),
        ddl.RenameColumn("a", "id", "key"),
        ddl.RenameTable("a", "c"),
        ddl.RenameTable("b", "d"),
    )
    tables = {c.table: c for c in fold([Migration(1, "m", steps)]) if isinstance(c, ddl.CreateTable)}
    index, row = fold([Migration(1, "m", steps)])[-2:]
    assert [c.name for c in tables["c"].columns] == ["key", "y"] and index.index == Index("ix", "c", ("y",)) and row == ddl.InsertRow("c", {"key": 1, "y": 2})
    assert tables["d"].columns[1].references == ("c", "key") and tables["d"].foreign_keys == (ForeignKey("d", ("a_id", "id"), "c", ("key", "y")),)
    dropped = fold([Migration(1, "m", (*steps, ddl.DropColumn("c", "y"), ddl.DropTable("d")))])
    assert [type(c).__name__ for c in dropped] == ["CreateTable", "InsertRow"] and dropped[1].values == {"key": 1}
    assert fold([Migration(1, "m", (*steps, ddl.DropTable("c")))])[0].columns[1].references is None


def test_folding_keeps_changes_after_the_steps_that_read_rows(spark):
    e = Engine(spark)
    for t in ("folded", "renamed"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    steps = (
        ddl.CreateTable("folded").primary_key("id", types.Bigint).column("old", types.Integer),
        ddl.InsertRow("folded", {"id": 1, "old": 2}),
        ddl.AddColumn("folded", ddl.Column("new", types.Integer, default=0)),
        ddl.UpdateRows("folded", {}, expressions={"new": "old + 40"}),
        ddl.DropColumn("folded", "old"),
        ddl.RenameTable("folded", "renamed"),
        ddl.RawSql("SELECT 1"),
    )
    for change in fold([Migration(1, "m", steps)]):
        change.apply(e)
    assert e.frame("renamed").first().asDict() == {"id": 1, "new": 42}
    assert fold([Migration(1, "m", (*steps, ddl.DropTable("renamed")))]) == [ddl.RawSql("SELECT 1")]


def test_keys_outlive_the_engine(spark):
    first = Engine(spark)
    for t in ("owners", "dogs", "hounds"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    ddl.CreateTable("owners").primary_key("id", types.Bigint).required("name", types.NVarchar(9), unique=True).apply(first)
    ddl.CreateTable("dogs").primary_key("id", types.Bigint).foreign_key("owner_id", types.Bigint, "owners", "id").apply(first)
    ddl.CreateIndex(Index("by_owner", "dogs", ("owner_id",))).apply(first)
    second = Engine(spark)
    assert read_table(second, "owners") == read_table(first, "owners") and read_table(second, "owners").columns[1].type == types.NVarchar(9)
    assert foreign_keys_to(second, "owners") == [ForeignKey("dogs", ("owner_id",), "owners", ("id",))]
    ddl.RenameColumn("owners", "id", "key").apply(second)
    ddl.RenameTable("dogs", "hounds").apply(second)
    third = Engine(spark)
    assert foreign_keys_from(third, "hounds") == [ForeignKey("hounds", ("owner_id",), "owners", ("key",))]
    info = read_table(third, "hounds")
    assert info.indexes == (Index("by_owner", "hounds", ("owner_id",)),) and info.primary_key == ("id",) and not read_table(third, "owners").columns[0].nullable
    ddl.DropColumn("owners", "key").apply(third)
    assert foreign_keys_from(Engine(spark), "hounds") == []
    assert [c.references for c in ddl.plan_of_table(info).columns] == [None, ("owners", "key")]


def test_comparison_of_backups_that_differ_in_shape(engine, tmp_path):
    a, b, none = (str(tmp_path / x) for x in ("a", "b", "none"))
    backup(engine, a, ["people", "depts"])
    backup(engine, none, [])
    assert compare_backups(engine, none, none).count() == 0
    other = Engine(engine.spark).register("people", engine.frame("people").drop("boss")).register("depts", engine.frame("depts").where("id < 3"))
    backup(other, b, ["people", "depts"])
    found = {r["name"]: (r["state"], r["only_left"], r["only_right"]) for r in compare_backups(engine, a, b).collect()}
    assert found == {"people": ("different columns", 5, 5), "depts": ("different", 1, 0)}
    rows = examples(engine.frame("depts"), other.frame("depts")).collect()
    assert [(r["side"], r["id"], r["name"]) for r in rows] == [("left", 3, "Void")]


def test_hooks_hear_of_the_engine_s_own_actions(spark):
    spark.sql("DROP TABLE IF EXISTS heard")
    heard = []
    e = Engine(spark).hook(lambda event, name, seconds: heard.append((event, name)))
    e.register("heard", spark.range(2)).append_rows("heard", [{"id": 5}])
    assert heard == [("begin", "replace heard"), ("end", "replace heard"), ("begin", "append heard"), ("end", "append heard")]
    with pytest.raises(ZeroDivisionError), e.told("x"):
        1 / 0  # noqa: B018
    assert heard[-1] == ("error", "x")


def test_command_line_migrations(spark, monkeypatch, capsys):
    import sys
    import types as modules

    from tidewater import __main__ as command

    for t in ("schema_migrations", "streets"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    made = modules.ModuleType("my_migrations")
    made.MIGRATIONS = [
        Migration(1, "streets", (ddl.CreateTable("streets").primary_key("id", types.Bigint),), (ddl.DropTable("streets"),)),
        Migration(2, "names", (ddl.AddColumn("streets", ddl.Column("name", types.Text())),), (ddl.DropColumn("streets", "name"),), (1,)),
    ]
    made.RELEASES = {"first": 1}
    monkeypatch.setitem(sys.modules, "my_migrations", made)

    def said(*args):
        command.main(["--migrations", "my_migrations", *args])
        return capsys.readouterr().out

    assert said("list-pending") == "1 streets\n2 names\n" and "CREATE TABLE" in said("preview", "--until", "first")
    assert said("migrate", "--until", "first") == "applied 1 streets\n" and said("apply", "2") == "applied 2\n"
    assert said("status").count("applied") == 2 and said("rollback", "2") == "reverted 2\n" and spark.table("streets").columns == ["id"]
    said("mark", "2")
    assert said("list-pending") == "" and said("verify") == ""
    with pytest.raises(SystemExit):
        command.main(["migrate"])
    said("hard-reset")
    assert not spark.catalog.tableExists("streets")


def test_background(spark):
    with Background(spark, 2) as b:
        assert [r.result() for r in [b.submit(spark.range(n).count) for n in (3, 4)]] == [3, 4]
        assert len(b.rows(spark.range(5)).result(60)) == 5
        slow = b.submit(spark.range(10**12).selectExpr("sum(id % 7)").collect)
        import time

        time.sleep(2)
        slow.cancel()
        began = time.perf_counter()
        with pytest.raises(Exception, match="cancel"):
            slow.result(60)
        assert time.perf_counter() - began < 30
    with logged("count", spark.range(1)):
        spark.range(1).count()


def test_scalar_functions(spark):
    one = spark.createDataFrame([(dt.datetime(2024, 2, 28, 23, 0, 0, 5), "aé日🙂b", None)], "t timestamp_ntz, s string, n string")
    short = [one.select(scalar.shortened(F.col("s"), n, "bytes")).first()[0] for n in range(12)]
    assert short == ["", "a", "a", "aé", "aé", "aé", "aé日", "aé日", "aé日", "aé日", "aé日🙂", "aé日🙂b"]
    assert one.select(scalar.shortened(F.col("s"), 3)).first()[0] == "aé日" and one.select(scalar.shortened(F.col("n"), 3, "bytes")).first()[0] is None
    assert one.select(scalar.shifted(F.col("t"), days=1, hours=2)).first()[0] == dt.datetime(2024, 3, 1, 1, 0, 0, 5)
    parts = one.select(*[c.alias(k) for k, c in scalar.date_parts(F.col("t")).items()]).first()
    assert (parts["second"], parts["microsecond"], parts["date"]) == (0, 5, dt.date(2024, 2, 28))
    a, b = (spark.createDataFrame([(x, "y")], "a string, b string").select(scalar.digest("a", "b")).first()[0] for x in (None, ""))
    assert a != b
    assert one.select(scalar.glob_match(F.lit("a.b"), "a.?"), scalar.glob_match(F.lit("axb"), "a.b"), scalar.glob_match(F.lit("a\nb"), "a*")).first() == (True, False, True)
    assert one.select(scalar.now_utc(), scalar.now(), scalar.today(), scalar.new_guid()).first()[0] is not None
