"""Rules of the builder: precedence, nulls, groups, misuse."""

import decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.functions.aggregates import count, total
from tidewater.operators.changes import delete, update
from tidewater.operators.predicate import Ref, Where
from tidewater.operators.query import Expr
from tidewater.operators.raw import parameters_in, run_sql, scalar, shaped


def ids(query):
    return sorted(r["id"] for r in query.field("id").all().collect())


def test_and_binds_tighter_than_or(engine):
    q = engine.table("people").where("dept", 2).where("salary", 70).or_where("dept", 1).where("salary", ">", 55)
    assert ids(q) == [2, 5]


def test_raw_text_joins_as_text(engine):
    assert ids(engine.table("people").where("dept", 1).where_raw("salary = 50 OR id = 5").where("salary", ">", 0)) == [1, 5]
    assert ids(engine.table("people").where_raw("salary = 50").or_where("name", "O'Neil \"x\" \\")) == [1, 4]


def test_empty_in_matches_nothing_and_composes(engine):
    assert ids(engine.table("people").where_in("id", [])) == []
    assert ids(engine.table("people").where("id", 1).or_().where_in("id", [])) == [1]
    assert ids(engine.table("people").not_().where_in("id", []).where("dept", 1)) == [1, 2]


def test_empty_group_is_no_condition(engine):
    assert ids(engine.table("people").where("dept", 1).where(lambda w: w).where("salary", 60)) == [2]


def test_nested_groups_and_not(engine):
    q = engine.table("people").not_().where(lambda w: w.where("dept", 1).or_where(lambda v: v.where("dept", 2).where("salary", 70)))
    assert ids(q) == []  # of null departments and salaries it isn't known
    assert ids(engine.table("people").not_().not_().where("dept", 1)) == [1, 2]


def test_nulls(engine):
    t = engine.table("people")
    assert ids(t.where("dept", None)) == [4] and ids(t.not_().where("dept", None)) == [1, 2, 3, 5]
    assert ids(t.where("dept", "=", None)) == [] and ids(t.where("dept", "IS", None)) == [4]
    assert ids(t.where_null("salary")) == [3] and ids(t.where_not_null("salary")) == [1, 2, 4, 5]
    assert ids(t.where_not_equal("dept", 1)) == [3, 5] and ids(t.where_not_equal("dept", None)) == [1, 2, 3, 5]


def test_optional_conditions(engine):
    t = engine.table("people")
    assert ids(t.if_(None).then_where("dept")) == [1, 2, 3, 4, 5] and ids(t.if_(60).then_where("salary", ">=")) == [2, 4, 5]


def test_subqueries(engine):
    t = engine.table("people")
    labs = engine.table("depts").field("id").where("name", "Lab")
    assert ids(t.where("dept", labs)) == [3, 5] and ids(t.where_in("dept", labs)) == [3, 5]
    assert ids(t.not_().where_in("id", t.field("boss"))) == []  # a null among the values: not known
    assert ids(t.not_().where_in("id", t.field("boss").where_not_null("boss"))) == [3, 4, 5]
    with pytest.raises(ValueError):
        t.where_raw("1 = 1").where_in("dept", labs).field("id").all()


@pytest.mark.parametrize("values", ["(1), (2)", "(1), (2), (2), (NULL)", ""])
def test_membership_in_a_query_keeps_the_rule_for_nulls(engine, values):
    """Held against SQL, alone, in OR, under negated groups, and as the condition of a change."""
    few = engine.spark.sql(f"SELECT CAST(boss AS int) AS boss FROM VALUES {values or '(0)'} AS t(boss) WHERE {bool(values)}")
    duck = duckdb.connect()
    duck.execute(f"CREATE TABLE few AS SELECT boss::int AS boss FROM (VALUES {values or '(0)'}) t(boss) WHERE {bool(values)}")
    duck.execute("CREATE TABLE people AS SELECT * FROM (VALUES (1, 50, NULL), (2, 60, 1), (3, NULL, 1), (4, 60, 2), (5, 70, 9)) t(id, salary, boss)")
    chains = {
        "NOT boss IN (FROM few)": lambda w: w.not_().where_in("boss", few),
        "salary = 60 OR NOT boss IN (FROM few)": lambda w: w.where("salary", 60).or_().not_().where_in("boss", few),
        "NOT (boss IN (FROM few) AND salary = 60)": lambda w: w.not_().where(lambda v: v.where_in("boss", few).where("salary", 60)),
        "NOT (NOT boss IN (FROM few) AND salary = 60)": lambda w: w.not_().where(lambda v: v.not_().where_in("boss", few).where("salary", 60)),
    }
    for text, chain in chains.items():
        want = [r[0] for r in duck.execute(f"SELECT id FROM people WHERE {text} ORDER BY id").fetchall()]
        assert ids(chain(engine.table("people"))) == want, text
    changed = update(delete(engine.frame("people"), chains["NOT boss IN (FROM few)"]), {"name": "hit"}, lambda w: w.where_in("boss", few))
    assert {r["id"]: r["name"] == "hit" for r in changed.collect()} == dict(duck.execute("SELECT id, coalesce(boss IN (FROM few), false) FROM people WHERE NOT coalesce(NOT boss IN (FROM few), false)").fetchall())


def test_membership_in_a_query_of_the_same_table(engine):
    """Columns of the outer table aren't taken from what the inner query was made of."""
    t = engine.table("people", "p")
    bosses = t.field("p.boss").where_not_null("p.boss")
    assert ids(t.not_().where_in("p.id", bosses)) == [3, 4, 5] and ids(t.where_in("p.id", bosses)) == [1, 2]
    engine.register("odd", engine.frame("people").select("id", F.col("boss").alias("id_")))
    assert ids(engine.table("odd").not_().where_in("id_", engine.table("odd").field("id").where("id", ">", 1))) == [2, 3, 5]


def test_not_in_a_query_sends_no_values_to_the_driver(engine):
    """a null-aware anti join broadcasts all values, whatever the limit for broadcasts."""
    spark, t = engine.spark, engine.table("people")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        negated = t.not_().where_in("id", t.field("boss"))
        for q in (negated, t.where("dept", 2).or_().not_().where_in("id", t.field("boss"))):
            assert "Broadcast" not in q.field("id").all()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_several_rows_of_a_scalar_subquery_are_an_error(engine):
    with pytest.raises(Exception, match="(?i)more than one row|SCALAR_SUBQUERY"):
        engine.table("people").field("id").where("dept", engine.table("depts").field("id")).all().collect()


def test_unknown_comparisons_are_refused(engine):
    with pytest.raises(ValueError):
        engine.table("people").where("id", "= 1 OR 1 =", 1)


def test_values_never_become_text(engine):
    assert ids(engine.table("people").where("name", "' OR '1'='1")) == []
    assert Where().where("a", "it's \\").text() == "`a` = 'it\\'s \\\\'"
    assert ids(engine.table("people").where("salary", decimal.Decimal("60"))) == [2, 4]


def test_joins(engine):
    people = engine.table("people", "p")
    left = people.left_join(("depts", "d"), "id", "p.dept").field_as("p.id", "id").field_as("d.name", "dept").all().collect()
    assert sorted((r["id"], r["dept"]) for r in left) == [(1, "Ops"), (2, "Ops"), (3, "Lab"), (4, None), (5, "Lab")]
    full = people.full_join(("depts", "d"), lambda j: j.on("d.id", "p.dept")).field_as("d.name", "dept").all()
    assert full.count() == 6
    boss = people.inner_join(("people", "b"), "id", "p.boss").field_as("p.name", "name").field_as("b.name", "boss").all()
    assert sorted((r["name"], r["boss"]) for r in boss.collect())[0] == ("Bob", "Ann")
    assert people.inner_join("depts", lambda j: j).field("p.id").all().count() == 5
    either = people.inner_join(("depts", "d"), lambda j: j.on("d.id", "p.dept").or_on("d.id", "p.boss")).field_as("p.id", "id").all()
    assert either.count() == 6


def test_join_with_an_empty_table(engine):
    assert engine.table("people").inner_join("nothing", "id", "dept").field("people.id").all().count() == 0
    assert engine.table("people").left_join("nothing", "id", "dept").field("people.id").all().count() == 5


def test_projection_misuse(engine):
    t = engine.table("people")
    for bad in (lambda: t.as_("x"), lambda: t.field("*").as_("x"), lambda: t.field("id").as_("a").as_("b"), lambda: t.all(), lambda: t.field("id").range(1, 1)):
        with pytest.raises(ValueError):
            bad()


def test_grouping(engine):
    t = engine.table("people")
    rows = t.field("dept").field(count()).as_("n").field(total("salary")).as_("pay").group_by("dept").order_by("n", "desc").order_by("dept").all().collect()
    assert [tuple(r) for r in rows] == [(1, 2, 110), (2, 2, 70), (None, 1, 60)]
    with pytest.raises(ValueError):
        t.field("name").field(count()).group_by("dept").all()
    with pytest.raises(ValueError):
        t.group_by("dept").count_rows()
    assert sorted(r["count"] for r in t.group_by("dept").count().collect()) == [1, 2, 2]
    assert sorted(r["count"] for r in t.distinct().group_by("dept").count().collect()) == [1, 2]
    assert t.count_rows() == 5 and engine.table("nothing").count_rows() == 0
    assert t.field(Expr("count(DISTINCT dept)", aggregate=True)).as_("n").all().first()["n"] == 2
    assert t.field(count("people.*")).as_("n").all().first()["n"] == 5


def test_order_and_pages(engine):
    t = engine.table("people").field("id")
    assert [r["id"] for r in t.order_by("salary").order_by("id").all().collect()] == [3, 1, 2, 4, 5]
    assert [r["id"] for r in t.order_by("salary", "desc").order_by("id", "desc").all().collect()] == [5, 4, 2, 1, 3]
    assert [r["id"] for r in t.order_by("salary", nulls="last").order_by("id").range(3, 10).collect()] == [5, 3]
    assert [r["id"] for r in t.order_by("id").first(2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        t.distinct().order_by("name").all()


def test_a_query_can_be_used_twice(engine):
    base = engine.table("people").where("dept", 1)
    assert ids(base.where("salary", 50)) == [1] and ids(base) == [1, 2] and base.exists() and not base.where("id", 9).exists()


def test_tuples(engine):
    row = engine.table("people").inner_join("depts", "id", "dept").order_by("people.id").tuples("people", "depts").first()
    assert row["people"]["name"] == "Ann" and row["depts"]["name"] == "Ops"


def test_theta(engine):
    q = engine.table("people", "a").inner_join(("people", "b"), "dept", "a.dept").where("a.id", "<", Ref("b.id"))
    assert [tuple(r) for r in q.field_as("a.id", "x").field_as("b.id", "y").all().orderBy("x").collect()] == [(1, 2), (3, 5)]


def test_raw_sql(engine):
    spark = engine.spark
    assert parameters_in("SELECT '?', \"?\", `?` -- ?\n, ? /* ? */ + ?") == 2
    for args in ((1,), (1, 2, 3)):
        with pytest.raises(ValueError):
            run_sql(spark, "SELECT ? + ?", *args)
    assert scalar(spark, "SELECT ? + ?", 1, 2) == 3 and scalar(spark, "SELECT 1 WHERE 1 = 0") is None
    assert shaped(run_sql(spark, "SELECT 1, 2"), "a", "b").columns == ["a", "b"]
    assert engine.sql("SELECT count(*) AS n FROM people WHERE salary > ?", 55).first()["n"] == 3
