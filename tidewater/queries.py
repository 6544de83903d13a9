"""A query for each operator, over whole tables, with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import scalar, types
from tidewater.functions.aggregates import average, count, greatest, least, total
from tidewater.operators import changes
from tidewater.operators.predicate import Ref
from tidewater.operators.query import Expr
from tidewater.operators.raw import shaped
from tidewater.operators.records import AUTO_KEY, KEY, BelongsTo, Field, HasMany, Mapper, Record, Through
from tidewater.plans import ddl
from tidewater.plans.migrate import Migration, fold
from tidewater.sources.backup import backup, compare, restore
from tidewater.sources.engine import Engine, row_blocks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Callable[[Engine], DataFrame]], Callable[[Engine], DataFrame]]:
    """Register a function of an engine under its name, with the SQL to hold it against."""

    def add(f: Callable[[Engine], DataFrame]) -> Callable[[Engine], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Engine(spark, sf_dir))
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _with_nulls(e: Engine) -> Engine:
    """Customers whose segment or nation is unknown: the tables themselves hold no nulls."""
    c = e.frame("customer")
    return e.register(
        "client",
        c.select("c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.nullif("c_nationkey", F.lit(3)).alias("nation"), "c_acctbal"),
    )


CLIENT = "(SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS segment, nullif(c_nationkey, 3) AS nation, c_acctbal FROM customer)"


# -- records of the star schema ---------------------------------------------------------------


class Nation(Record, table="nation"):
    n_nationkey = Field(types.Integer, key=KEY)
    n_name = Field(types.Varchar(25))
    n_regionkey = Field(types.Integer)
    customers = HasMany("Customer", "c_nationkey")


class Customer(Record, table="customer"):
    c_custkey = Field(types.Bigint, key=AUTO_KEY)
    c_name = Field(types.Varchar(25))
    c_nationkey = Field(types.Integer)
    c_acctbal = Field(types.Real(53))
    c_mktsegment = Field(types.Varchar(10))
    nation = BelongsTo("Nation", ("c_nationkey",))
    orders = HasMany("Order")


class Order(Record, table="orders"):
    o_orderkey = Field(types.Bigint, key=AUTO_KEY)
    o_custkey = Field(types.Bigint)
    o_orderstatus = Field(types.Char(1))
    o_totalprice = Field(types.Real(53))
    customer = BelongsTo("Customer", ("o_custkey",))
    parts = Through("Part", "Line")
    first_supplier = Through("Supplier", "Line", one=True)


class Line(Record, table="lineitem"):
    l_orderkey = Field(types.Bigint, key=KEY)
    l_linenumber = Field(types.Integer, key=KEY)
    l_partkey = Field(types.Bigint)
    l_suppkey = Field(types.Bigint)
    l_quantity = Field(types.Real(53))
    order = BelongsTo("Order", ("l_orderkey",))
    part = BelongsTo("Part", ("l_partkey",))
    supplier = BelongsTo("Supplier", ("l_suppkey",))


class Part(Record, table="part"):
    p_partkey = Field(types.Bigint, key=AUTO_KEY)
    p_name = Field(types.Varchar(55))
    p_size = Field(types.Integer)


class Supplier(Record, table="supplier"):
    s_suppkey = Field(types.Bigint, key=AUTO_KEY)
    s_name = Field(types.Varchar(25))


# -- scans and projections --------------------------------------------------------------------


@query("SELECT r_regionkey, r_name FROM region")
def q_s1_from_table(e):
    return e.table("region").fields("r_regionkey", "r_name").all()


@query("SELECT n.n_name AS n_name FROM nation AS n")
def q_s2_from_table_as(e):
    return e.table("nation", "n").field("n.n_name").all()


@query("SELECT n_name FROM nation")
def q_s3_schema_table(e):
    return e.schema_table("", "nation").field("n_name").all()


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_s5_record_scan(e):
    return Mapper(e).query(Customer).all()


@query("SELECT c_name FROM customer")
def q_p1_field(e):
    return e.table("customer").field("c_name").all()


@query("SELECT * FROM supplier")
def q_p2_star(e):
    return e.table("supplier").field("*").all()


@query("SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def q_p3_qualified_star(e):
    return e.table("nation", "n").inner_join(("region", "r"), "r_regionkey", "n.n_regionkey").field("n.*").field("r.r_name").all()


@query("SELECT p_partkey, p_retailprice * 2 AS doubled FROM part")
def q_p4_expression(e):
    return e.table("part").field("p_partkey").field(Expr("p_retailprice * 2")).as_("doubled").all()


@query("SELECT s_name AS supplier_name FROM supplier")
def q_p5_alias(e):
    return e.table("supplier").field("s_name").as_("supplier_name").all()


@query("SELECT p_partkey, p_brand, p_size FROM part")
def q_p7_field_list(e):
    return e.table("part").fields(["p_partkey", "p_brand"]).fields(["p_size"], of="part").all()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_p9_fields_of_record(e):
    return e.table("nation").fields_of(Nation).all()


@query("SELECT p_partkey AS id, p_name AS title FROM part")
def q_p10_field_as(e):
    return e.table("part").field_as("p_partkey", "id").field_as("p_name", "title").all()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def q_p11_build(e):
    return e.table("orders").build(lambda q: q.field("o_orderkey").where("o_orderstatus", "P")).all()


@query("SELECT DISTINCT c_mktsegment FROM customer")
def q_p13_distinct(e):
    return e.table("customer").field("c_mktsegment").distinct().all()


@query("SELECT c_custkey, c_acctbal FROM customer")
def q_p14_members(e):
    return Mapper(e).query(Customer, "c_custkey", "c_acctbal").all()


@query("SELECT r_regionkey AS id, r_name AS label FROM region")
def q_p16_shaped(e):
    return shaped(e.table("region").fields("r_regionkey", "r_name").all(), "id", "label")


# -- conditions -------------------------------------------------------------------------------


@query(f"SELECT c_custkey FROM {CLIENT} WHERE segment IS NULL")
def q_f1_where_null_value(e):
    return _with_nulls(e).table("client").field("c_custkey").where("segment", None).all()


@query(f"SELECT c_custkey FROM {CLIENT} WHERE segment IS NOT NULL AND nation IS NULL")
def q_f1_not_null_value(e):
    return _with_nulls(e).table("client").field("c_custkey").not_().where("segment", None).where("nation", None).all()


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_orderpriority LIKE '1%'")
def q_f2_operators(e):
    return e.table("orders").field("o_orderkey").where("o_totalprice", ">=", 100000).where("o_orderpriority", "LIKE", "1%").all()


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_discount > l_tax")
def q_f4_column_compare(e):
    return e.table("lineitem").fields("l_orderkey", "l_linenumber", "l_quantity").where("l_discount", ">", Ref("l_tax")).all()


@query(f"SELECT c_custkey FROM {CLIENT} WHERE segment = NULL")
def q_f5_equals_null(e):
    return _with_nulls(e).table("client").field("c_custkey").where("segment", "=", None).all()


@query("SELECT c_custkey FROM customer WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer)")
def q_f6_scalar_subquery(e):
    return e.table("customer").field("c_custkey").where("c_acctbal", e.table("customer").field(greatest("c_acctbal"))).all()


@query("SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)")
def q_f7_where_in(e):
    return e.table("nation").field("n_name").where_in("n_regionkey", [1, 3]).all()


@query("SELECT n_name FROM nation WHERE 1 = 0 OR n_nationkey = 5")
def q_f7_where_in_empty(e):
    return e.table("nation").field("n_name").where_in("n_regionkey", []).or_where("n_nationkey", 5).all()


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def q_f8_in_subquery(e):
    machines = e.table("customer").field("c_custkey").where("c_mktsegment", "MACHINERY")
    return e.table("orders").field("o_orderkey").where_in("o_custkey", machines).all()


@query(f"SELECT c_custkey FROM {CLIENT} WHERE nation IS NULL OR segment IS NOT NULL AND c_acctbal < 0")
def q_f9_null_tests(e):
    return _with_nulls(e).table("client").field("c_custkey").where_null("nation").or_().where_not_null("segment").where("c_acctbal", "<", 0).all()


@query(f"SELECT c_custkey FROM {CLIENT} WHERE segment <> 'MACHINERY'")
def q_f10_not_equal(e):
    return _with_nulls(e).table("client").field("c_custkey").where_not_equal("segment", "MACHINERY").all()


@query("SELECT doc_id FROM (SELECT doc_id, toxic = 1 AS bad, quality = 1 AS good FROM labels) WHERE bad = TRUE AND good = FALSE")
def q_f11_true_false(e):
    e.register("flags", e.frame("labels").select("doc_id", (F.col("toxic") == 1).alias("bad"), (F.col("quality") == 1).alias("good")))
    return e.table("flags").field("doc_id").where_true("bad").where_false("good").all()


@query("SELECT p_partkey FROM part WHERE p_size = 1 AND p_brand = 'Brand#11' OR p_size = 2 AND p_retailprice > 1000 AND NOT p_brand = 'Brand#12'")
def q_f12_precedence(e):
    q = e.table("part").field("p_partkey").where("p_size", 1).where("p_brand", "Brand#11").or_where("p_size", 2)
    return q.where("p_retailprice", ">", 1000).not_().where("p_brand", "Brand#12").all()


@query("SELECT p_partkey FROM part WHERE p_retailprice > 1200 AND (p_size = 1 OR p_size = 2)")
def q_f15_group(e):
    return e.table("part").field("p_partkey").where("p_retailprice", ">", 1200).where(lambda w: w.where("p_size", 1).or_where("p_size", 2)).where(lambda w: w).all()


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal > 100")
def q_f16_if_then_where(e):
    q = e.table("supplier").field("s_suppkey")
    return q.if_(100).then_where("s_acctbal", ">").if_(None).then_where("s_nationkey").all()


@query("SELECT p_partkey FROM part WHERE p_size = 7 AND p_retailprice > 1500 OR p_size = 8 AND p_retailprice < 1000")
def q_f17_where_raw(e):
    return e.table("part").field("p_partkey").where("p_size", 7).where_raw("p_retailprice > 1500 OR p_size = 8").where("p_retailprice", "<", 1000).all()


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def q_f18_parameters(e):
    return e.view("orders").sql("SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderstatus = ?", 200000, "F")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey = 7")
def q_f20_single(e):
    return Mapper(e).query(Nation).where("n_nationkey", "=", 7).first()


@query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS found")
def q_f21_exists(e):
    negative = e.table("orders").where("o_totalprice", "<", 0).base().limit(1)
    return negative.agg((F.count(F.lit(1)) > 0).alias("found"))


# -- joins ------------------------------------------------------------------------------------


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey")
def q_j1_inner(e):
    return e.table("orders", "o").inner_join(("customer", "c"), "c_custkey", "o.o_custkey").fields("o.o_orderkey", "c.c_name").all()


@query("SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def q_j2_inner_main(e):
    return e.table("nation").inner_join("region", "r_regionkey", "n_regionkey").fields("n_name", "r_name").all()


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def q_j3_record_members(e):
    return e.table("orders").join_records((Order, "o_custkey"), (Customer, "c_custkey")).fields("o_orderkey", "c_name").all()


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON c_nationkey = s_nationkey AND c_acctbal = s_acctbal")
def q_j4_inner_callable(e):
    on = lambda j: j.on("customer.c_nationkey", "supplier.s_nationkey").on("customer.c_acctbal", "supplier.s_acctbal")
    return e.table("supplier").inner_join("customer", on).fields("s_suppkey", "c_custkey").all()


@query("SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def q_j5_left(e):
    return e.table("orders").left_join("lineitem", "l_orderkey", "o_orderkey").fields("o_orderkey", "l_linenumber").all()


@query("SELECT l_linenumber, o_orderkey FROM lineitem RIGHT JOIN orders ON o_orderkey = l_orderkey")
def q_j6_right(e):
    return e.table("lineitem").right_join("orders", "o_orderkey", "l_orderkey").fields("l_linenumber", "o_orderkey").all()


@query(f"SELECT c_custkey, n_name FROM {CLIENT} AS client FULL JOIN nation ON n_nationkey = nation")
def q_j7_full(e):
    return _with_nulls(e).table("client").full_join("nation", "n_nationkey", "client.nation").fields("c_custkey", "n_name").all()


@query("SELECT a.n_nationkey AS left_key, b.n_nationkey AS right_key FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey OR a.n_regionkey = b.n_nationkey")
def q_j8_or_on(e):
    on = lambda j: j.on("a.n_nationkey", "b.n_regionkey").or_on("a.n_regionkey", "b.n_nationkey")
    return e.table("nation", "a").inner_join(("nation", "b"), on).field_as("a.n_nationkey", "left_key").field_as("b.n_nationkey", "right_key").all()


@query("SELECT a.s_suppkey AS s1, b.s_suppkey AS s2 FROM supplier a JOIN supplier b ON b.s_nationkey = a.s_nationkey WHERE a.s_suppkey < b.s_suppkey")
def q_j9_self(e):
    q = e.table("supplier", "a").inner_join(("supplier", "b"), "s_nationkey", "a.s_nationkey")
    return q.field_as("a.s_suppkey", "s1").field_as("b.s_suppkey", "s2").where("a.s_suppkey", "<", Ref("b.s_suppkey")).all()


@query("SELECT n_name FROM nation")
def q_j10_empty_on(e):
    return e.table("nation").inner_join("region", lambda j: j).field("n_name").all()


@query("SELECT n.n_name AS n_name, r.r_name AS r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def q_j12_tuple(e):
    pairs = e.table("nation").inner_join("region", "r_regionkey", "n_regionkey").tuples("nation", "region")
    return pairs.select("nation.n_name", "region.r_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def q_j13_semi(e):
    return e.table("customer").field("c_custkey").where_in("c_custkey", e.table("orders").field("o_custkey").where("o_orderstatus", "P")).all()


@query(f"""SELECT 'with null' AS kind, p_partkey FROM part WHERE p_partkey NOT IN (SELECT nation FROM {CLIENT})
           UNION ALL SELECT 'without', p_partkey FROM part WHERE p_partkey NOT IN (SELECT nation FROM {CLIENT} WHERE nation IS NOT NULL)""")
def q_j14_not_in_with_null(e):
    """A null on the right leaves no row; without it the others stay."""
    nations = _with_nulls(e).table("client").field("nation")
    tagged = lambda kind, inner: e.table("part").field(F.lit(kind).alias("kind")).field("p_partkey").not_().where_in("p_partkey", inner).all()
    return tagged("with null", nations).unionByName(tagged("without", nations.where_not_null("nation")))


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal OR c_acctbal > 9990")
def q_j8_operator(e):
    on = lambda j: j.on("c.c_nationkey", "s.s_nationkey").operator("c.c_acctbal", "<", Ref("s.s_acctbal")).operator("c.c_acctbal", ">", 9990, "OR")
    return e.table("supplier", "s").inner_join(("customer", "c"), on).fields("s.s_suppkey", "c.c_custkey").all()


@query("SELECT s.s_suppkey AS s_suppkey, c.c_custkey AS c_custkey FROM supplier s LEFT JOIN customer c ON c.c_nationkey = s.s_nationkey AND c.c_acctbal > s.s_acctbal")
def q_j11_aliased_callable(e):
    on = lambda j: j.on("c.c_nationkey", "s.s_nationkey").operator("c.c_acctbal", ">", Ref("s.s_acctbal"))
    return e.table("supplier", "s").left_join(("customer", "c"), on).fields("s.s_suppkey", "c.c_custkey").all()


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q_j14_not_in(e):
    return e.table("orders").field("o_orderkey").not_().where_in("o_orderkey", e.table("lineitem").field("l_orderkey")).all()


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON c_nationkey = s_nationkey WHERE c_acctbal > s_acctbal AND c_acctbal < 0")
def q_j15_theta(e):
    q = e.table("supplier").inner_join("customer", "c_nationkey", "s_nationkey").fields("s_suppkey", "c_custkey")
    return q.where("customer.c_acctbal", ">", Ref("supplier.s_acctbal")).where("customer.c_acctbal", "<", 0).all()


# -- relations --------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def q_r1_belongs_to(e):
    return Mapper(e).parents(Order, "customer").select("owner.o_orderkey", "parent.c_name")


@query("SELECT c_custkey AS owner_key, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey")
def q_r2_has_many(e):
    return Mapper(e).children(Customer, "orders")


@query("SELECT n_nationkey AS owner_key, count(c_custkey) AS count FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 0) ON c_nationkey = n_nationkey GROUP BY 1")
def q_r3_has_many_count(e):
    e.register("customer", e.frame("customer").where("c_acctbal < 0"))
    return Mapper(e).children_counts(Nation, "customers")


@query("SELECT l_orderkey AS owner_key, min(l_suppkey) AS s_suppkey FROM lineitem GROUP BY 1")
def q_r5_has_one_through(e):
    return Mapper(e).through(Order, "first_supplier").select("owner_key", "s_suppkey")


@query("SELECT l_orderkey AS owner_key, p_partkey, p_name, p_size FROM lineitem JOIN part ON p_partkey = l_partkey")
def q_r6_through(e):
    return Mapper(e).through(Order, "parts")


@query("SELECT o_orderkey AS owner_key, count(p_partkey) AS count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1")
def q_r6_through_count(e):
    return Mapper(e).through_counts(Order, "parts")


@query("SELECT a.c_custkey AS c_custkey, b.s_suppkey AS s_suppkey FROM customer a LEFT JOIN (SELECT s_nationkey, s_acctbal, max(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1, 2) b ON a.c_nationkey = b.s_nationkey AND a.c_acctbal = b.s_acctbal")
def q_r7_composite_key(e):
    account = e.table("supplier").fields("s_nationkey", "s_acctbal").field(greatest("s_suppkey")).as_("s_suppkey").group_by("s_nationkey", "s_acctbal").all()
    e.register("account", account)

    class Account(Record, table="account"):
        s_nationkey = Field(types.Integer, key=KEY)
        s_acctbal = Field(types.Real(53), key=KEY)
        s_suppkey = Field(types.Bigint)

    class Holder(Record, table="customer"):
        c_custkey = Field(types.Bigint, key=KEY)
        c_nationkey = Field(types.Integer)
        c_acctbal = Field(types.Real(53))
        account = BelongsTo("Account", ("c_nationkey", "c_acctbal"))

    return Mapper(e).parents(Holder, "account").select("owner.c_custkey", "parent.s_suppkey")


@query("SELECT l_orderkey AS owner_key, p_partkey FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def q_r8_load_relations(e):
    loaded = Mapper(e).load_relations(Order, e.frame("orders").where("o_orderstatus = 'P'"))
    return loaded["parts"].select("owner_key", "p_partkey")


ROUTES = "(SELECT c_custkey AS id, c_nationkey AS origin, cast(c_custkey % 25 AS INTEGER) AS target FROM customer)"


class Place(Record, table="nation"):
    n_nationkey = Field(types.Integer, key=KEY)
    n_name = Field(types.Varchar(25))
    leaving = HasMany("Route", "origin")
    coming = HasMany("Route", "target")
    reachable = Through("Place", "Route", own_fk="origin", other_fk="target")
    reached_from = Through("Place", "Route", own_fk="target", other_fk="origin")


class Route(Record, table="route"):
    id = Field(types.Bigint, key=AUTO_KEY)
    origin = Field(types.Integer)
    target = Field(types.Integer)
    begin = BelongsTo("Place", ("origin",))
    end = BelongsTo("Place", ("target",))


def _routes(e: Engine) -> Mapper:
    key = F.col("c_custkey")
    return Mapper(e.register("route", e.frame("customer").select(key.alias("id"), F.col("c_nationkey").alias("origin"), (key % 25).cast("int").alias("target"))))


@query(f"SELECT n_nationkey AS owner_key, (SELECT count(*) FROM {ROUTES} r WHERE r.origin = n_nationkey) AS leaving, (SELECT count(*) FROM {ROUTES} r WHERE r.target = n_nationkey) AS coming FROM nation")
def q_r10_two_keys_to_one_table(e):
    m = _routes(e)
    counts = [m.children_counts(Place, name).withColumnRenamed("count", name) for name in ("leaving", "coming")]
    return counts[0].join(counts[1], "owner_key")


@query(f"""SELECT 'reachable' AS way, r.origin AS owner_key, n.n_name AS n_name FROM {ROUTES} r JOIN nation n ON n.n_nationkey = r.target
           UNION ALL SELECT 'reached from', r.target, n.n_name FROM {ROUTES} r JOIN nation n ON n.n_nationkey = r.origin""")
def q_r11_self_many_to_many(e):
    m = _routes(e)
    ways = [m.through(Place, name.replace(" ", "_")).select(F.lit(name).alias("way"), "owner_key", "n_name") for name in ("reachable", "reached from")]
    return ways[0].unionByName(ways[1])


# -- aggregates, order, limits ----------------------------------------------------------------


@query("SELECT count(*) AS n FROM customer WHERE c_acctbal < 0")
def q_a9_mapper_count(e):
    return e.spark.createDataFrame([(Mapper(e).query(Customer).where("c_acctbal", "<", 0).count_rows(),)], "n long")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 10")
def q_o5_mapper_range(e):
    return Mapper(e).query(Customer, "c_custkey", "c_name").order_by("c_custkey").range(10, 20)


@query("SELECT * FROM supplier")
def q_o2_all(e):
    return e.table("supplier").field("*").all()


@query(f"SELECT count(*) AS n, count(segment) AS known FROM {CLIENT}")
def q_a1_count(e):
    return _with_nulls(e).table("client").field(count()).as_("n").field(count("segment")).as_("known").all()


@query("SELECT n_regionkey, count(*) AS n FROM nation n GROUP BY n_regionkey")
def q_a2_count_star_of(e):
    return e.table("nation", "n").field("n.n_regionkey").field(count("n.*")).as_("n").group_by("n.n_regionkey").all()


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount,
                 min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest FROM lineitem GROUP BY 1, 2""")
def q_a3_a6_grouped(e):
    q = e.table("lineitem").fields("l_returnflag", "l_linestatus").field(total("l_quantity")).as_("quantity").field(average("l_discount")).as_("discount")
    q = q.field(least("l_extendedprice")).as_("lowest").field(greatest("l_extendedprice")).as_("highest").group_by("l_returnflag").group_by("l_linestatus")
    return q.all().withColumns({"quantity": F.round("quantity", 2), "discount": F.round("discount", 6)})


@query("SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'O'")
def q_a7_count(e):
    return e.table("orders").where("o_orderstatus", "O").count()


@query("SELECT count(*) AS count FROM orders GROUP BY o_orderpriority")
def q_a7_grouped_count(e):
    return e.table("orders").group_by("o_orderpriority").count()


@query("SELECT DISTINCT count(*) AS count FROM supplier GROUP BY s_nationkey")
def q_a8_distinct_count(e):
    return e.table("supplier").distinct().group_by("s_nationkey").count()


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def q_a10_count_distinct(e):
    return e.table("orders").field("o_orderstatus").field(Expr("count(DISTINCT o_custkey)", aggregate=True)).as_("customers").group_by("o_orderstatus").all()


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def q_window_expression(e):
    return e.table("orders").field("o_orderkey").field(Expr("rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")).as_("place").all().withColumn("place", F.col("place").cast("long"))


@query(f"SELECT c_custkey, segment FROM {CLIENT} ORDER BY segment DESC NULLS LAST, c_custkey LIMIT 25")
def q_o1_order_nulls(e):
    return _with_nulls(e).table("client").fields("c_custkey", "segment").order_by("segment", "desc").order_by("c_custkey").first(25)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q_o3_first(e):
    return e.table("orders").fields("o_orderkey", "o_totalprice").order_by("o_totalprice", "desc").order_by("o_orderkey").first(10)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 30 OFFSET 50")
def q_o4_range(e):
    return e.table("part").fields("p_partkey", "p_name").order_by("p_partkey").range(50, 30)


@query("SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 7")
def q_o6_first_members(e):
    return Mapper(e).query(Customer, "c_name").order_by("c_acctbal").order_by("c_custkey").first(7)


@query("""SELECT c.c_custkey AS c_custkey, c.c_name AS c_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
          FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
          WHERE c.c_mktsegment = 'BUILDING' GROUP BY 1, 2 ORDER BY revenue DESC, c_custkey LIMIT 10""")
def q_flagship(e):
    """Revenue per customer of one market segment, top ten."""
    q = e.table("customer", "c").inner_join(("orders", "o"), "o_custkey", "c.c_custkey").inner_join(("lineitem", "l"), "l_orderkey", "o.o_orderkey")
    q = q.where("c.c_mktsegment", "BUILDING").fields("c.c_custkey", "c.c_name").field(Expr("round(sum(l.l_extendedprice * (1 - l.l_discount)), 2)", aggregate=True)).as_("revenue")
    return q.group_by("c.c_custkey", "c.c_name").order_by("revenue", "desc").order_by("c.c_custkey").first(10)


# -- literals, negation, shorthands -----------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' OR p_type = 'it''s' OR NOT (p_size > 3)")
def q_f3_f13_f14_f19_chain(e):
    return e.table("part").field("p_partkey").where("p_brand", "=", "Brand#11").or_where("p_type", "it's").or_().not_().where("p_size", ">", 3).all()


@query("SELECT n.n_nationkey AS n_nationkey, n.n_name AS n_name, r.r_name AS r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey")
def q_p6_p8_lists(e):
    return e.table("nation", "n").inner_join(("region", "r"), "r_regionkey", "n.n_regionkey").fields("n.n_nationkey", "n.n_name").fields(["r.r_name"]).all()


@query("SELECT c_custkey, c_mktsegment FROM customer")
def q_p15_members_only(e):
    return Mapper(e).query(Customer, "c_custkey", "c_mktsegment").all()


@query("SELECT n_nationkey, true AS yes, n_regionkey = 1 AS here FROM nation")
def q_x7_truth_values(e):
    return e.frame("nation").select("n_nationkey", types.literal(True).alias("yes"), (F.col("n_regionkey") == 1).alias("here"))


# -- scalar functions -------------------------------------------------------------------------


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, o_orderdate + INTERVAL 36 HOUR AS later FROM orders")
def q_x2_dates(e):
    parts = scalar.date_parts(F.col("o_orderdate"))
    long = lambda c: parts[c].cast("long")
    return e.frame("orders").select("o_orderkey", long("year").alias("y"), long("month").alias("m"), long("day").alias("d"), scalar.shifted(F.col("o_orderdate"), hours=36).alias("later"))


@query("SELECT p_partkey, rtrim(p_name || '   ') AS name, p_name = 'it''s \"quoted\"' AS odd FROM part")
def q_x3_x4_text(e):
    return e.frame("part").select("p_partkey", scalar.trimmed(F.concat("p_name", F.lit("   "))).alias("name"), (F.col("p_name") == types.literal("it's \"quoted\"")).alias("odd"))


@query("SELECT p_partkey, substr(p_name, 1, 5) AS short FROM part")
def q_x5_shortened(e):
    return e.frame("part").select("p_partkey", scalar.shortened(F.col("p_name"), 5).alias("short"))


@query("SELECT n_name, hex('\\x0A\\xFF'::BLOB) AS digits FROM nation")
def q_x6_binary(e):
    return e.frame("nation").select("n_name", F.hex(scalar.binary("0AFF")).alias("digits"))


@query("SELECT max(p_partkey) + 1 AS next_key FROM part")
def q_x8_next_key(e):
    return e.frame("part").agg((F.max("p_partkey") + 1).alias("next_key"))


@query("SELECT r_name, sha256(r_name) AS digest FROM region")
def q_x10_sha256(e):
    return e.frame("region").select("r_name", scalar.sha256("r_name").alias("digest"))


@query("SELECT p_partkey FROM part WHERE p_type GLOB '*E*' AND p_brand GLOB 'Brand#?1'")
def q_x11_glob(e):
    return e.frame("part").where(scalar.glob_match(F.col("p_type"), "*E*") & scalar.glob_match(F.col("p_brand"), "Brand#?1")).select("p_partkey")


# -- changes ----------------------------------------------------------------------------------


@query("SELECT * FROM region UNION ALL SELECT 99, 'ATLANTIS'")
def q_d1_insert(e):
    return changes.insert(e.frame("region"), [{"r_regionkey": 99, "r_name": "ATLANTIS"}])


@query(f"SELECT c_custkey, CASE WHEN segment = 'MACHINERY' THEN 'TOOLS' ELSE segment END AS segment, CASE WHEN segment = 'MACHINERY' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM {CLIENT}")
def q_d3_update(e):
    table = _with_nulls(e).frame("client").select("c_custkey", "segment", "c_acctbal")
    return changes.update(table, {"segment": "TOOLS", "c_acctbal": F.col("c_acctbal") + 1}, lambda w: w.where("segment", "=", "MACHINERY"))


@query(f"SELECT c_custkey, segment FROM {CLIENT} WHERE segment IS NULL OR NOT (segment = 'MACHINERY')")
def q_d4_delete(e):
    return changes.delete(_with_nulls(e).frame("client").select("c_custkey", "segment"), lambda w: w.where("segment", "=", "MACHINERY"))


@query("SELECT count(*) AS n, count(DISTINCT r_regionkey) AS keys, max(r_regionkey) - (SELECT max(r_regionkey) FROM region) AS added FROM (SELECT r_regionkey FROM region UNION ALL SELECT (SELECT max(r_regionkey) FROM region) + row_number() OVER () FROM nation)")
def q_d8_new_keys(e):
    region = e.frame("region")
    keyed = changes.with_new_keys(e.frame("nation").select(F.col("n_name").alias("r_name")), "r_regionkey", region, ["r_name"])
    both = region.unionByName(keyed)
    return both.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("r_regionkey").alias("keys"), F.max("r_regionkey").alias("m")).crossJoin(F.broadcast(region.agg(F.max("r_regionkey").alias("old")))).select("n", "keys", (F.col("m") - F.col("old")).cast("long").alias("added"))  # one row each


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debtor' ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def q_d10_update_rows(e):
    table = e.frame("supplier")
    fresh = table.where("s_acctbal < 0").withColumn("s_name", F.lit("debtor")).withColumn("s_acctbal", F.lit(0.0))
    return changes.update_rows(table, fresh, ["s_suppkey"])


@query("SELECT * FROM supplier WHERE s_acctbal >= 0")
def q_d11_delete_rows(e):
    table = e.frame("supplier")
    return changes.delete_rows(table, table.where("s_acctbal < 0"), ["s_suppkey"])


@query("SELECT n_nationkey, 'n_name' AS member, n_name AS \"left\", lower(n_name) AS \"right\" FROM nation")
def q_d13_differences(e):
    nation = e.frame("nation")
    return changes.differences(nation, nation.withColumn("n_name", F.lower("n_name")), ["n_nationkey"])


# -- comparison and raw SQL -------------------------------------------------------------------


@query("""WITH a AS (SELECT *, count(*) AS n FROM lineitem GROUP BY ALL),
          b AS (SELECT *, count(*) AS n FROM (SELECT * REPLACE (CASE WHEN l_returnflag = 'A' THEN l_tax + 1 ELSE l_tax END AS l_tax) FROM lineitem WHERE l_returnflag <> 'R') GROUP BY ALL)
          SELECT n AS left_rows, 0 AS right_rows FROM a WHERE l_returnflag IN ('A', 'R') UNION ALL SELECT 0, n FROM b WHERE l_returnflag = 'A'""")
def q_g17_diff(e):
    """All columns: rows with R are missing on the right, rows with A have another tax there."""
    a = e.frame("lineitem")
    b = a.where("l_returnflag <> 'R'").withColumn("l_tax", F.when(F.col("l_returnflag") == "A", F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    return compare(a, b).select("left_rows", "right_rows")


# -- what writes tables -----------------------------------------------------------------------


def _own_copy(e: Engine, record: type[Record]) -> type[Record]:
    """The record over a table under a name of its own, which the catalog gets with the first change and keeps."""
    name = f"{record.table_name}_{uuid.uuid4().hex[:12]}"
    e.register(name, e.frame(record.table_name).select(*record.column_names()))
    return type(f"{record.__name__}_{name}", (record,), {}, table=name)


def _least(e: Engine, record: type[Record]) -> Record:
    key = record.keys()[0].column
    return Mapper(e).single(record, e.frame(record.table_name).agg(F.min(key)).first()[0])


CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
NEXT = "(SELECT max(c_custkey) + 1 FROM customer)"
FIRST = "(SELECT min(c_custkey) FROM customer)"


@query(f"SELECT {NEXT} AS last_key")
def q_d2_last_key(e):
    own = _own_copy(e, Customer)
    return e.spark.createDataFrame([(Mapper(e).create(own(c_name="new")).c_custkey,)], "last_key long")


@query(f"{CUSTOMER} WHERE NOT (c_acctbal < 0)")
def q_d5_mapper_delete_where(e):
    own = _own_copy(e, Customer)
    Mapper(e).delete_where(own, lambda w: w.where("c_acctbal", "<", 0))
    return Mapper(e).query(own).all()


@query(f"{CUSTOMER} UNION ALL SELECT {NEXT}, 'new', 7, 1.5, NULL")
def q_d6_create(e):
    own = _own_copy(e, Customer)
    Mapper(e).create(own(c_name="new", c_nationkey=7, c_acctbal=1.5))
    return Mapper(e).query(own).all()


@query(f"{CUSTOMER} UNION ALL SELECT {NEXT}, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = {FIRST}")
def q_d7_create_copy(e):
    own = _own_copy(e, Customer)
    Mapper(e).create_copy(_least(e, own))
    return Mapper(e).query(own).all()


@query(f"SELECT c_custkey, CASE WHEN c_custkey = {FIRST} THEN 'renamed' ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_d9_mapper_update(e):
    record = _least(e, _own_copy(e, Customer))
    record.c_name = "renamed"
    Mapper(e).update(record)
    return Mapper(e).query(type(record)).all()


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey <> {FIRST}")
def q_d11_mapper_delete(e):
    record = _least(e, _own_copy(e, Customer))
    Mapper(e).delete(record)
    return Mapper(e).query(type(record), "c_custkey", "c_name").all()


@query("SELECT r_regionkey + 100 AS r_regionkey, CASE WHEN r_name = 'ASIA' THEN 'EAST' ELSE r_name END AS r_name FROM region WHERE r_name <> 'EUROPE' UNION ALL SELECT 199, 'ATLANTIS'")
def q_g8_data_steps(e):
    name = f"region_{uuid.uuid4().hex[:12]}"
    ddl.CreateTable(name).primary_key("r_regionkey", types.Integer).required("r_name", types.Varchar(25)).apply(e)
    e.append(name, e.frame("region"))
    steps = [
        ddl.InsertRow(name, {"r_regionkey": 99, "r_name": "ATLANTIS"}),
        ddl.UpdateRows(name, {}, expressions={"r_regionkey": "r_regionkey + 100"}),
        ddl.UpdateRows(name, {"r_name": "EAST"}, ddl.Where().where("r_name", "ASIA")),
        ddl.DeleteRows(name, ddl.Where().where("r_name", "EUROPE")),
    ]
    for step in steps:
        step.apply(e)
    return e.frame(name)


@query("SELECT 1 AS id, 'one' AS title, 5 AS size UNION ALL SELECT 2, 'two', 6")
def q_g15_fold(e):
    """The net schema of migrations that rename, add and drop columns between their rows."""
    name = f"folded_{uuid.uuid4().hex[:12]}"
    first = (ddl.CreateTable(name).primary_key("id", types.Integer).column("name", types.Text()).column("gone", types.Integer), ddl.InsertRow(name, {"id": 1, "name": "one", "gone": 3}))
    then = (ddl.RenameColumn(name, "name", "title"), ddl.DropColumn(name, "gone"), ddl.AddColumn(name, ddl.Column("size", types.Integer, default=5)), ddl.InsertRow(name, {"id": 2, "title": "two", "size": 5}))
    last = (ddl.UpdateRows(name, {}, ddl.Where().where("id", 2), {"size": "size + 1"}),)
    for step in fold([Migration(k, str(k), up) for k, up in enumerate((first, then, last))]):
        step.apply(e)
    return e.frame(name)


@query("SELECT * FROM nation")
def q_s16_s17_backup_restore(e):
    """A backup in the warehouse, restored into an engine of its own, which verifies rows and digests."""
    folder = f"{e.spark.conf.get('spark.sql.warehouse.dir')}/backup-{uuid.uuid4().hex[:12]}"
    backup(e, folder, ["nation", "region"])
    fresh = Engine(e.spark)
    restore(fresh, folder, "nation")
    return fresh.frame("nation")


@query("SELECT count(*) AS rows, cast(ceil(count(*) / 10) AS BIGINT) AS blocks FROM nation")
def q_s9_blocks(e):
    sizes = [len(b) for b in row_blocks(e.frame("nation"), 10)]
    return e.spark.createDataFrame([(sum(sizes), len(sizes))], "rows long, blocks long")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def q_raw_having(e):
    return e.view("orders").sql("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > ?", 15)


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 250000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY 1")
def q_raw_cte(e):
    return e.view("orders").sql("WITH big AS (SELECT * FROM orders WHERE o_totalprice > ?) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY 1", 250000)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_suppkey FROM supplier EXCEPT SELECT n_regionkey FROM nation")
def q_raw_union(e):
    return e.view("customer", "supplier", "nation").sql("SELECT cast(c_nationkey AS bigint) AS k FROM customer UNION SELECT s_suppkey FROM supplier EXCEPT SELECT n_regionkey FROM nation")


@query("SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def q_raw_window(e):
    return e.view("events").sql("SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def q_raw_rollup(e):
    return e.view("lineitem").sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
