"""Aggregates, ranking, scalar functions, construction and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import scalar
from factloom.functions.codec import constant_key, encoding
from factloom.operators import folds
from factloom.plans.algebra import Head, Pattern, Var, find, pattern, vars_
from factloom.queries.registry import attr, graph, query, table
from factloom.sources.facts import Attribute, Catalog, FactSource, entities

c, n, x, y = vars_("c n x y")
C_SEG, C_BAL, C_NATION = attr("customer.c_mktsegment", "text"), attr("customer.c_acctbal", "float"), attr("customer.c_nationkey", "id")
O_CUST, O_DATE, O_PRICE = attr("orders.o_custkey", "id"), attr("orders.o_orderdate", "time"), attr("orders.o_totalprice", "float")


@query("SELECT count(DISTINCT c_mktsegment) AS exact, 1 AS near FROM customer")
def a2_count_distinct(spark, d):
    df = find([(x, "text")], Pattern(graph(spark, d, "customer"), c, C_SEG, x))
    both = folds.count_distinct(df, "x", name="exact").crossJoin(folds.count_distinct(df, "x", approximate=True, name="about"))
    return both.select("exact", (F.abs(F.col("about") - F.col("exact")) <= 1).cast("int").alias("near"))


@query("SELECT DISTINCT c_mktsegment AS x FROM customer")
def a3_distinct_projection(spark, d):
    return folds.distinct(find([(x, "text")], Pattern(graph(spark, d, "customer"), c, C_SEG, x)))


@query("SELECT 'nation/' || c_nationkey AS n, count(*) AS count FROM customer GROUP BY ALL ORDER BY count DESC, n LIMIT 10")
def a4_top_counts(spark, d):
    return folds.top_counts(find([n], Pattern(graph(spark, d, "customer"), c, C_NATION, n)), "n")


@query("SELECT c_mktsegment AS x, count(*) AS n, round(min(c_acctbal), 6) AS low, round(max(c_acctbal), 6) AS high, round(sum(c_acctbal), 4) AS total, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY c_mktsegment")
def a5_group_aggregates(spark, d):
    df = find([(x, "text"), (y, "float")], pattern(graph(spark, d, "customer"), (c, {C_SEG: x, C_BAL: y})))
    return folds.group(df, ["x"], n=F.count("*"), low=F.round(F.min("y"), 6), high=F.round(F.max("y"), 6), total=F.round(F.sum("y"), 4), mean=F.round(F.avg("y"), 6))


@query("SELECT 'customer/' || o_custkey AS c, max_by('orders/' || o_orderkey, (o_orderdate, 'orders/' || o_orderkey)) AS x FROM orders GROUP BY o_custkey")
def a12_max_by_key(spark, d):
    df = find([c, x, (y, "time")], pattern(graph(spark, d, "orders"), (x, {O_CUST: c, O_DATE: y})))
    return folds.max_by_key(df, ["c"], "x", "y")


@query("SELECT count(*) AS count FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)")
def a13_distinct_pairs(spark, d):
    return folds.count_distinct(find([n, x], pattern(graph(spark, d, "customer"), (c, {C_NATION: n, C_SEG: x}))), "n", "x")


@query("SELECT DISTINCT 'nation/' || n_nationkey AS k FROM nation UNION SELECT 'region/' || r_regionkey FROM region")
def a14_domain(spark, d):
    return folds.domain(graph(spark, d, "nation", "region"), "e")


@query("SELECT 3 * (SELECT count(*) FROM nation) AS facts, (SELECT count(*) FROM nation) AS entities, 3::BIGINT AS attributes, (SELECT count(*) FROM nation) * 2 + (SELECT count(DISTINCT n_regionkey) FROM nation) AS values")
def a15_axis_counts(spark, d):
    return folds.axis_counts(graph(spark, d, "nation"))


@query("SELECT 'customer/' || c_custkey AS c FROM customer ORDER BY c LIMIT 25")
def k1_limit(spark, d):
    return folds.take(find([c], Pattern(graph(spark, d, "customer"), c, C_SEG, x)), 25, "c")


@query("SELECT c, x, rank FROM (SELECT 'customer/' || o_custkey AS c, 'orders/' || o_orderkey AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, 'orders/' || o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def k_top_per_group(spark, d):
    df = find([c, x, (y, "float")], pattern(graph(spark, d, "orders"), (x, {O_CUST: c, O_PRICE: y})))
    return folds.top_per_group(df, ["c"], [F.desc("y"), F.asc("x")], 3).select("c", "x", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT p_partkey AS k, length(p_name)::BIGINT AS len, CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, 1, instr(p_name, ' ') - 1) ELSE '' END AS before, CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '' END AS after, starts_with(p_name, 'P')::INT AS starts, suffix(p_name, '1')::INT AS ends, contains(p_name, '1') AS has, regexp_matches(p_name, '[0-9]{2}') AS matched FROM part")
def f1_string_functions(spark, d):
    t = table(spark, d, "part")
    p = F.col("p_name")
    return t.select(F.col("p_partkey").alias("k"), scalar.strlen(p).cast("bigint").alias("len"), scalar.strbefore(p, " ").alias("before"), scalar.strafter(p, " ").alias("after"), scalar.strstarts(p, "P").alias("starts"), scalar.strends(p, "1").alias("ends"), scalar.contains(p, "1").alias("has"), scalar.regex(p, "[0-9]{2}").alias("matched"))


@query("SELECT o_orderkey AS k, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d FROM orders")
def f15_date_parts(spark, d):
    t = table(spark, d, "orders")
    return t.select(F.col("o_orderkey").alias("k"), scalar.year("o_orderdate").alias("y"), scalar.month("o_orderdate").alias("m"), scalar.day("o_orderdate").alias("d"))


@query("SELECT event_id AS k, event_id AS lower, event_id * 3 AS upper, event_id * 2 AS mid, event_id * 2 AS width FROM events")
def f18_intervals(spark, d):
    t = table(spark, d, "events").select("event_id", scalar.interval(F.col("event_id"), F.col("event_id") * 3).alias("i"))
    i = F.col("i")
    return t.select(F.col("event_id").alias("k"), "i.lower", "i.upper", scalar.midpoint(i).alias("mid"), scalar.width(i).cast("bigint").alias("width"))


@query("SELECT o_orderkey AS k, epoch_us(date_trunc('day', o_orderdate)) * 1000 AS lower, (epoch_us(date_trunc('day', o_orderdate)) + 86400000000) * 1000 - 1 AS upper, (o_orderkey % 50) * 86400000000000 + 90061500000000 AS dur FROM orders")
def f19_xsd_times(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat(F.lit("P"), (F.col("o_orderkey") % 50 + 1).cast("string"), F.lit("DT1H1M1.5S")).alias("dur"))
    t = t.select("*", scalar.parse_time(F.col("day"), "date").alias("i"))
    return t.select(F.col("o_orderkey").alias("k"), "i.lower", "i.upper", scalar.parse_duration(F.col("dur")).alias("dur"))


@query("SELECT p_partkey AS k, round(p_retailprice * 100)::BIGINT AS cents, (round(p_retailprice * 100) * 3)::BIGINT AS triple, (round(p_retailprice * 100) + 5)::BIGINT AS plus FROM part")
def f20_money(spark, d):
    t = table(spark, d, "part").withColumn("a", F.round(F.col("p_retailprice"), 2).cast("decimal(38,18)"))
    five = F.lit("0.05").cast("decimal(38,18)")
    return t.select(F.col("p_partkey").alias("k"), scalar.to_minor(F.col("a")).alias("cents"), scalar.to_minor(scalar.money_mul(F.col("a"), F.lit(3))).alias("triple"), scalar.to_minor(scalar.money_add(F.col("a"), five)).alias("plus"))


@query("SELECT p_partkey AS k, sign((p_size * 7) - (p_partkey % 11 + 1) * 100)::INT AS cmp FROM part")
def f21_rational_order(spark, d):
    t = table(spark, d, "part")
    a, b = scalar.rational(F.col("p_size"), F.col("p_partkey") % 11 + 1), scalar.rational(F.lit(100), F.lit(7))
    return t.select(F.col("p_partkey").alias("k"), scalar.compare(a, b).alias("cmp"))


@query("SELECT item_id AS k, sha256(text) AS handle FROM benchmark")
def f22_handles(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("k"), scalar.digest(F.col("text")).alias("handle"))


@query("SELECT event_id AS k, ((event_id - 5000) % 1024 + 1024) % 1024 AS dist FROM events")
def f24_timestamp_distance(spark, d):
    t = table(spark, d, "events")
    return t.select(F.col("event_id").alias("k"), scalar.timestamp_distance(F.col("event_id"), F.lit(5000), 10).alias("dist"))


@query("SELECT 'region' AS a, count(*) AS n FROM region UNION ALL SELECT 'name', count(*) FROM region WHERE r_regionkey <> 1 UNION ALL SELECT 'code', 2 * count(*) FROM region")
def x3_entities(spark, d):
    """An optional attribute leaves nulls out; a repeated one gives a fact for each element."""
    t = table(spark, d, "region")
    facts = entities(t, F.concat(F.lit("r/"), F.col("r_regionkey").cast("string")), {
        Attribute.named("region", "int"): F.col("r_regionkey"),
        Attribute.named("name", "text"): F.when(F.col("r_regionkey") != 1, F.col("r_name")),
        Attribute.named("code", "text", many=True): F.array(F.substring("r_name", 1, 2), F.concat(F.lit("x"), F.col("r_name"))),
    })
    return facts.groupBy("a").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT (l_orderkey, l_linenumber, l_returnflag)) AS n FROM lineitem")
def x4_content_ids(spark, d):
    """Rows of equal content are one entity, in whatever order their facts come."""
    t = table(spark, d, "lineitem")
    a, b, e = (Attribute.named(k, kind) for k, kind in (("a", "int"), ("b", "int"), ("e", "text")))
    one = entities(t, None, {a: F.col("l_orderkey"), b: F.col("l_linenumber"), e: F.col("l_returnflag")})
    two = entities(t, None, {e: F.col("l_returnflag"), b: F.col("l_linenumber"), a: F.col("l_orderkey")})
    return folds.count_distinct(one.unionByName(two), "e", name="n")


@query("SELECT 'size' AS name, 'int' AS encoding UNION ALL SELECT 'brand', 'text'")
def x1_catalog(spark, d):
    catalog = Catalog().add(Attribute.named("size", "int", doc="how large"), Attribute.named("brand", "text"))
    facts = FactSource(catalog.facts(spark))
    name, kind = Var("name"), Var("encoding")
    return find([(name, "text"), (kind, "text")], pattern(facts, (Var("_a"), {"attribute.name": name, "attribute.encoding": kind})))


@query("SELECT 'customer/' || c_custkey AS c, c_acctbal AS value, NULL::VARCHAR AS error FROM customer")
def p5_fallible_values(spark, d):
    got = find([c, Head(x, "float", fallible=True)], Pattern(graph(spark, d, "customer"), c, C_BAL, x))
    return got.select("c", "x.value", "x.error")


@query("SELECT 'customer/' || c_custkey AS c, round(c_acctbal / 7, 9) AS value, c_custkey % 5 = 0 AS nan, true AS same FROM customer")
def m7_codec_round_trip(spark, d):
    """Keys decode to what was encoded, NaN included, and a constant's key is that of the column's value."""
    t = table(spark, d, "customer")
    enc = encoding("float")
    v = F.when(F.col("c_custkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal") / 7)
    back = enc.decode(enc.key(v))
    plain = enc.decode(enc.key(F.col("c_acctbal") / 7))
    fixed = (enc.key(F.col("c_custkey") * 0 + F.lit(-0.001)) == constant_key(-0.001)) & (enc.key(F.col("c_custkey") * 0 + F.lit(1e10)) == constant_key(1e10))
    return t.select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("c"), F.round(plain, 9).alias("value"), F.isnan(back).alias("nan"), fixed.alias("same"))
