"""Scans, heads, predicates, joins and unions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from factloom.functions.codec import Id
from factloom.operators import folds, paths, sets
from factloom.operators.shared import shared_folder
from factloom.plans.algebra import Equal, Has, Head, Is, Pattern, Range, Relation, Var, Where, and_, entity_range, exists, find, or_, pattern, rows, vars_
from factloom.queries.registry import attr, graph, lineitems, query, table
from factloom.sources.facts import UnionSource, merge_archives, ordered, ordered_scan, read_archive, table_facts, validate, write_archive

c, n, r, x, y, z, name, bal, a, v = vars_("c n r x y z name bal a v")
e1, e2 = vars_("e1 e2")
C_NAME, C_NATION, C_BAL, C_SEG = attr("customer.c_name", "text"), attr("customer.c_nationkey", "id"), attr("customer.c_acctbal", "float"), attr("customer.c_mktsegment", "text")
N_REGION, N_NAME, R_NAME = attr("nation.n_regionkey", "id"), attr("nation.n_name", "text"), attr("region.r_name", "text")
O_CUST, O_STATUS, O_PRICE, O_DATE = attr("orders.o_custkey", "id"), attr("orders.o_orderstatus", "text"), attr("orders.o_totalprice", "float"), attr("orders.o_orderdate", "time")
S_NATION, S_NAME = attr("supplier.s_nationkey", "id"), attr("supplier.s_name", "text")
P_SIZE, P_BRAND = attr("part.p_size", "int"), attr("part.p_brand", "text")


@query("SELECT c_name AS name, c_acctbal AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_acctbal >= 5000")
def flagship(spark, d):
    g = graph(spark, d, "customer", "nation", "region")
    where = and_(pattern(g, (c, {C_NAME: name, C_BAL: bal, C_NATION: n}), (n, {N_REGION: r}), (r, {R_NAME: "ASIA"})), Range(bal, 5000.0, None))
    return find([(name, "text"), (bal, "float")], where)


@query("SELECT 'customer/' || c_custkey AS c, c_mktsegment AS x FROM customer")
def s1_pattern_scan(spark, d):
    return find([c, (x, "text")], Pattern(graph(spark, d, "customer"), c, C_SEG, x))


@query("SELECT 'nation/' || n_nationkey AS x FROM nation WHERE n_regionkey = 2")
def s1_constant_value(spark, d):
    return find([x], Pattern(graph(spark, d, "nation"), x, N_REGION, Id("region/2")))


def _archive_dir(spark) -> str:
    """A new folder where the cluster keeps shared files."""
    return shared_folder(spark, "archives")


@query("SELECT 'customer/' || c_custkey AS c, c_mktsegment AS x FROM customer WHERE c_acctbal BETWEEN 0 AND 1000")
def s3_archive_scan(spark, d):
    path = _archive_dir(spark) + "/a"
    write_archive(table_facts(table(spark, d, "customer"), "customer", "c_custkey", {"c_nationkey": "nation"}), path)
    g = read_archive(spark, path)
    return find([c, (x, "text")], and_(pattern(g, (c, {C_SEG: x, C_BAL: Var("_b")})), Range(Var("_b"), 0.0, 1000.0)))


@query("SELECT 'customer/' || c_custkey AS c, c_name AS x FROM customer WHERE c_custkey % 3 < 2")
def s4_union_of_archives(spark, d):
    t = table(spark, d, "customer")
    parts = [table_facts(t.where(F.col("c_custkey") % 3 == k), "customer", "c_custkey", {"c_nationkey": "nation"}) for k in (0, 1, 1)]
    return find([c, (x, "text")], Pattern(UnionSource(*parts), c, C_NAME, x))


@query("SELECT 'customer.' || a AS a, count(v) AS n FROM (SELECT unnest(['c_custkey','c_name','c_nationkey','c_acctbal','c_mktsegment']) AS a, unnest([c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, c_acctbal::VARCHAR, c_mktsegment]) AS v FROM customer) GROUP BY ALL")
def s5_free_attribute(spark, d):
    got = find([a, v], Pattern(graph(spark, d, "customer"), c, a, v))
    return got.groupBy("a").agg(F.count("v").alias("n"))


@query("SELECT 'repeated' AS reason, a, count(*) AS n FROM (SELECT 'nation.n_name' AS a FROM nation WHERE n_nationkey % 3 = 1) GROUP BY a UNION ALL SELECT 'null or empty', 'region.r_name', 2 * count(*) FROM region UNION ALL SELECT 'null or empty', '', count(*) FROM supplier")
def s20_validate(spark, d):
    """Good facts of four tables, some of them again, some without an entity, a value or an attribute."""
    good = graph(spark, d, "nation", "region", "supplier").facts()
    k = F.split_part("e", F.lit("/"), F.lit(2)).cast("bigint")
    names = good.where("a = 'region.r_name'")
    bad = good.where((F.col("a") == "nation.n_name") & (k % 3 == 1)).unionByName(names.withColumn("e", F.lit("")))
    bad = bad.unionByName(names.withColumn("v", F.lit(None).cast("string"))).unionByName(good.where("a = 'supplier.s_name'").withColumn("a", F.lit("")))
    return validate(good.unionByName(bad)).groupBy("reason", "a").agg(F.count("*").alias("n"))


_SUPPLIERS = "SELECT 'supplier/' || s_suppkey AS e, unnest(['supplier.s_suppkey', 'supplier.s_name', 'supplier.s_nationkey']) AS a, unnest(['=i:' || s_suppkey, '=t:' || s_name, 'nation/' || s_nationkey]) AS v FROM supplier"


@query(_SUPPLIERS)
def s21_merge_archives(spark, d):
    path = _archive_dir(spark)
    t = table(spark, d, "supplier")
    for k, part in enumerate((t.where("s_suppkey % 2 = 0"), t.where("s_suppkey % 2 = 1"), t.where("s_suppkey % 5 = 0"))):
        write_archive(table_facts(part, "supplier", "s_suppkey", {"s_nationkey": "nation"}, ["s_suppkey", "s_name", "s_nationkey"]), f"{path}/{k}")
    merge_archives(spark, [f"{path}/{k}" for k in range(3)], f"{path}/all")
    return read_archive(spark, f"{path}/all").facts().select("e", "a", "v")


@query("SELECT e, a, v, row_number() OVER (ORDER BY e, a, v) AS place FROM (SELECT 'nation/' || n_nationkey AS e, unnest(['nation.n_nationkey', 'nation.n_name', 'nation.n_regionkey']) AS a, unnest(['=i:' || n_nationkey, '=t:' || n_name, 'region/' || n_regionkey]) AS v FROM nation)")
def s25_ordered_facts(spark, d):
    """All facts in order: numbered as they come, partition after partition."""
    facts = ordered(graph(spark, d, "nation"))
    return facts.coalesce(1).select("e", "a", "v", (F.monotonically_increasing_id() + 1).alias("place"))


@query("SELECT 'part/' || p_partkey AS e, p_size::BIGINT AS v FROM part ORDER BY p_size DESC, ('part/' || p_partkey) DESC LIMIT 50")
def s23_ordered_scan(spark, d):
    df = ordered_scan(graph(spark, d, "part"), "part.p_size", descending=True, order="int").limit(50)
    return df.select("e", F.col("int").alias("v"))


@query("SELECT 'part/' || p_partkey AS e, p_size::BIGINT AS v FROM part WHERE p_size >= 40")
def s24_ordered_scan_from(spark, d):
    return ordered_scan(graph(spark, d, "part"), "part.p_size", F.lit(40), order="int").select("e", F.col("int").alias("v"))


@query("SELECT c_mktsegment AS x FROM customer JOIN orders ON o_custkey = c_custkey")
def p1_find_bag(spark, d):
    """Hidden variables multiply rows."""
    g = graph(spark, d, "customer", "orders")
    return find([(x, "text")], pattern(g, (c, {C_SEG: x}), (Var("_o"), {O_CUST: c})))


@query("SELECT count(*) AS n FROM orders")
def p3_unit_head(spark, d):
    return folds.count_all(find([], Pattern(graph(spark, d, "orders"), x, O_STATUS, y)), "n")


@query("SELECT 'customer/' || c_custkey AS c, c_custkey AS v FROM customer")
def p4_typed_head_skips(spark, d):
    """Of all values of all attributes only whole numbers decode; the foreign key is an id."""
    return find([c, (v, "int")], Pattern(graph(spark, d, "customer"), c, a, v))


@query("SELECT sum((k = 'ok')::INT)::BIGINT AS ok, sum((k <> 'ok')::INT)::BIGINT AS failed FROM (SELECT unnest(['ok','no','no','no','no']) AS k FROM customer)")
def p5_fallible_head(spark, d):
    got = find([Head(v, "int", fallible=True)], Pattern(graph(spark, d, "customer"), c, a, v))
    return got.agg(F.count_if(F.col("v.error").isNull()).alias("ok"), F.count_if(F.col("v.error").isNotNull()).alias("failed"))


@query("SELECT (SELECT count(*) FROM region WHERE r_name = 'ASIA') > 0 AS some, (SELECT count(*) FROM region WHERE r_name = 'ATLANTIS') > 0 AS none")
def p6_exists(spark, d):
    g = graph(spark, d, "region")
    some, none = (rows(Pattern(g, r, R_NAME, x)).limit(1).agg(F.count("*").alias(n)) for x, n in (("ASIA", "a"), ("ATLANTIS", "b")))
    return some.crossJoin(none).select((F.col("a") > 0).alias("some"), (F.col("b") > 0).alias("none"))


@query("SELECT 'orders/' || o_orderkey AS x, n_name AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def p7_hidden_variables(spark, d):
    """The customer and the nation are hidden: a row for each binding of theirs."""
    g = graph(spark, d, "orders", "customer", "nation")
    return find([x, (y, "text")], pattern(g, (x, {O_CUST: Var("_c")}), (Var("_c"), {C_NATION: Var("_n")}), (Var("_n"), {N_NAME: y})))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def p9_constant_term(spark, d):
    return folds.count_all(rows(Pattern(graph(spark, d, "orders"), x, O_STATUS, "F")), "n")


@query("SELECT 'nation/' || n_nationkey AS x FROM nation")
def p10_constant_pattern(spark, d):
    """A clause without variables lets everything or nothing through."""
    g = graph(spark, d, "nation", "region")
    return find([x], and_(Pattern(g, x, N_NAME, Var("_v")), Pattern(g, Id("region/2"), R_NAME, "ASIA")))


@query("SELECT 'nation/' || n_nationkey AS x, n_name AS y FROM nation WHERE n_name IN ('NATION_7', 'NATION_11')")
def p11_is_constant(spark, d):
    g = graph(spark, d, "nation")
    return find([x, (y, "text")], or_(and_(Pattern(g, x, N_NAME, y), Is(y, "NATION_7")), and_(Pattern(g, x, N_NAME, y), y.is_("NATION_11"))))


@query("SELECT 'orders/' || o_orderkey AS x, 'customer/' || c_custkey AS y FROM customer JOIN orders ON o_custkey = c_custkey")
def p12_equality(spark, d):
    """Two variables that no clause joins."""
    g = graph(spark, d, "customer", "orders")
    k = Var("_k")
    return find([x, y], and_(Pattern(g, x, O_CUST, k), Pattern(g, y, C_SEG, Var("_s")), Equal(k, y)))


@query("SELECT 'orders/' || o_orderkey AS x FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31'")
def p13_value_range(spark, d):
    p, t = vars_("_p _t")
    return find([x], and_(pattern(graph(spark, d, "orders"), (x, {O_PRICE: p, O_DATE: t})), Range(p, 1000.0, 50000.0), Range(t, dt.datetime(1996, 1, 1), dt.datetime(1997, 12, 31))))


@query("SELECT DISTINCT p_size::BIGINT AS v FROM part WHERE p_size BETWEEN 10 AND 20")
def p14_value_in_range(spark, d):
    return find([(v, "int")], and_(Pattern(graph(spark, d, "part"), x, P_SIZE, v), Range(v, 10, 20))).distinct()


@query("SELECT 'customer/' || c_custkey AS c FROM customer WHERE 'customer/' || c_custkey BETWEEN 'customer/1' AND 'customer/2'")
def p15_entity_range(spark, d):
    return find([c], and_(Pattern(graph(spark, d, "customer"), c, C_NAME, Var("_n")), entity_range(c, "customer/1", "customer/2")))


@query("SELECT 'customer.' || a AS a, count(*) AS n FROM (SELECT unnest(['c_custkey', 'c_mktsegment', 'c_name']) AS a FROM customer) GROUP BY ALL")
def p16_attribute_range(spark, d):
    got = find([a], and_(Pattern(graph(spark, d, "customer"), c, a, v), entity_range(a, "customer.c_b", "customer.c_namf")))
    return got.groupBy("a").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT k FROM (SELECT 'nation/' || n_nationkey AS k FROM nation UNION ALL SELECT 'region/' || n_regionkey FROM nation) WHERE k BETWEEN 'nation/2' AND 'region/3'")
def p18_domain_range(spark, d):
    return folds.domain(graph(spark, d, "nation"), "e", "v", low="nation/2", high="region/3")


@query("SELECT 'customer/' || c_custkey AS c FROM customer WHERE length(c_name) + c_custkey % 7 > 20")
def p19_predicate(spark, d):
    k = attr("customer.c_custkey", "int")
    where = Where(lambda q: F.length(q["_n"]) - 3 + F.substring(q["_k"], 4, 20).cast("bigint") % 7 > 20, vars_("_n _k"), strict=True)
    return find([c], and_(pattern(graph(spark, d, "customer"), (c, {C_NAME: Var("_n"), k: Var("_k")})), where))


@query("SELECT count(*) AS n FROM lineitem WHERE l_orderkey <> l_partkey AND l_suppkey < 50")
def p20_filter_rows(spark, d):
    g = lineitems(spark, d)
    q = attr("lineitem.l_orderkey", "id"), attr("lineitem.l_partkey", "id"), attr("lineitem.l_suppkey", "id")
    df = rows(pattern(g, (x, {q[0]: y, q[1]: z, q[2]: v})))
    num = lambda col: F.split_part(F.col(col), F.lit("/"), F.lit(2)).cast("bigint")
    return folds.count_all(df.where((num("y") != num("z")) & (num("v") < 50)), "n")


@query("SELECT 'customer/' || c_custkey AS c, c_name AS x, c_acctbal AS y FROM customer")
def j2_star(spark, d):
    return find([c, (x, "text"), (y, "float")], pattern(graph(spark, d, "customer"), (c, {C_NAME: x, C_BAL: y})))


@query("SELECT 'orders/' || o_orderkey AS x, r_name AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j3_chain(spark, d):
    g = graph(spark, d, "orders", "customer", "nation", "region")
    return find([x, (y, "text")], pattern(g, (x, {O_CUST: c}), (c, {C_NATION: n}), (n, {N_REGION: r}), (r, {R_NAME: y})))


@query("SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey")
def j4_multi_column(spark, d):
    g = lineitems(spark, d)
    k, m = attr("lineitem.l_orderkey", "id"), attr("lineitem.l_suppkey", "id")
    return folds.count_all(rows(pattern(g, (x, {k: Var("_o"), m: Var("_s")}), (y, {k: Var("_o"), m: Var("_s")}))), "n")


@query("SELECT 'orders/' || o_orderkey AS x, c_mktsegment AS y FROM orders JOIN customer ON o_custkey = c_custkey")
def j5_cross_source(spark, d):
    return find([x, (y, "text")], and_(pattern(graph(spark, d, "orders"), (x, {O_CUST: c})), pattern(graph(spark, d, "customer"), (c, {C_SEG: y}))))


@query("SELECT 'orders/' || o_orderkey AS x FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def j6_membership(spark, d):
    g = graph(spark, d, "orders", "customer")
    rich = find([c], and_(Pattern(g, c, C_BAL, Var("_b")), Range(Var("_b"), 9000.0000001, None)))
    return find([x], and_(Pattern(g, x, O_CUST, Var("_c")), Has(Var("_c"), rich)))


@query("SELECT * FROM (VALUES ('nation/1'), ('nation/3')) t(x)")
def j6_membership_proposes(spark, d):
    """A set binds the variable where nothing else does: its distinct members."""
    return find([x], and_(Has(x, [Id("nation/1"), Id("nation/3"), Id("nation/1")], spark), Pattern(graph(spark, d, "nation"), x, N_NAME, Var("_n"))))


@query("SELECT 'nation/' || n_nationkey AS x FROM nation WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_24')")
def j8_sorted_members(spark, d):
    return find([x], and_(Pattern(graph(spark, d, "nation"), x, N_NAME, Var("_n")), Has(Var("_n"), ["NATION_1", "NATION_2", "NATION_24"], spark)))


@query("SELECT 'customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j12_exists_filter(spark, d):
    g = graph(spark, d, "customer", "orders")
    return folds.having(find([c], Pattern(g, c, C_NAME, Var("_n"))), find([c], Pattern(g, Var("_o"), O_CUST, c)))


@query("SELECT 'customer/' || c_custkey AS c, 'orders/' || o_orderkey AS x FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def j13_optional(spark, d):
    g = graph(spark, d, "customer", "orders")
    return folds.optional(find([c], Pattern(g, c, C_NAME, Var("_n"))), find([c, x], Pattern(g, x, O_CUST, c)))


@query("SELECT 'customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice >= 400000)")
def j14_minus(spark, d):
    """Customers without a large order."""
    g = graph(spark, d, "customer", "orders")
    large = find([c], and_(pattern(g, (Var("_o"), {O_CUST: c, O_PRICE: Var("_p")})), Range(Var("_p"), 400000.0, None)))
    return folds.minus(find([c], Pattern(g, c, C_NAME, Var("_n"))), large)


@query("SELECT 'customer/' || c_custkey AS c, r_name AS y FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j15_path_join(spark, d):
    g = graph(spark, d, "customer", "nation", "region")
    index = paths.PathIndex.build(g, "<customer.c_nationkey> <nation.n_regionkey>")
    return find([c, (y, "text")], and_(index.constraint(c, Var("_r")), Pattern(g, Var("_r"), R_NAME, y)))


@query("SELECT 'customer/' || c_custkey AS x FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT 'supplier/' || s_suppkey FROM supplier WHERE s_acctbal > 5000")
def u1_or_is_a_set(spark, d):
    g = graph(spark, d, "customer", "supplier")
    b = Var("_b")
    left = Pattern(g, x, C_SEG, "BUILDING")
    right = and_(Pattern(g, x, attr("supplier.s_acctbal", "float"), b), Range(b, 5000.0000001, None))
    return find([x], or_(left, Relation(find([x], right), [x])))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def u2_bag_union(spark, d):
    g = graph(spark, d, "customer", "supplier")
    both = folds.bag_union(find([n], Pattern(g, c, C_NATION, n)), find([n], Pattern(g, c, S_NATION, n)))
    return both.select(F.split_part("n", F.lit("/"), F.lit(2)).cast("int").alias("k"))


def _halves(spark, d):
    t = table(spark, d, "supplier")
    return [table_facts(p, "supplier", "s_suppkey", {"s_nationkey": "nation"}, ["s_name", "s_nationkey"]) for p in (t.where("s_suppkey % 2 = 0 or s_suppkey % 3 = 0"), t.where("s_suppkey % 3 <> 1"))]


_SETS = "SELECT DISTINCT 'supplier/' || s_suppkey AS e, 'supplier.s_name' AS a, '=t:' || s_name AS v FROM supplier WHERE {0} UNION ALL SELECT 'supplier/' || s_suppkey, 'supplier.s_nationkey', 'nation/' || s_nationkey FROM supplier WHERE {0}"


@query(_SETS.format("(s_suppkey % 2 = 0 OR s_suppkey % 3 = 0) OR s_suppkey % 3 <> 1"))
def u3_union(spark, d):
    return sets.union(*_halves(spark, d)).select("e", "a", "v")


@query(_SETS.format("(s_suppkey % 2 = 0 OR s_suppkey % 3 = 0) AND s_suppkey % 3 <> 1"))
def u4_intersect(spark, d):
    return sets.intersect(*_halves(spark, d)).select("e", "a", "v")


@query(_SETS.format("(s_suppkey % 2 = 0 OR s_suppkey % 3 = 0) AND NOT (s_suppkey % 3 <> 1)"))
def u5_difference(spark, d):
    return sets.difference(*_halves(spark, d)).select("e", "a", "v")


@query("SELECT true AS same, false AS other, 3 * count(*) AS n FROM nation")
def u6_fingerprint(spark, d):
    """Equal sets have equal fingerprints in whatever order and however often their facts come; others don't."""
    facts = graph(spark, d, "nation").facts()
    again, less = facts.orderBy("v").unionByName(facts), facts.where("v <> '=t:NATION_7'")
    token = lambda f, name: sets.fingerprint(f).select(F.struct("n", "x", "s").alias(name))
    one = token(facts, "one").crossJoin(token(again, "two")).crossJoin(token(less, "three"))
    return one.select((F.col("one") == F.col("two")).alias("same"), (F.col("one") == F.col("three")).alias("other"), F.col("one.n").alias("n"))


@query("SELECT DISTINCT substr('customer/' || c_custkey, 10, 1) AS infix FROM customer")
def u8_infixes(spark, d):
    return sets.infixes(graph(spark, d, "customer").scan("customer.c_name"), "e", "customer/", 1)


@query("SELECT min(p_size)::BIGINT AS int FROM part WHERE p_size > 17")
def u8_successor(spark, d):
    return sets.successor(graph(spark, d, "part").scan("part.p_size"), "int", 17)


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'changed' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 9")
def u9_put_remove(spark, d):
    t = table(spark, d, "nation").select("n_nationkey", "n_name")
    new = t.where("n_nationkey < 3").select("n_nationkey", F.lit("changed").alias("n_name"))
    return sets.remove(sets.put(t, new, "n_nationkey"), t.where("n_nationkey = 9"), "n_nationkey")


@query("SELECT o_orderkey AS member FROM orders WHERE o_orderkey % 4 = 1")
def u10_cover_additions(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("member"))
    old, new = sets.Cover(t.where("member % 4 = 0")), sets.Cover(t.where("member % 4 < 2"))
    return new.additions_since(old).df


@query("SELECT DISTINCT 'nation/' || c_nationkey AS id FROM customer UNION SELECT 'region/' || n_regionkey FROM nation")
def u12_id_sets(spark, d):
    facts = graph(spark, d, "customer", "nation").facts()
    return sets.join_id_sets(sets.id_set(facts, "customer.c_nationkey"), sets.id_set(facts, "nation.n_regionkey"))


@query("SELECT 'supplier/' || s_suppkey AS e, '=t:' || s_name AS v FROM supplier WHERE s_suppkey % 7 = 0")
def c8_reconcile(spark, d):
    t = table(spark, d, "supplier")
    mine, theirs = (table_facts(p, "supplier", "s_suppkey", {}, ["s_name"]) for p in (t.where("s_suppkey % 7 <> 0"), t))
    return sets.missing(mine, theirs).select("e", "v")
