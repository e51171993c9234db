"""The benchmark's query shapes over the supplied tables.

The benchmark asks about publications; its data isn't supplied, so each shape runs over attributes of like kind and size:
a small one, large ones, a numeric one, a text, and links between entities. Names follow the shapes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import scalar
from factloom.functions.codec import Id
from factloom.operators import folds, paths
from factloom.plans.algebra import Equal, Pattern, Range, and_, find, or_, pattern, rows, vars_
from factloom.queries.registry import attr, graph, query, table
from factloom.sources.facts import Attribute, FactSource, entities

s, o, o1, o2, o3, o4, a, b, c, e = vars_("s o o1 o2 o3 o4 a b c e")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders")


class Rel:
    """An attribute: its scan in Spark, and the same rows (s, o) in SQL."""

    def __init__(self, column: str, kind: str) -> None:
        self.attr, self.kind = attr(column, kind), kind
        table, name = column.split(".")
        key = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}[table]
        target = {"n_regionkey": "region", "c_nationkey": "nation", "s_nationkey": "nation", "o_custkey": "customer"}.get(name)
        value = f"'{target}/' || {name}" if target else name
        self.sql = f"(SELECT '{table}/' || {key} AS s, {value} AS o FROM {table})"


STATUS, PRIORITY, CUST, PRICE, DATE = Rel("orders.o_orderstatus", "text"), Rel("orders.o_orderpriority", "text"), Rel("orders.o_custkey", "id"), Rel("orders.o_totalprice", "float"), Rel("orders.o_orderdate", "time")
SEGMENT, NATION, C_NAME, BALANCE = Rel("customer.c_mktsegment", "text"), Rel("customer.c_nationkey", "id"), Rel("customer.c_name", "text"), Rel("customer.c_acctbal", "float")
REGION, N_NAME, R_NAME = Rel("nation.n_regionkey", "id"), Rel("nation.n_name", "text"), Rel("region.r_name", "text")
SIZE, P_NAME, BRAND, S_NATION = Rel("part.p_size", "int"), Rel("part.p_name", "text"), Rel("part.p_brand", "text"), Rel("supplier.s_nationkey", "id")


def _graph(spark, d):
    return graph(spark, d, *TABLES)


def _buddies(spark, d, n: int = 1000):
    """Each customer's buddy: the customer of three times its key, modulo ``n``."""
    node = lambda k: F.concat(F.lit("customer/"), k.cast("string"))
    t = table(spark, d, "customer")
    return FactSource(entities(t, node(F.col("c_custkey")), {Attribute.named("buddy", "id"): node(F.col("c_custkey") * 3 % n)}))


def _count(name: str, sql: str, build) -> None:
    @query(f"SELECT count(*) AS count FROM {sql}", name)
    def run(spark, d):
        return folds.count_all(build(_graph(spark, d)))


def _p(g, rel: Rel, subject, value) -> Pattern:
    return Pattern(g, subject, rel.attr, value)


def _df(g, *parts):
    return rows(and_(*parts))


# Joins: (name, left relations on s, right ones). Star shapes share s; chains go from value to subject.
_STARS = {
    "join_2_small_large": [STATUS, PRIORITY],
    "join_2_large_small": [PRIORITY, STATUS],
    "join_2_large_large": [STATUS, CUST],
    "join_2_largest_result": [CUST, PRICE],
    "join_2_large_large_with_large_result": [CUST, DATE],
    "join_2_large_large_with_small_result": [NATION, CUST],
    "join_3_star_largest_sum_of_join_sizes": [STATUS, PRIORITY, CUST],
    "join_xlarge_star_on_small_predicates": [STATUS, PRIORITY, CUST, PRICE, DATE],
}
for _name, _rels in _STARS.items():
    _count("q_" + _name, " JOIN ".join([f"{_rels[0].sql} r0", *(f"{x.sql} r{i} USING (s)" for i, x in enumerate(_rels[1:], 1))]), lambda g, rels=_rels: _df(g, *(_p(g, x, s, v) for x, v in zip(rels, vars_("o0 o1 o2 o3 o4")))))

_CHAIN = f"{CUST.sql} r1 JOIN {NATION.sql} r2 ON r1.o = r2.s JOIN {REGION.sql} r3 ON r2.o = r3.s"
_count("q_join_3_chain_largest_sum_of_join_sizes", _CHAIN, lambda g: _df(g, _p(g, CUST, a, b), _p(g, NATION, b, c), _p(g, REGION, c, o)))
_count("q_join_xlarge_chain_on_small_predicates", _CHAIN + f" JOIN {R_NAME.sql} r4 ON r3.o = r4.s", lambda g: _df(g, _p(g, CUST, a, b), _p(g, NATION, b, c), _p(g, REGION, c, o), _p(g, R_NAME, o, o1)))

# OPTIONAL, MINUS and EXISTS of the same sides: name -> (left, right) as lists of relations on s, or chains.
_SIDES = {
    "small_large": ([N_NAME], [REGION]),
    "large_small": ([C_NAME], [SEGMENT]),
    "large_large": ([STATUS], [CUST]),
    "2_large_large_with_large_result": ([CUST], [PRICE]),
    "2_large_large_with_small_join_result_1": ([NATION], [CUST]),
    "2_large_large_with_small_join_result_2": ([CUST], [NATION]),
    "3_star_1": ([STATUS, PRIORITY], [CUST]),
    "3_star_2": ([STATUS], [PRIORITY, CUST]),
}


def _star_sql(rels: list[Rel], prefix: str) -> str:
    body = " JOIN ".join([f"{rels[0].sql} {prefix}0", *(f"{x.sql} {prefix}{i} USING (s)" for i, x in enumerate(rels[1:], 1))])
    return f"(SELECT s FROM {body})"


def _star_df(g, rels: list[Rel], prefix: str):
    return _df(g, *(_p(g, x, s, v) for x, v in zip(rels, vars_(" ".join(f"{prefix}{i}" for i in range(len(rels)))))))


for _name, (_l, _r) in _SIDES.items():
    _ls, _rs = _star_sql(_l, "l"), _star_sql(_r, "r")
    _count(f"q_optional_join_{_name}", f"{_ls} l LEFT JOIN {_rs} r USING (s)", lambda g, l=_l, r=_r: folds.optional(_star_df(g, l, "l"), _star_df(g, r, "r")))
    _count(f"q_minus_join_{_name}", f"{_ls} l WHERE s NOT IN (SELECT s FROM {_rs} r)", lambda g, l=_l, r=_r: folds.minus(_star_df(g, l, "l"), _star_df(g, r, "r")))
    _count(f"q_exists_join_{_name}", f"{_ls} l WHERE s IN (SELECT s FROM {_rs} r)", lambda g, l=_l, r=_r: folds.having(_star_df(g, l, "l"), _star_df(g, r, "r")))

_AB = f"(SELECT r1.s AS a, r1.o AS b, r2.o AS c FROM {CUST.sql} r1 JOIN {NATION.sql} r2 ON r1.o = r2.s)"
_B = f"(SELECT s AS a, o AS b FROM {CUST.sql})"
_BCD = f"(SELECT r2.s AS b FROM {NATION.sql} r2 JOIN {REGION.sql} r3 ON r2.o = r3.s)"
_CD = f"(SELECT s AS c FROM {REGION.sql} WHERE o <> 'region/2')"


def _ab(g):
    return _df(g, _p(g, CUST, a, b), _p(g, NATION, b, c))


def _cd(g):
    return _df(g, _p(g, REGION, c, o)).where(F.col("o") != "region/2")


for _op, _f, _sql1, _sql2 in (
    ("optional", folds.optional, f"{_AB} l LEFT JOIN {_CD} r USING (c)", f"{_B} l LEFT JOIN {_BCD} r USING (b)"),
    ("minus", folds.minus, f"{_AB} l WHERE c NOT IN (SELECT c FROM {_CD} r)", f"{_B} l WHERE b NOT IN (SELECT b FROM {_BCD} r)"),
    ("exists", folds.having, f"{_AB} l WHERE c IN (SELECT c FROM {_CD} r)", f"{_B} l WHERE b IN (SELECT b FROM {_BCD} r)"),
):
    _count(f"q_{_op}_join_3_chain_1", _sql1, lambda g, f=_f: f(_ab(g), _cd(g)))
    _count(f"q_{_op}_join_3_chain_2", _sql2, lambda g, f=_f: f(_df(g, _p(g, CUST, a, b)), _df(g, _p(g, NATION, b, c), _p(g, REGION, c, o))))

# Unions
_count("q_union_no_constraint", f"(SELECT * FROM {STATUS.sql} UNION SELECT * FROM {CUST.sql})", lambda g: _df(g, or_(_p(g, STATUS, s, o), _p(g, CUST, s, o))))
_count("q_union_constraint_from_star", f"(SELECT * FROM {STATUS.sql} UNION ALL SELECT * FROM {PRIORITY.sql}) u JOIN {CUST.sql} r USING (s)", lambda g: folds.bag_union(_df(g, _p(g, STATUS, s, o1), _p(g, CUST, s, o2)), _df(g, _p(g, PRIORITY, s, o1), _p(g, CUST, s, o2))))
_count("q_union_constraint_small_join", f"(SELECT * FROM {NATION.sql} UNION SELECT * FROM {S_NATION.sql}) u JOIN {SEGMENT.sql} r USING (s)", lambda g: _df(g, or_(_p(g, NATION, s, o1), _p(g, S_NATION, s, o1)), _p(g, SEGMENT, s, o2)))
_count("q_union_constraint_large_join", f"(SELECT * FROM {STATUS.sql} UNION SELECT * FROM {PRIORITY.sql}) u JOIN {CUST.sql} r USING (s)", lambda g: _df(g, or_(_p(g, STATUS, s, o1), _p(g, PRIORITY, s, o1)), _p(g, CUST, s, o2)))
_count("q_multicolumn_join_small", f"{NATION.sql} l JOIN {NATION.sql} r USING (s, o)", lambda g: _df(g, _p(g, NATION, s, o), _p(g, NATION, s, o)))
_count("q_multicolumn_join_large", f"{CUST.sql} l JOIN {CUST.sql} r USING (s, o)", lambda g: _df(g, _p(g, CUST, s, o), _p(g, CUST, s, o)))

# Groups


def _top(name: str, sql: str, build, key: str = "o") -> None:
    @query(f"SELECT o, count(*) AS count FROM {sql} GROUP BY o ORDER BY count DESC, o LIMIT 10", name)
    def run(spark, d):
        return folds.top_counts(build(_graph(spark, d)), key)


_top("q_group_by_count_object_high_multiplicity", STATUS.sql, lambda g: find([s, (o, "text")], _p(g, STATUS, s, o)))
_top("q_group_by_count_object_low_multiplicity", CUST.sql, lambda g: find([s, o], _p(g, CUST, s, o)))
_top("q_group_by_count_object_wrong_sort_order", f"(SELECT l.o FROM {PRIORITY.sql} l JOIN {CUST.sql} r USING (s))", lambda g: find([(o, "text")], and_(_p(g, PRIORITY, s, o), _p(g, CUST, s, o2))))


@query(f"SELECT l.o, count(*) AS count, min(s) AS min, max(s) AS max, min(s) AS sample FROM {PRIORITY.sql} l JOIN {CUST.sql} r USING (s) GROUP BY l.o ORDER BY count DESC, l.o LIMIT 10")
def q_group_by_complex_aggregate(spark, d):
    g = _graph(spark, d)
    df = find([s, (o, "text")], and_(_p(g, PRIORITY, s, o), _p(g, CUST, s, o2)))
    return folds.group(df, ["o"], count=F.count("*"), min=F.min("s"), max=F.max("s"), sample=F.min("s")).orderBy(F.desc("count"), "o").limit(10)


def _fold(name: str, rel: Rel, sql: str, **aggregates) -> None:
    @query(f"SELECT {sql} FROM {rel.sql}", name)
    def run(spark, d):
        return folds.describe(find([(o, rel.kind)], _p(_graph(spark, d), rel, s, o)), {k: f(F.col("o")) for k, f in aggregates.items()})


_long = lambda c: c.cast("bigint")
_fold("q_group_by_implicit_numeric_baseline", SIZE, "count(o) AS count", count=F.count)
_fold("q_group_by_implicit_numeric_sum", SIZE, "sum(o)::BIGINT AS sum", sum=F.sum)
_fold("q_group_by_implicit_numeric_min", SIZE, "min(o)::BIGINT AS min", min=F.min)
_fold("q_group_by_implicit_numeric_max", SIZE, "max(o)::BIGINT AS max", max=F.max)
_fold("q_group_by_implicit_numeric_avg", SIZE, "round(avg(o), 6) AS avg", avg=lambda x: F.round(F.avg(x), 6))
_fold("q_group_by_implicit_string_baseline", P_NAME, "count(o) AS count", count=F.count)
_fold("q_group_by_implicit_string_min", P_NAME, "min(o) AS min", min=F.min)
_fold("q_group_by_implicit_string_max", P_NAME, "max(o) AS max", max=F.max)


@query(f"SELECT s, string_agg(o, ' ' ORDER BY o) AS text FROM (SELECT * FROM {PRIORITY.sql} UNION ALL SELECT * FROM {STATUS.sql}) GROUP BY s")
def q_group_by_string_groupconcat(spark, d):
    g = _graph(spark, d)
    both = folds.bag_union(find([s, (o, "text")], _p(g, PRIORITY, s, o)), find([s, (o, "text")], _p(g, STATUS, s, o)))
    return folds.group_concat(both, ["s"], "o")


def _distinct(name: str, sql: str, build) -> None:
    @query(f"SELECT count(DISTINCT o) AS count FROM {sql}", name)
    def run(spark, d):
        return folds.count_distinct(build(_graph(spark, d)), "o")


_distinct("q_distinct_count_object_high_multiplicity", STATUS.sql, lambda g: find([o], _p(g, STATUS, s, o)))
_distinct("q_distinct_count_object_low_multiplicity", CUST.sql, lambda g: find([o], _p(g, CUST, s, o)))
_distinct("q_distinct_count_object_wrong_sort_order", f"(SELECT l.o FROM {PRIORITY.sql} l JOIN {CUST.sql} r USING (s))", lambda g: find([o], and_(_p(g, PRIORITY, s, o), _p(g, CUST, s, o2))))


def _matching(name: str, sql: str, test) -> None:
    @query(f"SELECT count(*) AS count FROM {P_NAME.sql} WHERE {sql}", name)
    def run(spark, d):
        return folds.count_all(find([(o, "text")], _p(_graph(spark, d), P_NAME, s, o)).where(test(F.col("o"))))


_matching("q_regex_3_contains", "contains(o, '12')", lambda x: scalar.contains(x, "12"))
_matching("q_regex_3_fixed", "regexp_matches(o, '12')", lambda x: scalar.regex(x, "12"))
_matching("q_regex_3", "regexp_matches(o, '1.2')", lambda x: scalar.regex(x, "1.2"))
for _n, _re in enumerate(("^p", "^pa", "^part"), 1):
    _matching(f"q_regex_prefix_{_n}", f"regexp_matches(o, '(?i){_re}')", lambda x, r=_re: scalar.regex(x, "(?i)" + r))

_fold("q_strlen", P_NAME, "sum(length(o))::BIGINT AS checksum", checksum=lambda x: F.sum(scalar.strlen(x)))
_fold("q_strbefore", P_NAME, "sum(CASE WHEN instr(o, 'a') > 0 THEN instr(o, 'a') - 1 ELSE 0 END)::BIGINT AS checksum", checksum=lambda x: F.sum(F.length(scalar.strbefore(x, "a"))).cast("bigint"))
_fold("q_strafter", P_NAME, "sum(CASE WHEN instr(o, 'a') > 0 THEN length(o) - instr(o, 'a') ELSE 0 END)::BIGINT AS checksum", checksum=lambda x: F.sum(F.length(scalar.strafter(x, "a"))).cast("bigint"))
_fold("q_strstarts", P_NAME, "sum(starts_with(o, 'p')::INT)::BIGINT AS count", count=lambda x: F.sum(scalar.strstarts(x, "p")))
_fold("q_strends", P_NAME, "sum(suffix(o, '1')::INT)::BIGINT AS count", count=lambda x: F.sum(scalar.strends(x, "1")))

for _name, _n in (("tiny", 10), ("small", 1000), ("medium", 100_000), ("large", 1_000_000), ("xlarge", 10_000_000)):
    @query(f"SELECT s, o FROM {STATUS.sql} ORDER BY s, o LIMIT {_n}", f"q_result_size_{_name}")
    def _size(spark, d, n=_n):
        return folds.take(find([s, (o, "text")], _p(_graph(spark, d), STATUS, s, o)), n, "s", "o")

for _name, _sql, _f in (
    ("baseline", "sum(o)", F.sum), ("abs", "sum(abs(o))", lambda x: F.sum(F.abs(x))), ("ceil", "sum(ceil(o))", lambda x: F.sum(F.ceil(x))), ("floor", "sum(floor(o))", lambda x: F.sum(F.floor(x))), ("round", "sum(round(o))", lambda x: F.sum(F.round(x))),
    ("add", "sum(o + o)", lambda x: F.sum(x + x)), ("greater", "sum((o > 0)::INT)", lambda x: F.sum((x > 0).cast("int"))),
):
    _fold(f"q_numeric_{_name}", BALANCE, f"round({_sql}, 2) AS sum", sum=lambda x, f=_f: F.round(f(x).cast("double"), 2))
for _name, _k in (("fifty_fifty", 25), ("seventy_thirty", 35), ("ninetyfive_five", 48)):
    _count(f"q_numeric_filter_bin_search_{_name}", f"{SIZE.sql} WHERE o >= {_k}", lambda g, k=_k: _df(g, _p(g, SIZE, s, o), Range(o, k, None)))


@query("SELECT 'customer/' || c_custkey AS s FROM customer WHERE c_custkey = c_custkey * 3 % 1000")
def q_filter_few_results(spark, d):
    """Customers that are their own buddies."""
    return find([s], and_(Pattern(_buddies(spark, d), s, "buddy", o), Equal(s, o)))


@query("SELECT count(*) AS count FROM (SELECT 'customer/' || c_custkey AS s FROM customer WHERE c_custkey = c_custkey * 3 % 1000 UNION SELECT 'customer/' || c_custkey FROM customer WHERE c_custkey = c_custkey * 3 % 700)")
def q_union_constraint_filter_restrictive(spark, d):
    g, h = _buddies(spark, d), _buddies(spark, d, 700)
    return folds.count_all(rows(or_(and_(Pattern(g, s, "buddy", o), Equal(s, o)), and_(Pattern(h, s, "buddy", o), Equal(s, o)))))


_count("q_filter_many_results", f"{CUST.sql} WHERE s <> o", lambda g: _df(g, _p(g, CUST, s, o)).where(F.col("s") != F.col("o")))


@query("SELECT count(*) AS count FROM documents WHERE lang = 'en'")
def q_filter_language_en(spark, d):
    docs = table(spark, d, "documents").where("text is not null and lang is not null")
    tagged = F.sha2(F.concat("lang", F.lit("\x00"), "text"), 256)
    facts = entities(docs, F.concat(F.lit("document/"), F.col("doc_id").cast("string")), {Attribute.named("body", "id"): tagged})
    langs = FactSource(entities(docs, tagged, {Attribute.named("rdf.lang", "text"): F.col("lang")}), distinct=False)
    return folds.count_all(rows(and_(Pattern(FactSource(facts), s, "body", o), Pattern(langs, o, "rdf.lang", "en"))))


for _name, _f in (("year", scalar.year), ("month", scalar.month), ("day", scalar.day)):
    _fold(f"q_date_{_name}", DATE, f"sum({_name}(o))::BIGINT AS sum", sum=lambda x, f=_f: F.sum(f(x)).cast("bigint"))

# Of a table with n columns, none null, each row has n facts.
_WIDTHS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6}
_ROWS = " + ".join(f"{n} * (SELECT count(*) FROM {t})" for t, n in _WIDTHS.items())


@query(f"SELECT {_ROWS} AS count")
def q_number_of_triples(spark, d):
    return folds.count_all(_graph(spark, d).facts())


@query("SELECT " + " + ".join(f"(SELECT count(*) FROM {t})" for t in _WIDTHS) + " AS count")
def q_number_of_subjects(spark, d):
    return folds.count_distinct(_graph(spark, d).facts(), "e")


@query(f"SELECT {sum(_WIDTHS.values())}::BIGINT AS count")
def q_number_of_predicates(spark, d):
    return folds.count_distinct(_graph(spark, d).facts(), "a")


# Values are told apart by encoding: i whole numbers, f others, t texts, d times, and the entities that foreign keys name.
_VALUES = {
    "region": "i:r_regionkey t:r_name", "nation": "i:n_nationkey t:n_name region:n_regionkey", "customer": "i:c_custkey t:c_name nation:c_nationkey f:c_acctbal t:c_mktsegment",
    "supplier": "i:s_suppkey t:s_name nation:s_nationkey f:s_acctbal", "part": "i:p_partkey t:p_name t:p_brand t:p_type i:p_size f:p_retailprice", "orders": "i:o_orderkey customer:o_custkey t:o_orderstatus f:o_totalprice d:o_orderdate t:o_orderpriority",
}
_OBJECTS = " UNION ALL ".join(f"SELECT '{k}/' || {c} AS o FROM {t}" for t, cs in _VALUES.items() for k, c in (x.split(":") for x in cs.split()))


@query(f"SELECT count(DISTINCT o) AS count FROM ({_OBJECTS})")
def q_number_of_objects(spark, d):
    return folds.count_distinct(_graph(spark, d).facts(), "v")


@query(f"SELECT ({_ROWS}) - (SELECT count(*) FROM nation) - (SELECT count(*) FROM customer) - (SELECT count(*) FROM supplier) - (SELECT count(*) FROM orders) AS count")
def q_number_of_literals(spark, d):
    return folds.count_all(folds.literals(_graph(spark, d)))


# Paths over the parent relation that the keys of customers spell: k -> k / 2.


def _tree(spark, d):
    t = table(spark, d, "customer").where("c_custkey > 1")
    node = lambda k: F.concat(F.lit("customer/"), k.cast("string"))
    return FactSource(entities(t, node(F.col("c_custkey")), {Attribute.named("parent", "id"): node(F.floor(F.col("c_custkey") / 2))}))


_UP = "WITH RECURSIVE up(s, o) AS (SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_custkey > 1 UNION SELECT s, o // 2 FROM up WHERE o > 1)"


@query(f"{_UP} SELECT count(*) AS count FROM up")
def q_transitive_path_plus(spark, d):
    return folds.count_all(paths.PathIndex.build(_tree(spark, d), "parent+").pairs)


@query(f"{_UP} SELECT count(*) AS count FROM up WHERE s = 100")
def q_transitive_path_plus_fixed_subject(spark, d):
    only = spark.range(1).select(F.lit("customer/100").alias("src"))
    return folds.count_all(paths.PathIndex.build(_tree(spark, d), "parent+", only).pairs)


@query(f"{_UP} SELECT count(*) AS count FROM orders JOIN up ON o_custkey = s")
def q_transitive_path_large_join_and_plus(spark, d):
    g = _graph(spark, d)
    return folds.count_all(rows(and_(_p(g, CUST, s, a), paths.PathIndex.build(_tree(spark, d), "parent+").constraint(a, o))))


@query(f"{_UP} SELECT count(*) AS count FROM nation n JOIN customer ON c_nationkey = n_nationkey JOIN up ON c_custkey = s WHERE n_nationkey = 3")
def q_transitive_path_small_join_and_plus(spark, d):
    g = _graph(spark, d)
    return folds.count_all(rows(and_(_p(g, NATION, a, Id("nation/3")), paths.PathIndex.build(_tree(spark, d), "parent+").constraint(a, o))))


