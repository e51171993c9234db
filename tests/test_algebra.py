"""Laws of the query algebra, with a small solver in Python as the second opinion, and fixtures of known sizes."""

import datetime as dt
from collections import Counter
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions.codec import ENCODINGS, Id, constant_key
from factloom.operators import folds, sets
from factloom.plans.algebra import Equal, Has, Head, Is, Pattern, Range, Relation, Var, Where, and_, count, exists, find, or_, pattern, rows, vars_
from factloom.sources.facts import FACT_SCHEMA, Attribute, Catalog, FactSource, UnionSource, intrinsic_id, read_archive, validate, write_archive
from factloom.streaming.delta import pattern_changes

x, y, z = vars_("x y z")


def source(spark, triples, distinct=False):
    rows_ = [(e, a, v, int(v[3:]) if v.startswith("=i:") else None, None) for e, a, v in triples]
    return FactSource(spark.createDataFrame(rows_, FACT_SCHEMA), distinct)


def solve(clauses, facts):
    """Bag of bindings of clauses (e, a, v) of Var or constant, by trying all facts."""
    facts = set(facts)
    out = [{}]
    for clause in clauses:
        new = []
        for b in out:
            for f in facts:
                c = dict(b)
                if all((c.setdefault(t.name, k) == k) if isinstance(t, Var) else t == k for t, k in zip(clause, f)):
                    new.append(c)
        out = new
    return Counter(tuple(sorted(b.items())) for b in out)


def bag(df):
    names = sorted(df.columns)
    return Counter(tuple((n, r[n]) for n in names) for r in df.collect())


ids = st.sampled_from(["p", "q", "r"])
fact = st.tuples(ids, st.sampled_from(["k", "l"]), st.one_of(ids, st.sampled_from(["=i:1", "=i:2", "=t:1"])))
term = st.one_of(st.sampled_from([x, y, z]), st.sampled_from(["p", "q"]))
clause = st.tuples(term, st.one_of(st.sampled_from(["k", "l"]), st.just(Var("w"))), term)
few = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def built(g, clauses):
    return [Pattern(g, Id(e) if isinstance(e, str) else e, a, Id(v) if isinstance(v, str) else v) for e, a, v in clauses]


@few
@given(st.lists(fact, max_size=10), st.lists(clause, min_size=1, max_size=3))
def test_and_against_solver(spark, facts, clauses):
    if not any(isinstance(t, Var) for c in clauses for t in c):
        return
    g = source(spark, facts)
    got = rows(and_(*built(g, clauses)))
    assert bag(got) == solve(clauses, facts)


@few
@given(st.lists(fact, max_size=10), st.lists(fact, max_size=4), st.lists(clause, min_size=1, max_size=2))
def test_changes_against_solver(spark, old, new, clauses):
    """A change query gives just the bindings that use a new fact, once each."""
    if not any(isinstance(t, Var) for c in clauses for t in c):
        return
    full, delta = source(spark, old + new), source(spark, [f for f in new if f not in old])
    got = bag(rows(pattern_changes(built(full, clauses), full, delta)))
    want = set(solve(clauses, old + new)) - set(solve(clauses, old))
    assert set(got) == want and all(n == 1 for n in got.values())


@few
@given(st.lists(fact, max_size=8), st.lists(fact, max_size=8), st.lists(fact, max_size=8))
def test_set_laws(spark, a, b, c):
    a_, b_, c_ = (source(spark, t).facts() for t in (a, b, c))
    triples = lambda df: {(r["e"], r["a"], r["v"]) for r in df.collect()}
    assert triples(sets.union(a_, b_)) == set(a) | set(b)
    assert triples(sets.intersect(a_, sets.union(b_, c_))) == set(a) & (set(b) | set(c))
    assert triples(sets.difference(a_, b_)) == set(a) - set(b)
    assert triples(sets.missing(b_, a_)) == set(a) - set(b)
    same = sets.fingerprint(a_).first() == sets.fingerprint(b_).first()
    assert same == (set(a) == set(b))


def test_bag_and_set(spark):
    """Two fans of 8 on 32 entities: hidden variables multiply, distinct doesn't."""
    g = source(spark, [(f"e{i}", a, f"{a}{k}") for i in range(32) for a in "kl" for k in range(8)])
    w = pattern(g, (x, {"k": Var("_a"), "l": Var("_b")}))
    assert find([x], w).count() == 32 * 64 and find([x], w).distinct().count() == 32
    assert count(w) == 2048 and find([], w).count() == 2048


def test_known_sizes(spark):
    both = [(f"e{i}", "k", "v") for i in range(1800)] + [(f"e{i}", "l", "v") for i in range(1600, 2000)]
    g = source(spark, both)
    assert count(or_(Pattern(g, x, "k", y), Pattern(g, x, "l", y))) == 2000
    hub = source(spark, [("hub", "k", f"v{i}") for i in range(2000)] + [(f"u{i}", "k", "v") for i in range(100)])
    assert count(Pattern(hub, x, "k", y)) == 2100
    chain = source(spark, [(f"{c}{i}", "n", f"{c}{i + 1}") for c in "ab" for i in range(12)])
    hops = [Pattern(chain, Var(f"h{i}"), "n", Var(f"h{i + 1}")) for i in range(12)]
    assert count(and_(*hops)) == 2
    consts = source(spark, [(f"c{i}", "k", "v") for i in range(20)])
    assert exists(and_(*[Pattern(consts, Id(f"c{i}"), "k", Id("v")) for i in range(20)], Is(x, 1)))
    assert not exists(and_(Pattern(consts, Id("c20"), "k", Id("v")), Is(x, 1)))


def test_or_needs_equal_variables(spark):
    g = source(spark, [("p", "k", "=i:1")])
    with pytest.raises(ValueError, match="different variables"):
        or_(Pattern(g, x, "k", y), Pattern(g, x, "k", z))


def test_or_arms_with_literals_and_hidden_variables(spark):
    g = source(spark, [("p", "k", "=i:1"), ("p", "l", "=t:b"), ("q", "l", "=t:b")])
    assert bag(find([x], or_(Pattern(g, x, "k", 1), Pattern(g, x, "l", "b")))) == Counter([(("x", "p"),), (("x", "q"),)])
    # a hidden variable tells bindings apart, so the head may repeat
    got = find([x], or_(Pattern(g, x, "k", y), Pattern(g, x, "l", y)))
    assert got.count() == 3


def test_heads(spark):
    g = source(spark, [("p", "k", "=i:7"), ("q", "k", "=t:seven"), ("r", "k", "p")])
    assert [r["y"] for r in find([(y, "int")], Pattern(g, x, "k", y)).collect()] == [7]
    got = {r["x"]: r["y"] for r in find([x, Head(y, "int", fallible=True)], Pattern(g, x, "k", y)).collect()}
    assert got["p"]["value"] == 7 and got["p"]["error"] is None and got["q"]["value"] is None and "seven" in got["q"]["error"]
    with pytest.raises(ValueError, match="twice"):
        find([x, x], Pattern(g, x, "k", y))
    with pytest.raises(ValueError, match="local"):
        find([Var("_x")], Pattern(g, Var("_x"), "k", y))
    with pytest.raises(ValueError, match="nothing binds"):
        find([z], Pattern(g, x, "k", y))


def test_ranges_by_value_and_by_key(spark):
    g = source(spark, [(f"e{i}", "k", f"=i:{i}") for i in (-5, 2, 10, 33)])
    ask = lambda **o: sorted(r["y"] for r in find([(y, "int")], and_(Pattern(g, x, "k", y), Range(y, 2, 33, **o))).collect())
    assert ask() == [2, 10, 33]
    assert ask(order="key") == [2, 33]  # "10" sorts before "2"
    assert find([y], and_(Pattern(g, x, "k", y), Range(y, None, 2))).count() == 2
    bound = Relation(spark.createDataFrame([("=i:3",), ("=i:99",), ("=t:3",)], "k string"), [y])
    assert find([y], and_(bound, Range(y, 1, 50))).count() == 1


def test_membership_and_equality(spark):
    g = source(spark, [("p", "k", "p"), ("p", "k", "q"), ("q", "k", "q")])
    assert {r["x"] for r in find([x], Pattern(g, x, "k", x)).collect()} == {"p", "q"}
    assert count(and_(Pattern(g, x, "k", y), Equal(x, y))) == 2
    assert {r["x"] for r in find([x], Has(x, [Id("p"), Id("p"), Id("z")], spark)).collect()} == {"p", "z"}
    assert count(and_(Pattern(g, x, "k", y), Has(x, [Id("p")], spark))) == 2
    with pytest.raises(ValueError, match="bound by nothing"):
        rows(and_(Pattern(g, x, "k", y), Range(z, 1, 2)))


def test_strict_predicate_raises(spark):
    g = source(spark, [("p", "k", "=t:x")])
    w = Where(lambda c: F.substring(c["y"], 4, 9).try_cast("int") > 1, [y], strict=True)
    with pytest.raises(Exception, match="predicate failed"):
        find([x], and_(Pattern(g, x, "k", y), w)).collect()


def test_filters_reach_the_file_scan(spark, tmp_path):
    g = source(spark, [(f"e{i}", a, f"=i:{i}") for i in range(100) for a in ("k", "l")])
    write_archive(g.facts(), str(tmp_path / "a"))
    got = find([x], and_(Pattern(read_archive(spark, str(tmp_path / "a")), x, "k", y), Range(y, 10, 19)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(a" in plan and "GreaterThanOrEqual(int,10)" in plan and "num" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert got.count() == 10


def test_codecs_round_trip(spark):
    values = {"int": [0, -3, 2**62], "float": [0.0, -0.0, 1.5, 1e-7, 1.25e300, 123456789.125, 1e7, 0.001], "text": ["", "=t:", "é\n"], "bool": [True, False], "decimal": [Decimal("1.5"), Decimal("-12.000000000000000001")], "bytes": [b"", b"\x00\xff"], "time": [dt.datetime(2020, 1, 2, 3, 4, 5, 6), dt.datetime(1969, 12, 31)]}
    for name, some in values.items():
        enc = ENCODINGS[name]
        df = spark.createDataFrame([(v,) for v in some], f"v {enc.sql_type}")
        for r, v in zip(df.select(enc.key(F.col("v")).alias("k"), enc.decode(enc.key(F.col("v"))).alias("b")).collect(), some):
            assert r["k"] == constant_key(v) and (r["b"] == v), (name, v, r)


def test_content_ids(spark):
    a, b = Attribute.named("a", "int"), Attribute.named("b", "text")
    from factloom.sources.facts import entities, fact_structs

    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i int, t string")
    one = entities(df, None, {a: F.col("i"), b: F.col("t")})
    two = entities(df, None, {b: F.col("t"), a: F.col("i")})
    assert {r["e"] for r in one.collect()} == {r["e"] for r in two.collect()} and one.select("e").distinct().count() == 2
    salted = df.select(intrinsic_id(fact_structs({a: F.col("i")}), "salt").alias("e"), intrinsic_id(fact_structs({a: F.col("i")})).alias("f"))
    assert all(r["e"] != r["f"] for r in salted.collect())
    assert Attribute.derived("iri", "int").key != Attribute.derived("iri", "text").key
    with pytest.raises(ValueError, match="declared twice"):
        Catalog().add(a, Attribute.named("a", "text"))


def test_sources(spark, tmp_path):
    a = source(spark, [("p", "k", "=i:1"), ("p", "k", "=i:1")])
    assert a.facts().count() == 1 and UnionSource(a.facts(), a.facts()).scan("k").count() == 1
    bad = validate(spark.createDataFrame([("p", "k", "v", None, None), ("p", "k", "v", None, None), ("", "k", "v", None, None)], FACT_SCHEMA))
    assert {r["reason"] for r in bad.collect()} == {"repeated", "null or empty"}


def test_outer_joins_without_a_shared_variable(spark):
    left, right = spark.createDataFrame([("p",)], "x string"), spark.createDataFrame([("q",)], "y string")
    assert folds.minus(left, right).count() == 1
    with pytest.raises(ValueError, match="share no variable"):
        folds.optional(left, right)


def test_cover(spark):
    a, b = (sets.Cover(spark.createDataFrame([(m,) for m in t], "member string")) for t in ("ab", "abc"))
    assert [r[0] for r in b.additions_since(a).df.collect()] == ["c"] and a.is_subset(b) and not b.is_subset(a)
    with pytest.raises(sets.ResetRequired):
        a.additions_since(b)


