"""Registers, paths, incremental queries, rules and collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import collections, folds, paths, registers
from factloom.plans.algebra import Pattern, Var, and_, find, pattern, vars_
from factloom.plans.paths import any_step, except_, step
from factloom.queries.benchmark import _tree
from factloom.queries.pattern_queries import _archive_dir
from factloom.queries.registry import attr, graph, query, table
from factloom.sources.facts import Attribute, FactSource, entities
from factloom.streaming import delta, rules

c, x, y = vars_("c x y")
OBSERVES, REGISTER, AT = Attribute.named("observes", "id"), Attribute.named("register", "id"), Attribute.named("at", "time")


def _events(spark, d):
    """Events as states: the register is the user, the order the time; an event observes the one 300 before, if any."""
    t = table(spark, d, "events")
    node = lambda k: F.concat(F.lit("event/"), k.cast("string"))
    return FactSource(entities(t, node(F.col("event_id")), {
        OBSERVES: F.when(F.col("event_id") % 3 == 0, node(F.col("event_id") - 300)),
        REGISTER: F.concat(F.lit("user/"), F.col("user_id").cast("string")),
        AT: F.when(F.col("event_id") % 10 != 7, F.col("ts")),
    }))


_OBSERVED = "(SELECT event_id - 300 AS k FROM events WHERE event_id % 3 = 0)"


@query(f"SELECT 'event/' || event_id AS state FROM events WHERE event_id NOT IN (SELECT k FROM {_OBSERVED})")
def r1_latest(spark, d):
    g = _events(spark, d)
    return registers.latest(g, "observes", g.scan("register").select(F.col("e").alias("state")))


@query("SELECT 'event/' || event_id AS state FROM events WHERE event_id % 3 <> 0")
def r5_first_observed(spark, d):
    g = _events(spark, d)
    return registers.resolve(registers.ObservationOrder(g, "observes", first=True), g.scan("register").select(F.col("e").alias("state")))


_STATED = "SELECT 'event/' || event_id AS state FROM events e WHERE event_id % 10 = 7 OR ts = (SELECT {0}(ts) FROM events f WHERE f.user_id = e.user_id AND f.event_id % 10 <> 7)"


@query(_STATED.format("max"))
def r6_stated_order(spark, d):
    """States without a time survive, and so do ties."""
    g = _events(spark, d)
    return registers.resolve(registers.StatedOrder(g, "register", "at", by="int"), g.scan("register").select(F.col("e").alias("state")))


@query(_STATED.format("min"))
def r6_stated_order_first(spark, d):
    g = _events(spark, d)
    return registers.resolve(registers.StatedOrder(g, "register", "at", first=True, by="int"), g.scan("register").select(F.col("e").alias("state")))


@query("SELECT 'user/' || user_id AS register, CASE WHEN count(*) = 1 THEN 'sole' ELSE 'fork' END AS kind, count(*)::INT AS n FROM events e WHERE event_id % 10 = 7 OR ts = (SELECT max(ts) FROM events f WHERE f.user_id = e.user_id AND f.event_id % 10 <> 7) GROUP BY user_id")
def r3_sole_or_fork(spark, d):
    """Whole registers: what the stated order over all events leaves of each."""
    g = _events(spark, d)
    df = find([Var("register"), Var("state")], Pattern(g, Var("state"), REGISTER, Var("register")))
    got = registers.sole(registers.maximal(df, "state", registers.StatedOrder(g, "register", "at", by="int")), "register", "state")
    return got.select("register", "kind", F.coalesce(F.size("fork"), F.lit(1)).alias("n"))


@query(f"SELECT 'event/' || event_id AS state FROM events WHERE event_id % 3 = 0 AND event_id NOT IN (SELECT k FROM {_OBSERVED})")
def r7_heads(spark, d):
    """Heads of two parts, joined, are those of the whole."""
    facts = _events(spark, d).scan("observes")
    even = F.pmod(F.xxhash64("e"), F.lit(2)) == 0
    a, b = (registers.Heads.derive(FactSource(facts.where(p)), "observes") for p in (even, ~even))
    return a.join(b).states()


_LWW = "SELECT 'user/' || user_id AS register, max_by('event/' || event_id, (ts, 'event/' || event_id)) AS state FROM events WHERE event_id % 10 <> 7 GROUP BY user_id"


@query(_LWW)
def r10_last_write_wins(spark, d):
    return registers.Lww.derive(_events(spark, d), "register", "at", by="int").winners().select("register", "state")


@query("SELECT 'event/' || event_id AS state FROM events WHERE event_id % 10 = 7")
def r10_unresolved(spark, d):
    return registers.Lww.derive(_events(spark, d), "register", "at", by="int").unresolved()


@query(f"SELECT w.register, c.value FROM ({_LWW}) w JOIN (SELECT 'event/' || event_id AS state, event_type AS value FROM events) c USING (state)")
def m2_current_values(spark, d):
    """Winners as a constraint: the current value of each register."""
    g = _events(spark, d)
    t = table(spark, d, "events")
    values = FactSource(entities(t, F.concat(F.lit("event/"), F.col("event_id").cast("string")), {Attribute.named("type", "text"): F.col("event_type")}))
    order = registers.StatedOrder(g, "register", "at", tiebreak_by_id=True, by="int")
    state = Var("state")
    where = and_(Pattern(values, state, "type", Var("value")), pattern(g, (state, {REGISTER: Var("register"), AT: Var("_at")})))
    df = find([state, Var("register"), (Var("value"), "text")], where)
    return registers.maximal(df, "state", order).select("register", "value")


_UP = "WITH RECURSIVE up(s, o) AS (SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_custkey > 1 UNION SELECT s, o // 2 FROM up WHERE o > 1)"


@query(f"{_UP} SELECT 'customer/' || s AS src, 'customer/' || o AS dst FROM up UNION SELECT 'customer/' || c_custkey, 'customer/' || c_custkey FROM customer WHERE c_custkey > 0")
def g8_star_with_identity(spark, d):
    return paths.PathIndex.build(_tree(spark, d), step("parent").star()).pairs


@query("SELECT 'customer/' || a.c_custkey AS src, 'customer/' || b.c_custkey AS dst FROM customer a JOIN customer b ON a.c_custkey // 2 = b.c_custkey // 2 WHERE a.c_custkey > 1 AND b.c_custkey > 1")
def g2_inverse_siblings(spark, d):
    return paths.PathIndex.build(_tree(spark, d), "parent ^parent").pairs


@query("SELECT 'nation/' || n_nationkey AS src, 'region/' || n_regionkey AS dst FROM nation UNION SELECT 'nation/' || n_nationkey, '=i:' || n_nationkey FROM nation")
def g2_negated_step(spark, d):
    return paths.PathIndex.build(graph(spark, d, "nation"), except_("nation.n_name")).pairs


@query("SELECT 'nation/' || n_nationkey AS src, '=t:' || r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'nation/' || n_nationkey, '=i:' || r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def g2_any_step(spark, d):
    return paths.PathIndex.build(graph(spark, d, "nation", "region"), any_step() >> any_step()).pairs


@query(f"{_UP} SELECT 'customer/' || s AS src FROM up WHERE o = 7")
def g9_reaching(spark, d):
    return paths.PathIndex.build(_tree(spark, d), "parent+").reaching("customer/7")


@query(f"{_UP} SELECT 'customer/' || s AS src, 'customer/' || o AS dst FROM up")
def g10_merged_summaries(spark, d):
    """Arcs of two halves of the edges, united and closed, are the closure of all edges."""
    a = step("parent").plus().compile()
    edges = paths.edges_of(_tree(spark, d), a)
    even = F.pmod(F.xxhash64("src"), F.lit(2)) == 0
    return paths.close(paths.merge_summaries(paths.arcs(edges.where(even), a), paths.arcs(edges.where(~even), a)), a)


@query("SELECT 'orders/' || o_orderkey AS x, c_mktsegment AS y FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 10 = 0 OR c_custkey % 10 = 0")
def i1_pattern_changes(spark, d):
    """Bindings with at least one new fact, where a tenth of each table's entities is new."""
    full = graph(spark, d, "orders", "customer")
    key = F.split_part("e", F.lit("/"), F.lit(2)).cast("bigint")
    facts = full.scan("orders.o_custkey").unionByName(full.scan("customer.c_mktsegment"))
    new = FactSource(facts.where(key % 10 == 0))
    seg, cust = attr("customer.c_mktsegment", "text"), attr("orders.o_custkey", "id")
    return find([x, (y, "text")], delta.pattern_changes([Pattern(full, x, cust, c), Pattern(full, c, seg, y)], FactSource(facts), new))


@query(f"{_UP} SELECT 'customer/' || s AS e, 'customer/' || o AS v FROM up")
def i3_forward_chaining(spark, d):
    """Ancestry by two rules, to quiescence."""
    rule = rules.parse("base: ?x parent ?y => ?x ancestor ?y\n\nstep: ?x ancestor ?y, ?y parent ?z => ?x ancestor ?z\n")
    done = rules.advance(_tree(spark, d).facts(), rule)
    assert done.quiescent
    return done.facts.where("a = 'ancestor'").select("e", "v")


@query("SELECT count(*) AS n FROM nation a JOIN nation b ON contains(a.n_name, b.n_name) AND a.n_name <> b.n_name")
def i4_string_contains_rule(spark, d):
    g = graph(spark, d, "nation")
    a, b = vars_("a b")
    rule = rules.Rule("part", ((x, "nation.n_name", a), (y, "nation.n_name", b)), ((x, "holds", y),), (rules.string_contains(a, b),))
    return folds.count_all(rules.fire(rule, g, None).where("e <> v"), "n")


@query("SELECT count(*) AS made, count(*) AS links FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)")
def i5_constructed_entities(spark, d):
    """One new entity for each pair of nation and segment, however many customers have it."""
    g = graph(spark, d, "customer")
    pairs = find([x, y], pattern(g, (c, {attr("customer.c_nationkey", "id"): x, attr("customer.c_mktsegment", "text"): y}))).distinct()
    src = FactSource(pairs.select(F.col("x").alias("e"), F.lit("market").alias("a"), F.col("y").alias("v"), F.lit(None).cast("bigint").alias("int"), F.lit(None).cast("double").alias("num")))
    made = rules.fire(rules.Rule("m", ((x, "market", y),), ((rules.New("m"), "of", x), (rules.New("m"), "segment", y))), src, None)
    return made.agg(F.count_distinct("e").alias("made"), F.count_if(F.col("a") == "segment").alias("links"))


@query("SELECT 'customer/' || c_custkey AS e, count(*) AS n FROM customer GROUP BY ALL")
def c3_collection_read(spark, d):
    """Two overlapping commits and a third that isn't admitted."""
    store = collections.Collection(spark, _archive_dir(spark))
    t = graph(spark, d, "customer").scan("customer.c_name")
    key = F.split_part("e", F.lit("/"), F.lit(2)).cast("bigint")
    store.commit(t.where(key % 3 < 2), "ann")
    store.commit(t.where(key % 3 > 0), "bob")
    store.commit(t.select(F.concat(F.lit("bad/"), F.col("e")).alias("e"), "a", "v", "int", "num"), "eve")
    grants = spark.createDataFrame([("root", "ann"), ("ann", "bob"), ("other", "eve")], "issuer string, subject string")
    admitted = collections.Policy(("root",)).admitted(store.commits(), grants)
    return store.read(admitted).facts().groupBy("e").agg(F.count("*").alias("n"))


@query("SELECT 'c' || c_custkey AS author FROM customer WHERE (c_custkey % 3 <> 0)::INT + (c_custkey % 4 <> 0 OR c_custkey % 5 = 0)::INT + (c_custkey % 5 = 0)::INT >= 2")
def c5_quorum(spark, d):
    """Two of three roots: the first grants to two thirds of all customers, the second to three quarters, the third to the
    delegate of a fifth; a customer needs two of them."""
    t = table(spark, d, "customer")
    k, name = F.col("c_custkey"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    given = lambda issuer, where: t.where(where).select(F.lit(issuer).alias("issuer"), name.alias("subject"))
    delegate = spark.createDataFrame([("r3", "deputy")], "issuer string, subject string")
    grants = given("r1", k % 3 != 0).unionByName(given("r2", k % 4 != 0)).unionByName(given("deputy", k % 5 == 0)).unionByName(given("nobody", k > 0)).unionByName(delegate)
    extra = given("r2", (k % 4 == 0) & (k % 5 == 0))
    commits = t.select(k.cast("string").alias("commit"), name.alias("author"))
    return collections.Policy(("r1", "r2", "r3"), 2).admitted(commits, grants.unionByName(extra)).select("author")


@query("SELECT r_name AS x, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def c7_derived(spark, d):
    derived = collections.Derivations()
    derived.derive("counts", ("named",), lambda t: t.groupBy("x").agg(F.count("*").alias("n")))
    derived.derive("named", ("customers", "nations", "regions"), lambda a, b, r: a.join(b, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("x")))
    sources = {"customers": table(spark, d, "customer"), "nations": table(spark, d, "nation"), "regions": table(spark, d, "region")}
    return derived.refresh(sources, _archive_dir(spark))["counts"]

