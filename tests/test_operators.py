"""Registers, paths, search, vectors, imports, streaming, rules and collections on small fixtures."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalar, text
from factloom.operators import collections, paths, registers, search, sets, vectors
from factloom.plans.algebra import Pattern, Var, find, pattern, vars_
from factloom.plans.paths import Automaton, Step, any_step, except_, parse, step
from factloom.sources import blobs, json_facts, ntriples
from factloom.sources.facts import FACT_SCHEMA, FactSource
from factloom.streaming import delta, rules

x, y, z = vars_("x y z")


def source(spark, triples):
    return FactSource(spark.createDataFrame([(e, a, v, int(v[3:]) if v.startswith("=i:") else None, None) for e, a, v in triples], FACT_SCHEMA), distinct=False)


def column(df, name=None):
    return sorted(r[name or 0] for r in df.collect())


def states(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "state string")


# Registers


def test_latest_and_forks(spark):
    g = source(spark, [("b", "obs", "a"), ("c", "obs", "a"), ("d", "obs", "c")])
    assert column(registers.latest(g, "obs", states(spark, "a", "b", "c", "d", "lone"))) == ["b", "d", "lone"]
    assert column(registers.resolve(registers.ObservationOrder(g, "obs", first=True), states(spark, "a", "b"))) == ["a"]
    assert column(registers.resolve(registers.Unordered(), states(spark, "a", "a"))) == ["a"]
    heads = registers.Heads.derive(g, "obs")
    late = heads.join(registers.Heads.derive(source(spark, [("a", "obs", "z")]), "obs"))
    assert column(heads.states()) == ["b", "d"] and column(late.states()) == ["b", "d"]  # an old fact revives nothing
    cycle = registers.Heads.derive(source(spark, [("p", "obs", "q"), ("q", "obs", "p")]), "obs")
    assert column(cycle.states()) == []


def test_stated_order(spark):
    g = source(spark, [("s1", "of", "r"), ("s2", "of", "r"), ("s3", "of", "r"), ("s1", "at", "=i:1"), ("s2", "at", "=i:5"), ("s3", "at", "=i:5"), ("free", "of", "r")])
    all_ = states(spark, "s1", "s2", "s3", "free")
    assert column(registers.resolve(registers.StatedOrder(g, "of", "at", by="int"), all_)) == ["free", "s2", "s3"]
    assert column(registers.resolve(registers.StatedOrder(g, "of", "at", by="int", tiebreak_by_id=True), all_)) == ["free", "s3"]
    assert column(registers.resolve(registers.StatedOrder(g, "of", "at", by="int", first=True), all_)) == ["free", "s1"]
    # domination ranges over all states, not the candidates alone
    assert column(registers.resolve(registers.StatedOrder(g, "of", "at", by="int"), states(spark, "s1"))) == []


def test_last_write_wins(spark):
    a = registers.Lww.derive(source(spark, [("s1", "of", "r"), ("s2", "of", "r"), ("s1", "at", "=i:1")]), "of", "at", by="int")
    assert column(a.unresolved()) == ["s2"]
    b = a.join(registers.Lww.derive(source(spark, [("s2", "at", "=i:9")]), "of", "at", by="int"))
    assert [tuple(r) for r in b.winners().collect()] == [("r", "s2", 9)] and column(b.unresolved()) == []
    clash = b.join(registers.Lww.derive(source(spark, [("s2", "at", "=i:3")]), "of", "at", by="int"))
    with pytest.raises(Exception, match="two values"):
        clash.winners().collect()


# Paths


def bfs(edges, automaton, nullable_domain):
    """Accepted pairs by search over vertices and states."""
    moves = {}
    for p, q, s in automaton.moves:
        for a, label, b in edges:
            if s.label == label or s.label is None and label not in s.excluded:
                u, v = (b, a) if s.reverse else (a, b)
                moves.setdefault((u, p), set()).add((v, q))
    out = {(v, v) for v in nullable_domain} if automaton.nullable else set()
    for start in {v for e in edges for v in (e[0], e[2])}:
        seen, todo = set(), [(start, 0)]
        while todo:
            for n in moves.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        out |= {(start, v) for v, q in seen if q in automaton.accepting}
    return out


EXPRESSIONS = ["a", "a b", "(a | b)+", "a*", "a (^b | c)+ a?", "^(a b)", "!a", "!(a | b) c?", ". .", "(a b? c)*"]


@pytest.mark.parametrize("expression", EXPRESSIONS)
def test_closure_against_search(spark, expression):
    rng = random.Random(expression)
    edges = {(f"v{rng.randint(0, 7)}", rng.choice("abc"), f"v{rng.randint(0, 7)}") for _ in range(14)}
    got = paths.PathIndex.build(source(spark, edges), expression)
    vertices = {v for e in edges for v in (e[0], e[2])}
    assert {tuple(r) for r in got.pairs.collect()} == bfs(edges, parse(expression).compile(), vertices)


def test_path_views(spark):
    g = source(spark, [("p", "n", "q"), ("q", "n", "r"), ("r", "n", "p"), ("r", "n", "s")])
    index = paths.PathIndex.build(g, step("n").plus())
    assert index.contains("p", "p") and not index.contains("s", "p") and column(index.diagonal()) == ["p", "q", "r"]
    assert column(index.reachable_from("p")) == ["p", "q", "r", "s"] and column(index.ends()) == ["p", "q", "r", "s"] and column(index.starts()) == ["p", "q", "r"]
    assert find([x], index.constraint(x, x)).count() == 3
    bounded = paths.close(paths.arcs(paths.edges_of(g, step("n").plus().compile()), step("n").plus().compile()), step("n").plus().compile(), rounds=1)
    assert bounded.count() == 4


def test_path_syntax():
    for bad in ("", "a |", "(a", "a)", "!", "*"):
        with pytest.raises(ValueError):
            parse(bad)
    assert (~(step("a") >> step("b"))).compile().moves == (~step("b") >> ~step("a")).compile().moves
    assert parse("<http://x/y> .").compile().moves == (step("http://x/y") >> any_step()).compile().moves
    assert parse("!(a|b)").compile().moves == except_("a", "b").compile().moves
    with pytest.raises(ValueError):
        Automaton(1, [(0, 1, Step("a"))], frozenset())


# Search and vectors


def test_bm25(spark):
    docs = [("1", "the quick brown fox"), ("2", "the lazy brown dog"), ("3", "quick silver fox, FOX!"), ("4", None), ("3", "fox")]
    index = search.Bm25.build(spark.createDataFrame(docs, "id string, t string"), "id", "t")
    got = [tuple(r) for r in index.ranked(["fox"]).collect()]
    n, avg = 4, (4 + 4 + 4 + 0) / 4
    idf = math.log((n - 2 + 0.5) / 2.5 + 1)
    score = lambda tf, dl: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert [d for d, _ in got] == ["3", "1"] and got[0][1] == pytest.approx(score(2, 4)) and got[1][1] == pytest.approx(score(1, 4))
    assert index.query([]).count() == 0 and index.with_all([]) is None and column(index.with_all(["quick", "fox"])) == ["1", "3"]
    twice = {r["doc"]: r["score"] for r in index.query(["fox", "fox"]).collect()}
    assert twice["1"] == pytest.approx(2 * got[1][1])
    empty = search.Bm25.build(spark.createDataFrame([], "id string, t string"), "id", "t")
    assert empty.query(["a"]).count() == 0


def shuffles(df) -> int:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Exchange")


def test_bm25_counts_within_rows(spark):
    """Where each document is one row, its postings, lengths and bags shuffle nothing."""
    docs = spark.createDataFrame([("1", "b a b"), ("2", None), ("3", "!!"), ("4", "c")], "id string, t string")
    index = search.Bm25.build(docs, "id", "t")
    assert [shuffles(x) for x in (index.postings, index.lengths, index.reconstruct())] == [0, 0, 0]
    assert {tuple(r) for r in index.postings.collect()} == {("1", "a", 1), ("1", "b", 2), ("4", "c", 1)}
    assert {tuple(r) for r in index.lengths.collect()} == {("1", 3), ("2", 0), ("3", 0), ("4", 1)}
    assert {r["doc"]: [tuple(t) for t in r["terms"]] for r in index.reconstruct().collect()} == {"1": [("a", 1), ("b", 2)], "4": [("c", 1)]}


def test_bm25_segments(spark, tmp_path):
    """Segments that share documents, in memory or stored, score as one index of all rows; terms are found once a segment."""
    rows = [(i % 7, " ".join(f"w{(i * j) % 5}" for j in range(i % 4 + 1))) for i in range(20)] + [(9, None)]
    whole = search.Bm25.build(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    parts = [search.Bm25.build(spark.createDataFrame(rows[k::2], "id long, t string"), "id", "t") for k in range(2)]
    for k, x in enumerate(parts):
        x.write(str(tmp_path / f"{k}"))
    apart = [search.Bm25.build(spark.createDataFrame([r for r in rows if (r[0] > 3) == k], "id long, t string"), "id", "t") for k in (False, True)]
    for k, x in enumerate(apart):
        x.write(str(tmp_path / f"apart{k}"))
    want = {r["doc"]: round(r["score"], 9) for r in whole.query(["w0", "w1"]).collect()}
    assert len(want) == 7
    for index in (parts[0].merge(parts[1]), parts[1].merge(parts[0]), search.Bm25.read(spark, str(tmp_path / "0"), str(tmp_path / "1")), search.Bm25.read(spark, str(tmp_path / "apart0"), str(tmp_path / "apart1"))):
        assert {r["doc"]: round(r["score"], 9) for r in index.query(["w0", "w1"]).collect()} == want
        assert sorted(map(tuple, index.lengths.collect())) == sorted(map(tuple, whole.lengths.collect()))
    assert shuffles(parts[0].merge(parts[1]).postings) == 1
    assert shuffles(search.Bm25.read(spark, str(tmp_path / "apart0"), str(tmp_path / "apart1")).postings) == 0


def test_best_entities(spark):
    """An entity's best text counts, equal texts are one document, and of texts that score alike the greatest is shown."""
    g = source(spark, [("a", "body", "=t:the cat"), ("a", "body", "=t:the the"), ("b", "body", "=t:the cat"), ("c", "body", "=t:a dog"), ("d", "body", "=t:the dog")])
    got = [(r["e"], round(r["score"], 9), r["snippet"]) for r in search.best_entities(g, "body", "the of", 3).collect()]
    idf = math.log((4 - 3 + 0.5) / 3.5 + 1)
    score = lambda tf: round(idf * tf * 2.5 / (tf + 1.5), 9)
    assert got == [("a", score(2), "the the"), ("b", score(1), "the cat"), ("d", score(1), "the dog")]
    assert search.best_entities(g, "body", "!", 3).count() == 0


def test_words_of_odd_texts(spark):
    """Punctuation within a word stays; U+2028 ends no word, so what stands before it isn't trimmed."""
    texts = ["--a--b--", "x.\u2028", "...", "", "A.\t(b)\x0bC", "-" * 50_000 + "z" + "-" * 50_000 + "y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.words(F.col("t")), text.bigram_tokens(F.col("t"))).collect()
    assert [r[0] for r in rows] == [["a--b"], ["x.\u2028"], [], [], ["a", "b", "c"], ["z" + "-" * 50_000 + "y"]]
    assert [r[1] for r in rows] == [[], [], [], [], ["a b", "b c"], []]


def test_tokenizers(spark):
    df = spark.createDataFrame([("  Hello, (World)! don't -- 2x \U0001f600\U0001f44d\U0001f3fd",), ("parseHTTPResponse2JSON snake_case",), (None,)], "t string")
    t = F.col("t")
    rows = df.select(text.hash_tokens(t), text.bigram_tokens(t), text.code_tokens(t), text.ngram_tokens(t, 3)).collect()
    assert rows[0][0] == ["hello", "world", "don't", "2x", "\U0001f600", "\U0001f44d\U0001f3fd"]
    assert rows[0][1] == ["hello world", "world don't", "don't 2x"]
    assert rows[1][2] == ["parse", "http", "response", "2", "json", "snake", "case"]
    assert rows[0][3][:3] == ["hel", "ell", "llo"] and list(rows[2]) == [[], [], [], []]


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.9, 0.1, 0.0]), ("c", [0.0, 1.0, 0.0]), ("z", [0.0, 0.0, 0.0]), ("a", [0.0, 0.0, 1.0])], "handle string, vec array<float>")
    assert column(vectors.similar_to(df, [1, 0, 0], 0.8)) == ["a", "b"] and vectors.similar_to(df, [1, 0, 0], 1.5).count() == 0
    assert [r["handle"] for r in vectors.top_k(df, [1, 0, 0], 3).collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="NaN"):
        vectors.similar_to(df, [1, 0, 0], float("nan"))
    assert df.select(vectors.l2_normalize(F.col("vec")).alias("v")).collect()[3]["v"] == [0.0, 0.0, 0.0]
    pairs = spark.createDataFrame([("b", "c"), ("b", "a"), ("b", "a")], "p string, q string")
    assert vectors.cosine_at_least(pairs, df, "p", "q", 0.8).count() == 2


# Imports


def test_ntriples(spark):
    lines = [
        '<http://e/s> <http://e/p> <http://e/o> .', '<http://e/s> <http://e/i> "42"^^<http://www.w3.org/2001/XMLSchema#integer> . # note', '<http://e/s> <http://e/i> "x42"^^<http://www.w3.org/2001/XMLSchema#integer> .',
        '<http://e/s> <http://e/t> "a\\t\\"q\\" \\u00e9 \\U0001F600 \\\\n" .', '<http://e/s> <http://e/l> "hallo"@DE .', '<http://e/s2> <http://e/l> "hallo"@de .', '<http://e/s> <http://e/y> "2020"^^<http://www.w3.org/2001/XMLSchema#gYear> .',
        '<http://e/s> <http://e/d> "P1DT2H"^^<http://www.w3.org/2001/XMLSchema#duration> .', '<http://e/s> <http://e/b> "1"^^<http://www.w3.org/2001/XMLSchema#boolean> .', '<http://e/s> <http://e/e> "" .', '<http://e/s> <http://e/x> "bad \\q" .', 'junk', '', '# comment', '<http://e/s> <http://e/p> <http://e/o> .',
    ]
    got = ntriples.parse(spark.createDataFrame([(v,) for v in lines], "value string"))
    vals = {}
    for r in got.facts.collect():
        vals.setdefault(r["a"].rsplit("/", 1)[-1], set()).add(r["v"])
    assert got.triples == 11 and vals["i"] == {"=i:42", "=t:x42"} and vals["t"] == {'=t:a\t"q" é \U0001f600 \\n'} and vals["b"] == {"=b:true"} and vals["e"] == {"=t:"}
    assert vals["y"] == {"=v:1577836800000000000/1609459199999999999"} and vals["d"] == {"=u:93600000000000"} and len(vals["l"]) == 1 and vals["rdf.lang"] == {"=t:de"} and "x" not in vals
    again = ntriples.parse(ntriples.to_lines(got.facts.where("a = 'http://e/t'"), got.uris))
    assert again.facts.count() == 1


def test_blank_nodes(spark):
    parse_ = lambda *v: ntriples.parse(spark.createDataFrame([(t,) for t in v], "value string")).facts
    one = parse_("<http://e/s> <http://e/p> _:a .", "_:a <http://e/q> _:b .", '_:b <http://e/n> "x" .')
    two = parse_('_:q <http://e/n> "x" .', "<http://e/s> <http://e/p> _:z .", "_:z <http://e/q> _:q .")
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()}
    assert parse_("<http://e/s> <http://e/p> _:orphan .").where("v like '\\_:%'").count() == 0
    with pytest.raises(ntriples.BlankNodeCycle):
        parse_("_:a <http://e/p> _:b .", "_:b <http://e/p> _:a .")


def test_json_objects(spark):
    docs = [(1, '{"title": "Dune", "pages": 412, "tags": ["a", "b", "a"], "by": {"name": "F"}, "none": null, "ok": true}'), (2, '{"a": 1, "a": 2}'), (3, '{"a": "\\ud800"}'), (4, "[1]"), (5, '{"a": 1e999}'), (6, "{" * 200), (7, None), (8, '{"by": {"name": "F"}}'), (9, '{"a": NaN}')]
    got = json_facts.import_objects(spark.createDataFrame(docs, "k int, t string"), F.col("k"), F.col("t"))
    by = {r["doc"]: r for r in got.collect()}
    assert {k for k, r in by.items() if r["error"]} == {"2", "3", "4", "5", "6", "9"} and by["7"]["facts"] == []
    facts = {(f["a"], f["v"]) for f in by["1"]["facts"]}
    assert {("title", "=t:Dune"), ("pages", "=f:412.0"), ("tags", "=t:a"), ("tags", "=t:b"), ("ok", "=b:true"), ("name", "=t:F")} <= facts and len(facts) == 7
    g = FactSource(json_facts.facts_of(got))
    assert find([y], pattern(g, (x, {"by": Var("_b")}), (Var("_b"), {"name": y}))).count() == 2
    root = spark.createDataFrame([(by["1"]["roots"][0],)], "r string")
    out = json.loads(json_facts.export(g, root).first()["json"])
    assert out == {"title": "Dune", "pages": 412, "tags": ["a", "b"], "by": {"name": "F"}, "ok": True}


def test_json_export_of_cycles(spark):
    g = source(spark, [("p", "friend", "q"), ("q", "friend", "p"), ("p", "name", "=t:\"é\n"), ("q", "age", "=i:3")])
    out = json.loads(json_facts.export(g, spark.createDataFrame([("p",)], "r string")).first()["json"])
    assert out == {"friend": {"age": 3, "friend": {"$ref": "p"}}, "name": '"é\n'}


def test_json_trees(spark):
    docs = [(1, '{"a": [1.50, null, "x"]}'), (2, ' {"a":[1.50,null,"x"]}'), (3, '{"a": [1.5, null, "x"]}')]
    got = {r["doc"]: r for r in json_facts.import_trees(spark.createDataFrame(docs, "k int, t string"), F.col("k"), F.col("t")).collect()}
    assert got["1"]["roots"] == got["2"]["roots"] != got["3"]["roots"] and "=t:1.50" in {f["v"] for f in got["1"]["facts"]}


def test_blobs(spark):
    store = blobs.put(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string"), F.col("t"))
    assert store.count() == 2 and {r["text"] for r in blobs.text(store).collect()} == {"a", "b"}
    top = blobs.put(store.agg(F.unhex(F.array_join(F.collect_list("handle"), "")).alias("b")), F.col("b"))
    both = blobs.union(store, top)
    assert blobs.bundle(both, top.first()["handle"]).count() == 3 and blobs.children(both).count() == 2


def test_scalars(spark):
    df = spark.createDataFrame([("abcabc", 1)], "t string, i int")
    t = F.col("t")
    row = df.select(scalar.strbefore(t, "c"), scalar.strafter(t, "c"), scalar.strbefore(t, "x"), scalar.strafter(t, "x"), scalar.parse_duration(F.lit("-PT1.5S")), scalar.parse_duration(F.lit("P1M")), scalar.parse_time(F.lit("2020-02-30"), "date"), scalar.parse_time(F.lit("2020-01-01T00:00:00+01:00"), "dateTime")["lower"], scalar.timestamp_distance(F.lit(1), F.lit(2), 8)).first()
    assert list(row) == ["ab", "abc", "", "", -1_500_000_000, None, None, 1577833200000000000, 255]
    with pytest.raises(Exception, match="inexact"):
        df.select(scalar.to_minor(F.lit("1.005").cast("decimal(38,18)"))).collect()


# Streaming, rules, collections


def test_stream_of_changes(spark, tmp_path):
    """Two batches of files; the second completes a pair whose first half came before. A rerun finds nothing new."""
    seen = []
    source_dir, full, check = (str(tmp_path / n) for n in ("in", "full", "check"))

    def put(triples):
        source(spark, triples).facts().coalesce(1).write.mode("append").parquet(source_dir)

    def run():
        incoming = spark.readStream.schema(FACT_SCHEMA).parquet(source_dir)
        ask = lambda f, d: delta.pattern_changes([Pattern(f, x, "knows", y), Pattern(f, y, "lives", z)], f, d)
        delta.stream(spark, incoming, full, ask, [x, z], lambda df, n: seen.extend(tuple(r) for r in df.collect()), check).awaitTermination()

    put([("ann", "knows", "bob"), ("cat", "lives", "=t:rome")])
    run()
    assert seen == []
    put([("bob", "lives", "=t:oslo"), ("ann", "knows", "bob"), ("ann", "knows", "cat")])
    run()
    assert sorted(seen) == [("ann", "=t:oslo"), ("ann", "=t:rome")]
    run()
    assert len(seen) == 2


def test_rules(spark):
    facts = source(spark, [(f"n{i}", "next", f"n{i + 1}") for i in range(6)] + [("n6", "next", "n0")]).facts()
    book = "one: ?x next ?y => ?x far ?y\n\ntwo: ?x far ?y, ?y next ?z => ?x far ?z, *pair from ?x, *pair text \"a \\\"b\\\", c\"\n"
    parsed = rules.parse(book)
    assert rules.parse(rules.write(parsed)) == parsed
    done = rules.advance(facts, parsed)
    far = done.facts.where("a = 'far'")
    assert done.quiescent and far.count() == 49 and done.facts.where("a = 'text'").count() == 7 * 49 // 7
    some = rules.advance(facts, parsed, budget=1)
    assert not some.quiescent and some.rounds == 1
    with pytest.raises(ValueError, match="bound by nothing"):
        rules.Rule("bad", ((x, "a", y),), ((x, "b", z),))
    with pytest.raises(ValueError):
        rules.parse("no arrow here")
    more = rules.advance(done.facts.unionByName(source(spark, [("n6", "next", "m")]).facts()), parsed, delta=source(spark, [("n6", "next", "m")]).facts())
    assert more.facts.where("a = 'far' and v = 'm'").count() == 7


def test_rule_heads(spark):
    assert column(rules.heads(source(spark, [("r2", "replaces", "r1"), ("r3", "replaces", "r1")]), "replaces")) == ["r2", "r3"]


def test_collections(spark, tmp_path):
    store = collections.Collection(spark, str(tmp_path / "c"))
    a, b = source(spark, [("p", "k", "=i:1")]).facts(), source(spark, [("p", "k", "=i:1"), ("q", "k", "=i:2")]).facts()
    one = store.commit(a, "ann")
    assert store.commit(a, "ann") == one and store.commit(b, "bob") != one and store.commits().count() == 2
    assert store.read().facts().count() == 2
    only = collections.Policy(("ann",)).admitted(store.commits())
    assert store.read(only).facts().count() == 1 and collections.Policy().admitted(store.commits()).count() == 2
    with pytest.raises(ValueError):
        collections.Policy(("a",), 2)


def test_derivations(spark, tmp_path):
    d = collections.Derivations()
    d.derive("b", ("a",), lambda a: a.select((F.col("id") + 1).alias("id")))
    d.derive("c", ("b",), lambda b: b.agg(F.sum("id").alias("s")))
    d.derive("other", ("z",), lambda z: z)
    assert d.order({"a"}) == ["b", "c"]
    out = d.refresh({"a": spark.range(3), "z": spark.range(1)}, str(tmp_path))
    assert out["c"].first()["s"] == 6
    d.derive("x", ("y",), lambda y: y)
    d.derive("y", ("x",), lambda x: x)
    with pytest.raises(ValueError, match="from itself"):
        d.order()


def test_digests(spark):
    a = source(spark, [(f"e{i}", "k", f"=i:{i}") for i in range(50)])
    assert sets.missing(a.facts(), a.facts()).count() == 0
    assert sets.digests(a.facts(), 1).agg(F.sum("n")).first()[0] == 50




# Grammars


def test_grammar():
    from factloom.operators import grammar as g

    leaf = g.Construction("leaf", lambda n, c: isinstance(n, str), (), lambda i: i.node)
    item = g.Construction("item", lambda n, c: isinstance(n, dict), (g.Constituent(g.Field("v"), g.Child("leaf")), g.Constituent(g.Field("note"), g.Drop("a note"), optional=True)), lambda i: {"item": i.parts[0][0]})
    all_ = g.Construction("list", lambda n, c: isinstance(n, list), (g.Constituent(g.Each(), g.Child("item")),), lambda i: i.parts[0])
    book = g.Grammar([leaf, item, all_])
    assert book.cover([{"v": "a"}, {"v": "b", "note": [1]}], "list") == ([{"item": "a"}, {"item": "b"}], [])
    image, found = book.cover([{"v": "a", "x": "y"}, {}, {"v": [1]}], "list")
    assert image is None and [f.path for f in found] == ["$[0]", "$[1]", "$[2].v"] and "leaves" in found[0].problem and "lacks" in found[1].problem
    twice = g.Grammar([leaf, leaf, item, all_])
    assert twice.count([{"v": "a"}], "list") == 2 and "2 constructions" in twice.cover([{"v": "a"}], "list")[1][0].problem
    with pytest.raises(ValueError, match="twice"):
        g.Grammar([g.Construction("x", lambda n, c: True, (g.Constituent(g.Field("a"), g.Bind()), g.Constituent(g.EachField(), g.Bind())), lambda i: None)])
    context = g.Construction("pair", lambda n, c: isinstance(n, dict), (g.Constituent(g.EachField(), g.Child(lambda n, c, m: "leaf:" + m)),), lambda i: len(i.parts[0]))
    assert g.Grammar([g.Construction("leaf", lambda n, c: n == c.split(":")[1], (), lambda i: i.category), context]).count({"a": "a", "b": "b"}, "pair") == 1


def test_approximate_neighbours(spark):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(200)]
    rows += [(1000 + i, [x + rng.gauss(0, 0.1) for x in v]) for i, v in rows[:60]]
    df = spark.createDataFrame(rows, "handle long, vec array<double>")
    q = df.where("handle < 60").select(F.col("handle").alias("query"), "vec")
    got = {(r["query"], r["handle"]) for r in vectors.approximate_pairs(q, df, 0.9, 16).collect()}
    want = {(r["query"], r["handle"]) for r in vectors.top_k_per_query(q, df, 260).where("cosine >= 0.9").collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_reconstructed_vectors_are_near(spark):
    """No cosine with a quantised vector is off by more than the distance from its direction, which is below 0.06."""
    from factloom.operators import quantised

    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * rng.choice([1, 1, 1, 30]) for _ in range(64)]) for i in range(300)] + [(300, [0.0] * 64), (301, [1.0]), (302, [5e-9] * 20 + [1.0]), (303, None), (304, [1.0, None]), (305, [float("nan")]), (306, [])]
    t = spark.createDataFrame(rows, "handle long, vec array<double>")
    got = quantised.derive(t).join(t, "handle").select("handle", vectors.l2_normalize(F.col("vec")).alias("u"), vectors.l2_normalize(quantised.reconstruct(F.col("q"))).alias("v"))
    off = {r["handle"]: math.dist(r["u"], r["v"]) for r in got.collect()}
    assert set(off) == {*range(303), 306} and max(off.values()) < 0.03


def test_pairs_are_a_plain_scan(spark, monkeypatch):
    from factloom.operators import nearest

    monkeypatch.setattr(nearest, "PAIRS", 2000)
    t = _odd_vectors(spark).where("handle >= 250")
    t = t.unionByName(t.where("handle < 260").select("handle", F.reverse("vec").alias("vec"))).withColumn("w", F.reverse("vec"))
    q = t.where("handle % 5 = 0").select(F.col("handle").alias("query"), "vec")
    got = nearest.pairs(q, t, ["vec", "w"]).groupBy("query", "handle").agg(F.max("c0").alias("a"), F.max("c1").alias("b"), F.count("*").alias("n"))
    two = q.distinct().withColumnRenamed("vec", "q").crossJoin(t)
    want = two.groupBy("query", "handle").agg(F.max(vectors.cosine(F.col("q"), F.col("vec"))).alias("a"), F.max(vectors.cosine(F.col("q"), F.col("w"))).alias("b"))
    rounded = lambda df: {(r["query"], r["handle"], *[x if x is None else round(x, 9) for x in (r["a"], r["b"])]) for r in df.collect()}
    assert rounded(got) == rounded(want)


def test_graph_of_a_large_shard(spark, monkeypatch):
    """Shards beyond what a task links get the links that one task finds."""
    from factloom.operators import nearest, neighbours

    rng = random.Random(8)
    t = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)] + [(401, None)], "handle long, vec array<double>")
    shape = lambda index: sorted((r["shard"], r["number"], r["handle"], r["vec"], r["layers"]) for r in index.rows.collect())
    whole = [shape(neighbours.GraphIndex.build(t, m=3, shard=n)) for n in (1000, 150)]
    assert max(len(r[4]) for r in whole[0]) > 2
    monkeypatch.setattr(neighbours, "WHOLE", 50)
    monkeypatch.setattr(nearest, "SIDE", 64 * 6)
    assert [shape(neighbours.GraphIndex.build(t, m=3, shard=n)) for n in (1000, 150)] == whole


def test_walks_in_step_are_walks(monkeypatch):
    import numpy as np

    from factloom.operators import neighbours

    rng = np.random.default_rng(2)
    v = rng.normal(size=(700, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    layers = neighbours.layers_of(v, 4, 1)
    q = rng.normal(size=(40, 12))
    for k, ef in ((3, 8), (10, 40), (1, 1)):
        want = [{x for _, x in neighbours.walk(one, v, layers, k, ef)} for one in q]
        exact = [set(np.argsort(-(v @ one))[:k].tolist()) for one in q]
        hits = lambda got: sum(len(x & y) for x, y in zip(got, exact))
        for together in (1, 8):
            monkeypatch.setattr(neighbours, "TOGETHER", together)
            i, j = neighbours.walks(q, v, layers, k, ef)
            got = [set(j[i == n].tolist()) for n in range(40)]
            if together == 1:
                assert got == want
            else:
                assert all(len(x) == k for x in got) and hits(got) >= 0.95 * hits(want)
    i, j = neighbours.walks(q, v[:1], [[[]]], 5, 9)
    assert i.tolist() == list(range(40)) and set(j.tolist()) == {0}


def test_json_texts_of_a_batch_are_parsed_once(spark, monkeypatch):
    """Equal texts, nulls and refused texts keep their own rows; arrays keep their order across batches."""
    import pyarrow as pa

    calls = []
    docs = [("a", '{"k": 1}'), ("b", None), ("c", '{"k": 1}'), ("d", "{"), ("e", '{"k": 1}'), ("f", "{")]

    class Frame:  # what _parsed asks of a table, to see the texts that its function parses
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return pa.Table.from_batches(run(iter([pa.RecordBatch.from_pydict({"doc": [d for d, _ in docs], "text": pa.array([t for _, t in docs], pa.string())})])))

    def parse(text):
        calls.append(text)
        return json_facts.object_facts(text)

    got = json_facts._parsed(Frame(), F.col("doc"), F.col("text"), parse).to_pylist()
    assert len(calls) == 2
    one = json_facts.object_facts('{"k": 1}')
    want = {'{"k": 1}': (one[0], [dict(zip(["e", "a", "v", "int", "num"], f)) for f in one[1]], False), None: ([], [], False), "{": ([], [], True)}
    assert [(r["doc"], r["roots"], r["facts"], r["error"] is not None) for r in got] == [(d, *want[t]) for d, t in docs]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(d, i, f"c{(i * 7) % 5}") for d in ("x", "y", "z") for i in range(8 if d == "x" else 2)]
        made = json_facts.array_node(spark.createDataFrame(rows[::-1], "doc string, index long, child string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    child = {r["e"]: r["v"] for r in made if r["a"] == "json.value"}
    index = {r["e"]: r["int"] for r in made if r["a"] == "json.index"}
    for d in ("x", "y", "z"):
        items = sorted((index[r["v"]], child[r["v"]]) for r in made if r["doc"] == d and r["a"] == "json.item")
        assert items == [(i, c) for e, i, c in rows if e == d]
    assert len({r["array"] for r in made}) == 2  # y and z are equal


def test_many_rows_are_dealt_to_many_tasks(spark, monkeypatch, tmp_path):
    """However few files and partitions a session has, a task makes no more than so many rows distinct."""
    from factloom.operators import shared
    from factloom.sources import facts

    for m in (shared, facts):
        monkeypatch.setattr(m, "ROWS", 20)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.range(0, 400, 1, 1).selectExpr("id % 300 AS x")
    got = shared.distinct(df, 400, "x")
    assert got.count() == 300 and max(r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 60
    kept = shared.cut(df.distinct(), 400)
    assert kept.count() == 300 and spark.conf.get("spark.sql.shuffle.partitions") == before
    with pytest.raises(Exception, match="nothing"):
        shared.cut(df.select(F.raise_error(F.lit("nothing"))), 400)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    g = source(spark, [(f"e{i % 90}", "k", f"=i:{i % 90}") for i in range(100)]).scan("k").coalesce(1)
    facts.write_archive(g, str(tmp_path / "a"))
    assert facts.read_archive(spark, str(tmp_path / "a")).facts().count() == 90 and len(list((tmp_path / "a" / "a=k").glob("*.parquet"))) > 4
    # the closure of a chain of 60 links, with repeated facts, by rules
    chain = source(spark, [(f"n{i}", "parent", f"n{i + 1}") for i in range(60)] * 2).facts()
    done = rules.advance(chain, rules.parse("base: ?x parent ?y => ?x ancestor ?y\n\nstep: ?x ancestor ?y, ?y parent ?z => ?x ancestor ?z\n"))
    assert done.quiescent and done.facts.count() == done.facts.distinct().count() == 60 + 60 * 61 // 2


def test_lines_without_blank_nodes_are_not_searched(spark, monkeypatch):
    def never(_):
        raise AssertionError

    with monkeypatch.context() as m:
        m.setattr(ntriples, "resolve_blank_nodes", never)
        lines = spark.createDataFrame([('<a:x> <a:p> "1" .',), ("<a:x> <a:q> <a:y> .",)] * 3, "value string")
        assert ntriples.parse(lines).facts.count() == 2
        with pytest.raises(AssertionError):
            ntriples.parse(lines.unionByName(spark.createDataFrame([("<a:x> <a:q> _:b .",)], "value string")))


def _odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]) for i in range(300)]  # many ties
    rows += [(300, None), (301, [1.0, None, 2.0]), (302, [0.0] * 3), (303, [1e-170] * 3), (304, [1e170, 1.0, 1.0]), (305, [1.0, 2.0]), (306, []), (307, [float("nan"), 1.0, 1.0]), (308, [float("inf"), 0.0, 1.0])]
    return spark.createDataFrame(rows, "handle long, vec array<double>")


@pytest.mark.parametrize("k", [1, 3, 400])
def test_nearest_is_a_plain_scan(spark, monkeypatch, k):
    """Blocks smaller than the input, ties, vectors of other lengths, null, not finite or of no length: as a scan of all pairs."""
    from pyspark.sql import Window

    from factloom.operators import nearest

    monkeypatch.setattr(nearest, "SIDE", 64 * 3)
    monkeypatch.setattr(nearest, "PRODUCTS", 2000)
    t = _odd_vectors(spark)
    q = t.where("handle % 5 = 0 or handle >= 300").select(F.col("handle").alias("query"), "vec")
    got = vectors.top_k_per_query(q, t, k)
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    pairs = q.withColumnRenamed("vec", "q").crossJoin(t).select("query", "handle", vectors.cosine(F.col("q"), F.col("vec")).alias("cosine"))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "handle"))).where(F.col("rank") <= k)
    assert sorted(map(tuple, got.select("query", "rank", "handle", "cosine").collect())) == sorted(map(tuple, want.select("query", "rank", "handle", "cosine").collect()))


def test_approximate_top_k_is_the_best_of_the_pairs(spark, monkeypatch):
    from pyspark.sql import Window

    from factloom.operators import nearest

    monkeypatch.setattr(nearest, "SIDE", 64 * 3)
    t = _odd_vectors(spark)
    t = t.unionByName(t.where("handle < 40").select("handle", F.reverse("vec").alias("vec")))  # several rows of a key
    q = t.where("handle % 5 = 0").select(F.col("handle").alias("query"), "vec")
    got = vectors.approximate_top_k(q, t, 4, 3, tables=5, bits=3)
    near = vectors.approximate_pairs(q, t, -1.0, 3, tables=5, bits=3)
    want = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "handle"))).where("rank <= 4")
    assert sorted(map(tuple, got.select("query", "rank", "handle", "cosine").collect())) == sorted(map(tuple, want.select("query", "rank", "handle", "cosine").collect()))
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString()


def test_recall_of_approximate_top_k(spark):
    """The approximate query gives nine of ten true neighbours of every row whose id 20 divides, with right cosines."""
    from factloom.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = {(r["query"], r["vec_id"]): r["cosine"] for r in QUERIES["v4_approximate_neighbours"](spark, sf).collect()}
    t = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("handle"), F.col("embedding").alias("vec"))
    q = t.where("handle % 20 = 0").select(F.col("handle").alias("query"), "vec")
    want = {(r["query"], r["handle"]): r["cosine"] for r in vectors.top_k_per_query(q, t, 10).collect()}
    assert {a for a, _ in got} == {a for a, _ in want} and len(want) == 250
    assert len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got.keys() & want.keys())


def test_sole_or_fork_of_whole_registers(spark):
    """Every user of the events has a row, with as many survivors as a plain count finds."""
    from factloom.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts").collect()
    last: dict = {}
    for r in rows:
        if r["event_id"] % 10 != 7:
            last[r["user_id"]] = max(last.get(r["user_id"], r["ts"]), r["ts"])
    want: dict = {}
    for r in rows:
        if r["event_id"] % 10 == 7 or r["ts"] == last[r["user_id"]]:
            want[f"user/{r['user_id']}"] = want.get(f"user/{r['user_id']}", 0) + 1
    got = {r["register"]: (r["kind"], r["n"]) for r in QUERIES["r3_sole_or_fork"](spark, sf).collect()}
    assert got == {k: ("sole" if n == 1 else "fork", n) for k, n in want.items()}


def test_timestamp_distance_of_all_events(spark):
    """Also of events far before the stamp, where the distance wraps around."""
    from factloom.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    keys = [r["event_id"] for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id").collect()]
    got = {r["k"]: r["dist"] for r in QUERIES["f24_timestamp_distance"](spark, sf).collect()}
    assert got == {k: (k - 5000) % 1024 for k in keys} and min(got) < 3976


def test_top_k_of_the_whole_query_set(spark):
    from factloom.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    want = {r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").collect()}
    got = QUERIES["k5_cosine_top_k_per_query"](spark, sf).groupBy("query").count().collect()
    assert {r["query"] for r in got} == want and {r["count"] for r in got} == {3}
