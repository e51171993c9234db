"""Stores, codecs, graph and quantised vectors, lines in the JVM, closures that rules spell."""

import random
from types import SimpleNamespace as N

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import lineage, paths, quantised, shared, vectors
from factloom.operators.neighbours import GraphIndex
from factloom.plans.algebra import Var
from factloom.plans.paths import step
from factloom.sources import blobs, ntriples, row_codec, stores
from factloom.sources.facts import Attribute, FactSource, entities
from factloom.streaming import rules


def test_lines_in_the_jvm(spark):
    """Both parsers take the same lines apart in the same way."""
    lines = [
        "<http://a> <http://b> <http://c> .", "<http://a> <http://b> \"plain\" .", "<a><b>\"x\"@en-GB.", "_:n1 <b> _:n.2-é .# note", '<a> <b> "" .', "<> <> <> .",
        '<a> <b> "1"^^<http://www.w3.org/2001/XMLSchema#integer> . # "end"', '<a> <b> "tab\\t\\u00e9 \\"q\\"" .', '<a> <b> "bad\\q" .', "<a> <b> <c>", "<a> <b> <c> . x", "<a b> <c> <d> .",
        '<a> <b> "with \x01 mark" .', "\t <a>\t<b>\t<c>\t.\t", "# a remark", "", "_:x. <b> <c> .", '<a> <b> "x"^^<d>@en .', '<a> <b> "日本   x" .', None,
    ]
    df = spark.createDataFrame([("d", x) for x in lines], "doc string, value string")
    got = sorted(map(str, (tuple(r)[1:] for r in ntriples._terms(df).collect())))
    assert got == sorted(str(t) for x in lines if x is not None and (t := ntriples.parse_line(x)) is not None)


def test_rules_that_spell_a_closure(spark):
    """With cycles and facts of the closure that come from elsewhere, the same as round by round."""
    rng = random.Random(3)
    link = Attribute.named("in", "id")
    pairs = spark.createDataFrame([(f"n{rng.randint(0, 20)}", f"n{rng.randint(0, 20)}") for _ in range(25)], "a string, b string")
    extra = spark.createDataFrame([("other", "n3")], "a string, b string")
    facts = entities(pairs, F.col("a"), {link: F.col("b")}).unionByName(entities(extra, F.col("a"), {Attribute.named("below", "id"): F.col("b")}))
    some = rules.parse("base: ?x in ?y => ?x below ?y\n\nstep: ?y in ?z, ?x below ?y => ?x below ?z\n")
    assert rules.chains(some) == [("below", "in")] and rules.chains(some[1:]) == [] and rules.chains([*some, rules.Rule("r", ((Var("x"), "p", Var("y")),), ((Var("x"), "in", Var("y")),))]) == []
    fast, slow = rules.advance(facts, some), rules._advance(facts, some, None, None)
    rows = lambda x: {tuple(r) for r in x.facts.where("a = 'below'").select("e", "v").collect()}
    assert rows(fast) == rows(slow) and fast.quiescent


def test_path_collection_audit(spark, tmp_path):
    kept = paths.PathCollection.create(spark, str(tmp_path / "p"), "in (on | in)*")
    edges = spark.createDataFrame([("a", "in", "b"), ("b", "on", "c"), ("c", "in", "a")], "src string, label string, dst string")
    kept.add(edges)
    assert kept.audit().isEmpty() and {tuple(r) for r in kept.close().pairs.collect()} == {(x, y) for x in "ac" for y in "abc"}
    spark.createDataFrame([("a", 7, "b", 9), (None, 0, "b", 1)], paths.SUMMARY).write.parquet(str(tmp_path / "p" / "arcs" / "part=bad"))
    assert {r["part"]: r["n"] for r in kept.audit().collect()} == {"bad": 2}
    index = kept.close()
    index.write(str(tmp_path / "index"))
    assert paths.PathIndex.read(spark, str(tmp_path / "index")).contains("a", "c") and step("in").plus().compile().states == 2


def test_graph_index(spark):
    """Walks find nine tenths of the nearest in several shards; odd vectors take no part."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(900)]
    odd = [(None, [1.0] * 24), (2000, None), (2001, []), (2002, [None] + [1.0] * 23), (5, rows[5][1])]
    t = spark.createDataFrame(rows + odd, "handle long, vec array<double>")
    q = t.where("handle % 20 = 0 and handle < 900").select(F.col("handle").alias("query"), "vec")
    index = GraphIndex.build(t, m=8, shard=300)
    assert index.rows.count() == 900
    near = index.top_k(q, 10, ef=80)
    exact = vectors.top_k_per_query(q, t.where("handle < 900").dropDuplicates(["handle"]), 10)
    assert near.join(exact.select("query", "handle"), ["query", "handle"], "left_semi").count() >= 0.9 * 450
    assert near.where("rank = 1 and query <> handle").count() == 0
    assert GraphIndex.build(t.where("false")).top_k(q, 3).count() == 0


def test_quantised_vectors(spark):
    rows = [(1, [0.0] * 5), (2, None), (3, [1.0, float("nan")]), (4, []), (5, [6.0, -3.0, 0.4] + [0.0] * 20 + [1e-6])]
    t = spark.createDataFrame(rows, "handle long, vec array<double>")
    got = {r["handle"]: r["v"] for r in t.select("handle", quantised.reconstruct(quantised.quantise(F.col("vec"))).alias("v")).collect()}
    assert got[1] == [0.0] * 5 and got[2] is None and got[3] is None and got[4] == [] and got[5][:2] == pytest.approx([6.0, -3.0]) and len(got[5]) == 24


def test_row_codec(spark):
    facts = spark.createDataFrame([("e" * 32, "x", str(i)) for i in range(9000)], "e string, a string, v string")
    chunks = row_codec.encode(facts)
    assert chunks.agg(F.max(F.octet_length("bytes"))).first()[0] <= row_codec.ROW * row_codec.CHUNK and row_codec.validate(chunks).isEmpty()
    assert {r[0] for r in row_codec.decode(chunks).select("row").collect()} == {r[0] for r in row_codec.row_hex(facts).collect()}
    twice = chunks.unionByName(chunks.withColumn("chunk", F.col("chunk") + (1 << 50)))
    assert {r["reason"] for r in row_codec.validate(twice).collect()} <= {"order", "repeated"} and not row_codec.validate(twice).isEmpty()
    assert row_codec.encode(facts.where("false")).isEmpty()


def test_folder_store(spark, tmp_path):
    store = stores.FolderStore.create(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "x string")
    for _ in range(2):
        store.put(df, F.col("x"))
        store.note(df, "k", F.col("x"))
    assert store.blobs().count() == 2 and store.records().count() == 2 and store.verify().isEmpty()
    assert store.compact() == 1 and store.generation() == 1 and store.reclaim() == 1 and store.reclaim() == 0
    assert {r["text"] for r in blobs.text(store.blobs()).collect()} == {"a", "b"} and store.records().count() == 2
    assert stores.Snapshot(spark, ()).blobs().isEmpty() and stores.MemoryStore(spark).blobs().isEmpty()


def test_records(spark):
    df = spark.createDataFrame([("o", ["b", "a", "b"]), (None, ["x"]), ("p", None)], "o string, i array<string>")
    one = lineage.records(df, "merge", F.col("o"), F.col("i"))
    assert [tuple(r)[3:] for r in one.collect()] == [("o", ["a", "b"])]
    other = lineage.records(df.where("o = 'o'"), "merge", F.lit("q"), F.array(F.lit("a"), F.lit("b")))
    assert lineage.conflicts(one.unionByName(other)).count() == 1
    with pytest.raises(ValueError):
        lineage.records(df, "join", F.col("o"), F.col("i"))


def test_folders_on_a_cluster():
    """Without a shared folder a cluster's work is an error; local mode makes its own."""
    far = N(conf=N(get=lambda *_: None), sparkContext=N(master="yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(far, "x")
    near = N(conf=N(get=lambda *_: "hdfs://a/b/"), sparkContext=N(master="yarn"))
    assert shared.shared_folder(near, "x").startswith("hdfs://a/b/x-") and FactSource is not None
