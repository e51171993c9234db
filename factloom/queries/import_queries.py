"""Import and export: N-Triples, JSON objects and trees, blobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import scalar
from factloom.operators import folds
from factloom.operators.shared import cut, shared_folder
from factloom.plans.algebra import Pattern, Range, Var, and_, find, pattern, vars_
from factloom.queries.registry import graph, query, table
from factloom.sources import blobs, json_facts, ntriples
from factloom.sources.facts import FactSource

e, x, y, z = vars_("e x y z")
_BASE = "http://example.org/"


def _iri(name: str, key):
    return F.concat(F.lit(f"<{_BASE}{name}/"), key.cast("string"), F.lit(">"))


def _customer_lines(spark, d):
    """Each customer as four lines, one with a language, and one line that is no triple."""
    t = table(spark, d, "customer")
    subject = _iri("customer", F.col("c_custkey"))
    def line(p, obj):
        return F.concat(subject, F.lit(f" <{_BASE}{p}> "), obj, F.lit(" ."))
    lines = F.array(
        line("name", F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))),
        line("nation", _iri("nation", F.col("c_nationkey"))),
        line("balance", F.concat(F.lit('"'), F.col("c_acctbal").cast("string"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#double>'))),
        line("segment", F.concat(F.lit('"'), F.col("c_mktsegment"), F.lit('"@en'))),
        F.concat(subject, F.lit(" is not a triple")),
    )
    return t.select(F.explode(lines).alias("value"))


@query("SELECT 4 * count(*) AS triples, 3 * count(*) + count(*) + 2 * count(DISTINCT c_mktsegment) AS facts, count(*) + count(DISTINCT c_nationkey) + 4 AS uris FROM customer")
def s6_ntriples_counts(spark, d):
    got = ntriples.parse(_customer_lines(spark, d))
    return folds.count_all(got.terms, "triples").crossJoin(folds.count_all(got.facts, "facts")).crossJoin(folds.count_all(got.uris, "uris"))


@query("SELECT 'http://example.org/customer/' || c_custkey AS uri, c_name || chr(10) || '\"é' AS x FROM customer")
def s9_ntriples_files(spark, d):
    """Lines with escapes, written to files and read from there."""
    path = shared_folder(spark, "lines") + "/nt"
    name = F.concat(F.lit('"'), F.col("c_name"), F.lit('\\n\\"\\u00e9"'))
    lines = table(spark, d, "customer").select(F.concat(_iri("customer", F.col("c_custkey")), F.lit(f" <{_BASE}name> "), name, F.lit(" . # a remark")).alias("value"))
    lines.write.text(path)
    got = ntriples.read(spark, path)
    return find([e, (x, "text")], Pattern(FactSource(got.facts), e, _BASE + "name", x)).join(got.uris, F.col("e") == F.col("id")).select("uri", "x")


@query("SELECT 'http://example.org/customer/' || c_custkey AS uri, c_name AS x, c_acctbal AS y, c_mktsegment AS z FROM customer WHERE c_acctbal >= 0")
def s10_ntriples_query(spark, d):
    got = ntriples.parse(_customer_lines(spark, d))
    g = FactSource(got.facts)
    seg = Var("_seg")
    where = and_(pattern(g, (e, {_BASE + "name": x, _BASE + "balance": y, _BASE + "segment": seg}), (seg, {ntriples.RDF_TEXT: z, ntriples.RDF_LANG: "en"})), Range(y, 0.0, None))
    found = find([e, (x, "text"), (y, "float"), (z, "text")], where)
    return found.join(got.uris, F.col("e") == F.col("id")).select("uri", "x", "y", "z")


@query("SELECT r_name AS x, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def s12_blank_nodes(spark, d):
    """Each nation refers to a blank node for its region; equal content makes one node of them all."""
    t = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    b = F.concat(F.lit("_:b"), F.col("n_nationkey").cast("string"))
    lines = t.select(F.explode(F.array(F.concat(_iri("nation", F.col("n_nationkey")), F.lit(f" <{_BASE}in> "), b, F.lit(" .")), F.concat(b, F.lit(f' <{_BASE}name> "'), F.col("r_name"), F.lit('" .')))).alias("value"))
    g = FactSource(ntriples.parse(lines).facts)
    return find([(x, "text")], pattern(g, (e, {_BASE + "in": y}), (y, {_BASE + "name": x}))).groupBy("x").agg(F.count("*").alias("n"))


@query("SELECT '<http://example.org/nation/' || n_nationkey || '> <http://example.org/name> \"' || n_name || '\" .' AS value FROM nation")
def s_ntriples_round_trip(spark, d):
    lines = table(spark, d, "nation").select(F.concat(_iri("nation", F.col("n_nationkey")), F.lit(f' <{_BASE}name> "'), F.col("n_name"), F.lit('" .')).alias("value"))
    got = ntriples.parse(lines)
    return ntriples.to_lines(got.facts, got.uris)


@query("SELECT event_id::VARCHAR AS doc, CASE WHEN event_id % 7 IN (0, 1) THEN NULL ELSE json_extract(props, '$.k')::DOUBLE END AS k, event_id % 7 IN (0, 1) AS refused FROM events")
def s14_json_objects(spark, d):
    """Each event's properties; a seventh of them are cut short and a seventh name a field twice, which is refused."""
    k = F.col("event_id") % 7
    props = F.when(k == 0, F.substring("props", 1, 5)).when(k == 1, F.concat(F.lit('{"k": 1, '), F.substring("props", 2, 1000))).otherwise(F.col("props"))
    got = json_facts.import_objects(table(spark, d, "events"), F.col("event_id"), props)
    return got.select("doc", F.get("facts", F.lit(0))["num"].alias("k"), F.col("error").isNotNull().alias("refused"))


@query("SELECT (SELECT count(DISTINCT props) FROM events) AS ids, 2 * (SELECT count(DISTINCT props) FROM events) AS salted, (SELECT count(*) FROM events) AS deep")
def s15_json_options(spark, d):
    """Another salt makes other ids of equal content; deeper documents than allowed are refused."""
    t = table(spark, d, "events")
    one = json_facts.facts_of(json_facts.import_objects(t, F.col("event_id"), F.col("props")))
    two = json_facts.facts_of(json_facts.import_objects(t, F.col("event_id"), F.col("props"), salt="other"))
    deep = json_facts.import_objects(t, F.col("event_id"), F.concat(F.lit('{"a": '), F.col("props"), F.lit("}")), depth=1)
    ids = folds.count_distinct(one, "e", name="ids").crossJoin(folds.count_distinct(one.unionByName(two), "e", name="salted"))
    return ids.crossJoin(deep.agg(F.count_if(F.col("error").isNotNull()).alias("deep")))


@query("SELECT user_id::VARCHAR AS doc, string_agg(value, ',' ORDER BY event_id) AS texts FROM (SELECT user_id, event_id, json_extract(props, '$.k')::VARCHAR AS value FROM events) GROUP BY user_id")
def s17_json_arrays(spark, d):
    """An array node of each user's numbers, in the order of the events, read back."""
    t = table(spark, d, "events")
    number = F.get_json_object("props", "$.k")
    nodes = json_facts.import_trees(t.withColumn("n", number), F.col("event_id"), F.col("n"))
    child = nodes.select(F.col("doc").cast("bigint").alias("event_id"), F.get("roots", F.lit(0)).alias("child"), "facts")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    placed = t.join(child, "event_id").select(F.col("user_id").cast("string").alias("doc"), place.cast("bigint").alias("index"), "child")
    made = cut(json_facts.array_node(placed))  # read four times
    texts = json_facts.facts_of(nodes).where("a = 'json.text'").select(F.col("e").alias("child"), F.substring("v", 4, 100).alias("text"))
    items = made.where("a = 'json.item'").select("array", F.col("v").alias("entry"))
    index = made.where("a = 'json.index'").select("array", F.col("e").alias("entry"), F.col("int").alias("i"))
    value = made.where("a = 'json.value'").select("array", F.col("e").alias("entry"), F.col("v").alias("child"))
    arrays = items.join(index, ["array", "entry"]).join(value, ["array", "entry"]).distinct().join(texts, "child")
    read = arrays.groupBy("array").agg(F.sort_array(F.collect_list(F.struct("i", "text"))).alias("t")).select("array", F.array_join(F.transform("t", lambda r: r["text"]), ",").alias("texts"))
    return made.select("doc", "array").distinct().join(read, "array").select("doc", "texts")


@query("SELECT event_id::VARCHAR AS e, json_extract(props, '$.k')::BIGINT AS x FROM events WHERE json_extract(props, '$.k')::BIGINT >= 50")
def s14_json_flat(spark, d):
    facts = FactSource(json_facts.flat_facts(table(spark, d, "events"), F.col("event_id"), F.col("props"), "k bigint"))
    return find([e, (x, "int")], and_(Pattern(facts, e, "k", x), Range(x, 50, None)))


@query("SELECT event_id::VARCHAR AS doc, 'object' AS kind, 'k' AS key, json_extract(props, '$.k')::VARCHAR AS text FROM events")
def s16_json_trees(spark, d):
    """Each document's tree: its object, the member's key and the number as written."""
    got = json_facts.import_trees(table(spark, d, "events"), F.col("event_id"), F.col("props"))
    facts = FactSource(cut(json_facts.facts_of(got)))
    root, member, value = vars_("root _m _v")
    kind, key, text = vars_("kind key text")
    where = pattern(facts, (root, {"json.kind": kind, "json.member": member}), (member, {"json.key": key, "json.value": value}), (value, {"json.text": text}))
    found = find([root, (kind, "text"), (key, "text"), (text, "text")], where)
    return got.select("doc", F.get("roots", F.lit(0)).alias("root")).join(found, "root").select("doc", "kind", "key", "text")


@query("""SELECT 'nation/' || n_nationkey AS root, '{"nation.n_name":"' || n_name || '","nation.n_nationkey":' || n_nationkey || ',"nation.n_regionkey":{"region.r_name":"' || r_name || '","region.r_regionkey":' || r_regionkey || '}}' AS json FROM nation JOIN region ON n_regionkey = r_regionkey""")
def s18_json_export(spark, d):
    g = graph(spark, d, "nation", "region")
    roots = g.scan("nation.n_name").select("e")
    return json_facts.export(g, roots)


@query("SELECT sha256(text) AS handle, strlen(text)::BIGINT AS length FROM benchmark UNION SELECT sha256(text), strlen(text)::BIGINT FROM benchmark")
def s26_blobs(spark, d):
    t = table(spark, d, "benchmark").select("text")
    return blobs.metadata(blobs.union(blobs.put(t, F.col("text")), blobs.put(t, F.col("text")))).select("handle", "length")


@query("SELECT handle, strlen(text)::BIGINT AS length, 'kept' AS what FROM (SELECT DISTINCT text, sha256(text) AS handle FROM benchmark) WHERE handle < '8' UNION ALL SELECT handle, strlen(text)::BIGINT, 'left' FROM (SELECT DISTINCT text, sha256(text) AS handle FROM benchmark) WHERE handle >= '8'")
def s27_blob_keep_forget(spark, d):
    store = blobs.put(table(spark, d, "benchmark"), F.col("text"))
    some = store.where("handle < '8'").select("handle")
    kept, left = blobs.metadata(blobs.keep(store, some)), blobs.metadata(blobs.forget(store, some))
    return kept.select("handle", "length", F.lit("kept").alias("what")).unionByName(left.select("handle", "length", F.lit("left").alias("what")))


_LEAVES = "SELECT DISTINCT sha256(n_name) AS handle FROM nation"


@query(f"SELECT handle FROM ({_LEAVES}) UNION ALL SELECT sha256(unhex(string_agg(handle, '' ORDER BY handle))) FROM ({_LEAVES})")
def s28_blob_children(spark, d):
    """A blob that holds the handles of all others reaches them, and nothing else of the store."""
    leaves = blobs.put(table(spark, d, "nation"), F.col("n_name"))
    root = leaves.agg(F.unhex(F.array_join(F.sort_array(F.collect_list("handle")), "")).alias("b"))  # 25 handles
    top = blobs.put(root, F.col("b"))
    store = blobs.union(leaves, top, blobs.put(table(spark, d, "region"), F.col("r_name")))
    return blobs.reachable(store, top.select("handle"))


@query(f"SELECT handle, true AS whole FROM ({_LEAVES}) UNION ALL SELECT sha256(unhex(string_agg(handle, '' ORDER BY handle))), true FROM ({_LEAVES})")
def m4_bundle(spark, d):
    """The root's blob with all that it refers to, each of them whole."""
    leaves = blobs.put(table(spark, d, "nation"), F.col("n_name"))
    top = blobs.put(leaves.agg(F.unhex(F.array_join(F.sort_array(F.collect_list("handle")), "")).alias("b")), F.col("b"))
    store = blobs.union(leaves, top, blobs.put(table(spark, d, "region"), F.col("r_name")))
    return blobs.bundle(store, top.select("handle")).select("handle", (scalar.digest(F.col("bytes")) == F.col("handle")).alias("whole"))


@query("SELECT 'json.k' AS a, 'float' AS encoding, count(DISTINCT props) AS n FROM events")
def m9_import_metadata(spark, d):
    got = json_facts.facts_of(json_facts.import_objects(table(spark, d, "events"), F.col("event_id"), F.col("props")))
    return json_facts.attributes_seen(got).select(F.concat(F.lit("json."), F.col("a")).alias("a"), "encoding", "n")


