"""Stores, fragments, records, stored indexes, graphs of vectors, drivers and telemetry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from factloom.functions import render, scalar
from factloom.operators import collections, folds, lineage, paths, quantised, registers, search, semantic, vectors
from factloom.operators.neighbours import GraphIndex
from factloom.operators.shared import shared_folder
from factloom.plans.algebra import OwnedIds, Pattern, Var, and_, find, local_ids, pattern, similar, vars_
from factloom.plans.paths import Automaton, Step
from factloom.queries.benchmark import _UP, _tree
from factloom.queries.more_queries import _vectors
from factloom.queries.registry import attr, graph, query, table
from factloom.queries.search_queries import _COS, _POSTINGS, _SCORE
from factloom.queries.state_queries import _events
from factloom.sources import blobs, row_codec, stores
from factloom.sources.facts import Attribute, FactSource, entities, ordered
from factloom.sources.fragments import Fragment
from factloom.streaming import rules, telemetry
from factloom.streaming.driver import CollectionDriver, all_facts

c, x, y, z, a, e = vars_("c x y z a e")
C_SEG, C_NATION = attr("customer.c_mktsegment", "text"), attr("customer.c_nationkey", "id")

# Stores

_BLOBS = "SELECT DISTINCT sha256(text) AS handle, text FROM benchmark WHERE text IS NOT NULL"


def _benchmark(spark, d):
    return table(spark, d, "benchmark").where("text is not null")


@query(f"SELECT handle, strlen(text)::BIGINT AS length, NULL::VARCHAR AS note FROM ({_BLOBS}) UNION ALL SELECT DISTINCT sha256('seen' || chr(31) || item_id), NULL, item_id::VARCHAR FROM benchmark WHERE text IS NOT NULL")
def s29_memory_store(spark, d):
    """Everything is put twice and noted twice."""
    store = stores.MemoryStore(spark)
    for _ in range(2):
        store.put(_benchmark(spark, d), F.col("text"))
        store.note(_benchmark(spark, d), "seen", F.col("item_id"))
    held = blobs.metadata(store.blobs()).select("handle", "length", F.lit(None).cast("string").alias("note"))
    return held.unionByName(store.records().select(F.col("record").alias("handle"), F.lit(None).cast("bigint").alias("length"), F.col("body").alias("note")))


@query(f"SELECT (SELECT count(*) FROM ({_BLOBS})) AS blobs, (SELECT count(*) FROM benchmark WHERE text IS NOT NULL) AS records, 0::BIGINT AS others")
def s31_hybrid_store(spark, d):
    """Blobs in a folder, records in memory; neither holds what the other does."""
    store = stores.HybridStore(stores.FolderStore.create(spark, shared_folder(spark, "store")), stores.MemoryStore(spark))
    store.put(_benchmark(spark, d), F.col("text"))
    store.note(_benchmark(spark, d), "seen", F.col("item_id"))
    n = lambda df, name: folds.count_all(df, name)
    others = store.blob_store.records().select("record").unionByName(store.record_store.blobs().select(F.col("handle").alias("record")))
    return n(store.blobs(), "blobs").crossJoin(n(store.records(), "records")).crossJoin(n(others, "others"))


def _pile(spark, d) -> stores.FolderStore:
    """Nations' names, a blob that refers to those below M, and the regions' names; then some names again, and one that isn't
    what its handle says."""
    store = stores.FolderStore.create(spark, shared_folder(spark, "pile"))
    store.put(table(spark, d, "nation"), F.col("n_name"))
    store.put(table(spark, d, "region"), F.col("r_name"))
    some = table(spark, d, "nation").where("n_nationkey < 7").select(scalar.digest(F.col("n_name")).alias("h"))
    store.put(some.agg(F.unhex(F.array_join(F.sort_array(F.collect_list("h")), "")).alias("b")), F.col("b"))
    store.put(table(spark, d, "nation"), F.col("n_name"))  # all are stored already
    return store


_HANDLES = "SELECT DISTINCT sha256(n_name) AS handle FROM nation WHERE n_nationkey < {0}"
_TOP = f"SELECT sha256(unhex(string_agg(handle, '' ORDER BY handle))) AS handle FROM ({_HANDLES.format(7)})"


@query(f"SELECT handle FROM ({_HANDLES.format(7)}) UNION ALL {_TOP}")
def s32_compaction(spark, d):
    """A new generation keeps what the root reaches; the old one is reclaimed."""
    store = _pile(spark, d)
    some = table(spark, d, "nation").where("n_nationkey < 7").select(scalar.digest(F.col("n_name")).alias("h"))
    root = some.agg(F.unhex(F.array_join(F.sort_array(F.collect_list("h")), "")).alias("b")).select(scalar.digest(F.col("b")).alias("handle"))
    assert store.compact(root) == 1 and store.reclaim() == 1
    return store.blobs().select("handle")


@query("SELECT DISTINCT sha256(r_name) AS handle FROM region")
def s33_subtract(spark, d):
    """What the store has beyond another: the nations and the blob that refers to some are there as well."""
    store, other = _pile(spark, d), stores.MemoryStore(spark)
    other.put(table(spark, d, "nation"), F.col("n_name"))
    found = store.subtract(other)
    return found.where(F.octet_length("bytes") % 32 != 0).select("handle")


@query(f"SELECT handle, 'content' AS reason FROM ({_HANDLES.format(3)}) UNION ALL SELECT handle, 'repeated' FROM ({_HANDLES.format(3)})")
def s33_verify(spark, d):
    """Handles under which other bytes were written beside the right ones."""
    store = _pile(spark, d)
    wrong = store.blobs().join(table(spark, d, "nation").where("n_nationkey < 3").select(scalar.digest(F.col("n_name")).alias("handle")), "handle", "left_semi")
    wrong.withColumn("bytes", F.encode(F.lit("broken"), "UTF-8")).write.mode("append").parquet(f"{store.path}/generation-0/blobs")
    return store.verify()


@query(f"SELECT handle FROM ({_HANDLES.format(1000)}) UNION SELECT sha256(r_name) FROM region UNION {_TOP}")
def s33_capture(spark, d):
    """A captured store doesn't see what is appended later."""
    store = _pile(spark, d)
    snapshot = store.capture()
    store.put(_benchmark(spark, d), F.col("text"))
    return snapshot.blobs().select("handle")


_ROW = "substr(sha256(e), 33, 32) || substr(sha256(a), 33, 32) || sha256(v)"
_CUSTOMERS = "SELECT 'customer/' || c_custkey AS e, unnest(['customer.c_name', 'customer.c_mktsegment']) AS a, unnest(['=t:' || c_name, '=t:' || c_mktsegment]) AS v FROM customer"


def _customer_facts(spark, d):
    g = graph(spark, d, "customer")
    return g.scan("customer.c_name").unionByName(g.scan("customer.c_mktsegment"))


@query(f"SELECT {_ROW} AS row, row_number() OVER (ORDER BY {_ROW}) AS place FROM ({_CUSTOMERS})")
def s19_canonical_rows(spark, d):
    """Rows of 64 bytes, through chunks and back, in order."""
    facts = _customer_facts(spark, d)
    chunks = row_codec.encode(facts.unionByName(facts))
    back = row_codec.decode(chunks).orderBy("chunk", "place").coalesce(1)
    return back.select("row", (F.monotonically_increasing_id() + 1).alias("place"))


@query("SELECT unnest(['order', 'repeated', 'nil entity', 'short']) AS reason, unnest([count(*), count(*), count(*), count(*)]) AS n FROM region")
def s19_validation(spark, d):
    """Chunks of a region each: rows in the wrong order, a row twice, an entity of zeros, and a cut row."""
    h = lambda s: F.sha2(F.concat(F.lit(s), "r_name"), 256)
    row = F.concat(h("e"), h("v"))
    pair = F.array_sort(F.array(row, F.concat(h("f"), h("w"))))
    bad = F.array(F.array_join(F.reverse(pair), ""), F.array_join(F.array_repeat(row, 2), ""), F.concat(F.lit("0" * 32), F.substring(row, 33, 96)), F.substring(row, 1, 100))
    found = None
    for i in range(4):
        for k in range(5):
            chunk = table(spark, d, "region").where(F.col("r_regionkey") == k).select(F.lit(0).cast("bigint").alias("chunk"), F.unhex(bad[i]).alias("bytes"))
            part = row_codec.validate(chunk)
            found = part if found is None else found.unionByName(part)
    return found.groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT 'nation/' || n_nationkey AS e, 'nation.n_name' AS a, '=t:' || n_name AS v, row_number() OVER (ORDER BY 'nation/' || n_nationkey) AS place FROM nation")
def k7_ordered_keys(spark, d):
    facts = ordered(FactSource(graph(spark, d, "nation").scan("nation.n_name"))).coalesce(1)
    return facts.select("e", "a", "v", (F.monotonically_increasing_id() + 1).alias("place"))


@query("SELECT min('customer/' || c_custkey) AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
def k2_first_result(spark, d):
    """One result, made definite by an order."""
    return find([c], Pattern(graph(spark, d, "customer"), c, C_SEG, "BUILDING")).orderBy("c").limit(1)


# Fragments and records


@query("SELECT 'facts' AS part, count(*) AS n FROM supplier UNION ALL SELECT 'meta', 2 UNION ALL SELECT 'blobs', count(DISTINCT s_name) FROM supplier UNION ALL SELECT 'exports', count(*) FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT 'exported', count(*) FROM supplier WHERE s_suppkey % 5 = 0")
def u13_fragments(spark, d):
    """Overlapping parts, united, are the whole."""
    t = table(spark, d, "supplier")
    meta = FactSource(entities(spark.range(1), F.lit("supplier.s_name"), {Attribute.named("attribute.doc", "text"): F.lit("a name")})).facts()
    more = entities(spark.range(1), F.lit("supplier.s_name"), {Attribute.named("attribute.encoding", "text"): F.lit("text")})

    def part(rows):
        facts = entities(rows, F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")), {Attribute.named("supplier.s_name", "text"): F.col("s_name")})
        exports = rows.where("s_suppkey % 5 = 0").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("id"))
        return Fragment(facts, meta, blobs.put(rows, F.col("s_name")), exports)

    whole = (part(t.where("s_suppkey % 3 < 2")) + part(t.where("s_suppkey % 3 > 0"))).describe(more)
    out = None
    for name, df in (("facts", whole.facts), ("meta", whole.meta), ("blobs", whole.blobs), ("exports", whole.exports), ("exported", whole.exported())):
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT 'region/' || min(r_regionkey) AS root, count(*) - 1 AS without FROM region")
def m8_fragment_root(spark, d):
    """A fragment of one export has a root, others don't."""
    t = table(spark, d, "region")
    least = t.agg(F.min("r_regionkey").alias("k"))
    empty = graph(spark, d, "region").facts().where("false")
    store = blobs.put(t.where("false"), F.col("r_name"))
    one = Fragment(empty, empty, store, least.select(F.concat(F.lit("region/"), F.col("k").cast("string")).alias("id")))
    many = Fragment(empty, empty, store, t.select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("id")))
    assert many.root() is None
    return t.agg((F.count("*") - 1).alias("without")).select(F.lit(one.root()).alias("root"), "without")


def _records(spark, d):
    """Each brand is derived from its parts, each type of a brand's last digit merges brands."""
    t = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("p"), F.col("p_brand").alias("b"))
    made = lineage.records(t, "map", F.concat(F.lit("m/"), "p"), F.array(F.concat(F.lit("p/"), "p")), "clean")
    brands = t.groupBy("b").agg(F.collect_list(F.concat(F.lit("m/"), "p")).alias("ps"))
    merged = lineage.records(brands, "merge", F.concat(F.lit("b/"), "b"), F.col("ps"))
    ends = brands.groupBy(F.substring("b", -1, 1).alias("k")).agg(F.collect_list(F.concat(F.lit("b/"), "b")).alias("bs"))
    return made.unionByName(merged).unionByName(lineage.records(ends, "merge", F.concat(F.lit("k/"), "k"), F.col("bs")))


@query("SELECT 'k/' || right(p_brand, 1) AS output, 'p/' || p_partkey AS source FROM part UNION ALL SELECT 'b/' || p_brand, 'p/' || p_partkey FROM part UNION ALL SELECT 'm/' || p_partkey, 'p/' || p_partkey FROM part")
def c2_record_sources(spark, d):
    return lineage.sources(_records(spark, d))


@query("SELECT count(*) + count(DISTINCT p_brand) + count(DISTINCT right(p_brand, 1)) AS records, 0::BIGINT AS conflicts, count(*) FILTER (p_partkey % 2 = 1) AS pending FROM part")
def c2_equal_records(spark, d):
    """Records found again, inputs in another order, are the same; parts to which a function wasn't applied are pending."""
    found = _records(spark, d)
    again = found.where("kind = 'merge'").select("output", F.reverse("inputs").alias("i"))
    both = found.unionByName(lineage.records(again, "merge", F.col("output"), F.col("i"))).distinct()
    t = table(spark, d, "part").select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("m"), "p_partkey")
    done = lineage.records(t.where("p_partkey % 2 = 0"), "derive", F.concat(F.lit("d/"), "m"), F.array("m"), "index")
    counts = [folds.count_all(both, "records"), folds.count_all(lineage.conflicts(both), "conflicts"), folds.count_all(lineage.pending(done, "index", t.select("m")), "pending")]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


@query("SELECT 'user/' || user_id AS register, max(event_id) AS last, list_sort(list(DISTINCT event_type))::VARCHAR AS types, 0::BIGINT AS broken FROM events GROUP BY user_id")
def x11_joined_encodings(spark, d):
    """Values joined by their encodings; joining parts, some of them twice, changes nothing."""
    t = table(spark, d, "events").select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("register"), F.col("event_id").alias("last"), F.array("event_type").alias("types"))
    one = lineage.GREATEST.joined(t, ["register"], "last")
    two = lineage.UNION.joined(t, ["register"], "types").select("register", F.concat(F.lit("["), F.array_join("types", ", "), F.lit("]")).alias("types"))
    broken = lineage.GREATEST.preserves(t, ["register"], "last", F.col("last") % 7).unionByName(lineage.UNION.preserves(t, ["register"], "types", F.col("last") % 5))
    return one.join(two, "register").crossJoin(broken.agg(F.count("*").alias("broken")))


# Paths, registers, constraints


@query(f"{_UP} SELECT 'customer/' || s AS src, 'customer/' || o AS dst FROM up")
def g11_stored_summaries(spark, d):
    """Arcs of overlapping parts of the edges, stored, read back, found whole and closed."""
    kept = paths.PathCollection.create(spark, shared_folder(spark, "paths"), "parent+")
    edges = paths.edges_of(_tree(spark, d), kept.automaton())
    k = F.pmod(F.xxhash64("src"), F.lit(3))
    names = {kept.add(edges.where(w)) for w in (k < 2, k > 0, k > 0)}
    assert len(names) == 2 and kept.audit().isEmpty()
    return kept.close().pairs


@query("SELECT 'customer/' || c_custkey AS src, 'region/' || n_regionkey AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer")
def g4_manual_automaton(spark, d):
    """States and moves written out: a nation, or on to its region."""
    a = Automaton(3, [(0, 1, Step("customer.c_nationkey")), (1, 2, Step("nation.n_regionkey"))], frozenset({1, 2}))
    return paths.close(paths.arcs(paths.edges_of(graph(spark, d, "customer", "nation"), a), a), a)


@query("SELECT 'event/' || event_id AS state FROM events")
def r4_unordered(spark, d):
    """Without an order nothing dominates: all states stay."""
    g = _events(spark, d)
    return registers.resolve(registers.Unordered(), g.scan("register").select(F.col("e").alias("state")))


@query("SELECT 'event/' || event_id AS state FROM events WHERE event_id % 3 = 0 AND event_id NOT IN (SELECT event_id - 300 FROM events WHERE event_id % 3 = 0)")
def i6_rule_heads(spark, d):
    """Events as revisions that replace others: those that none replaces."""
    return rules.heads(_events(spark, d), "observes")


@query("SELECT 'nation/' || n_nationkey AS x, n_name AS y FROM nation WHERE n_nationkey IN (1, 3, 5)")
def p21_local_ids(spark, d):
    """Ids that a writer owns, as a membership set."""
    owner = OwnedIds(spark, "nation/1", "nation/3")
    owner.adopt("nation/5", "nation/3", "nation/1000")
    return find([x, (y, "text")], and_(Pattern(graph(spark, d, "nation"), x, attr("nation.n_name", "text"), y), local_ids(x, owner)))


@query("SELECT 'nation/' || n_nationkey AS x FROM nation WHERE n_nationkey IN (2, 4)")
def j11_owned_ids_propose(spark, d):
    """The owned ids bind the variable themselves; a path over them joins."""
    return find([x], and_(OwnedIds(spark, "nation/2", "nation/4", "nation/2").has(x), Pattern(graph(spark, d, "nation"), x, attr("nation.n_regionkey", "id"), Var("_r"))))


@query("SELECT DISTINCT 'customer/' || c_custkey AS c, c_mktsegment AS x FROM customer WHERE c_nationkey < 5")
def v7_candidate_set(spark, d):
    """Candidates that come several times bind once."""
    rows = table(spark, d, "customer").where("c_nationkey < 5").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("k"))
    return find([c, (x, "text")], and_(similar(rows.unionByName(rows), c), Pattern(graph(spark, d, "customer"), c, C_SEG, x)))


@dataclass
class _EvenKeys:
    """A user's own constraint: ids whose number is even."""

    var: Var

    def variables(self):
        return [self.var.name]

    def to_df(self, known):
        return None

    def filter(self, df):
        return df.where(F.split_part(self.var.name, F.lit("/"), F.lit(2)).cast("bigint") % 2 == 0)


@query("SELECT 'customer/' || c_custkey AS c, c_mktsegment AS x FROM customer WHERE c_custkey % 2 = 0")
def x5_own_constraint(spark, d):
    return find([c, (x, "text")], and_(Pattern(graph(spark, d, "customer"), c, C_SEG, x), _EvenKeys(c)))


@query("SELECT 'customer/' || c_custkey AS c, c_name AS x, length(substr(sha256('19:http://names.org/ctext'), 1, 32)) AS width FROM customer")
def x2_derived_attributes(spark, d):
    """Attributes named by an IRI: the encoding is part of the id, so the number of that IRI is another attribute."""
    t = table(spark, d, "customer")
    text, number = Attribute.derived("http://names.org/c", "text"), Attribute.derived("http://names.org/c", "int")
    assert text.key != number.key
    g = FactSource(entities(t, F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")), {text: F.col("c_name"), number: F.col("c_custkey")}))
    return find([c, (x, "text")], Pattern(g, c, text, x)).withColumn("width", F.lit(len(text.key)))


# Search


@query(f"WITH {_POSTINGS} SELECT doc, round({_SCORE}, 6) AS score FROM post JOIN df USING (term) JOIN len USING (doc), st WHERE term IN ('the', 'de', 'of') GROUP BY doc")
def t13_stored_postings(spark, d):
    """Two segments, stored and read as one index."""
    path, docs = shared_folder(spark, "postings"), table(spark, d, "documents")
    for k in range(2):
        search.Bm25.build(docs.where(F.col("doc_id") % 2 == k), "doc_id", "text").write(f"{path}/{k}")
    return search.Bm25.read(spark, f"{path}/0", f"{path}/1").query(["the", "de", "of"]).select("doc", F.round("score", 6).alias("score"))


@query("WITH tok AS (SELECT 'part/' || p_partkey AS doc, unnest(string_split(lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '|', 'g')), '|')) AS term FROM part) SELECT doc, term, count(*) AS tf FROM tok GROUP BY ALL")
def t14_attribute_index(spark, d):
    """Postings of one text attribute of facts, by the tokenizer of code."""
    return search.Bm25.from_facts(graph(spark, d, "part"), "part.p_type", "code").postings


# Vectors


@query("SELECT count(*) * 10 AS asked, true AS recall_of_nine_tenths FROM embeddings WHERE vec_id % 20 = 0")
def v3_graph_recall(spark, d):
    """The graph index, stored and read back: of the ten nearest of each query, found exactly, it gives nine tenths or more."""
    t, q = _vectors(spark, d)
    path = shared_folder(spark, "graph") + "/index"
    GraphIndex.build(t).write(path)
    near = GraphIndex.read(spark, path).top_k(q, 10).select("query", "handle", F.lit(1).alias("hit"))
    exact = vectors.top_k_per_query(q, t, 10).select("query", "handle")
    both = exact.join(near, ["query", "handle"], "left").agg(F.count("*").alias("asked"), F.count("hit").alias("found"))
    return both.select("asked", (F.col("found") >= 0.9 * F.col("asked")).alias("recall_of_nine_tenths"))


@query(None)
def v5_graph_neighbours(spark, d):
    """Ten neighbours of each query row by the graph index; no SQL, since some are missed."""
    t, q = _vectors(spark, d)
    return GraphIndex.build(t).top_k(q, 10).select("query", "rank", F.col("handle").alias("vec_id"), "cosine")


@query(f"SELECT a.vec_id AS handle, b.vec_id AS neighbour FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) = 1")
def v6_graph_links(spark, d):
    """The lowest layer joins every vector to its nearest, if one shard holds both."""
    t, _ = _vectors(spark, d)
    index = GraphIndex.build(t, shard=1 << 20)
    pairs = index.neighbours().join(t.select("handle", F.col("vec").alias("v")), "handle").join(t.select(F.col("handle").alias("neighbour"), F.col("vec").alias("w")), "neighbour")
    best = F.max(F.struct(vectors.cosine(F.col("v"), F.col("w")).alias("s"), (-F.col("neighbour")).alias("n")))
    return pairs.groupBy("handle").agg(best.alias("b")).select("handle", (-F.col("b.n")).alias("neighbour"))


@query("SELECT vec_id AS handle, 64 AS codes, 4 AS scales, true AS near FROM embeddings")
def m11_quantised_vectors(spark, d):
    """Four bits a component; what they stand for is within 0.02 of the vector's direction."""
    t, _ = _vectors(spark, d)
    got = quantised.derive(t).join(t, "handle")
    near = vectors.cosine(quantised.reconstruct(F.col("q")), F.col("vec")) > 0.98
    return got.select("handle", F.size("q.codes").alias("codes"), F.size("q.scales").alias("scales"), near.alias("near"))


@query(f"SELECT a.vec_id AS query, b.vec_id AS handle, true AS near FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 20 = 0 AND abs({_COS}) <= 2")
def v9_reconstructed_cosines(spark, d):
    """Cosines from two stages of four bits are within 0.06 of the exact ones."""
    t, q = _vectors(spark, d)
    got = quantised.reconstructed_cosines(quantised.derive(t).join(t.withColumnRenamed("vec", "exact"), "handle"), q, beside="exact")
    return got.select("query", "handle", (F.abs(F.col("cosine") - F.col("exact")) <= 0.06).alias("near"))


_LETTERS = "list_transform(range(26), lambda i: (length(lower(t)) - length(replace(lower(t), chr(97 + i::INT), '')))::DOUBLE)"


@query(f"WITH v AS (SELECT item_id AS handle, t, {_LETTERS} AS v FROM (SELECT item_id, text AS t FROM benchmark WHERE text IS NOT NULL)), s AS (SELECT a.handle AS query, b.handle, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS s FROM v a JOIN v b ON true WHERE a.handle % 20 = 0) SELECT query, round(s, 6) AS cosine, row_number() OVER (PARTITION BY query ORDER BY s DESC, handle)::INT AS rank FROM s QUALIFY rank <= 3")
def v10_semantic_search(spark, d):
    """A caller's encoder; here the letters of a text."""
    t = _benchmark(spark, d)
    index = semantic.SemanticIndex.build(t, "item_id", "text", semantic.letters)
    asked = t.where("item_id % 20 = 0").select(F.col("item_id").alias("query"), F.col("text").alias("content"))
    return index.search(asked, 3).select("query", F.round("cosine", 6).alias("cosine"), "rank")


# Encodings, drivers, telemetry


@query("SELECT p_partkey AS k, p_name AS name, p_partkey * 3 - 1000 AS number, p_size::BIGINT AS size, true AS refused FROM part")
def x8_blob_encodings(spark, d):
    """Texts and lists of numbers as blobs and back; a blob cut short is refused."""
    t = table(spark, d, "part")
    text, longs = render.blob_encoding("text"), render.blob_encoding("longs")
    numbers = F.array(F.col("p_partkey") * 3 - 1000, F.col("p_size").cast("bigint"))
    b = t.select(F.col("p_partkey").alias("k"), text.encode(F.col("p_name")).alias("t"), longs.encode(numbers).alias("n"))
    got = b.select("k", text.decode(F.col("t")).alias("name"), longs.decode(F.col("n")).alias("list"), longs.decode(F.substring("n", 1, 9)).isNull().alias("refused"))
    return got.select("k", "name", F.get("list", F.lit(0)).alias("number"), F.get("list", F.lit(1)).alias("size"), "refused")


@query("SELECT 'customer/' || c_custkey AS e, 'customer.c_nationkey' AS a, 'nation/' || c_nationkey AS text FROM customer UNION ALL SELECT 'customer/' || c_custkey, 'customer.c_name', c_name FROM customer UNION ALL SELECT 'customer/' || c_custkey, 'customer.c_custkey', c_custkey::VARCHAR FROM customer")
def x9_rendered_values(spark, d):
    got = render.render(graph(spark, d, "customer").facts())
    return got.where("a in ('customer.c_name', 'customer.c_custkey', 'customer.c_nationkey')")


@query("SELECT event_type AS name, count(*) AS spans, sum(event_id % 50)::BIGINT AS took FROM events GROUP BY event_type")
def m16_spans(spark, d):
    """Events as spans: what each kind took, found in the facts."""
    t = table(spark, d, "events").select(F.concat(F.lit("span/"), F.col("event_id").cast("string")).alias("span"), F.lit(None).cast("string").alias("parent"), F.col("event_type").alias("name"), F.col("event_id").alias("begin"), (F.col("event_id") + F.col("event_id") % 50).alias("end"))
    g = FactSource(telemetry.span_facts(t))
    name, took, s = vars_("name took _s")
    got = find([(name, "text"), (took, "int")], pattern(g, (s, {telemetry.NAME: name, telemetry.TOOK: took})))
    return got.groupBy("name").agg(F.count("*").alias("spans"), F.sum("took").alias("took"))


@query("SELECT event_id AS k, 1000 + event_id * 7 AS at, 5::BIGINT AS spans, 3::BIGINT AS inner_took FROM events")
def m17_virtual_clock(spark, d):
    """Readings for rows, and spans of a driver under a clock that ticks at each reading."""
    log = telemetry.Telemetry(telemetry.VirtualClock(100, 3))
    for _ in range(2):
        with log.span("outer"), log.span("inner"):
            pass
    with log.span("last"):
        log.clock.advance(10)
    facts = log.facts(spark)
    one = facts.agg(F.count_distinct("e").alias("spans"), F.min(F.when(F.col("a") == telemetry.TOOK.key, F.col("int"))).alias("inner_took"))
    return table(spark, d, "events").select(F.col("event_id").alias("k"), telemetry.virtual_times(F.col("event_id"), 1000, 7).alias("at")).crossJoin(one)


def _links(spark, d, where: str):
    """Facts  nation in region,  region in world."""
    t = table(spark, d, "nation").where(where)
    within = Attribute.named("in", "id")
    low = entities(t, F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")), {within: F.concat(F.lit("region/"), F.col("n_regionkey").cast("string"))})
    high = entities(t.select("n_regionkey").distinct(), F.concat(F.lit("region/"), F.col("n_regionkey").cast("string")), {within: F.lit("world")})
    return low.unionByName(high)


@query("SELECT 'nation/' || n_nationkey AS e, 'region/' || n_regionkey AS v FROM nation UNION SELECT 'nation/' || n_nationkey, 'world' FROM nation UNION SELECT 'region/' || n_regionkey, 'world' FROM nation")
def i7_collection_driver(spark, d):
    """Commits, a step, more commits and a step that only seeks what is new, and one that finds nothing to do."""
    path = shared_folder(spark, "driver")
    source, target = collections.Collection(spark, f"{path}/source"), collections.Collection(spark, f"{path}/target")
    driver = CollectionDriver(source, target, rules.parse("base: ?x in ?y => ?x below ?y\n\nstep: ?x below ?y, ?y in ?z => ?x below ?z\n"))
    source.commit(_links(spark, d, "n_nationkey % 2 = 0"), "ann")
    assert driver.step() is not None
    source.commit(_links(spark, d, "n_nationkey % 3 > 0"), "bob")
    source.commit(_links(spark, d, "n_nationkey % 3 = 0"), "bob")
    assert driver.watch(0, 2) == 1
    return all_facts(driver).where("a = 'below'").select("e", "v")


@query("SELECT count(*) AS facts, true AS same, true AS others, 2::BIGINT AS commits FROM nation")
def m14_dependencies(spark, d):
    """A batch committed again is the same commit, so a driver that read it has nothing to do."""
    path = shared_folder(spark, "dependencies")
    source = collections.Collection(spark, f"{path}/source")
    facts = graph(spark, d, "nation").scan("nation.n_name")
    one, two, three = source.commit(facts, "ann"), source.commit(facts.orderBy("v").unionByName(facts), "ann"), source.commit(facts.where("v <> '=t:NATION_1'"), "ann")
    driver = CollectionDriver(source, collections.Collection(spark, f"{path}/target"), [])
    commits = len(driver.dependencies())
    return source.read().facts().agg(F.count("*").alias("facts")).select("facts", F.lit(one == two).alias("same"), F.lit(one != three).alias("others"), F.lit(commits).cast("bigint").alias("commits"))


def _derivations():
    out = collections.Derivations()
    out.derive("named", ("customers", "nations"), lambda a, b: a.join(b, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("x"), "c_acctbal"))
    out.derive("counts", ("named",), lambda t: t.groupBy("x").agg(F.count("*").alias("n")))
    out.derive("others", ("regions",), lambda t: t.select("r_name"))
    return out


@query("SELECT n_name AS x, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0 GROUP BY n_name")
def i9_maintained(spark, d):
    """Sources are read again and again; only what follows from a changed one is computed."""
    path, states = shared_folder(spark, "maintained"), iter(("c_custkey > 0", "c_custkey > 0", "c_custkey % 2 = 0"))
    read = lambda: {"customers": table(spark, d, "customer").where(next(states)), "nations": table(spark, d, "nation"), "regions": table(spark, d, "region")}
    assert _derivations().watch(read, path, 0, 3) == [["named", "counts", "others"], [], ["named", "counts"]]
    return spark.read.parquet(f"{path}/counts")


@query("SELECT n_name AS x, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def m19_rederived(spark, d):
    """A derived table that was lost is made again, with what follows from it."""
    path, made = shared_folder(spark, "rederived"), _derivations()
    sources = {"customers": table(spark, d, "customer"), "nations": table(spark, d, "nation"), "regions": table(spark, d, "region")}
    made.refresh(sources, path)
    spark.range(1).write.mode("overwrite").parquet(f"{path}/named")
    return made.rederive(sources, path, "named")["counts"]


@query("SELECT * FROM (VALUES ('ann', 'read'), ('ann', 'write'), ('bob', 'read'), ('root', 'read'), ('root', 'write')) t(author, \"right\")")
def c6_grants(spark, d):
    """Rights of a stored table of grants: bob may read through ann, whose right to write he has only from eve."""
    path = shared_folder(spark, "grants") + "/grants"
    for row in (("root", "ann", "read"), ("root", "ann", "write"), ("ann", "bob", "read"), ("eve", "bob", "write"), ("root", "ann", "read")):
        collections.grant(spark, path, *row)
    grants = collections.grants_at(spark, path)
    commits = spark.createDataFrame([(n, n) for n in ("root", "ann", "bob", "eve")], collections.COMMIT)
    policy = collections.Policy(("root",))
    return policy.admitted(commits, grants, "read").select("author", F.lit("read").alias("right")).unionByName(policy.admitted(commits, grants, "write").select("author", F.lit("write").alias("right")))
