"""Full-text ranking and vector similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import scalar, text
from factloom.operators import search, vectors
from factloom.plans.algebra import Has, Pattern, and_, find, vars_
from factloom.queries.registry import query, table
from factloom.sources.facts import Attribute, FactSource, entities

e, x = vars_("e x")
BODY = Attribute.named("body", "text")

# The word tokenizer in DuckDB, for texts without symbols beyond ASCII.
_WORDS = r"list_filter(list_transform(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: regexp_replace(w, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g')), lambda w: regexp_matches(w, '[\p{L}\p{N}]'))"
_POSTINGS = f"tok AS (SELECT doc_id AS doc, unnest({_WORDS}) AS term FROM documents), post AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY ALL), len AS (SELECT b.doc_id AS doc, coalesce(sum(tf), 0) AS dl FROM documents b LEFT JOIN post p ON p.doc = b.doc_id GROUP BY b.doc_id), st AS (SELECT count(*) AS n, avg(dl) AS av FROM len), df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"
_SCORE = "sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av)))"


def _index(spark, d, tokenizer: str = "word"):
    return search.Bm25.build(table(spark, d, "documents"), "doc_id", "text", tokenizer)


@query(f"SELECT doc_id AS k, array_to_string({_WORDS}, '|') AS words FROM documents")
def t1_word_tokens(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.array_join(text.hash_tokens(F.col("text")), "|").alias("words"))


@query(f"SELECT k, array_to_string(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]), '|') AS pairs FROM (SELECT doc_id AS k, {_WORDS} AS w FROM documents)")
def t2_bigrams(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.array_join(text.bigram_tokens(F.col("text")), "|").alias("pairs"))


@query("SELECT DISTINCT p_type AS x, lower(regexp_replace(p_type, '[^A-Za-z0-9]+', '|', 'g')) AS parts FROM part")
def t3_code_tokens(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("x"), F.array_join(text.code_tokens(F.col("p_type")), "|").alias("parts")).distinct()


@query("SELECT n_name AS x, len(list_distinct(list_filter(list_transform(generate_series(1, length(n_name)), lambda i: substr(lower(n_name), i::BIGINT, 3)), lambda g: regexp_matches(g, '^[a-z0-9]{3}$'))))::INT AS n FROM nation")
def t4_trigrams(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("x"), F.size(F.array_distinct(text.ngram_tokens(F.col("n_name"), 3))).alias("n"))


@query(f"WITH {_POSTINGS} SELECT doc, term, tf FROM post")
def t5_bm25_postings(spark, d):
    return _index(spark, d).postings


@query(f"WITH {_POSTINGS} SELECT doc, round({_SCORE}, 6) AS score FROM post JOIN df USING (term) JOIN len USING (doc), st WHERE term IN ('the', 'de', 'of') GROUP BY doc")
def k3_bm25_scores(spark, d):
    return _index(spark, d).query(["the", "de", "of"]).select("doc", F.round("score", 6).alias("score"))


@query(f"WITH {_POSTINGS} SELECT doc FROM post JOIN df USING (term) JOIN len USING (doc), st WHERE term IN ('the', 'de') GROUP BY doc HAVING {_SCORE} >= 0.5")
def t9_bm25_matches(spark, d):
    """The floor as a membership constraint in a query."""
    docs = table(spark, d, "documents")
    g = FactSource(entities(docs, F.col("doc_id").cast("string"), {BODY: F.col("text")}))
    hits = _index(spark, d).matches(["the", "de"], 0.5)
    return find([e], and_(Pattern(g, e, BODY, x), Has(e, hits.select(F.col("doc").cast("string"))))).select(F.col("e").cast("bigint").alias("doc"))


@query(f"WITH {_POSTINGS} SELECT doc FROM post WHERE term IN ('the', 'of') GROUP BY doc HAVING count(*) = 2")
def t11_docs_with_all(spark, d):
    return _index(spark, d).with_all(["the", "of"])


@query(f"WITH {_POSTINGS} SELECT term, df FROM df")
def t8_doc_frequency(spark, d):
    return _index(spark, d).doc_frequency()


@query(f"WITH {_POSTINGS} SELECT n AS n_docs, round(av, 9) AS avg_len FROM st")
def t8_statistics(spark, d):
    return _index(spark, d).statistics().select("n_docs", F.round("avg_len", 9).alias("avg_len"))


@query(f"WITH {_POSTINGS} SELECT doc, round({_SCORE}, 6) AS score FROM post JOIN df USING (term) JOIN len USING (doc), st WHERE term = 'the' GROUP BY doc")
def t12_bm25_merge(spark, d):
    """Overlapping segments score as the whole."""
    t = table(spark, d, "documents")
    a, b = (search.Bm25.build(p, "doc_id", "text") for p in (t.where("doc_id % 3 < 2"), t.where("doc_id % 3 > 0")))
    return a.merge(b).query(["the"]).select("doc", F.round("score", 6).alias("score"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'tion of')")
def t15_substring_search(spark, d):
    return search.substring_search(table(spark, d, "documents"), "doc_id", "text", "tion of", _index(spark, d, "trigram"))


@query(f"WITH {_POSTINGS} SELECT doc, string_agg(term || '=' || tf, ' ' ORDER BY term) AS bag FROM post GROUP BY doc")
def m10_reconstruct_documents(spark, d):
    terms = F.transform("terms", lambda t: F.concat(t["term"], F.lit("="), t["tf"].cast("string")))
    return _index(spark, d).reconstruct().select("doc", F.array_join(terms, " ").alias("bag"))


_TEXTS = "texts AS (SELECT DISTINCT text, sha256(text) AS h FROM documents WHERE text IS NOT NULL)"
_TEXT_POSTINGS = _POSTINGS.replace("documents", "texts").replace("doc_id", "h")


@query(f"WITH {_TEXTS}, {_TEXT_POSTINGS}, sc AS (SELECT doc, {_SCORE} AS score FROM post JOIN df USING (term) JOIN len USING (doc), st WHERE term IN ('the', 'of') GROUP BY doc) SELECT doc_id::VARCHAR AS e, round(score, 6) AS score FROM sc JOIN texts ON doc = h JOIN documents d ON d.text = texts.text ORDER BY sc.score DESC, e LIMIT 5")
def k6_best_entities(spark, d):
    g = FactSource(entities(table(spark, d, "documents"), F.col("doc_id").cast("string"), {BODY: F.col("text")}))
    return search.best_entities(g, "body", "the of", 5).select("e", F.round("score", 6).alias("score"))


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query(f"SELECT b.vec_id AS handle, round({_COS}, 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND {_COS} >= 0.2")
def v2_cosine_above(spark, d):
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("handle"), F.col("embedding").alias("vec"))
    return vectors.similar_to_key(t, 0, 0.2).select("handle", F.round("cosine", 6).alias("cosine"))


@query(f"SELECT b.vec_id AS handle, round({_COS}, 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id = 3 ORDER BY {_COS} DESC, handle LIMIT 10")
def k5_cosine_top_k(spark, d):
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("handle"), F.col("embedding").alias("vec"))
    q = t.where("handle = 3").select(F.col("handle").alias("query"), "vec")
    return vectors.top_k_per_query(q, t, 10).select("handle", F.round("cosine", 6).alias("cosine"))


@query(f"SELECT a.vec_id AS query, b.vec_id AS handle, round({_COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 3")
def k5_cosine_top_k_per_query(spark, d):
    """The whole query set: every row whose id 20 divides."""
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("handle"), F.col("embedding").alias("vec"))
    q = t.where("handle % 20 = 0").select(F.col("handle").alias("query"), "vec")
    return vectors.top_k_per_query(q, t, 3).select("query", "handle", F.round("cosine", 6).alias("cosine"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE {_COS} >= 0.1")
def j16_similarity_join(spark, d):
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("handle"), F.col("embedding").alias("vec"))
    pairs = t.select(F.col("handle").alias("a"), (F.col("handle") + 1).alias("b"))
    return vectors.cosine_at_least(pairs, t, "a", "b", 0.1)


_NORM = "sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))"


@query(f"SELECT vec_id AS k, round({_NORM}, 6) AS before, array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE / {_NORM}, 4)::DECIMAL(9, 4)), ' ') AS after FROM embeddings")
def v1_l2_normalize(spark, d):
    t = table(spark, d, "embeddings")
    twice = F.transform("embedding", lambda x: x.cast("double") * 2)
    unit = F.transform(vectors.l2_normalize(twice), lambda x: F.round(x, 4).cast("decimal(9,4)").cast("string"))
    return t.select(F.col("vec_id").alias("k"), F.round(vectors.norm(F.col("embedding")), 6).alias("before"), F.array_join(unit, " ").alias("after"))


@query("SELECT kind, count(*) AS n FROM (SELECT 'text' AS kind FROM pages UNION ALL SELECT 'pdf' FROM pages UNION ALL SELECT 'image' FROM pages) GROUP BY kind")
def v11_classify(spark, d):
    t = table(spark, d, "pages").select(F.explode(F.array(F.encode("html", "UTF-8"), F.concat(F.encode(F.lit("%PDF-1.7"), "UTF-8"), F.encode("html", "UTF-8")), F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode("html", "UTF-8")))).alias("b"))
    return t.groupBy(scalar.classify(F.col("b")).alias("kind")).agg(F.count("*").alias("n"))


