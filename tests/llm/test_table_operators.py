"""Chat formatting, HTML extraction, exact top-k, mixing and the pipeline: brute force and edge cases."""

import math
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm import chat_format, html_wrapper, mixing, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# Chat formatting


def formatted(spark, rows, schema="conv_id long, turn long, role string, text string"):
    df = chat_format.format_conversations(spark.createDataFrame(rows, schema), chat_format.text_parts(F.col("text")))
    return {r["conv_id"]: r for r in df.select("*", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss")).alias("learnt")).collect()}


def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\\0", "\\1", "0", "1", "2", "<", "[", "\n", "é", "\U0001f389", "ok", " ", "image:0]"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem", None, "<s>", "\\3"]), "".join(rng.choices(bits, k=rng.randint(0, 9))) if rng.random() > 0.1 else None) for c in range(60) for t in range(rng.randint(1, 8))]
    rng.shuffle(rows)
    got = formatted(spark, rows)
    by = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        by[c].append((role or "", text or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == by
    for c, r in got.items():
        assert r["learnt"] == "".join(t for role, t in by[c] if role == "assistant")
        raw = "".join(r["formatted"][s["start"] : s["start"] + s["chars"]] for s in r["loss"])
        for code, plain in (("\\2", "["), ("\\1", "<"), ("\\0", "\\")):
            raw = raw.replace(code, plain)
        assert raw == r["learnt"] and r["formatted"].count("</s>") == len(by[c])


def test_chat_parts(spark):
    parts = [[("text", "see <s>", None, None), ("image", None, "a.png", None), ("text", None, None, None), ("audio", None, "b.wav", 42), ("image", None, None, None), (None, "end", None, None)], None]
    df = spark.createDataFrame([(1, 0, "user", parts[0]), (1, 1, "assistant", parts[1]), (2, None, None, [])], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    got = {r["conv_id"]: r for r in chat_format.format_conversations(df, F.col("parts")).collect()}
    assert got[1]["formatted"] == "<s>user\nsee \\1s>[image:0][audio:1][image:2]end</s><s>assistant\n</s>"
    assert [tuple(a) for a in got[1]["attachments"]] == [(0, 0, "image", "a.png", 1, 576), (0, 1, "audio", "b.wav", 3, 42), (0, 2, "image", None, 4, 576)]
    assert got[1]["n_tokens_attached"] == 1194 and got[2]["formatted"] == "<s>\n</s>" and got[2]["loss"] == []


def test_chat_odd(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, 3, "assistant", "b"), (1, 3, "assistant", "a"), (1, None, "assistant", "first"), (2, 0, "user", "x" * 200_000)]
    got = formatted(spark, rows)
    assert len(got[None]["turns"]) == 2 and got[1]["learnt"] == "firstab" and len(got[2]["formatted"]) == 200_012
    assert formatted(spark, []) == {}
    clash = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1)).withColumn("start", F.lit(1))
    assert chat_format.format_conversations(clash, chat_format.text_parts(F.col("text"))).count() == 3


# HTML extraction


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}<script>var a='</p><p>no'; x<y</script></head><body>{body}</body></html>"


@pytest.mark.parametrize("body,want", [
    ("<nav>menu</nav><article><h1>A &amp; b</h1><p>One  <b>two</b>\n three<p>four&nbsp;five<ul><li>six<li>seven</ul></article><footer>f</footer>", "A & b\nOne two three\nfour five\nsix\nseven"),
    ("<article><p>x<br>y<!-- no --></p><aside>side</aside><form><p>in</p></form><div class='ad-box'>buy</div><p title='a>b'>z</p></article>", "x y\nz"),
    ("<main><p>text</p><section id='comments'><p>reader</p></section></main><div class='cookie-notice'>c</div>", "text"),
    ("<div class='sidebar'><p>side side</p></div><div id='content'><h2>Head</h2><p>A long main text that fills the page with words.</p></div><div class='footer'>f</div>", "Head\nA long main text that fills the page with words."),
    ("<article><p>a &lt;b&gt; &#x41;&#66; &unknown; c</p><style>p{}</style><pre>k  l</pre></article>", "a <b> AB &unknown; c\nk l"),
    ("<article><header><h1>Title</h1></header><p>unclosed <i>italic", "Title\nunclosed italic"),
    ("<header>site</header><article><p>1</p></article><article class='comment'><p>no</p></article>", "1"),
    ("<article><p>seen</p><p hidden>a</p><p style='display: none'>b</p><div aria-hidden='true'>c</div></article>", "seen"),
    ("<div class='page with-sidebar'><div class='text'><p>The main text of this page is here.</p></div><div class='sidebar'>side</div></div>", "The main text of this page is here."),
    ("<div class='widget'><p>All of the text stands in a widget.</p></div><nav>menu</nav>", "All of the text stands in a widget."),
    ("", ""), ("<article></article>", ""), ("plain & simple < text", "plain & simple < text"),
])
def test_main_text(body, want):
    assert html_wrapper.main_text(page(body), None) == want


def test_wrapper_drops_constant_blocks(spark):
    """Without any mark, what all pages of a host share is template; a host whose pages are all alike keeps its text."""
    rng = random.Random(2)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    rows, want = [], {}
    for i in range(12):
        text = [say(12) for _ in range(rng.randint(1, 4))]
        rows.append((i, f"https://one.example/{i}", page("<div><div>Home of One</div><div>" + "".join(f"<p>{t}</p>" for t in text) + "</div><div>All rights reserved</div></div>")))
        want[i] = "\n".join(text)
    for i in range(12, 20):
        rows.append((i, "https://two.example/x", page("<article><p>always the same text</p></article>")))
        want[i] = "always the same text"
    rows += [(30, None, None), (31, "nonsense", ""), (32, "https://one.example/7", rows[7][2]), (33, "https://one.example/7", "<<<>>> \x00 <p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in html_wrapper.extract(df.repartition(3)).collect()}
    assert len(got) == 24 and all(got[i]["text"] == t for i, t in want.items()), [(got[i]["text"], t) for i, t in want.items() if got[i]["text"] != t][:2]
    assert got[32]["text"] == want[7] and got[30]["text"] == "" and got[31]["n_chars"] == 0 and got[0]["host"] == "clash"
    assert html_wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_joined_when_large(spark, monkeypatch):
    monkeypatch.setattr(html_wrapper, "BROADCAST_BYTES", -1)
    rows = [(i, f"https://h{i % 3}.example/", page(f"<article><p>text {i}</p></article>")) for i in range(9)]
    got = html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in got.collect()} == {i: f"text {i}" for i in range(9)}


def tree(label, *children, text=None):
    w = html_wrapper.Wrapper(label, text=text)
    w.children = list(children)
    w.finish()
    return w


def test_simple_tree_matching():
    a = tree("r", tree("a", text=1), tree("b", text=5), tree("c", text=1), text=0)
    b = tree("r", tree("b", text=6), tree("d", text=1), tree("c", text=1), text=0)
    m = html_wrapper.merge(a, b)
    assert [(x.label, x.pages, x.text) for x in m.children] == [("a", 1, 1), ("b", 2, None), ("d", 1, 1), ("c", 2, 1)]


def test_alignment_is_the_best():
    """The weight of an alignment against a search of all alignments; flat rows give the same tree."""
    rng = random.Random(5)

    def grown(depth):
        return tree(rng.choice("ab"), *[grown(depth - 1) for _ in range(rng.randint(0, 3) if depth else 0)])

    def best(x, y):
        if not x or not y:
            return 0
        most = max(best(x[1:], y), best(x, y[1:]))
        if x[0].label == y[0].label:
            most = max(most, 1 + best(x[0].children, y[0].children) + best(x[1:], y[1:]))
        return most

    for _ in range(200):
        a, b = tree("r", *[grown(2) for _ in range(3)]), tree("r", *[grown(2) for _ in range(3)])
        assert html_wrapper._weight(a, b, {}) == 4 * (1 + best(a.children, b.children))
        m = html_wrapper.merge(a, b)
        assert m.size == a.size + b.size - 1 - best(a.children, b.children)
        assert html_wrapper.flat(html_wrapper.raised(html_wrapper.flat(m))) == html_wrapper.flat(m)


def test_deep_and_broken_pages():
    """Ten thousand open elements and a megabyte of broken markup take seconds, and text is kept."""
    for text, want in [
        ("<div>" * 10_000 + "deep" + "</div>" * 10_000 + "<p>after", "deep\nafter"), ("<div class='ad'>" * 800 + "x", "x"),
        ("<p a=" * 200_000, "<p a=" * 199_999 + "<p a="), ("<b>" * 5000 + "</x>" * 100_000 + "t", "t"),
        ("<title>" * 30_000 + "t", "t"), ("<p " + "a" * 1_000_000 + ">t", "t"), ("<p>" + "word " * 200_000, ("word " * 200_000).strip()),
    ]:
        began = time.perf_counter()
        w = html_wrapper.skeleton(html_wrapper.parse(text))
        both = html_wrapper.merge(w, html_wrapper.raised(html_wrapper.flat(w)))
        assert html_wrapper.main_text(text, None) == want == html_wrapper.main_text(text, both)
        assert time.perf_counter() - began < 20


def test_classes_alone_drop_no_article_text():
    for body, want in [
        ("<article><p>Hi</p><div class='related-work'><p>Body section</p></div></article>", "Hi\nBody section"),
        ("<article><p>Hi</p><div class='share-price'>Up 3</div><object>fallback</object></article>", "Hi\nUp 3\nfallback"),
        ("<article><p>Hi</p><div class='ad'>buy</div><div id='commentList'>no</div></article>", "Hi"),
    ]:
        assert html_wrapper.main_text(page(body), None) == want


def whole_wrapper(texts):
    """One host's wrapper, as the job makes it, without Spark."""
    found = {}
    for t in texts:
        w = html_wrapper.skeleton(html_wrapper.parse(t))
        found[w.shape] = html_wrapper.merge(found[w.shape], w) if w.shape in found else w
    out = None
    for _, w in sorted(found.items()):
        out = w if out is None else html_wrapper.merge(out, w)
    return out


def test_slots_alone_choose_the_content(spark):
    """On the supplied pages the aligned trees alone, without a mark, give the text that the marks give."""
    by = defaultdict(list)
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(html_wrapper.host(F.col("url")).alias("h"), "html").collect():
        by[r["h"]].append(r["html"])
    tried = 0
    for texts in by.values():
        w = whole_wrapper(texts)
        if w.pages >= html_wrapper.SUPPORT:
            for t in texts:
                tried += 1
                assert html_wrapper.main_text(t, w, marks=False) == html_wrapper.main_text(t, None) != ""
    assert tried > 140


def test_wrappers_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    parts = ["<div><ul><li>a</ul></div>", "<div class='x1'><p>b</div>", "<section><h3>c</h3></section>", "<div><p>d<p>e</div>", "<table><tr><td>f</table>"]
    rows = [(i, "https://mixed.example/", page("".join(rng.choices(parts, k=rng.randint(1, 6))) + f"<div><h1>t{i}</h1><p>body {i}</p></div>")) for i in range(60)]
    found = []
    for n in (1, 3, 8):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)
        found.append([tuple(r) for r in html_wrapper.wrappers(df).collect()])
    assert found[0] == found[1] == found[2] and len(found[0]) == 1


def test_wrapper_keeps_every_node(spark):
    """However many nodes come before it, an article of constant inline text isn't taken for a leaf."""
    rows = []
    for i in range(8):
        odd = "".join(f"<div class='{chr(97 + i)}{chr(97 + j % 26)}{chr(97 + j // 26)}'><p>x</p></div>" for j in range(80))
        rows.append((i, "https://wide.example/", page(f"{odd}<article><h1>title {i}</h1><div><div><p>body {i}</p></div></div><section><p>Signed by all</p></section></article>")))
    got = html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))
    assert {r["page_id"]: r["text"] for r in got.collect()} == {i: f"title {i}\nbody {i}" for i in range(8)}


def test_pages_are_aligned_as_learnt(spark):
    """A page without an optional constant block keeps the block of the same label that stands in its place."""
    with_note = [(i, "https://note.example/", page(f"<article><h1>title {i}</h1><p>Note to all</p><h2>part {i}</h2><p>body {i}</p></article>")) for i in range(9)]
    without = [(i, "https://note.example/", page(f"<article><h1>title {i}</h1><p>body {i}</p></article>")) for i in range(9, 12)]
    want = {i: f"title {i}\npart {i}\nbody {i}" for i in range(9)} | {i: f"title {i}\nbody {i}" for i in range(9, 12)}
    got = html_wrapper.extract(spark.createDataFrame(with_note + without, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in got.collect()} == want
    template = html_wrapper.raised([[0, "", 9, 0, 0], [1, "p", 9, 5, 9], [1, "h1", 9, None, 90]])
    roots, constant, _ = html_wrapper.located(html_wrapper.skeleton(html_wrapper.parse("<p>of this page</p><h1>title</h1>")), template)
    assert [r.tag for r in roots] == [""] and constant == set()


# Exact top-k


def brute_topk(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {(i, tuple(v)) for i, v in good if i % 3 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q[1], v)), i) for i, v in good if i != q[0])[:k]
        out += [(q[0], n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [16_384, 20])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.0, 0.5, -0.25, rng.uniform(-2, 2)]) for _ in range(6)]) for i in range(150)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (204, [float("nan")] * 6), (207, [float("inf")] * 6), (None, [1.0] * 6), (210, []), (213, [1.0, 2.0]), (216, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("rank", F.lit(1))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 3 == 0).collect())
    assert got == brute_topk(rows, 5)


def test_top_k_small(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (3, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 3 == 0).collect())) == [(0, 1, 1, 131072), (0, 2, 3, -65536), (3, 1, 0, -65536), (3, 2, 1, -131072)]
    assert topk.top_k(df.where("false"), F.lit(True)).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), F.lit(True)).count() == 0


# Mixing


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        level = (total - sum(3 * sizes[s] for s in full)) / max(1e-9, sum(w[s] for s in names if s not in full))
        more = {s for s in names if s not in full and w[s] * level > 3 * sizes[s] + 1e-9}
        if not more:
            return {s: 3 * sizes[s] if s in full else w[s] * level for s in names}
        full |= more


def mixing_docs(spark, seed=4):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))), "en", rng.choice(["s1", "s1", "s1", "s2", "s3", "S4", "é5", None]), 0) for i in range(600)]
    return rows + [(900, None, None, "empty", None), (901, "word", None, "tiny", None), (902, "a b", None, "tiny2", None), (None, "x y z", "en", None, 1), (5, "x y z", "en", "s1", 1), (5, "x y z", "en", "s1", 1)]


def test_mixing(spark):
    rows = mixing_docs(spark)
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("bucket", F.lit("clash"))
    got = mixing.sampled(df).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    goal = brute_targets(sizes)
    taken = defaultdict(int)
    longest = max(len((r[1] or "").split()) for r in rows)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= longest for s in goal), (taken, goal)
    again = mixing.sampled(df.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mixing_takes_rows(spark):
    df = spark.createDataFrame(mixing_docs(spark), DOCS)
    got, took = mixing.mixed(df), mixing.sampled(df)
    assert got.agg(F.sum("taken")).first() == took.agg(F.sum("taken")).first()
    assert got.count() == took.where("taken > 0").count() and got.where("taken <> times * size").count() == 0


def test_mixing_odd(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.sampled(empty).count() == 0 and mixing.mixed(empty).count() == 0
    nothing = spark.createDataFrame([(1, None, None, None, None), (2, "", None, "a", 0)], DOCS)
    assert [r["taken"] for r in mixing.sampled(nothing).collect()] == [0, 0]


def test_sampling_favours_quality(spark):
    """Of two kinds of documents of one source the one of higher quality weight is picked more often."""
    rows = [(i, "word " * 10 if i % 2 else "12|34 " * 10, "en", s, 0) for i in range(2000) for s in ["s1" if i % 4 < 2 else "s2"]]
    got = mixing.sampled(spark.createDataFrame(rows, DOCS), weights=(1.0, 9.0)).where("source = 's1'")
    good = got.where("doc_id % 2 = 1").agg(F.sum("taken")).first()[0]
    bad = got.where("doc_id % 2 = 0").agg(F.sum("taken")).first()[0]
    assert good > 3 * bad


def test_quality_is_learnt(spark):
    """Cells whose labelled texts are good are picked more often; clashing columns stay; low weights spread over buckets."""
    rows = [(i, "word " * 10 if i % 2 else "12|34 " * 10, "en", "s1" if i % 4 < 2 else "s2", 0) for i in range(2000)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = docs.where("doc_id % 5 = 0").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).unionByName(spark.createDataFrame([(None, 1), (3, None), (5, 1)], "doc_id long, quality int"))
    got = mixing.sampled(docs, weights=(1.0, 9.0), labels=labels).where("source = 's1'")
    assert got.where("doc_id % 2 = 1").agg(F.sum("taken")).first()[0] > 3 * got.where("doc_id % 2 = 0").agg(F.sum("taken")).first()[0]
    clash = docs.select("*", *[F.lit("mine").alias(c) for c in ("text_hash", "n_words", "copy", "key", "k", "bucket", "a.b")])
    took = mixing.mixed(clash, labels=labels.where("false"))
    assert took.columns == [*clash.columns, "size", "taken", "times"] and took.where("copy = 'mine' and `a.b` = 'mine'").count() == took.count() > 0
    poor = spark.createDataFrame([(i, "1234 " * (1 + i % 7), "en", f"s{i % 2}", 0) for i in range(4000)], DOCS)  # weights of 0.05
    found = mixing.sampled(poor, weights=(1.0, 3.0))
    for r in found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 4


def test_wide_scores_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e17, 1.0]), (3, [2.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        topk.top_k(df, F.col("vec_id") % 3 == 0)
    nulls = spark.createDataFrame([(0, None), (3, [1.0]), (4, [2.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(nulls, F.col("vec_id") % 3 == 0).collect())) == [(3, 1, 4, 131072)]


# Pipeline


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, stage):
    """Null and repeated ids with other texts, clashing columns and empty tables go through each stage."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    rng = random.Random(16)
    say = lambda: " ".join("".join(rng.choices("aeioustn", k=5)) for _ in range(60))
    rows = [(None, say(), "en", None, 1) for _ in range(4)] + [(7, say(), None, "s", 2), (7, say(), "en", "s", None), (8, None, None, None, None)]
    clash = ["score", "n_words", "n_hit", "text_hash", "copy", "lang_pred", "key", "kept", "a.b"]
    df = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(-5).alias(c) for c in clash])
    name, f = corpus_pipeline.STAGES[stage]
    got = f(spark, df, d)
    texts = sorted(r["text"] for r in got.collect() if r["text"])
    if name == "mixing":
        assert set(texts) <= {r[1] for r in rows}
    else:
        assert got.columns == df.columns and texts == sorted(r[1] for r in rows if r[1])
    assert got.where(" and ".join(f"`{c}` = -5" for c in clash)).count() == got.count()
    assert f(spark, df.where("false"), d).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    words = {"en": ["".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(400)], "fr": ["".join(rng.choices("éèçuqvxaj", k=rng.randint(2, 8))) for _ in range(400)]}
    say = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    passage, item = say("en", 60), say("en", 20)
    rows = [(i, say(["en", "fr"][i % 2], 150), ["en", "fr"][i % 2], f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0", 0), (101, rows[2][1] + " more", "en", "s1", 0)]  # an exact and a near copy
    rows += [(110, say("en", 50) + " " + passage + " " + say("en", 50), "en", "s1", 0), (111, say("en", 60) + " " + passage + " " + say("en", 40), "en", "s2", 0)]
    rows += [(120, say("en", 80) + " " + item.upper() + " " + say("en", 80), "en", "s0", 0), (121, item, "en", "s0", 0)]
    rows += [(130, "1234 5678", "en", "s0", 0), (131, None, "en", "s0", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    one, two, three, four, five = kept.values()
    assert set(one) == {r[0] for r in rows} - {130, 131}
    assert set(two) == set(one) - {100, 101}
    assert passage in three[110]["text"] and passage not in three[111]["text"] and len(three) == len(two)
    assert three[111]["n_chars"] == len(three[111]["text"])
    assert set(four) == set(three) - {121} and item not in four[120]["text"].lower()
    assert all(four[i]["text"] == three[i]["text"] for i in four if i != 120)
    assert set(five) <= set(four) and sum(r["taken"] for r in five.values()) > 0
    run = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert run == {k: r["taken"] for k, r in five.items()}


def test_queries_on_tables(spark):
    """Every registered query of this subpackage at the smallest size; those with SQL against it."""
    import oracle
    from factloom.llm.queries import QUERIES
    from factloom.llm.sql import ORACLE_SQL

    d = "/root/testdata/sf0.001"
    con = oracle.connect(d)
    for name, f in QUERIES.items():
        df = f(spark, d)
        if name in ORACLE_SQL:
            assert oracle.compare(df, con, ORACLE_SQL[name]) is None, name
        else:
            assert df.count() > 0


