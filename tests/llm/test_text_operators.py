"""Language ID, SimHash, decontamination, suffix dedup, token counts and toxicity: brute force and edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import common, decontam, language_id, shingle_dedup, simhash_dedup, suffix_dedup, token_count, toxicity
from factloom.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(b: bytes) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def odd_docs(spark):
    """Nulls, empty, letterless, repeated and long texts."""
    long = "word " * 60_000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "123 456", None, "a", 7), (4, "the cat sat on the mat", "en", None, 22), (4, "the cat sat on the mat", "en", None, 22), (None, "the dog", "en", "b", 7), (6, long, "en", "b", len(long)), (7, "日本語 Été \x00", "fr", "b", 9)]
    return spark.createDataFrame(rows, DOCS)


def with_clashes(df):
    """Extra columns with the names that the operators add."""
    for c in ("score", "lang_pred", "predicted", "n_words", "spans", "text hash", "okey", "fp"):
        df = df.withColumn(c, F.lit("mine"))
    return df


# Language ID


def speech(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


WORDS = {"en": "the and of with this that have from which".split(), "de": "der und nicht eine mit dass haben von".split(), "fr": "les des une dans pour avec qui sont".split()}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(1)
    rows = [(i, speech(rng, WORDS[x], 40), x, "s", 0) for i in range(90) for x in [list(WORDS)[i % 3]]]
    return spark.createDataFrame(rows, DOCS)


def test_language_id(spark, spoken):
    model = language_id.fit(spoken.where("doc_id % 2 = 0"))
    got = language_id.identify(spoken, model)
    assert got.where("lang_pred <> lang").count() == 0 and got.where("score < 0.9 or score > 1").count() == 0


def test_language_mixture(spark, spoken):
    rng = random.Random(2)
    mixed = speech(rng, WORDS["en"], 120) + ". " + speech(rng, WORDS["fr"], 60)
    row = language_id.identify(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), language_id.fit(spoken)).first()
    assert row["lang_pred"] == "en" and set(row["langs"]) == {"en", "fr"} and abs(row["langs"]["fr"] - 1 / 3) < 0.1


def test_language_id_odd(spark, spoken):
    model = language_id.fit(spoken)
    got = language_id.identify(with_clashes(odd_docs(spark)), model)
    assert got.count() == 8 and "spans" in got.columns
    by = {r["doc_id"]: r for r in got.select("doc_id", "lang_pred", "score").collect()}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (1, 2, 3)) and by[4]["lang_pred"] == "en"
    empty = spark.createDataFrame([], DOCS)
    assert language_id.identify(empty, model).count() == 0
    none = language_id.identify(odd_docs(spark), language_id.fit(empty)).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]


def test_mixture_against_plain_em(spark, spoken):
    """Proportions and set of languages against EM and penalised likelihood written out for one text."""
    rng = random.Random(12)
    model = language_id.fit(spoken)
    for mix in (["en"], ["en", "fr"], ["de", "fr", "en"], ["fr", "fr", "de"]):
        text = " ".join(speech(rng, WORDS[x], rng.randint(5, 60)) for x in mix).encode()
        folded = b"  " + text.translate(language_id._FOLD) + b"  "
        scores = []
        for m in re.finditer(rb"[^ ]+", folded):
            grams = [folded[i : i + 3] for i in range(m.start() - 1, m.end())]
            following = re.search(rb"[^ ]", folded[m.end() :])
            end = m.end() + following.start() - 1 if following else len(folded) - 2
            grams += [folded[i : i + 3] for i in range(m.end(), end)]
            slots = [(int.from_bytes(g, "big") * 2654435761 & 0xFFFFFFFF) >> 16 for g in grams]
            scores.append([sum(float(t[x]) for x in slots) for t in model.table])
        chance = [[math.exp(s - max(row)) for s in row] for row in scores]

        def em(p, rounds):
            for _ in range(rounds):
                sums = [0.0] * len(p)
                for row in chance:
                    total = sum(a * b for a, b in zip(p, row)) + 1e-30
                    sums = [x + a * b / total for x, a, b in zip(sums, p, row)]
                p = [x / len(chance) for x in sums]
            return p

        p = em([1 / 3] * 3, language_id.ROUNDS)
        order = sorted(range(3), key=lambda i: -p[i])
        best = None
        for k in (1, 2, 3):
            kept = [x + 1e-9 if i in order[:k] else 0.0 for i, x in enumerate(p)]
            kept = [x / sum(kept) for x in kept]
            fit = sum(math.log(sum(a * b for a, b in zip(kept, row)) + 1e-30) for row in chance) - language_id.PENALTY * (k - 1) * (1 + 0.5 * math.log(len(chance)))
            if best is None or fit > best[0]:
                best = fit, k, kept
        shares, sizes = model.infer(memoryview(text), np.array([0, len(text)]))
        assert sizes[0] == best[1] and np.allclose(shares[0], em(best[2], 2), atol=1e-3)


def test_six_languages_and_letters(spark):
    """A text of six languages keeps all six; signs that are no letters are none; ties go to the first name."""
    rng = random.Random(13)
    tongues = {f"l{i}": ["".join(rng.choices(chr(97 + 4 * i) + chr(98 + 4 * i) + chr(99 + 4 * i) + chr(100 + 4 * i), k=6)) for _ in range(30)] for i in range(6)}
    rows = [(i, speech(rng, tongues[x], 60), x) for i in range(60) for x in [f"l{i % 6}"]]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(1, " ".join(speech(rng, t, 50) for t in tongues.values())), (2, "² ½ Ⅷ 123"), (3, "² a")]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert len(got[1]["langs"]) == 6 and got[2]["lang_pred"] == "und" and got[3]["lang_pred"] != "und"
    tied = language_id.Model(["a", "b"], np.zeros((2, language_id.SLOTS), dtype=np.float32))
    assert language_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), tied).where("doc_id = 3").first()["lang_pred"] == "a"


def test_long_texts_in_pieces(spark, spoken, monkeypatch):
    """Language, toxicity, fingerprints, shingles and decontamination of texts read in pieces and read whole."""
    rng = random.Random(14)
    texts = [speech(rng, [w for ws in WORDS.values() for w in ws] + ["Été", "x"], n) for n in (3, 900, 2500)] + ["a", "", "one two"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = language_id.fit(spoken)
    embed = np.random.default_rng(1).normal(0, 1, (toxicity.SLOTS, toxicity.DIM)).astype(np.float32)
    net = toxicity.train([(np.zeros((3, 4), dtype=np.int32), 0), (np.ones((3, 4), dtype=np.int32), 1)])
    net.embed = embed
    judge = toxicity.Model(net, model, {"": 0.5})
    item = spark.createDataFrame([(1, texts[2][4000:4400]), (2, "one two"), (3, texts[1])], "item_id long, text string")

    def results():
        langs = [(r["lang_pred"], round(r["score"], 4)) for r in language_id.identify(rows, model).orderBy("doc_id").collect()]
        toxic = [round(r["score"], 4) for r in toxicity.toxicity(rows, judge).orderBy("doc_id").collect()]
        fps = [r["fp"] for r in simhash_dedup.fingerprint(rows).orderBy("key").collect()]
        sets = [shingle_dedup.shingle_set(t.encode()).tolist() for t in texts]
        clean = [tuple(r) for r in decontam.matches(rows, item, clean=True).orderBy("doc_id").collect()]
        return langs, toxic, fps, sets, clean

    whole = results()
    for chunk in (60, 1000):
        for m in (common, language_id, toxicity, simhash_dedup):
            monkeypatch.setattr(m, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(toxicity, "PIECE_WORDS", 40)
        monkeypatch.setattr(decontam, "PIECE_WORDS", 12)
        assert results() == whole


# SimHash


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", lower((text or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, linked):
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_simhash_fingerprints(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["A", "b", "cé", "dd\t", "\x0b"]) for _ in range(rng.randint(0, 700)))) for i in range(60)]
    got = {r["key"]: r["fp"] & (1 << 64) - 1 for r in simhash_dedup.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in rows}


def test_pigeonring_links_all(spark):
    """Links of fingerprints near some centres, and of random ones, against all pairs."""
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for c in list(fps)[:12] + [0]:
        for _ in range(14):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {(r["u"], r["v"]) for r in simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert got == want and want


def test_pigeonring_every_pattern(spark):
    """Each pair of differing bits is found from some chain."""
    fps = [0] + [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    assert got.where("u = 0 or v = 0").count() == 64 + 64 * 63 // 2


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = [" ".join(str(rng.randint(0, 999)) for _ in range(400)) for _ in range(8)]
    rows = [(100 - i, t + " tail" * rng.randint(0, 2)) for i, t in enumerate(base * 3)] + [(200, None), (150, ""), (151, " \t")]
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rows.sort()
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps, lambda a, b: bin(a ^ b).count("1") <= 2)
    assert got == {rows[i][0]: rows[r][0] for i, r in enumerate(roots)}
    kept = simhash_dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == set(got.values())


def test_near_duplicates_odd(spark):
    got = simhash_dedup.near_duplicates(with_clashes(odd_docs(spark)))
    assert got.count() == 8 and got.where("doc_id in (1, 2)").select("component_id", "fingerprint").distinct().collect()[0]["fingerprint"] == "0" * 16
    assert simhash_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert simhash_dedup.keep_first(odd_docs(spark)).where("doc_id = 4").count() == 1


def test_one_row_of_each_group_stays(spark):
    """Rows of one key or of none with other texts are documents each; repeated rows are one, whatever their columns."""
    rng = random.Random(15)
    say = lambda n: " ".join(str(rng.randint(0, 9999)) for _ in range(n))
    rows = [(None, say(40), "a.b", None) for _ in range(6)] + [(7, say(40), "x", 1), (7, say(40), "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, fp long")
    for keep in (simhash_dedup.keep_first, shingle_dedup.keep_first):
        assert sorted(map(str, keep(df).collect())) == sorted(map(str, df.collect()))
        twice = df.unionByName(df.withColumn("fp", F.lit(9).cast("long"))).repartition(5)
        got = keep(twice)
        assert got.columns == df.columns and got.count() == 8 and sorted(map(str, got.collect())) == sorted(map(str, keep(twice.repartition(2)).collect()))
        mixed = spark.createDataFrame([(3, "a b c d e f", "p", 1), (None, "a b c d e f", "p", 1), (2, "A b c d e f", "p", 1)], df.schema)
        assert [r["doc_id"] for r in keep(mixed).collect()] == [2]
        assert keep(df.where("false")).count() == 0


def test_near_copies_of_the_pipeline(spark, monkeypatch):
    """The pipeline's stage finds all pairs of a Jaccard similarity of 0.8 over five words, against all pairs."""
    import corpus_pipeline

    rng = random.Random(8)
    say = lambda n: [str(rng.randint(0, 999)) for _ in range(n)]
    line, rows = say(30), []
    for i in range(30):
        words = say(rng.choice([3, 12, 60, 300])) + (line if i % 2 else [])
        for _ in range(5):
            w = list(words)
            for _ in range(rng.choice([0, 1, 2, 4, 7])):
                w[rng.randrange(len(w))] = "odd"
            rows.append((len(rows) * 7 % 150, " ".join(w)))
    rows = sorted([*rows, (500, None), (501, " "), (502, "")])
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for _, t in rows)]
    roots = brute_components(sets, lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b))
    want = {rows[i][0]: rows[r][0] for i, r in enumerate(roots)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == set(want.values())
    for n in (1, 100):
        monkeypatch.setattr(shingle_dedup, "FREQUENT", n)
        assert {r["doc_id"]: r["component_id"] for r in shingle_dedup.near_copies(df).collect()} == want


def test_pipeline_joins_fingerprints(spark, monkeypatch):
    """The pipeline's near-copy stage joins SimHash fingerprints by the pigeonring, and what that connects is similar."""
    import corpus_pipeline

    rng = random.Random(19)
    base = [[str(rng.randint(0, 9999)) for _ in range(400)] for _ in range(12)]
    rows = [(i, " ".join(w if i < 12 else [*w[:-1], "odd"])) for i, w in enumerate(base * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, sets = shingle_dedup._sets_of(df, "doc_id", "text", 5)
    of = {r["fp"]: r for r in sets.collect()}
    hashes = [shingle_dedup.shingle_set(of_text.encode()) for _, of_text in rows]
    want = [int("".join("1" if 2 * sum(int(h) >> b & 1 for h in x) > len(x) else "0" for b in reversed(range(64))), 2) for x in hashes]
    assert sorted(r["simhash"] & (1 << 64) - 1 for r in of.values()) == sorted(want)
    pairs = {(r["u"], r["v"]) for r in shingle_dedup.ring_pairs(sets).collect()}
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    least = {u: min(v for v in of if near(of[u]["simhash"], of[v]["simhash"])) for u in of}
    assert pairs == {(u, v) for u, v in least.items() if u != v} and pairs
    seen, ring = [], shingle_dedup.ring_pairs
    monkeypatch.setattr(shingle_dedup, "ring_pairs", lambda x: seen.append(1) or ring(x))
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == set(range(12)) and seen


def test_components_of_a_long_path(spark):
    links = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert [r[0] for r in components(links).select("root").distinct().collect()] == [0]


# Decontamination


def brute_hits(doc, items, window):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower((t or "").encode()))
    d = split(doc)
    hit, ids = [0] * len(d), set()
    for i, t in items:
        w = split(t)
        k = min(window, len(w))
        wins = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
        for j in range(len(d) - k + 1):
            if k and tuple(d[j : j + k]) in wins:
                hit[j : j + k] = [1] * k
                ids.add(str(i))
    return len(d), sum(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), sum(hit) > 0


@pytest.mark.parametrize("block", [100_000, 15])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    rng = random.Random(6)
    words = ["A", "b", "c", "É", "x9", "-"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(0, 25))) for i in range(12)] + [(50, None), (51, "c"), (51, "b b b")]
    docs = [(i, f"{say(rng.randint(0, 60))} {rng.choice(items)[1] or ''}") for i in range(60)]
    docs += [(99, None), (98, "")]
    got = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4)
    got = {r["doc_id"]: tuple(r)[2:7] for r in got.collect()}
    assert got == {i: brute_hits(t, items, 4) for i, t in docs}


def test_decontamination_keeps_other_columns(spark):
    item = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    df = spark.createDataFrame([(1, "see one two three or more of it all", -5, "mine")], "doc_id long, text string, n_words long, `new n_hit` string")
    assert [tuple(r) for r in decontam.decontaminate(df, item).collect()] == [(1, "see  or more of it all", -5, "mine")]


def test_decontamination_cuts(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    docs = [(1, "Before. One two THREE, four five six seven eight nine ten eleven; after and much more text that stays here as it is."), (2, "clean"), (3, "one two three four five six seven eight nine ten eleven"), (4, None)]
    got = {r["doc_id"]: r["text"] for r in decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {1: "Before. ; after and much more text that stays here as it is.", 2: "clean", 4: None}


def test_decontamination_odd(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.matches(with_clashes(odd_docs(spark)), items).where("contaminated").count() == 0
    assert decontam.matches(spark.createDataFrame([], DOCS), items).count() == 0


# Suffix dedup


def brute_cut(rows, length):
    seen, out = set(), []
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(w)
        runs = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((k, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length,letters", [(100, "abc é"), (20, "ab"), (12, "aé"), (4, "abcdefghij")])
def test_suffix_dedup(spark, length, letters):
    rng = random.Random(length)
    some = lambda n: "".join(rng.choices(letters, k=n))
    passages = [some(rng.randint(length // 2, 4 * length)) for _ in range(6)]
    make = [lambda: some(rng.randint(0, 2 * length)), lambda: rng.choice(passages), lambda: rng.choice(passages)[rng.randint(0, 9) : rng.randint(10, 3 * length)], lambda: "a" * rng.randint(0, 3 * length)]
    rows = [(i * 7 % 101, "".join(rng.choice(make)() for _ in range(rng.randint(0, 5))) if i % 13 else None) for i in range(101)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length=length, digest=True)
    assert sorted(map(tuple, got.collect())) == brute_cut(sorted(rows), length)


def test_suffix_dedup_of_runs_over_batches(spark):
    """Ranks that span Arrow batches, with and without other contexts behind them."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = random.Random(9)
        shared = "".join(rng.choices("abcdefgh", k=90))
        rows = [(i, "".join(rng.choices("xyz", k=rng.randint(0, 30))) + shared[: rng.choice([40, 90, 90])] + "".join(rng.choices("uvw", k=rng.randint(0, 30)))) for i in range(60)]
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), length=32, digest=True)
        assert sorted(map(tuple, got.collect())) == brute_cut(rows, 32)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_suffix_dedup_odd(spark):
    docs = with_clashes(odd_docs(spark))
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix_dedup.remove_repeats(docs, digest=True).collect()}
    assert got[6, 300_000] == 299_995 and got[1, 0] == 0  # all but the first five bytes are covered again
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS), digest=True).count() == 0
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == 8
    twice = spark.createDataFrame([(1, "é" * 80), (2, "x" + "é" * 80 + "yz"), (3, "é" * 80)], "doc_id long, text string")
    assert {r[0]: r[1] for r in suffix_dedup.without_repeats(twice).collect()}[2] == "xyz"
    assert {r[0] for r in suffix_dedup.without_repeats(twice).collect()} == {1, 2}


def test_suffix_dedup_repeated_keys(spark):
    """Rows of one key are ordered by text, equal rows in any order."""
    t = "".join(random.Random(1).choices("abcdefgh", k=150))
    rows = [(5, t), (5, t), (5, "short"), (None, "b" + t)]
    got = sorted(tuple(r)[1:] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect())
    assert got == sorted(x[1:] for x in brute_cut(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), 100))


@pytest.mark.parametrize("chunk", [700, 3000])
def test_suffix_dedup_of_long_texts(spark, monkeypatch, chunk):
    """Texts that are read in pieces give what whole ones do."""
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(common, "CHUNK_BYTES", chunk)
    rng = random.Random(chunk)
    passages = ["".join(rng.choices("abcdefé ", k=rng.randint(60, 900))) for _ in range(5)]
    rows = [(i, "".join(rng.choice(passages)[rng.randint(0, 40) :] + "".join(rng.choices("xyz", k=rng.randint(0, 200))) for _ in range(rng.choice([1, 3, 30])))) for i in range(12)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), digest=True)
    assert sorted(map(tuple, got.collect())) == brute_cut(rows, 100)


def test_checkpoint_folder_on_a_cluster():
    """On a cluster that names no shared folder, cutting lineage is an error rather than a machine's own folder."""
    from types import SimpleNamespace as N

    sc = N(master="spark://a:1", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isEmpty=lambda: True))))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.cut(N(sparkSession=N(sparkContext=sc, conf=N(get=lambda *_: None))))


# Token counts


@pytest.fixture(scope="module")
def pieces():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_token_counts(spark, pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    rng = random.Random(7)
    bits = [" ", "  ", "\n", "▁", "a", "the", "é", "\t", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", "日本", "\U0001f389", "1", "2024", "\r", "_", "don't", "ing", "\n\n", " "]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 14)))) for i in range(3000)] + [(9000, None), (9001, "word" * 2000)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), pieces, limit=8).collect()}
    want = {i: (len((t or "").encode()), n, n > 8) for (i, t), n in zip(rows, map(len, model.encode([t or "" for _, t in rows])))}
    assert got == want


def test_token_counts_odd(spark, pieces, monkeypatch):
    assert token_count.token_counts(with_clashes(odd_docs(spark)), pieces).count() == 8
    assert token_count.token_counts(spark.createDataFrame([], DOCS), pieces).count() == 0
    monkeypatch.setattr(token_count, "CACHE", 3)
    assert token_count.count_tokens(["a bb ccc dddd", "eeee ff"], pieces) == token_count.count_tokens(["a bb ccc dddd", "eeee ff"], pieces)


# Toxicity


def test_toxicity(spark, spoken):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    texts, marks = [], []
    for i in range(900):
        bad = i % 4 == 0
        w = rng.choices(vocabulary, k=80)
        if bad:
            w[rng.randrange(80)] = "zorgl" + rng.choice(["", "ing", "er", "s"])
        texts.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(marks + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, language_id.fit(spoken), F.col("doc_id") % 3 != 0)
    got = toxicity.toxicity(docs, model).join(labels.where("toxic is not null"), "doc_id").where("doc_id % 3 = 0")
    right = got.where("predicted = toxic").count() / got.count()
    assert right > 0.97 and got.where("score < 0 or score > 1").count() == 0


def test_thresholds_are_drawn_together():
    """Few toxic texts of a language move its threshold little; many move it to its own; ties of scores are one."""
    p = np.array([0.1] * 50 + [0.9] * 50 + [0.3] * 2 + [0.4] * 2)
    y = np.array([0] * 50 + [1] * 50 + [0] * 2 + [1] * 2)
    langs = np.array(["en"] * 100 + ["fr"] * 4)
    got = toxicity.thresholds(p, y, np.ones(len(p)), langs)
    own = toxicity.threshold(p[100:], y[100:], np.ones(4))
    assert own == pytest.approx(0.35) and got["fr"] == pytest.approx((2 * own + toxicity.DRAWN * got[""]) / (2 + toxicity.DRAWN))
    assert abs(got["en"] - toxicity.threshold(p[:100], y[:100], np.ones(100))) < 0.1
    assert toxicity.thresholds(p[:50], y[:50], np.ones(50), langs[:50]) == {"": 0.5}


def test_toxicity_odd(spark, spoken):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    none = toxicity.fit(odd_docs(spark), empty, language_id.fit(spoken), F.lit(True))
    got = toxicity.toxicity(with_clashes(odd_docs(spark)), none)
    assert got.count() == 8 and got.where("predicted <> 0").count() == 0 and dict(got.dtypes)["score"] == "double"
    model = toxicity.Model(toxicity.train([(np.zeros((3, 4), dtype=np.int32), 0), (np.ones((3, 4), dtype=np.int32), 1)]), language_id.fit(spoken), {"": 0.5})
    assert toxicity.toxicity(odd_docs(spark), model).where("text is null or text = ''").where("score > 0").count() == 0
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), model).count() == 0


def test_toxicity_learns_from_every_labelled_text(spark, spoken, monkeypatch):
    """Long texts and more of them than a group are all counted, learnt and set thresholds; partitions don't matter."""
    rng = random.Random(18)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    rows = []
    for i in range(600):
        w = rng.choices(vocabulary, k=6500 if i % 10 == 0 else 20)  # the toxic texts have 39 KB each
        rows.append((i, " ".join([*w, "zorgling"] if i % 10 == 0 else w), int(i % 10 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    counts, found = [], []
    monkeypatch.setattr(toxicity, "GROUP", 100)
    counted, thresholds = toxicity._counted, toxicity.thresholds
    monkeypatch.setattr(toxicity, "_counted", lambda x: counts.append(counted(x)) or counts[-1])
    monkeypatch.setattr(toxicity, "thresholds", lambda p, y, w, langs: found.append((w[y == 0].sum(), w[y == 1].sum())) or thresholds(p, y, w, langs))
    languages = language_id.fit(spoken)
    model = toxicity.fit(docs.repartition(3), labels, languages, F.lit(True))
    again = toxicity.fit(docs.repartition(7), labels.repartition(2), languages, F.lit(True))
    assert counts[0][1].sum(axis=0).tolist() == [540, 60] and found == [(540, 60)] * 2
    assert np.array_equal(model.network.embed, again.network.embed) and model.thresholds == again.thresholds
    assert toxicity.toxicity(docs, model).join(labels, "doc_id").where("predicted <> toxic").count() <= 6


def test_shrunk_texts_train_alike(monkeypatch):
    """Words far from any that counts, and those of a long text that no filter is largest at, change no activation."""
    rng = np.random.default_rng(3)
    net = toxicity._network(toxicity.begin(np.append(0.0, rng.normal(0, 1, 49)), 1)[0], 50)
    for n in (1, 2, 5, 40, 400):
        cells = np.where(rng.random((n, 4)) < 0.02, rng.integers(1, 50, (n, 4)), 0).astype(np.int32)
        kept = cells[toxicity.near_active(cells.any(axis=1))]
        assert np.array_equal(net.pooled(cells, np.array([n]))[0], net.pooled(kept, np.array([len(kept)]))[0])
        with monkeypatch.context() as m:
            m.setattr(toxicity, "PIECE_WORDS", 30)
            short = net.shrunk(cells)
        assert np.array_equal(net.pooled(cells, np.array([n]))[0], net.pooled(short, np.array([len(short)]))[0])


def test_toxicity_packs_words_and_counts():
    """Cells and counts come back as they were; equal cells of a short word are kept once, small counts in a byte."""
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 300):
        for share in (0.0, 0.3, 1.0):
            cells = np.where(rng.random((n, 4)) < share, rng.integers(1, toxicity.SLOTS, (n, 4)), 0).astype(np.int32)
            cells[::3, 1:] = cells[::3, :1]
            assert np.array_equal(toxicity._cells(toxicity._packed(cells)), cells)
    short = np.repeat(rng.integers(1, 1 << 16, (4000, 1)), 4, axis=1).astype(np.int32)
    assert np.array_equal(toxicity._cells(toxicity._packed(short)), short) and len(toxicity._packed(short)) < 2.1 * len(short)
    for most, width in ((2, 0.3), (1 << 16, 2.3), (1 << 40, 5.3)):
        counts = rng.integers(0, most, toxicity.BLOCK)
        assert np.array_equal(toxicity._counts(toxicity._shrunk(counts)), counts) and len(toxicity._shrunk(counts)) < width * len(counts)
    start = rng.normal(0, 0.5, (900, 2 * toxicity.DIM)).astype(np.float32)
    moves = (start + rng.normal(0, 1e-3, start.shape).astype(np.float32)) - start
    at, back = toxicity._moves(toxicity._packed_moves(np.arange(0, 3600, 4), moves))
    assert at.tolist() == list(range(0, 3600, 4)) and np.array_equal(back, moves)
    assert len(toxicity._packed_moves(at, moves)) < 3.3 * moves.size


def test_toxicity_of_texts_beyond_a_chunk(spark, spoken):
    """Texts longer than a chunk, with and without places to cut, are scored."""
    net = toxicity.train([(np.zeros((3, 4), dtype=np.int32), 0), (np.ones((3, 4), dtype=np.int32), 1)])
    rows = [(1, "hello you " * 150_000), (2, "x" * 1_300_000)]
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), toxicity.Model(net, language_id.fit(spoken), {"": 0.5}))
    assert got.where("score >= 0").count() == 2


def test_languages_from_all_texts(spark, spoken):
    """Without a bound the trigrams of every text are counted, a text at a time or many at once."""
    one = language_id.fit(spoken.repartition(1), fit_docs=None)
    assert np.array_equal(one.table, language_id.fit(spoken.repartition(200), fit_docs=None).table)
    assert np.array_equal(one.table, language_id.fit(spoken, fit_docs=10**9).table) and not np.array_equal(one.table, language_id.fit(spoken, fit_docs=10).table)
    sums = np.full((3, language_id.SLOTS), 0.5)
    for r in spoken.collect():
        t = f" {r['text']} ".encode()
        for i in range(len(t) - 1):
            x = np.array([(t[i] << 16 | t[i + 1] << 8 | (t[i + 2] if i + 2 < len(t) else 32))], dtype=np.uint32)
            sums[one.languages.index(r["lang"]), int((x * np.uint32(2654435761) >> np.uint32(16))[0])] += 1
    assert np.allclose(one.table, np.log(sums / sums.sum(axis=1, keepdims=True)), atol=1e-5)
