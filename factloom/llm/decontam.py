"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every sequence of words of every item. Streaming a document's words through it tracks the longest
sequence that ends at each word and occurs in some item. Where that length reaches the window, the last words are an
occurrence of a window; shorter items are occurrences where they are matched whole, which is found along the suffix
links. Only runs of words that the items know at all go through the automaton, found by one scan of the words.

Items are cut into pieces of at most ``PIECE_WORDS`` words that overlap by a window less a word, so that every window is
whole in one of them, and pieces are collected in blocks of about ``BLOCK_WORDS`` words, each with an automaton of its own.
With more than one block the documents are scanned once a block, each task with that block's automaton alone; the hits
are joined to the documents by two hashes of the text. So a larger benchmark costs time, not memory.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, hidden, place_of, text_parts, with_fields, word_pieces

#: Words of the items of one automaton, about; a word takes some 700 bytes.
BLOCK_WORDS = 100_000
#: Words of a piece of an item.
PIECE_WORDS = 10_000

#: Lower-cases A-Z and makes every ASCII byte that is no letter or digit a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes that part words.
_ENDS = bytes(b for b in range(128) if _WORDS[b] == 32)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Automaton:
    """Suffix automaton of word sequences, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        seqs = [(i, w) for i, t in items if (w := words(t))]
        for _, w in seqs:
            self._add(w)
        self.vocabulary = frozenset(x for _, w in seqs for x in w)
        self.shortest = min([window, *(len(w) for _, w in seqs)])
        # the state that holds the last window words of a match: the last on the suffix path that is as long
        self.at = [-1] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            if self.length[s] >= window:
                self.at[s] = s if self.length[self.link[s]] < window else self.at[self.link[s]]
        self.items: dict[int, set[str]] = {}
        self.whole: dict[int, int] = {}  # states of which a short item is the longest sequence: its number of words
        for i, w in seqs:
            s = 0
            for n, x in enumerate(w, 1):
                s = self.next[s][x]
                if n >= window:
                    self.items.setdefault(self.at[s], set()).add(i)
            if len(w) < window:
                # its state's longest sequence may be longer than the item; the item's length is kept beside
                self.items.setdefault((s, len(w)), set()).add(i)
                self.whole[s] = self.whole.get(s, 0) | 1 << len(w)
        # the next state on the suffix path, itself included, that holds a short item
        self.short = [-1] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.short[s] = s if s in self.whole else self.short[self.link[s]]

    def _add(self, seq: list[bytes]) -> None:
        last = 0
        for x in seq:
            q = self.next[last].get(x)
            if q is not None and self.length[q] == self.length[last] + 1:
                last = q
                continue
            if q is not None:
                last = self._clone(last, x, q)
                continue
            s = self._state(self.length[last] + 1, {}, 0)
            p = last
            while p != -1 and x not in self.next[p]:
                self.next[p][x] = s
                p = self.link[p]
            if p != -1:
                q = self.next[p][x]
                self.link[s] = q if self.length[q] == self.length[p] + 1 else self._clone(p, x, q)
            last = s

    def _state(self, length: int, following: dict[bytes, int], link: int) -> int:
        self.length.append(length)
        self.next.append(following)
        self.link.append(link)
        return len(self.length) - 1

    def _clone(self, p: int, x: bytes, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = c
        while p != -1 and self.next[p].get(x) == q:
            self.next[p][x] = c
            p = self.link[p]
        return c

    def hits(self, text: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Maximal spans [first word, word after the last] covered by occurrences of windows, and the items matched."""
        known = bytes(map(self.vocabulary.__contains__, text))
        spans: list[list[int]] = []
        found: set[str] = set()
        at = known.find(b"\1" * self.shortest)
        while at >= 0:
            end = known.find(b"\0", at)
            end = len(known) if end < 0 else end
            s = n = 0
            for j in range(at, end):
                x = text[j]
                while s and x not in self.next[s]:
                    s = self.link[s]
                    n = self.length[s]
                if x in self.next[s]:
                    s, n = self.next[s][x], n + 1
                if n >= self.window:
                    found |= self.items[self.at[s]]
                    self._cover(spans, j + 1 - self.window, j + 1)
                longest = 0
                k = self.short[s]
                while k > 0:
                    for m in range(1, self.window):
                        if self.whole[k] >> m & 1 and m <= n and m > self.length[self.link[k]]:
                            found |= self.items[k, m]
                            longest = max(longest, m)
                    k = self.short[self.link[k]]
                if longest:
                    self._cover(spans, j + 1 - longest, j + 1)
            at = known.find(b"\1" * self.shortest, end)
        return spans, found

    @staticmethod
    def _cover(spans: list[list[int]], begin: int, end: int) -> None:
        while spans and spans[-1][1] >= begin:
            begin = min(begin, spans.pop()[0])
        spans.append([begin, end])


def _pieces(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(id, t, n) of the pieces of the items: n words, joined by spaces."""
    items = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.col(text).alias("t")).where("t is not null")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, t in zip(b.column("id").to_pylist(), b.column("t").to_pylist()):
                w = words(t.encode())
                # a short item is whole in its one piece; a longer one's last piece is a window at least
                starts = range(0, max(1, len(w) - window + 1), PIECE_WORDS) if w else ()
                got = [w[s : s + PIECE_WORDS + window - 1] for s in starts]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(got), pa.string()), pa.array([b" ".join(g).decode() for g in got], pa.string()), pa.array(list(map(len, got)), pa.int64())], names=["id", "t", "n"])

    return items.mapInArrow(run, "id string, t string, n long")


def _blocks(items: DataFrame, key: str, text: str, window: int) -> Iterator[tuple[int, Automaton]]:
    """(number of blocks, automaton) of each block."""
    pieces = cut(_pieces(items, key, text, window))
    count = (pieces.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS + 1
    for b in range(count):
        part = pieces.where(F.pmod(F.xxhash64("id", "t"), F.lit(count)) == b)
        yield count, Automaton([(r["id"], r["t"].encode()) for r in part.collect()], window)


def _union(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(a + b):
        if out and out[-1][1] >= s:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def hits_of(text: memoryview | bytes, automaton: Automaton) -> tuple[int, list[list[int]], set[str]]:
    """Words of a whole text, its spans of hit words and the items matched; a long text is read piece by piece."""
    n, spans, found = 0, [], set()
    before: list[bytes] = []
    for s, e in word_pieces(text, _ENDS):
        w = before + words(bytes(text[s:e]))
        got, ids = automaton.hits(w)
        at = n - len(before)
        spans = _union(spans, [[at + x, at + y] for x, y in got]) if got else spans
        found |= ids
        n = at + len(w)
        before = w[-(automaton.window - 1) :] if automaton.window > 1 else []
    return n, spans, found


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 10, clean: bool = False) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256, contaminated and spans to each row, and ``cleaned`` if asked for.

    Words are runs of ASCII letters, digits and other characters beyond ASCII, A-Z lower-cased. A window is ``window``
    consecutive words of an item, or all of an item of fewer. A word inside any occurrence of a window is hit. spans are
    the maximal runs of hit words (first, after the last); ``cleaned`` is the text less the bytes from the first to the
    last word of each. Null and wordless texts have no words and no hits, items without words have no windows, and an
    item id that repeats (null is the empty string) counts once. Columns of these names are replaced; repeated rows stay.
    """
    new = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"] + ["cleaned"] * clean
    names = [c for c in docs.columns if c.lower() not in new]
    found = _found(docs, place_of(docs, text), items, item_key, item_text, window, clean)
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c in names]
    return found.select(*kept, *[F.col(f"new {c}").alias(c) for c in new])


def _found(docs: DataFrame, text: str, items: DataFrame, item_key: str, item_text: str, window: int, clean: bool) -> DataFrame:
    """The rows of ``hidden(docs)`` with the columns of ``matches``, "new " before their names; ``text`` is the hidden name."""
    new = ["new n_words", "new n_hit", "new n_items", "new items_sha256", "new contaminated", "new spans"] + ["new cleaned"] * clean
    kinds = dict(zip(new, ["long", "long", "long", "string", "boolean", "array<array<int>>", "string"]))
    types = dict(zip(new, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.list_(pa.int32())), pa.string()]))
    base = hidden(docs)
    width = len(base.columns)
    schema = with_fields(base, ", ".join(f"`{k}` {v}" for k, v in kinds.items()))
    sc = docs.sparkSession.sparkContext
    whole: Broadcast | None = None
    if (blocks := _blocks(items, item_key, item_text, window)) and (first := next(blocks))[0] == 1:
        whole = sc.broadcast(first[1])  # bounded by BLOCK_WORDS
    else:
        hashes = [F.xxhash64(text).alias("own hash"), F.xxhash64(F.lit(1), F.col(text)).alias("own other")]
        parts = [_block_hits(base.select(*hashes, F.col(text).alias("text")), sc.broadcast(a)) for a in itertools.chain([first[1]], (a for _, a in blocks))]
        hit = functools.reduce(DataFrame.unionByName, parts).groupBy("hash", "other").agg(F.flatten(F.collect_set("spans")).alias("all spans"), F.flatten(F.collect_set("ids")).alias("all ids"))
        base = base.select("*", *hashes).join(hit, (F.col("own hash") == F.col("hash")) & (F.col("own other") == F.col("other")), "left").select(*base.columns, "all spans", "all ids")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            at = 0
            for _, _, data, offsets in text_parts(b, text):
                o = offsets.tolist()
                for s, e in zip(o, o[1:]):
                    t = data[s:e]
                    if whole is not None:
                        n, spans, ids = hits_of(t, whole.value)
                    else:
                        n = sum(len(words(bytes(t[x:y]))) for x, y in word_pieces(t, _ENDS))
                        spans, ids = _union([], b.column("all spans")[at].as_py() or []), set(b.column("all ids")[at].as_py() or [])
                    at += 1
                    digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
                    row = [n, sum(e - s for s, e in spans), len(ids), digest, bool(spans), spans]
                    rows.append(row + [cut_words(bytes(t), spans) if spans else str(t, "utf-8")] if clean else row)
            more = [pa.array(c, types[k]) for k, c in zip(new, zip(*rows) if rows else [[]] * len(new))]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *more], names=[*b.schema.names[:width], *new])

    return base.mapInArrow(run, schema)


def _block_hits(texts: DataFrame, automaton: Broadcast) -> DataFrame:
    """(hash, other, spans, ids) of the texts that a block's items hit."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for row, _, data, offsets in text_parts(b, "text"):
                o = offsets.tolist()
                for i, (s, e) in enumerate(zip(o, o[1:]), row):
                    _, spans, ids = hits_of(data[s:e], automaton.value)
                    if spans:
                        rows.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), spans, sorted(ids)))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())]
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["hash", "other", "spans", "ids"])

    return texts.mapInArrow(run, "hash long, other long, spans array<array<int>>, ids array<string>")


def cut_words(text: bytes, spans: list[list[int]]) -> str:
    """The text less the words of the spans and what lies between the words of one span."""
    edges, at = [0], 0
    for i, m in enumerate(_WORD.finditer(text)):
        if i == spans[at][0]:
            edges.append(m.start())
        if i == spans[at][1] - 1:
            edges.append(m.end())
            at += 1
            if at == len(spans):
                break
    edges.append(len(text))
    return b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2])).decode()


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", window: int = 10, coverage: float = 0.5, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with the columns, of ``docs``: hit spans are cut out of the text, and a row more than ``coverage`` of
    whose words are hit goes. Rows without hits are unchanged, and so are all other columns, whatever their names."""
    own = place_of(docs, text)
    found = _found(docs, own, items, item_key, item_text, window, clean=True).where(F.col("new n_hit") <= coverage * F.col("new n_words"))
    clean = F.when(F.col("new contaminated"), F.col("new cleaned")).otherwise(F.col(own))
    return found.select(*[(clean if f"c{i}" == own else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])
