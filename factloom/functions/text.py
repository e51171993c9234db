"""Tokenizers as expressions on a text column, each giving an array of terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PUNCTUATION = r"!-/:-@\[-`{-~"
_SPACE = r" \t\n\x0B\f\r"
#: Symbol characters beyond ASCII that are terms of their own (pictographs and the like), with joiners and modifiers.
_SYMBOL = r"[\x{2190}-\x{2BFF}\x{3030}\x{303D}\x{1F000}-\x{1FAFF}](?:[\x{FE0F}\x{20E3}\x{1F3FB}-\x{1F3FF}]|\x{200D}[\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}])*"


def _lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Words: split at ASCII white space, ASCII punctuation trimmed from both ends, without those that keep no letter or
    digit, A-Z lower-cased."""
    ends = f"(?<![{_PUNCTUATION}])[{_PUNCTUATION}]++(?![^{_SPACE}])|(?<![^{_SPACE}])[{_PUNCTUATION}]++"
    trimmed = F.regexp_replace(_lower_ascii(F.coalesce(text, F.lit(""))), ends, "")  # one pass over the text, not one a word
    return F.filter(F.split(trimmed, f"[{_SPACE}]+"), lambda p: p.rlike(r"[\p{L}\p{N}]"))


def hash_tokens(text: Column) -> Column:
    """Words, then the symbols of the text that are neither ASCII nor letters or digits."""
    return F.concat(words(text), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({_SYMBOL})"), F.lit(1)))


def bigram_tokens(text: Column) -> Column:
    """Pairs of neighbouring words, joined by a space."""
    def pairs(w: Column) -> Column:
        return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))

    return F.get(F.transform(F.array(words(text)), pairs), F.lit(0))  # the words are bound, not found for each use


def code_tokens(text: Column) -> Column:
    """Parts of identifiers: cut at other characters, between lower and upper case, before the last capital of a run
    that a lower-case letter follows, and between letters and digits; A-Z lower-cased."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[\p{Ll}])(?=[\p{Lu}])|(?<=[\p{Lu}])(?=[\p{Lu}][\p{Ll}])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})", " ")
    return F.filter(F.split(F.lower(marked), r"[^\p{L}\p{N}]+"), lambda p: p != "")


def ngram_tokens(text: Column, n: int) -> Column:
    """Character n-grams within each run of letters and digits, lower-cased."""
    runs = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda r: F.length(r) >= n)
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substring(r, i, F.lit(n)))))


def bag(terms: Column) -> Column:
    """An array of (term, tf), sorted by term, of an array of terms."""
    def runs(s: Column) -> Column:
        starts = F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)))

        def counted(at: Column) -> Column:
            return F.transform(at, lambda p, j: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - p).cast("bigint").alias("tf")))

        return F.get(F.transform(F.array(starts), counted), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(terms)), runs), F.lit(0))


TOKENIZERS = {"word": hash_tokens, "bigram": bigram_tokens, "code": code_tokens, "trigram": lambda t: ngram_tokens(t, 3)}
