"""Full-text search over an inverted index table: tokenizers, AND/OR/prefix/phrase queries, BM25.

The index is a DataFrame (doc, term, tf, positions); document frequencies and lengths are
aggregates of it. Terms of a query are few, so the index is filtered before anything is joined.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(w: str) -> int:
    """Vowel-consonant sequences of a stem, after Porter (1980)."""
    shape = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return sum(1 for a, b in zip(shape, shape[1:]) if a == "v" and b == "c")


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    n = len(w)
    return n >= 3 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


#: The suffixes of steps 2, 3 and 4 of the published algorithm.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


@lru_cache(1 << 17)
def porter(w: str) -> str:
    """The Porter stem of a lower-case word."""
    if len(w) <= 2 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for suffix in sorted(table, key=len, reverse=True):
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                w = stem + table[suffix] if _measure(stem) > 0 else w
                break
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if _measure(w) > 1 and w.endswith("ll"):
        w = w[:-1]
    return w


def word_start(stem: str) -> str:
    """What every word of a stem starts with: the steps change two letters before a stem's end at most (`biliti` to `ble`), and never the first."""
    return stem[: max(1, len(stem) - 2)]


def stems(lists: pa.Array) -> pa.Array:
    """Lists of words with each word's stem; a word that occurs often in a batch is stemmed once."""
    words = lists.flatten().dictionary_encode()
    flat = pa.array([porter(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), flat, mask=lists.is_null())


def _stemmed(words: Column) -> Column:
    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        return stems(lists)

    return run(words)


#: Characters of words, as a class's content.
_LETTERS = {"ascii": "a-z0-9", "porter": "a-z0-9", "unicode61": r"\p{L}\p{N}"}


def tokens(text: Column, tokenizer: str = "ascii") -> Column:
    """The array of a text's terms: ascii, unicode61 (letters and digits of any script) or porter (ascii, stemmed)."""
    if tokenizer not in _LETTERS:
        raise ValueError(f"no tokenizer {tokenizer!r}")
    words = F.regexp_extract_all(F.lower(text), F.lit(f"[{_LETTERS[tokenizer]}]+"), F.lit(0))
    return _stemmed(words) if tokenizer == "porter" else words


class TextIndex:
    """An inverted index over (doc, text)."""

    def __init__(self, docs: DataFrame, doc: str, text: str, tokenizer: str = "ascii"):
        self.tokenizer, self.spark = tokenizer, docs.sparkSession
        self.listed = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), tokens(F.col(text), tokenizer).alias("terms"))
        self.places = self.listed.select("doc", F.posexplode("terms").alias("pos", "term"))
        self.postings = self.places.groupBy("doc", "term").agg(F.count("*").alias("tf"))

    def terms_of(self, query: str) -> list[str]:
        row = self.spark.range(1).select(tokens(F.lit(query), self.tokenizer).alias("t")).first()
        return list(dict.fromkeys(row.t))

    def stats(self) -> DataFrame:
        """(term, df, cf): documents and occurrences of each term."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def match_all(self, query: str) -> DataFrame:
        """(doc): documents that hold every term of the query."""
        terms = self.terms_of(query)
        if not terms:
            return self.listed.select("doc").limit(0)
        # only words that start like a term are cut out of the texts, and stemmed
        starts = [word_start(t) if self.tokenizer == "porter" else t for t in terms]
        letters, low = _LETTERS[self.tokenizer], F.lower("text")
        words = F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?<![{letters}])(?:{'|'.join(starts)})[{letters}]*"), F.lit(0)))
        some = self.listed.where(reduce(or_, (F.contains(low, F.lit(t)) for t in starts))).select("doc", words.alias("words")).where(F.size("words") > 0)
        places = some.select("doc", F.explode(_stemmed(F.col("words")) if self.tokenizer == "porter" else "words").alias("term"))
        hit = places.where(F.col("term").isin(terms)).distinct()
        return hit.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") == len(terms)).select("doc")

    def prefix(self, start: str) -> DataFrame:
        """(doc): documents with a term that starts so."""
        return self.postings.where(F.startswith("term", F.lit(start.lower()))).select("doc").distinct()

    def phrase(self, query: str) -> DataFrame:
        """(doc): documents that hold the query's terms one after another."""
        row = self.spark.range(1).select(tokens(F.lit(query), self.tokenizer).alias("t")).first()
        numbered = self.spark.createDataFrame([(i, t) for i, t in enumerate(row.t)], "at int, term string")
        hit = self.places.join(F.broadcast(numbered), "term").select("doc", (F.col("pos") - F.col("at")).alias("start"), "at")
        return hit.groupBy("doc", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(row.t)).select("doc").distinct()

    def bm25(self, query: str, k1: float = 1.2, b: float = 0.75, idf: str = "okapi") -> DataFrame:
        """(doc, score) of documents with any term, by BM25; idf `okapi` is ln((N-df+.5)/(df+.5)+1), `plain` ln((N-df+1)/(df+1))."""
        terms = self.terms_of(query)
        if not terms:
            return self.listed.select("doc", F.lit(0.0).alias("score")).limit(0)

        def count(word: str) -> Column:
            return F.size(F.filter("terms", lambda t: t == word))

        # one pass counts terms; texts that may hold a query's term are found by its letters, and only these are cut
        # into terms. Nothing of a document is shuffled.
        hits = self.listed
        if self.tokenizer != "porter":
            low = F.lower("text")
            hits = hits.where(reduce(or_, (F.contains(low, F.lit(t)) for t in terms)))
        told = hits.select("doc", F.coalesce(F.size("terms"), F.lit(0)).alias("length"), F.array(*map(count, terms)).alias("tfs"))
        whole = self.listed.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.size("terms"), F.lit(0))).alias("mean"))
        dfs = told.agg(*[F.count_if(F.col("tfs")[k] > 0).alias(f"df{k}") for k in range(len(terms))])
        rows = told.where(F.exists("tfs", lambda tf: tf > 0)).crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(dfs))  # one row each
        n = F.col("n")

        def part(k: int) -> Column:
            d, tf = F.col(f"df{k}"), F.col("tfs")[k]
            weight = F.log((n - d + 0.5) / (d + 0.5) + 1) if idf == "okapi" else F.log((n - d + 1) / (d + 1))
            return F.when(tf > 0, weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))).otherwise(0.0)

        return rows.select("doc", sum((part(k) for k in range(1, len(terms))), part(0)).alias("score"))


def highlight(text: Column, terms: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    """The text with whole-word occurrences of the terms marked."""
    import re

    pattern = r"(?i)\b(" + "|".join(map(re.escape, terms)) + r")\b"
    return F.regexp_replace(text, pattern, before.replace("$", r"\$") + "$1" + after.replace("$", r"\$"))


def snippet(text: Column, term: str, around: int = 30) -> Column:
    """The surroundings of a term's first occurrence; NULL without one."""
    at = F.locate(term.lower(), F.lower(text))
    return F.when(at > 0, F.substring(text, F.greatest(at - around, F.lit(1)), F.lit(len(term) + 2 * around)))
