"""Secret scan over a trigram inverted index.

Each rule's regex is read into a Boolean query over trigrams (AND along a sequence, OR over
alternatives). Each slice of texts gets an inverted index of the rules' trigrams; a rule's
postings are intersected and united, and the candidate texts are verified with the regex itself.
A rule without mandatory trigrams scans every text. Index and queries fold ASCII case.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import lean, slices, texts

_parse = re._parser.parse  # the standard library's own regex parser


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Keeps a match; called with the match object.
    keep: Callable[[re.Match], bool] = lambda m: True


def _long_value(m: re.Match) -> bool:
    return len(m.group(2)) >= 12


def _long_access(m: re.Match) -> bool:
    return m.end() - m.start() >= 18


#: Base rules first, in the order in which kinds are listed; the rest are published key formats.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _long_value),
    Rule("access", r"AKIA[A-Z0-9]+", _long_access),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
BASE = ("assign", "access", "hex")

#: Alternatives of one literal run that are followed apart.
_SPELLINGS = 64


def trigram_query(pattern: str) -> tuple[tuple[frozenset[str], ...], ...]:
    """Conjunction of disjunctions of trigram sets that every match contains, in lower case; () if none is mandatory."""
    clauses: list[tuple[frozenset[str], ...]] = []

    def close(run: set[str]) -> None:
        if run and all(len(s) >= 3 for s in run):
            clauses.append(tuple(sorted((frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run), key=sorted)))

    def spell(items) -> set[str] | None:
        """All strings that the items match, if few."""
        out = {""}
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                more = {chr(arg).lower()}
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
                more = {chr(a).lower() for _, a in arg}
            elif name == "SUBPATTERN":
                more = spell(arg[3])
            elif name == "BRANCH":
                parts = [spell(b) for b in arg[1]]
                more = None if any(p is None for p in parts) else set().union(*parts)
            elif name == "MAX_REPEAT" and arg[1] == 1:
                inner = spell(arg[2])
                more = None if inner is None else inner | ({""} if arg[0] == 0 else set())
            elif name == "AT":
                more = {""}
            else:
                more = None
            if more is None or len(out) * len(more) > _SPELLINGS:
                return None
            out = {a + b for a in out for b in more}
        return out

    def walk(items) -> None:
        run = {""}
        for item in items:
            more = spell([item])
            if more is not None and len(run) * len(more) <= _SPELLINGS:
                run = {a + b for a in run for b in more}
                continue
            close(run)
            run = {""}
            op, arg = item
            if str(op) == "SUBPATTERN":
                walk(arg[3])
            elif str(op) == "MAX_REPEAT" and arg[0] >= 1:
                walk(arg[2])
        close(run)

    walk(_parse(pattern))
    return tuple(clauses)


class TrigramIndex:
    """Postings of chosen trigrams (lower case) over the texts of a slice."""

    def __init__(self, trigrams: list[bytes]):
        self.trigrams = trigrams
        self.number = np.zeros(1 << 24, np.uint8)
        for k, t in enumerate(trigrams):
            self.number[t[0] << 16 | t[1] << 8 | t[2]] = k + 1
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def postings(self, array: pa.Array) -> dict[bytes, np.ndarray]:
        offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
        if array.buffers()[2] is None or offsets[-1] - offsets[0] < 3:
            return {t: np.empty(0, np.int64) for t in self.trigrams}
        data = self.fold[np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
        offsets = offsets - offsets[0]
        b = data.astype(np.uint32)
        hit = self.number[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
        at = np.flatnonzero(hit)
        owner = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[owner + 1]
        at, owner = at[inside], owner[inside]
        pairs = np.unique(hit[at].astype(np.int64) * len(array) + owner)
        cuts = np.searchsorted(pairs, np.arange(1, len(self.trigrams) + 2) * len(array))
        return {t: pairs[cuts[k] : cuts[k + 1]] - (k + 1) * len(array) for k, t in enumerate(self.trigrams)}


class Scanner:
    """Finds the spans of all rules in a slice of texts."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        grams = sorted({t.encode() for _, _, q in self.rules for clause in q for s in clause for t in s if t.isascii()})
        assert len(grams) < 255
        self.index = TrigramIndex(grams)

    def candidates(self, query, postings, n: int) -> np.ndarray:
        live = None
        for clause in query:
            some = np.unique(np.concatenate([self._all(s, postings) for s in clause]))
            live = some if live is None else np.intersect1d(live, some, assume_unique=True)
        return np.arange(n) if live is None else live

    @staticmethod
    def _all(grams: frozenset[str], postings) -> np.ndarray:
        lists = sorted((postings[g.encode()] for g in grams), key=len)
        out = lists[0]
        for other in lists[1:]:
            out = np.intersect1d(out, other, assume_unique=True)
        return out

    def scan(self, array: pa.Array) -> list[list[tuple[str, int, int]]]:
        """For each text its (kind, start, end), by start, then in the order of the rules; code points, end exclusive."""
        found: list[list[tuple[int, int, str, int]]] = [[] for _ in range(len(array))]
        postings, read = self.index.postings(array), {}
        for order, (rule, regex, query) in enumerate(self.rules):
            for i in self.candidates(query, postings, len(array)).tolist():
                if i not in read:
                    read[i] = array[i].as_py()
                found[i] += [(m.start(), order, rule.kind, m.end()) for m in regex.finditer(read[i]) if rule.keep(m)]
        return [[(kind, a, b) for a, _, kind, b in sorted(f)] for f in found]


_SCANNER: list[Scanner] = []


def _scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]



def secret_spans(documents: DataFrame) -> DataFrame:
    """doc_id and found: array of (kind, start, end) of each whole text, by start, then kind as RULES list them.

    Offsets are code points, end exclusive; matches of one rule do not overlap, those of different
    rules may. A null text has none. Repeated rows repeat, a null doc_id stays null, other columns
    are ignored, an empty table gives none.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in slices(batches):
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in _scanner().scan(texts(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "found"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, found array<struct<kind:string,start:long,end:long>>")
