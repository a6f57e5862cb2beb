"""Benchmark decontamination by template canonicalisation.

Texts become token sequences in which numbers, names and units are typed placeholders, so a
question with other numbers or names has the same template. Windows of the items' templates are
hash-joined with the documents' windows. Windows that match along one alignment of a document and
an item must fill the placeholders consistently: one item value stands for one document value
throughout, and the other way round; windows that do not are left out. Names or numbers side by
side are one placeholder, and an alignment may gain or lose a few words on its way (up to
a quarter of the item's). Windows of words as they are, of any length and kind, are joined as well,
so that verbatim copies need no literals. An alignment that covers enough of the item is a hit.

A fixed-size bitmap of the items' window hashes lets documents emit only windows that may match;
its size never depends on the data, and a false hit falls in the join.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import bitmap, coded, lean, slices, split_words, stored, texts

#: Tokens in a window, share of an item's words that must be covered, literal tokens that a template window must hold.
WINDOW = 8
COVERED = 0.6
LITERALS = 3
BITMAP_BITS = 24

#: Common units of measure and money that follow or stand by numbers.
UNITS = frozenset("mm cm m km inch inches ft feet yd yards mile miles mg g kg lb lbs oz ton tons ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur km/h mph degrees".split())
_NUMBER = re.compile(r"[+-]?[0-9]+(?:[.,:/][0-9]+)*%?\Z")
_EDGES = re.compile(r"\A[\W_]+|[\W_]+\Z")
_LINE = "\u2028"
#: Scripts without spaces between words: each of their characters is a word of its own.
_SPACELESS = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])"
_PLACES = {name: np.uint64(xxhash.xxh3_64_intdigest(f"\x00{name}")) for name in ("number", "name", "unit")}
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Templates:
    """The templates of a slice of texts: token hashes, types (0 literal, 1 number, 2 name, 3 unit) and values."""

    def __init__(self, array: pa.Array):
        if not pc.all(pc.string_is_ascii(array), min_count=0).as_py():
            array = pc.replace_substring_regex(array, _SPACELESS, r" \1 ")
        flat, offsets = split_words(pc.replace_substring(array, "\n", f" {_LINE} "), lower=False)
        codes, raw = coded(flat)
        bare = [_EDGES.sub("", w) if w != _LINE else "" for w in raw]
        number = np.array([bool(_NUMBER.match(b)) for b in bare], bool)
        capital = np.array([b[:1].isupper() and not b.isupper() for b in bare], bool)
        unit = np.array([b.lower() in UNITS for b in bare], bool)
        stops = np.array([w == _LINE or w[-1:] in ".!?:;\"'”»)" for w in raw], bool)
        empty = np.array([not b for b in bare], bool)
        opens = np.array([w.startswith(b) for w, b in zip(raw, bare)], bool)
        closes = np.array([w.endswith(b) for w, b in zip(raw, bare)], bool)
        self.values = [b.lower() for b in bare]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(v) for v in self.values), np.uint64, len(raw))
        if not len(codes):
            self.codes = np.empty(0, np.int64)
            self.kind, self.hash, self.offsets = np.empty(0, np.int8), np.empty(0, np.uint64), np.zeros(len(array) + 1, np.int64)
            self.starts, self.words, self.plain, self.led = np.zeros(1, np.int64), self.offsets, self.hash, self.hash
            return
        before_stops = np.concatenate([[True], stops[codes[:-1]]])
        before_stops[offsets[:-1][offsets[:-1] < len(codes)]] = True
        keep = ~empty[codes]
        # a dropped token (line end, bare punctuation) hands its stop on
        name = capital[codes] & ~before_stops
        kept = np.concatenate([[0], np.cumsum(keep)])
        words = kept[offsets]
        all_codes, codes, name = codes, codes[keep], name[keep]
        self.codes, self.words = codes, words
        was_number = np.concatenate([[False], number[codes[:-1]]])
        kind = np.where(number[codes], 1, np.where(name, 2, np.where(unit[codes] & was_number, 3, 0))).astype(np.int8)
        # bare symbols are no words, but tell exact windows apart that hold them
        symbols = np.fromiter((xxhash.xxh3_64_intdigest(w) if e and w != _LINE else 0 for w, e in zip(raw, empty)), np.uint64, len(raw))
        at = np.flatnonzero(keep)
        self.plain = hashes[codes]
        with np.errstate(over="ignore"):
            passed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols[all_codes], dtype=np.uint64)])[at]
            self.led = self.plain.copy()
            self.led[1:] ^= np.diff(passed) * _M2
        # names or numbers side by side, with nothing between them, are one placeholder
        joined = np.zeros(len(codes), bool)
        beside = np.diff(at) == 1
        joined[1:] = (kind[1:] == kind[:-1]) & ((kind[1:] == 1) | (kind[1:] == 2)) & beside & closes[codes[:-1]] & opens[codes[1:]]
        joined[words[:-1][words[:-1] < len(codes)]] = False
        first = np.flatnonzero(~joined)
        self.starts = np.concatenate([first, [len(codes)]])
        self.offsets = np.searchsorted(first, words)
        self.kind = kind[first]
        self.hash = np.select([self.kind == 1, self.kind == 2, self.kind == 3], [_PLACES["number"], _PLACES["name"], _PLACES["unit"]], hashes[codes[first]])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position in the text, hash) of all windows of `size` tokens with enough literals."""
        n = len(self.hash)
        if n < size:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            h = np.full(n - size + 1, np.uint64(size))
            for k in range(size):
                h = (h ^ self.hash[k : n - size + 1 + k]) * _M1
                h ^= h >> np.uint64(31)
            h *= _M2
        owner = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))[: n - size + 1]
        literals = np.concatenate([[0], np.cumsum(self.kind == 0)])
        at = np.flatnonzero((np.arange(n - size + 1) + size <= self.offsets[owner + 1]) & (literals[size:] - literals[:-size] >= min(LITERALS, size)))
        return owner[at], at - self.offsets[owner[at]], h[at]

    def exact(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in words, hash) of all windows of `size` words as they are, whatever their types."""
        n = len(self.plain)
        if n < size:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            h = np.full(n - size + 1, ~np.uint64(size))
            for k in range(size):
                h = (h ^ (self.led if k else self.plain)[k : n - size + 1 + k]) * _M1
                h ^= h >> np.uint64(31)
            h *= _M2
        owner = np.repeat(np.arange(len(self.words) - 1), np.diff(self.words))[: n - size + 1]
        at = np.flatnonzero(np.arange(n - size + 1) + size <= self.words[owner + 1])
        return owner[at], at - self.words[owner[at]], h[at]

    def described(self, text: int, position: int, size: int) -> tuple[int, list[int], list[str]]:
        """A window's place in words, the words of each of its tokens, and their types and values; empty for a literal."""
        start = self.offsets[text] + position
        cuts = self.starts[start : start + size + 1].tolist()
        slots = [f"{self.kind[start + k]}{' '.join(self.values[c] for c in self.codes[a:b])}" if self.kind[start + k] else "" for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
        return cuts[0] - int(self.words[text]), [b - a for a, b in zip(cuts[:-1], cuts[1:])], slots


_WINDOWS = "h long, id long, key long, exact boolean, size int, tokens int, at int, lens array<int>, slots array<string>"


def _emitted(templates: Templates, exact: bool, size: int, chosen, batch, keys) -> list[tuple]:
    owner, at, h = chosen
    words = np.diff(templates.words)

    def described(o, p):
        return (int(p), [1] * size, [""] * size) if exact else templates.described(o, p, size)

    return [(int(x), batch[o], keys[o], exact, size, int(words[o]), *described(o, p)) for o, p, x in zip(owner.tolist(), at.tolist(), h.view(np.int64).tolist())]


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string())]
    names = ["h", "id", "key", "exact", "size", "tokens", "at", "lens", "slots"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _item_windows(batches):
    """Template windows of the items with three tokens at least, and exact windows of all."""
    for batch in slices(batches):
        t = Templates(texts(batch))
        ids, keys, rows = batch.column("id").to_pylist(), batch.column("key").to_pylist(), []
        for exact, lengths, least in ((False, np.diff(t.offsets), LITERALS), (True, np.diff(t.words), 1)):
            for size in {min(WINDOW, int(n)) for n in lengths if n >= least}:
                owner, at, h = t.exact(size) if exact else t.windows(size)
                own = np.minimum(lengths[owner], WINDOW) == size
                rows += _emitted(t, exact, size, (owner[own], at[own], h[own]), ids, keys)
        yield _record(rows)


def _document_windows(sizes: list[tuple[bool, int]], bitmap: bytes):
    def run(batches):
        bits = np.frombuffer(bitmap, np.uint8)
        for batch in slices(batches):
            t = Templates(texts(batch))
            ids, keys, rows = batch.column("id").to_pylist(), batch.column("key").to_pylist(), []
            for exact, size in sizes:
                owner, at, h = t.exact(size) if exact else t.windows(size)
                place = (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                may = np.flatnonzero(bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)
                rows += _emitted(t, exact, size, (owner[may], at[may], h[may]), ids, keys)
            yield _record(rows)

    return lean(run)


def _verbatim(window: tuple) -> bool:
    return window[3] == window[5]


def _consistent(windows: list[tuple]) -> list[tuple]:
    """The windows (item_at, at, item_lens, item_slots, lens, slots) of an alignment that fill the placeholders consistently.

    Of fills that exclude each other (one item value with two document values, or the other way
    round) the one at most places of the item stays, a verbatim one in a tie, otherwise none.
    Windows with another fill go; verbatim windows always stay.
    """
    places: dict[tuple[str, str], set[int]] = {}
    for item_at, _, lens, mine, _, its in windows:
        for fill, n in zip(zip(mine, its), lens):
            if fill[0]:
                places.setdefault(fill, set()).add(item_at)
            item_at += n
    rank = {f: (len(p), f[0] == f[1]) for f, p in places.items()}
    rivals: tuple[dict, dict] = ({}, {})
    for fill in rank:
        for side in (0, 1):
            rivals[side].setdefault(fill[side], []).append(fill)
    stay = {f for f in rank if all(r == f or rank[r] < rank[f] for side in (0, 1) for r in rivals[side][f[side]])}
    return [w for w in windows if _verbatim(w) or all(f in stay for f in zip(w[3], w[5]) if f[0])]


def _covered(windows: list[tuple]) -> int:
    """The most words of the item that the windows lay on words of the document, in order and one on one.

    Only the words of a placeholder may be more on one side: they follow each other at its place.
    """
    pairs = set()
    for item_at, at, item_lens, _, lens, _ in windows:
        for n, m in zip(item_lens, lens):
            pairs.update((item_at + k, -(at + min(k, m - 1)), -max(0, k - m + 1)) for k in range(n))
            item_at, at = item_at + n, at + m
    ends: list[tuple[int, int]] = []
    for _, a, k in sorted(pairs):
        place = (-a, -k)
        at = bisect_left(ends, place)
        ends[at : at + 1] = [place]
    return len(ends)


def _band(tokens: int) -> int:
    """The most words that an alignment may gain or lose on its way through the item."""
    return max(WINDOW, tokens // 4)


def _reach(tokens: int) -> int:
    """The most words of the document between the first windows and the last of an alignment."""
    return tokens + _band(tokens)


def _best(windows: list[tuple], tokens: int) -> tuple[float, bool]:
    """(coverage, whether verbatim windows alone reach it) of the best alignment: windows of one shift, or of a band of shifts."""
    shifts: dict[int, list[tuple]] = {}
    for w in windows:
        shifts.setdefault(w[1] - w[0], []).append(w)
    order, best = sorted(shifts), (0.0, True)
    lines = list(shifts.values())
    for k, s in enumerate(order):
        stop = bisect_right(order, s + _band(tokens))
        # a band that ends where the last one did holds nothing new
        if stop - k > 1 and (not k or stop > bisect_right(order, order[k - 1] + _band(tokens))):
            lines.append([w for near in order[k:stop] for w in shifts[near]])
    for line in lines:
        most = {i for w in line for i in range(w[0], w[0] + sum(w[2]))}
        if len(most) < best[0] * tokens:
            continue
        line = _consistent(line)
        places = _covered(line)
        best = max(best, (places / tokens, _covered([w for w in line if _verbatim(w)]) == places))
        if best == (1.0, True):
            break
    return best


_PAIRED = "doc_id long, key long, item_id long, coverage double, same boolean"


def _aligned(covered: float):
    """Arrow mapper over rows (doc_id, key, item_id, item_key, tokens, item_at, at, item_lens, item_slots, lens, slots), sorted by the first four and `at`.

    A document's windows of an item are taken in stretches of twice the length that an alignment
    may have, each half of which overlaps the next: memory follows the item, not the document.
    """
    names = ("doc_id", "key", "item_id", "item_key", "tokens", "item_at", "at", "item_lens", "item_slots", "lens", "slots")

    def run(batches):
        now, held, best, out = None, [], (0.0, True), []

        def record():
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc_id", "key", "item_id", "coverage", "same"])

        def close():
            found = max(best, _best(held, now[4])) if held else best
            if now and found[0] >= covered:
                out.append((*now[:3], *found))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if row[:5] != now:
                    close()
                    now, held, best = row[:5], [], (0.0, True)
                if best == (1.0, True):
                    continue
                reach = _reach(row[4])
                if held and row[6] - held[0][1] > 2 * reach:
                    best = max(best, _best(held, row[4]))
                    held = [w for w in held if row[6] - w[1] <= reach]
                held.append(row[5:])
            yield record()
            out.clear()
        close()
        yield record()

    return lean(run)


def contaminated(documents: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """(doc_id, key, item_id, coverage, reparameterised): one row for each item found in a text.

    `key` is xxhash64 of the text, which tells rows of one doc_id (or null ids) apart; coverage is
    the share of the item's words under consistent windows of the best alignment;
    reparameterised says that windows with another number, name or unit were needed for it. Items
    are found verbatim whatever their words, down to a single one; a template window needs three
    literal tokens. Null texts and texts without a letter or digit hold nothing and are not found.
    Repeated rows and items count once. Other columns are ignored. An empty table on either side
    gives no rows.
    """
    spark = documents.sparkSession
    items = stored(benchmark.select(F.col("item_id").cast("long").alias("id"), "text", F.xxhash64("text").alias("key")).mapInArrow(lean(_item_windows), _WINDOWS).distinct(), "items")
    bits = bitmap(items.select(F.shiftrightunsigned("h", 64 - BITMAP_BITS).alias("k")), BITMAP_BITS)
    sizes = sorted(tuple(r) for r in items.select("exact", "size").distinct().collect())  # at most twice WINDOW
    if not sizes:
        return spark.createDataFrame([], "doc_id long, key long, item_id long, coverage double, reparameterised boolean")
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64("text").alias("key"))
    found = docs.mapInArrow(_document_windows(sizes, bits), _WINDOWS)
    item = items.select("h", F.col("id").alias("item_id"), F.col("key").alias("item_key"), F.col("at").alias("item_at"), "tokens", F.col("lens").alias("item_lens"), F.col("slots").alias("item_slots"))
    both = found.select("h", F.col("id").alias("doc_id"), "key", "at", "lens", "slots").join(item, "h").where(F.size("slots") == F.size("item_slots"))
    one = ("doc_id", "key", "item_id", "item_key", "tokens")
    both = both.select(*one, "item_at", "at", "item_lens", "item_slots", "lens", "slots").distinct().repartition(*one).sortWithinPartitions(*one, "at", "item_at")
    lines = both.mapInArrow(_aligned(covered), _PAIRED)
    best = lines.groupBy("doc_id", "key", "item_id").agg(F.max(F.struct("coverage", "same")).alias("b"))
    return best.select("doc_id", "key", "item_id", F.col("b.coverage").alias("coverage"), (~F.col("b.same")).alias("reparameterised"))
