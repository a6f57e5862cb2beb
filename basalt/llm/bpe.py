"""Byte-level BPE encoding and decoding by a contiguous array of adjacent ranks.

A word is held as part boundaries with the rank of each adjacent pair. The array is scanned for
the minimum, that boundary is deleted, and the two neighbouring ranks are refreshed, until no
rank is left. Short words of one length are laid under each other and go through these steps
together, one row each; a long run without a break goes through a heap over linked parts, whose
order of merges is the same.

Words repeat, so each slice of texts encodes its distinct chunks only and gathers the ids. A
chunk starts at a single space between two non-space characters, where no pre-token can cross.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import expand, lean, slices, texts

#: Fixed value: the published pre-tokenisation pattern of this vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes up to which a word goes through the rank array; longer ones through the heap.
SHORT = 32
#: Chunks whose ids a worker remembers. Chunks met later are encoded for their slice only.
REMEMBERED = 100_000
NONE = np.int32(2**31 - 1)
#: An empty part, or one with white space at an end, by RE2's syntax.
ODD = r"^$|\A[\t-\r\x1c-\x20\x{85}\p{Z}]|[\t-\r\x1c-\x20\x{85}\p{Z}]\z"
#: Letters under this are judged by str.isalpha alone; the pattern judges all others.
LATIN = "\u0250"


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankArrayBPE:
    """Encoder and decoder for a byte-level BPE vocabulary file in the tokenizers library's JSON."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {i: bytes(letters[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        size = max(raw) + 1
        self.token_bytes = [raw.get(i, b"") for i in range(size)]
        self.lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.pool = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.ranks[vocab[left], vocab[right]] = (rank, vocab[left + right])
        keys = np.array([(a << 20) | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.ranks.values()], np.int32)[order]
        self.merged = np.array([i for _, i in self.ranks.values()], np.int64)
        self.pattern = regex.compile(PATTERN)
        self.gather: ChunkGather | None = None

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def _short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (one after another) and id counts of words of one length, by rank arrays laid under each other."""
        n, length = len(words), len(words[0])
        parts = self.of_byte[np.frombuffer(b"".join(words), np.uint8).reshape(n, length)]
        count = np.full(n, length)
        live, p = np.arange(n), parts
        ranks = self._rank(p[:, :-1], p[:, 1:]) if length > 1 else None
        while length > 1 and len(live):
            m = ranks.argmin(1)
            best = ranks[np.arange(len(live)), m]
            done = best == NONE
            if done.any():
                parts[live[done], : p.shape[1]] = p[done]
                live, p, ranks, m, best = live[~done], p[~done], ranks[~done], m[~done], best[~done]
                if not len(live):
                    break
            row = np.arange(len(live))
            width = p.shape[1]
            # delete the boundary after m: all later parts move one place to the left
            take = np.arange(width - 1)
            p = np.take_along_axis(p, take + (take > m[:, None]), 1)
            p[row, m] = self.merged[best]
            count[live] -= 1
            if width == 2:
                parts[live, 0] = p[:, 0]
                break
            take = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, take + (take >= m[:, None]), 1)
            has = m > 0
            ranks[row[has], m[has] - 1] = self._rank(p[row[has], m[has] - 1], p[row[has], m[has]])
            has = m < width - 2
            ranks[row[has], m[has]] = self._rank(p[row[has], m[has]], p[row[has], m[has] + 1])
        return parts[np.arange(length) < count[:, None]], count

    def _long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: a heap of (rank, position) over linked parts."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(self.ranks[pair][0], i, *pair) for i in range(n - 1) if (pair := (ids[i], ids[i + 1])) in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i] = self.ranks[left, right][1]
            ids[j] = -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (pair := (ids[a], ids[b])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[pair][0], a, *pair))
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens one after another, and each one's count."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts, done = np.zeros(len(words), np.int64), []
        for size in np.unique(sizes).tolist():
            places = np.flatnonzero(sizes == size)
            if size == 0:
                continue
            if size <= SHORT:
                flat, counts[places] = self._short([words[i] for i in places.tolist()])
            else:
                ids = [self._long(words[i]) for i in places.tolist()]
                flat, counts[places] = np.concatenate(ids), [len(x) for x in ids]
            done.append((places, flat))
        starts, out = np.cumsum(counts) - counts, np.empty(int(counts.sum()), np.uint32)
        for places, flat in done:
            out[expand(starts[places], counts[places])] = flat
        return out, counts

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after another, and each one's count; a chunk is pre-tokenised by itself."""
        return by_pieces(chunks, lambda pieces: self.encode_words([p.encode() for p in pieces]), self.pattern)

    def encode(self, text: str) -> list[int]:
        """Ids of one text, special tokens' strings included, as the library gives them without added tokens."""
        return self.encode_batch(pa.array([text], pa.string()))[0].tolist()

    def encode_batch(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order (uint32), and each text's offsets among them."""
        if self.gather is None:
            self.gather = ChunkGather(self.encode_chunks, self.special)
        return self.gather(batch)

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and the running byte count after each id; unknown ids have none."""
        ids = np.where(ids < len(self.lengths), ids, len(self.lengths) - 1).astype(np.int64)
        lengths = self.lengths[ids]
        return self.pool[expand(self.starts[ids], lengths)], np.cumsum(lengths)

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64))[0].tobytes().decode("utf-8", "replace")




def by_pieces(chunks: list[str], encode, pattern) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks one after another, and each one's count, from the ids of their distinct pre-tokens."""
    places: dict[str, int] = {}
    index, pieces = [], []
    place = places.setdefault
    for c in chunks:
        if (w := c[1:]).isalpha() and c[0] == " " and c < LATIN and max(w) < LATIN:
            index.append(place(c, len(places)))
            pieces.append(1)
        elif (w := c[1:-1]).isalpha() and c[0] == " " and c[-1] in ".,;:!?" and max(w) < LATIN:
            index.append(place(c[:-1], len(places)))
            index.append(place(c[-1], len(places)))
            pieces.append(2)
        else:
            found = pattern.findall(c)
            index += [place(p, len(places)) for p in found]
            pieces.append(len(found))
    flat, counts = encode(list(places))
    index, starts = np.array(index, np.int64), np.cumsum(counts) - counts
    ends = np.concatenate([[0], np.cumsum(counts[index])])[np.concatenate([[0], np.cumsum(pieces, dtype=np.int64)])]
    return flat[expand(starts[index], counts[index])], np.diff(ends)


class ChunkGather:
    """Encodes texts by their distinct chunks: new chunks are encoded once, ids are gathered from a bounded memory.

    A chunk starts at a single space between two non-space characters; no pre-token crosses that
    place. Texts with any other space, or with a special token's string, are cut by a slower rule.
    """

    def __init__(self, encode_chunks, special: dict[str, int], limit: int | None = None):
        self.encode_chunks, self.special, self.limit = encode_chunks, special, limit
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.starts, self.counts, self.pool, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(1 << 16, np.uint32), 0

    def places(self, chunks: list[str]) -> np.ndarray:
        """The place of each distinct chunk in memory, after new ones were encoded."""
        known = self.known
        if new := [c for c in chunks if c not in known]:
            special = [c for c in new if c in self.special]
            plain = [c for c in new if c not in self.special]
            flat, counts = self.encode_chunks(plain) if plain else (np.empty(0, np.uint32), np.empty(0, np.int64))
            flat, counts = np.concatenate([flat, np.array([self.special[s] for s in special], np.uint32)]), np.concatenate([counts, np.ones(len(special), np.int64)])
            if self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used + 2 * len(flat), np.uint32)])
            self.pool[self.used : self.used + len(flat)] = flat
            first = len(self.starts)
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.used += len(flat)
            known.update(zip([*plain, *special], range(first, len(self.starts))))
        return np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))

    def trim(self):
        """Forgets the newest chunks beyond the limit."""
        if (over := len(self.known) - (self.limit or REMEMBERED)) > 0:
            for _ in range(over):
                self.known.popitem()
            keep = 1 + max(self.known.values(), default=-1)
            self.starts, self.counts = self.starts[:keep].copy(), self.counts[:keep].copy()
            self.used = int(self.starts[-1] + self.counts[-1]) if keep else 0

    def slow(self, text: str) -> list[str]:
        """Chunks of any text; joined they give the text."""
        out, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            out += [*self.spaced(text[at : m.start()]), m.group()]
            at = m.end()
        return [c for c in (*out, *self.spaced(text[at:])) if c]

    @staticmethod
    def spaced(text: str) -> list[str]:
        parts = text.split(" ")
        out = [[parts[0]]]
        for p in parts[1:]:
            before = out[-1][-1]
            if p and not p[0].isspace() and before and not before[-1].isspace():
                out.append([" " + p])
            else:
                out[-1].append(" " + p)
        return ["".join(x) for x in out]

    def __call__(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(batch, " ")
        d = lists.flatten().dictionary_encode()
        codes = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = d.dictionary.to_pylist()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        odd = pc.match_substring_regex(d.dictionary, ODD).to_numpy(zero_copy_only=False)[codes]
        slow = np.add.reduceat(odd, offsets[:-1]) > 0 if len(sizes) else np.empty(0, bool)
        for s in self.special:
            slow |= pc.match_substring(batch, s).to_numpy(zero_copy_only=False)
        # chunk ids: [0, u) with the space before, [u, ..) texts' first parts and the chunks of slow texts
        u = len(distinct)
        first = offsets[:-1]
        heads: dict[str, int] = {}
        codes[first] = [u + heads.setdefault(distinct[c], len(heads)) for c in codes[first].tolist()]
        if slow.any():
            pieces = []
            for i in range(len(sizes)):
                if slow[i]:
                    cs = [u + heads.setdefault(c, len(heads)) for c in self.slow(batch[i].as_py())]
                    pieces.append(np.array(cs, np.int64))
                else:
                    pieces.append(codes[offsets[i] : offsets[i + 1]])
            codes = np.concatenate(pieces)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
        need = np.zeros(u + len(heads), bool)
        need[codes] = True
        chunks = [" " + p for p in distinct] + list(heads)
        wanted = np.flatnonzero(need)
        place = np.zeros(len(need), np.int64)
        place[wanted] = self.places([chunks[i] for i in wanted.tolist()])
        where = place[codes]
        counts = self.counts[where]
        flat = self.pool[expand(self.starts[where], counts)]
        self.trim()
        return flat, np.concatenate([[0], np.cumsum(counts)])[offsets]


_LOADED: dict[str, RankArrayBPE] = {}


def loaded(path: str) -> RankArrayBPE:
    """One encoder for each vocabulary in a worker."""
    if path not in _LOADED:
        _LOADED[path] = RankArrayBPE(path)
    return _LOADED[path]


def bpe_round_trip(documents: DataFrame, path: str, keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Encodes each whole text and decodes the ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the decoded text in UTF-8), and on request ids (array of int) and decoded
    (string). A null text counts as empty: no tokens. Repeated rows give repeated rows, a null
    doc_id stays null, other columns of the input are ignored, an empty table gives none.
    `path` is the vocabulary file, readable on every executor.
    """

    def run(batches):
        bpe = loaded(path)
        for batch in slices(batches):
            flat, offsets = bpe.encode_batch(texts(batch))
            raw, upto = bpe.decode_bytes(flat)
            upto = np.concatenate([[0], upto])
            cuts = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            ids, decoded = memoryview(flat.astype("<u4").view(np.uint8)), []
            digests = [hashlib.sha256(ids[4 * a : 4 * b]).hexdigest() for a, b in cuts]
            for a, b in cuts:
                out = raw[upto[a] : upto[b]].tobytes()
                try:
                    out.decode()
                except UnicodeDecodeError:
                    out = out.decode("utf-8", "replace").encode()
                decoded.append(out)
            columns = [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(digests, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32))))
                names.append("ids")
            if keep_text:
                columns.append(pa.array([x.decode() for x in decoded], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), schema)
