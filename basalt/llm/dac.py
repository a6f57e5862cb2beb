"""Token ids as directly addressable codes.

Ids are cut into chunks of 8 bits. Level 0 holds each id's lowest chunk; a bitmap marks the ids
that go on, and level 1 holds the next chunk of those alone, and so on. A rank directory (ones
before every 512 bits of a bitmap, and since then before every 64) finds an id's place on the next
level with one more count over a word, so any token is read without decoding a block.

File: magic `DAC2`, then as little-endian u64 the count of ids, the count of documents and the
count of levels; documents' ids (i64) and start offsets (u64, one more than documents); then for
each level its length (u64), its continuation bitmap in 64-bit words (bit i % 64 of word i // 64,
lowest first), its rank directories (u64 a block, u16 a word) and its chunk bytes. Files are rows
(part, seq, payload) of an uncompressed Parquet table, so that any store that Spark writes to can hold them.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import lean, slices, stored, texts

MAGIC = b"DAC2"
#: Bits of a word, and words of a block, of the rank directories.
WORD, BLOCK = 64, 8


class DirectCodes:
    """Ids in chunk levels with continuation bitmaps and rank directories: (chunks, words, ones before each block, ones before each word in its block)."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], count: int):
        self.levels, self.count = levels, count

    @classmethod
    def encode(cls, ids: np.ndarray) -> DirectCodes:
        rest, levels = np.asarray(ids, np.uint32), []
        while True:
            more = rest > 255
            words = np.packbits(np.pad(more, (0, -len(more) % WORD)), bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.uint64)])[: len(words)].astype(np.uint64)
            blocks = before[::BLOCK].copy()
            levels.append((rest.astype(np.uint8), words, blocks, (before - np.repeat(blocks, BLOCK)[: len(words)]).astype("<u2")))
            if not more.any():
                return cls(levels, len(ids))
            rest = rest[more] >> np.uint32(8)

    def access(self, positions) -> np.ndarray:
        """The ids at any positions, each in one step a level."""
        at = np.asarray(positions, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.count):
            raise IndexError("no such token")
        out = np.zeros(len(at), np.uint32)
        live = np.arange(len(at))
        for k, (chunks, words, blocks, inner) in enumerate(self.levels):
            out[live] |= chunks[at].astype(np.uint32) << np.uint32(8 * k)
            word, bit = at // WORD, (at % WORD).astype(np.uint64)
            own = words[word]
            more = np.flatnonzero(own >> bit & np.uint64(1))
            if not len(more):
                break
            live, word = live[more], word[more]
            below = np.bitwise_count(own[more] & ((np.uint64(1) << bit[more]) - np.uint64(1)))
            at = blocks[word // BLOCK].astype(np.int64) + inner[word] + below
        return out

    def all(self) -> np.ndarray:
        """All ids in order."""
        return self.access(np.arange(self.count))

    def to_bytes(self) -> bytes:
        parts = []
        for chunks, words, blocks, inner in self.levels:
            parts += [struct.pack("<Q", len(chunks)), words.tobytes(), blocks.astype("<u8").tobytes(), inner.tobytes(), chunks.tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: memoryview, count: int, levels: int) -> DirectCodes:
        at, out = 0, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            w = -(-n // WORD)
            b = -(-w // BLOCK)
            cuts = np.cumsum([at + 8, 8 * w, 8 * b, 2 * w]).tolist()
            out.append((np.frombuffer(data, np.uint8, n, cuts[3]), np.frombuffer(data, "<u8", w, cuts[0]), np.frombuffer(data, "<u8", b, cuts[1]), np.frombuffer(data, "<u2", w, cuts[2])))
            at = cuts[3] + n
        return cls(out, count)


def pack(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    codes = DirectCodes.encode(ids)
    return MAGIC + struct.pack("<QQQ", len(ids), len(doc_ids), len(codes.levels)) + doc_ids.astype("<i8").tobytes() + starts.astype("<u8").tobytes() + codes.to_bytes()


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, DirectCodes]:
    """(document ids, their start offsets and the end, codes) of a file."""
    if payload[:4] != MAGIC:
        raise ValueError("not a file of directly addressable codes")
    count, docs, levels = struct.unpack_from("<QQQ", payload, 4)
    ids = np.frombuffer(payload, "<i8", docs, 28)
    starts = np.frombuffer(payload, "<u8", docs + 1, 28 + 8 * docs).astype(np.int64)
    return ids, starts, DirectCodes.from_bytes(memoryview(payload)[28 + 8 * (2 * docs + 1) :], count, levels)


#: Code points of texts that go to the library at once: its results are many times larger.
CALL_CHARS = 400_000

#: Code points that `byte_first` writes the library's split out for: Latin letters and the punctuation of prose.
COVERED = [*range(0x250), *range(0x2010, 0x2028)]

_LOADED: dict[str, tuple] = {}


def byte_first(tokenizer) -> bool:
    """Has a plain byte-level tokenizer map a text's bytes to letters before it splits the text, not piece by piece after: same ids, for texts of COVERED alone.

    The split is the library's pattern over the letters of bytes; which code points are letters, numbers or
    blanks is asked of the library. False, and nothing changed, for a tokenizer that prepares texts in any other way.
    """
    from tokenizers import Regex, pre_tokenizers

    own = tokenizer.pre_tokenizer
    if tokenizer.normalizer is not None or not isinstance(own, pre_tokenizers.ByteLevel) or own.add_prefix_space or not own.use_regex:
        return False
    mapped = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    kinds = defaultdict(lambda: defaultdict(str))  # by kind and letters before the last: the last letters
    for c in map(chr, COVERED):
        kind = next((k for k in "a1!" if len(own.pre_tokenize_str(k + c)) == 1), " ")
        letters = mapped.pre_tokenize_str(c)[0][0]
        kinds[kind][letters[:-1]] += f"\\x{{{ord(letters[-1]):x}}}"

    def one(kind: str) -> str:
        return "(?:" + "|".join(f"{lead}[{last}]" + "++" * (not lead and kind != " ") for lead, last in sorted(kinds[kind].items())) + ")"

    blank = one(" ")
    split = "|".join([f"Ġ?{one('a')}++", "'(?:[stmd]|re|ve|ll)", f"Ġ?{one('1')}++", f"Ġ?{one('!')}++", f"{blank}+(?={blank}|\\z)", f"{blank}+"])
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([mapped, pre_tokenizers.Split(Regex(split), "isolated")])
    return True


def library_encoder(path: str):
    """A function texts -> (all ids, offsets of each text) that gives whole texts to the tokenizers library; one for each vocabulary in a worker."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        tokenizer, quick = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (tokenizer, quick):
            t.no_padding()
            t.no_truncation()
        _LOADED[path] = tokenizer, quick if byte_first(quick) else None
    tokenizer, quick = _LOADED[path]
    uncovered = re.compile("[^" + "".join(map(re.escape, map(chr, COVERED))) + "]")

    def encode(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts, counts, call, size = [np.empty(0, np.uint32)], [], [], 0

        def flush():
            lists = [[]] * len(call)
            covered = [quick is not None and not uncovered.search(text) for text in call]
            for coder, is_own in ((quick, True), (tokenizer, False)):
                at = [i for i, c in enumerate(covered) if c == is_own]
                for i, e in zip(at, coder.encode_batch_fast([call[i] for i in at], add_special_tokens=False) if at else []):
                    lists[i] = e.ids
            counts.extend(map(len, lists))
            parts.append(np.fromiter(itertools.chain.from_iterable(lists), np.uint32, sum(map(len, lists))))

        for text in array.to_pylist():
            call.append(text)
            size += len(text)
            if size >= CALL_CHARS:
                flush()
                call, size = [], 0
        if call:
            flush()
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

    return encode


NULL_DOC = -(2**63)


def write_codes(documents: DataFrame, path: str, end_id: int | None = 0) -> DataFrame:
    """Encodes all texts (null: empty) in ascending doc_id order and writes the files; returns the written table.

    Columns part, seq (order of files), n_tokens and payload. Each document ends with end_id, if
    given. Rows that repeat a doc_id follow each other by text; a null doc_id comes first. Other
    columns are ignored; an empty table writes no file.
    """
    import os

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part = library_encoder(path), TaskContext.get().partitionId()
        for seq, batch in enumerate(slices(batches)):
            flat, offsets = encoder(texts(batch))
            if end_id is not None:
                flat = np.insert(flat, offsets[1:], np.uint32(end_id))
                offsets = offsets + np.arange(len(offsets))
            docs = batch.column("doc_id").fill_null(NULL_DOC).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([pack(docs, offsets, flat)], pa.binary())], names=["part", "seq", "n_tokens", "payload"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # range bounds over the ids alone; equal ids stay together and are ordered by text
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(dealt.mapInArrow(lean(run), "part int, seq int, n_tokens long, payload binary"), "token-files", "uncompressed")


def file_starts(files: DataFrame) -> DataFrame:
    """(part, seq, before): ids in all files before each; sums over a part, then over the parts' totals."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    # one row for each part: the number of parts is a setting, not the data's size
    ahead = totals.select("part", (F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("ahead"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)).alias("inside"))
    return inside.join(ahead, "part").select("part", "seq", (F.col("inside") + F.coalesce("ahead", F.lit(0))).alias("before"))


#: Ids that are read at once, and those up to the end of a document.
READ_IDS = 1 << 16


def read_codes(files: DataFrame) -> DataFrame:
    """One row per document of written files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for part, seq, payload in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("payload")):
                docs, starts, codes = unpack(payload.as_buffer().to_pybytes())
                n, sums = len(docs), []
                # documents' ids by their own places, for those that start in one stretch of ids together
                for i, j in itertools.pairwise([*np.flatnonzero(np.diff(starts[:-1] // READ_IDS, prepend=-1)).tolist(), n]):
                    ids = codes.access(np.arange(starts[i], starts[j])).astype("<u4")
                    sums += [zlib.crc32(ids[a:b]) for a, b in itertools.pairwise((starts[i : j + 1] - starts[i]).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(docs, mask=docs == NULL_DOC), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(sums, pa.int64())],
                    names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    rows = files.select("part", "seq", "payload").mapInArrow(lean(run), "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(file_starts(files.select("part", "seq", "n_tokens")), ["part", "seq"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
