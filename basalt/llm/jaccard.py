"""N-gram Jaccard join over a count-vector R-tree, and the groups its links make.

A document's set holds its distinct word n-grams (64-bit hashes). Tokens are hashed into groups, a
power of two that follows the set's size; a set's counts per group are its point, and halves of a
point folded onto each other give the point of half as many groups. Since overlap cannot pass the summed
coordinate minima, an R-tree over points (boxes of coordinate maxima) yields the pairs that may
reach the threshold, and the surviving pairs are verified on the whole sets.

At scale one tree over all points would compare everything of like size, so the points are first
dealt into blocks, none of which loses a pair: under any fixed order of tokens, two sets with
J >= t share a token among the first n - ceil(t n) + 1 of each. The order is by hash, but tokens
that several documents share come after those of one document, and tokens that many share last, so
shared passages and frequent phrases do not make blocks. Sharing is counted over all tokens of all
different texts, into bitmaps whose size follows the number of shared ones; a token without its bit
stands in one text only and names no block. The counts move as packed 32-bit numbers, not as rows.
Of two such sets the smaller has a shared token among its first n - ceil(2t n / (1 + t)) + 1
already, so a token that is in no set's first so many names no block either. Equal sets are one node.

Links are found in turns, over the blocks that still hold several groups. First each node meets
only two of its blocks and its likeliest partner there is verified, again and again as long as this
merges much. Then each node outside a block's largest group gets its likeliest partner in every
other group; last, all its surviving partners in other groups. A group of many near copies thus
costs a few rows a node, not all its pairs, and no link between groups is lost. Blocks of many
nodes are indexed in parts: in the first turns a few nodes of the block meet all parts and tie them
together, later only nodes outside the largest group do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .text import bitmap, coded, collected, discard, lean, slices, split_words, stored, texts

#: Groups of tokens: the fewest, the most that are finer than a token each, and tokens that a group of larger sets holds.
LEAST_GROUPS = 16
FINE_GROUPS = 2048
PER_GROUP = 2
#: A count of 255 or more is stored as 255 and read as this: the bound only grows.
FULL = 65535
#: Tokens are counted by their upper bits: these name the part that counts them, 32 more the token there. Tokens that agree in all of
#: them count as one, which only makes them look shared.
PART_BITS = 10
#: A token of so many texts comes last in the order.
OFTEN = 32
#: Bits of the shared-token bitmap for each shared token, and the most in all as a power of two. A false hit loses no pair, but a full
#: bitmap makes every token look shared and so fills the prefixes.
BITS_A_TOKEN = 8
BITMAP_BITS = 28
#: Bits a wanted doc_id gets, and the most in all, in the bitmaps by which texts are left out before they are shuffled.
BITS_AN_ID = 16
MOST_ID_BITS = 26
#: Rows compared with one centre in a task.
CENTRE_ROWS = 512
#: Points of a block that one task indexes at once; larger blocks are dealt out in parts. Nodes that tie parts together.
BLOCK_POINTS = 1024
HUBS = 32
#: Blocks whose names a node's rows carry, at most: pairs of nodes with more come from each block and are made distinct later.
NAMES = 256
#: Turns of few pairs go on while one finds more than this part (one in ..) of the first one's links.
WORTH = 20
#: Parts into which the rows of any key are dealt where facts of the key are joined to them.
SALTS = 16
LEAF = 32
#: Bytes of coordinates compared at once.
COMPARED = 1 << 21

_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MULT[3]
    h = (h ^ (h >> np.uint64(29))) * _MULT[4]
    return h ^ (h >> np.uint64(32))


def shingle_sets(array: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingle hashes, ascending; fewer words are one shingle, none an empty set."""
    flat, offsets = split_words(array)
    codes, distinct = coded(flat)
    if not len(codes):
        return [np.empty(0, np.uint64)] * len(array)
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))[codes]
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(words), np.uint64)
        for k in range(min(n, len(words))):
            rolled[: len(words) - k] = _mixed(rolled[: len(words) - k] * _MULT[0] + words[k:] + _MULT[1])
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(rolled[a : b - n + 1]))
            elif b > a:
                short = np.uint64(b - a)
                for w in words[a:b]:
                    short = (short * _MULT[2]) ^ w
                out.append(_mixed(np.array([short], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _groups(n: int) -> int:
    """Sets whose sizes differ by less than a factor of two have equal or neighbouring numbers of groups."""
    return max(LEAST_GROUPS, min(1 << max(2 * n - 1, 0).bit_length(), FINE_GROUPS), 1 << (max(n - 1, 0) // PER_GROUP).bit_length())


def _dealt(tokens: np.ndarray) -> pa.RecordBatch:
    """The tokens as one row for each part: part, tokens (packed 32-bit numbers, ascending)."""
    keys = np.sort(tokens >> np.uint64(32 - PART_BITS))
    parts = (keys >> np.uint64(32)).astype(np.int32)
    edges = np.concatenate([[0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(parts)]])
    if not len(parts):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.binary())], names=["part", "tokens"])
    offsets = pa.py_buffer((4 * edges).astype(np.int32))
    packed = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, offsets, pa.py_buffer(keys.astype(np.uint32))])
    return pa.RecordBatch.from_arrays([pa.array(parts[edges[:-1]]), packed], names=["part", "tokens"])


_PARTS = "part int, tokens binary"


def _counted_tokens(n: int, only: bytes):
    """Arrow mapper: doc_id, text -> the tokens of the documents in the bitmap `only`, each once for each text, packed by part."""

    def run(batches):
        for batch in slices(_among(batches, "doc_id", only)):
            yield _dealt(np.concatenate(shingle_sets(texts(batch), n)))

    return lean(run)


def _common(dealt: DataFrame, least: int) -> DataFrame:
    """(part, shared, often), packed: the tokens that occur `least` times, and OFTEN times, at least."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for part, x in zip(batch.column("part").to_pylist(), batch.column("tokens").to_pylist()):
                held.setdefault(part, []).append(x)
        for part in list(held):
            x = np.sort(np.frombuffer(b"".join(held.pop(part)), np.uint32))
            heads = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
            times = np.diff(heads, append=len(x))
            packed = [pa.array([x[heads[times >= k]].tobytes()], pa.binary()) for k in (least, OFTEN)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *packed], names=["part", "shared", "often"])

    return stored(dealt.repartition("part").mapInArrow(lean(run), "part int, shared binary, often binary"), "many")


def _part_bitmap(common: DataFrame, column: str) -> bytes:
    """A bitmap over the packed tokens of a column, by their upper bits: a part's tokens lie side by side. Its size follows their number up to a bound."""
    count = common.agg(F.sum(F.octet_length(column))).first()[0] or 0
    bits = min(BITMAP_BITS, max(16, (BITS_A_TOKEN * count // 4).bit_length()))
    width = max(1, (1 << (bits - PART_BITS)) // 8)

    def start(part: int) -> int:
        return (part << (bits - PART_BITS)) >> 3

    def own(batches):
        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = ((np.uint64(part << 32) | np.frombuffer(x, np.uint32)) >> np.uint64(32 + PART_BITS - bits)).astype(np.int64)
                out = np.zeros(width, np.uint8)
                np.bitwise_or.at(out, (at >> 3) - start(part), (128 >> (at & 7)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["part", "bits"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in common.select("part", column).mapInArrow(own, "part int, bits binary").collect():  # the bitmap itself: 2**bits / 8 bytes at most
        out[start(r.part) : start(r.part) + width] |= np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def _token_bitmap(shared: DataFrame) -> bytes:
    """A bitmap over the tokens t, of a size that follows their number up to a bound."""

    def dealt(batches):
        for batch in batches:
            yield _dealt(batch.column("t").to_numpy(zero_copy_only=False).view(np.uint64))

    common = _common(shared.select("t").mapInArrow(dealt, _PARTS), 1)
    out = _part_bitmap(common, "shared")
    discard(common)
    return out


def _told(s: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which tokens have their bit."""
    at = (s >> np.uint64(65 - (8 * len(bitmap)).bit_length())).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _shared_tokens(docs: DataFrame, n: int) -> tuple[bytes, bytes]:
    """Bitmaps of the tokens that several different texts hold, and that many do. Of equal texts the one with the smallest doc_id counts."""
    digest = (F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    ids = stored(docs.where("doc_id is not null").groupBy(*(d.alias(f"d{i}") for i, d in enumerate(digest))).agg(F.min("doc_id").alias("id")).select("id"), "different")
    only = _id_bitmap(ids, ids.count())
    discard(ids)
    common = _common(docs.where("doc_id is not null").mapInArrow(_counted_tokens(n, only), _PARTS), 2)
    collected(docs.sparkSession)
    out = _part_bitmap(common, "shared"), _part_bitmap(common, "often")
    discard(common)
    return out


def _described(n: int, percent: int, shared: bytes, often: bytes):
    """Arrow mapper: doc_id, text -> doc_id, n, h1, h2, point, prefix, firsts. Bitmaps of the tokens that several texts share, and many.

    The prefix leaves out tokens that stand in one text only; without any other the point is empty too.
    `firsts`: how many of the prefix are among those of which a larger set's prefix holds one.
    """

    def run(batches):
        some, many = np.frombuffer(shared, np.uint8), np.frombuffer(often, np.uint8)
        for batch in slices(batches):
            size, h1, h2, points, prefixes, firsts = [], [], [], [], [], []
            for s in shingle_sets(texts(batch), n):
                size.append(len(s))
                a, b = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                h1.append(a)
                h2.append(b)
                keep = len(s) - (len(s) * percent + 99) // 100 + 1 if len(s) else 0
                late = s[_told(s, some)]
                alone = len(s) - len(late)
                if keep > alone:
                    # in order: tokens of one text, shared ones by hash, frequent ones by hash
                    last = _told(late, many)
                    prefix = np.concatenate([late[~last], late[last]])[: keep - alone]
                else:
                    prefix = late[:0]
                prefixes.append(prefix.view(np.int64))
                least = (2 * percent * len(s) + 99 + percent) // (100 + percent)
                firsts.append(min(len(prefix), max(0, len(s) - least + 1 - alone)))
                groups = _groups(len(s))
                full = np.bincount((s >> np.uint64(20)).astype(np.int64) & (groups - 1), minlength=groups) if len(prefix) else np.empty(0)
                points.append(np.minimum(full, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(points, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(firsts, pa.int32())],
                names=["doc_id", "n", "h1", "h2", "point", "prefix", "firsts"],
            )

    return lean(run)


def _id_bucket(ids: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mixed(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _among(batches, column: str, bitmap: bytes):
    """The rows whose id is in the bitmap (or shares a bit with one that is)."""
    bits = np.frombuffer(bitmap, np.uint8)
    for batch in batches:
        if batch.num_rows:
            at = _id_bucket(batch.column(column).fill_null(0).to_numpy(zero_copy_only=False), (8 * len(bits)).bit_length() - 1)
            batch = batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
        yield batch


def _id_bitmap(ids: DataFrame, count: int) -> bytes:
    """A bitmap over the single column of `count` ids, of a size that follows their number up to a bound."""
    bits = min(MOST_ID_BITS, max(16, (BITS_AN_ID * count).bit_length()))

    def buckets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_id_bucket(b.column(0).to_numpy(zero_copy_only=False), bits))], names=["k"])

    return bitmap(ids.mapInArrow(buckets, "k long"), bits)


_DESCRIBED = "doc_id long, n long, h1 long, h2 long, point binary, prefix array<long>, firsts int"


class CountTree:
    """R-tree over count vectors, bulk-loaded by size: a box keeps its coordinate maxima and its least size."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        self.order = np.lexsort((points.argmax(1), sizes))
        self.sizes, self.points = sizes[self.order], points[self.order]
        self.levels = []
        tops, least = self.points, self.sizes
        while len(least) > LEAF or not self.levels:
            cuts = np.arange(0, len(least), LEAF if not self.levels else 8)
            tops, least = np.maximum.reduceat(tops, cuts), np.minimum.reduceat(least, cuts)
            self.levels.append((tops, least))
            if len(least) == 1:
                break

    def search(self, size: int, point: np.ndarray, percent: int) -> np.ndarray:
        """Positions of all points whose summed minima with `point` allow the threshold."""

        def may(tops, least):
            return (100 + percent) * _overlap(tops, point) >= percent * (size + least)

        live = np.flatnonzero(may(*self.levels[-1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            if not len(live):
                return live
            width = LEAF if depth == 0 else 8
            below = (self.points, self.sizes) if depth == 0 else self.levels[depth - 1]
            kids = (live[:, None] * width + np.arange(width)).ravel()
            kids = kids[kids < len(below[1])]
            live = kids[may(below[0][kids], below[1][kids])]
        return self.order[live]


def _unpacked(points: list[bytes]) -> np.ndarray:
    out = np.frombuffer(b"".join(points), np.uint8).reshape(len(points), -1)
    if not (out == 255).any():
        return out
    out = out.astype(np.uint16)
    out[out == 255] = FULL
    return out


def _folded(points: np.ndarray) -> np.ndarray:
    half = points.shape[1] // 2
    return np.minimum(points[:, :half].astype(np.uint32) + points[:, half:], FULL).astype(np.uint16)


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed coordinate minima along the last axis."""
    return np.minimum(a, b).sum(-1, dtype=np.int64)


def _block_pairs(percent: int, partners: str):
    """Arrow mapper over rows (key, side, ask, id, n, point, label, major, block, names) sorted by key: pairs that survive the tree.

    Side 0 rows are indexed; rows that `ask` are searched for. Yields (id, other, label, score): an asking node,
    a partner of another label, the partner's label and the bound on their similarity in steps of a twentieth.
    `partners`: "one", that of the highest score, then smallest id, for each asking node; "each", the same for
    each other label; "all", every pair, in the first of the blocks that its nodes name both (`names`, ascending;
    null names no block, and its pairs come from each). `major` marks nodes of the block's largest group: they do not ask.
    """

    def one(ids, sides, asks, sizes, points, labels, majors, names, block, found):
        # sets that may link differ by less than a factor of two: their numbers of groups are equal or neighbours
        widths = np.fromiter(map(len, points), np.int64, len(points))
        for width in np.unique(widths).tolist():
            at, above = np.flatnonzero(widths == width), np.flatnonzero(widths == 2 * width)
            x = _unpacked([points[i] for i in at])
            if len(above):
                x, at = np.concatenate([x, _folded(_unpacked([points[i] for i in above]))]), np.concatenate([at, above])
            if len(at) > 1:
                within(ids[at], sides[at], asks[at], sizes[at], x, labels[at], majors[at], names and [names[i] for i in at], block, found, len(at) - len(above))

    def within(ids, sides, asks, sizes, points, labels, majors, names, block, found, lower):
        """`lower`: how many points, from the first, have this width themselves; pairs of two wider ones come later."""
        own, asking = np.flatnonzero(sides == 0), np.flatnonzero(asks)
        if not len(own) or not len(asking):
            return
        tree = CountTree(sizes[own], points[own]) if len(own) > LEAF else None
        step = max(1, COMPARED // (len(own) * points.shape[1] * points.itemsize))
        for start in range(0, len(asking), step):
            some = asking[start : start + step]
            if tree is None:
                bound = _overlap(points[some, None, :], points[None, own, :])
            for k, i in enumerate(some.tolist()):
                if tree is None:
                    near, over = own, bound[k]
                else:
                    near = own[tree.search(sizes[i], points[i], percent)]
                    over = _overlap(points[near], points[i])
                low, high = np.minimum(sizes[near], sizes[i]), np.maximum(sizes[near], sizes[i])
                good = ((100 + percent) * over >= percent * (low + high)) & (labels[near] != labels[i]) & (100 * low >= percent * high)
                if i >= lower:
                    good &= near < lower
                if partners == "all":
                    good &= majors[near] | (ids[i] < ids[near])
                if good.any():
                    over, total = np.minimum(over, low)[good], (low + high)[good]
                    near = near[good]
                    if partners == "all":
                        first = [first_common(names[i], names[j], block) for j in near.tolist()]
                        near, over, total = near[first], over[first], total[first]
                    keep(int(ids[i]), ids[near], labels[near], 20 * over // (total - over), found)

    def first_common(a, b, block):
        return a is None or b is None or min(set(a).intersection(b)) == block

    def keep(me, others, labels, scores, found):
        if partners == "all":
            found.update(dict.fromkeys(((me, o) for o in others.tolist()), (0, 0)))
            return
        if partners == "one":
            labels = np.zeros(len(others), np.int64)
        order = np.lexsort((others, -scores, labels))
        _, firsts = np.unique(labels[order], return_index=True)
        for k in order[firsts].tolist():
            mine = (me, int(labels[k]))
            found[mine] = max(found.get(mine, (-1, 0)), (int(scores[k]), -int(others[k])))

    def flush(found):
        rows = [(a, b, 0, 0) for a, b in found] if partners == "all" else [(a, -other, label, score) for (a, label), (score, other) in found.items()]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["id", "other", "label", "score"])

    def run(batches):
        held, found = None, {}

        def blocks(t, last):
            keys = t.column("key").to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            stop = len(keys) if last else (cuts[-1] if len(cuts) else 0)
            if stop:
                ids, sides, asks, sizes, labels, majors = (t.column(c).to_numpy()[:stop] for c in ("id", "side", "ask", "n", "label", "major"))
                points = t.column("point").slice(0, stop).to_pylist()
                blocks_of, names = t.column("block").to_numpy(), t.column("names").slice(0, stop).to_pylist() if partners == "all" else None
                edges = [0, *cuts[cuts < stop].tolist(), stop]
                for a, b in zip(edges[:-1], edges[1:]):
                    if b - a > 1:
                        one(ids[a:b], sides[a:b], asks[a:b], sizes[a:b], points[a:b], labels[a:b], majors[a:b], names and names[a:b], int(blocks_of[a]), found)
            return t.slice(stop)

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            held = blocks(held.combine_chunks(), False)
            if len(found) > 200_000:
                yield flush(found)
        if held is not None and held.num_rows:
            blocks(held.combine_chunks(), True)
        if found:
            yield flush(found)

    return lean(run)


def _verified(n: int, percent: int):
    """Arrow mapper over rows (a, salt, b, text), centre rows (b null) first: the pairs that link."""

    def run(batches):
        now, centres, links = None, [], []
        for batch in slices(batches):
            a, salt, b = (batch.column(c).to_pylist() for c in ("a", "salt", "b"))
            for i, own in enumerate(shingle_sets(texts(batch), n)):
                if (a[i], salt[i]) != now:
                    now, centres = (a[i], salt[i]), []
                if b[i] is None:
                    centres.append(own)
                    continue
                for c in centres:
                    small, large = (own, c) if len(own) < len(c) else (c, own)
                    if len(small) * 100 < len(large) * percent or not len(small):
                        continue
                    at = np.searchsorted(large, small)
                    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    if 100 * common >= percent * (len(small) + len(large) - common):
                        links.append((a[i], b[i]))
                        break
            if len(links) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
                links = []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return lean(run)


def _linked(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> tuple[DataFrame, int]:
    """The pairs (a, b) that verification on whole texts keeps, and the number of pairs (id, other) asked about. A centre with many partners is dealt over several tasks."""
    pairs = stored(pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "pairs")
    count = pairs.count()
    if not count:
        return pairs, 0
    only = _id_bitmap(pairs.select(F.explode(F.array("a", "b")).alias("id")), 2 * count)
    docs = docs.mapInArrow(lambda batches: _among(batches, "doc_id", only), "doc_id long, text string")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CENTRE_ROWS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"))
    wanted = dealt.select("a", "salt", "b", F.col("b").alias("doc_id")).union(dealt.select("a", "salt", F.lit(None).cast("long").alias("b"), F.col("a").alias("doc_id")).distinct())
    rows = wanted.join(docs, "doc_id").select("a", "salt", "b", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    links = stored(rows.mapInArrow(_verified(n, percent), "a long, b long").distinct(), "links")
    discard(pairs)
    return links, count


def _with_facts(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """`rows` (key, id, ..) with the columns of `facts` (one row a key). A frequent key's rows stay dealt out by their salts."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    dealt = rows.select(key, "salt").distinct().join(facts, key)
    return rows.join(dealt, [key, "salt"]).drop("salt")


def _shared(nodes: DataFrame) -> DataFrame:
    """(block, id): blocks of the nodes that share a prefix token, if it is among the first ones of any of them.

    Tokens that the same nodes share make one block: its name is a digest of its members. Should two
    sets of members have one digest, their blocks unite and no pair is lost.
    """
    posts = nodes.where(F.size("prefix") > 0).select("id", "firsts", F.posexplode("prefix").alias("at", "token")).select("id", "token", (F.col("at") < F.col("firsts")).alias("first"))
    facts = posts.groupBy("token").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("members"), F.max("first").alias("first")).where("m > 1 and first")
    named = _with_facts(posts.drop("first"), facts.select("token", F.xxhash64("members", "m").alias("block")), "token")
    return stored(named.select("block", "id").distinct(), "shared")


_PAIRS = "id long, other long, label long, score long"


def _met(rows: DataFrame, nodes: DataFrame, percent: int, partners: str) -> DataFrame:
    """Pairs of rows (block, cell, side, ask, id, label, major) that meet in a cell of a block and survive its tree."""
    rows = rows.withColumn("key", F.xxhash64("block", "cell")).drop("cell").join(nodes.select("id", "n", "point"), "id")
    if partners == "all":
        names = rows.groupBy("id").agg(F.array_sort(F.collect_set("block")).alias("names")).where(F.size("names") <= NAMES)
        rows = rows.join(names, "id", "left")
    rows = rows.repartition("key").sortWithinPartitions("key")
    pairs = rows.mapInArrow(_block_pairs(percent, partners), _PAIRS)
    if partners == "all":
        return pairs
    best = F.max(F.struct("score", (-F.col("other")).alias("other"))).alias("best")
    return pairs.groupBy("id", "label").agg(best).select("id", (-F.col("best.other")).alias("other"))


def _mixed_blocks(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(block, id, label, major, m): the rows of blocks that hold several groups; `major` marks a block's largest group, if any has two nodes."""
    if labels is None:
        told = shared.withColumn("label", F.col("id"))
    else:
        told = shared.join(labels, "id", "left").select("block", "id", F.coalesce("label", "id").alias("label"))
    counts = told.groupBy("block", "label").agg(F.count("*").alias("c"))
    facts = counts.groupBy("block").agg(F.max(F.struct("c", (-F.col("label")).alias("l"))).alias("top"), F.count("*").alias("groups"), F.sum("c").alias("m")).where("groups > 1")
    rows = _with_facts(told, facts.select("block", (-F.col("top.l")).alias("top"), F.col("top.c").alias("c"), "m"), "block")
    return rows.select("block", "id", "label", ((F.col("label") == F.col("top")) & (F.col("c") > 1)).alias("major"), "m")


def _few_pairs(mixed: DataFrame, nodes: DataFrame, percent: int, turn: int) -> DataFrame:
    """The likeliest partner in another group of each node in two of its blocks, which near copies mostly agree on; others in each turn."""
    place = F.struct(F.xxhash64("block", F.lit(turn)), "block", "major")
    two = mixed.groupBy("id", "label").agg(F.min(place).alias("x"), F.max(place).alias("y"))
    rows = two.select("id", "label", F.explode(F.array_distinct(F.array("x", "y"))).alias("at")).select("id", "label", "at.block", "at.major")
    rows = _with_facts(rows, rows.groupBy("block").agg(F.count("*").alias("m")).where("m > 1"), "block")
    parts = F.ceil(F.col("m") / BLOCK_POINTS).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    hub = (parts > 1) & (F.pmod(F.xxhash64("id", F.lit("hub")), F.col("m")) < HUBS)
    # a hub is a point of every part and asks in its own
    rows = rows.withColumn("cell", F.explode(F.when(hub, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))))
    asks = (F.col("cell") == own) & ~F.col("major")
    return _met(rows.select("block", "cell", F.lit(0).alias("side"), asks.alias("ask"), "id", "label", "major"), nodes, percent, "one")


def _other_pairs(mixed: DataFrame, nodes: DataFrame, percent: int, partners: str) -> DataFrame:
    """Pairs across groups in all mixed blocks, asked by all nodes but those of a block's largest group."""
    parts = F.ceil(F.col("m") / BLOCK_POINTS).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    cells = F.when(F.col("major"), F.array(own)).otherwise(F.sequence(F.lit(0), parts - 1))
    rows = mixed.withColumn("cell", F.explode(cells)).withColumn("side", F.when(F.col("cell") == own, 0).otherwise(1))
    return _met(rows.select("block", "cell", "side", (~F.col("major")).alias("ask"), "id", "label", "major"), nodes, percent, partners)


def jaccard_groups(documents: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of `documents`: doc_id, n_shingles, component_id (smallest doc_id reached by links).

    Null and blank texts have an empty set (n_shingles 0) and link with nothing. Rows that repeat a
    doc_id are one document and count as linked. A null doc_id takes no part in links: its
    component_id is null. Other columns of the input are ignored, so their names cannot clash.
    An empty table gives an empty table.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = stored(docs.mapInArrow(_described(n, percent, *_shared_tokens(docs, n)), _DESCRIBED), "sets")
    collected(docs.sparkSession)
    named = told.where("doc_id is not null and n > 0")
    nodes = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n", "point", "prefix", "firsts")))
    nodes = stored(nodes, "nodes")
    reps = nodes.select("h1", "h2", F.col("id").alias("rep"))
    rows = stored(told.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2").join(reps, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "rows")
    discard(told)
    repeated = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    links = stored(rows.join(repeated, "doc_id").select("a", F.col("rep").alias("b")), "same")

    shared, used = _shared(nodes), [links]
    turn, labels, first, stages = 0, None, 0, ["few", "each", "all"]
    while stages:
        mixed = stored(_mixed_blocks(shared, labels), "mixed")
        pairs = _few_pairs(mixed, nodes, percent, turn) if stages[0] == "few" else _other_pairs(mixed, nodes, percent, stages[0])
        more, asked = _linked(docs, pairs, n, percent)
        discard(mixed)
        used.append(more)
        count = more.count() if asked else 0
        if count or labels is None:
            links = links.union(more.select("a", "b"))
            if labels is not None:
                discard(labels)
            labels = components(links)
        first, turn = first or count, turn + 1
        # few pairs a turn as long as these merge much
        if stages[0] != "few" or 10 * count <= asked or WORTH * count <= first:
            stages.pop(0)
    discard(nodes, shared, *used)
    out = rows.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep")).alias("component_id"))
