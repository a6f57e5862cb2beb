"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample and holds centres only. Every vector is indexed: it
descends to its nearest leaf. A query walks the tree with a priority queue of nodes, best centre
first, and visits as many leaves as calibration found to reach the wanted recall: on a bounded set
of queries, answers over all rows by brute force (in blocks) show how far visits must widen.

Equal vectors are one point that keeps its smallest ids, as many as a result can show, so a
vector that a third of the rows share costs one point. A leaf's points are dealt out in parts, and so
are its queries: a task streams queries past one part, whatever their number. A leaf answers with its
best points that reach the query's bar, a score that a few times k points of the fitted sample reach; a
query that finds too few points above its bar visits its leaves again without one.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import lean, stored

#: Bounds: vectors in the fitted sample, leaves, calibration queries; children of a node; points of a leaf's part, and queries.
SAMPLE = 20_000
LEAVES = 4096
CALIBRATION = 200
BRANCH = 16
PART = 4096
ASKED = 16_384
#: Queries that meet a part in one matrix product.
TOGETHER = 1024
#: Points that a leaf should hold: this number, or this multiple of the square root of all, so that leaves visited
#: grow less than the rows; and the recall that calibration must show.
LEAF_POINTS = 256
LEAF_ROOTS = 4
RECALL = 0.95


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's algorithm: centres (without empty ones) and each row's centre."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        near = (-2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        used = np.unique(near)
        centres = np.stack([x[near == c].mean(0) for c in used])
    return centres, (-2 * x @ centres.T + (centres**2).sum(1)).argmin(1)


class MeansTree:
    """Centres of all nodes; children of node i are kids[i], a leaf has none and a number."""

    def __init__(self, sample: np.ndarray, leaf_size: int, seed: int = 5):
        self.centres, self.kids, self.leaf = [sample.mean(0) if len(sample) else np.zeros(0)], [[]], [-1]
        rng, stack, self.leaves = np.random.default_rng(seed), [(0, sample)], 0
        while stack:
            node, x = stack.pop()
            k = min(BRANCH, len(x) // max(leaf_size, 1) + 1, len(x))
            if k >= 2 and len(x) > leaf_size:
                centres, near = _means(x, k, rng)
                if len(centres) > 1:
                    for c in range(len(centres)):
                        self.kids[node].append(len(self.centres))
                        self.centres.append(centres[c])
                        self.kids.append([])
                        self.leaf.append(-1)
                        stack.append((len(self.centres) - 1, x[near == c]))
                    continue
            self.leaf[node] = self.leaves
            self.leaves += 1
        self.centres = np.array(self.centres)
        self.squares = (self.centres**2).sum(1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child on each level."""
        out = np.empty(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if not self.kids[node]:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.kids[node])
            near = (-2 * x[rows] @ self.centres[kids].T + self.squares[kids]).argmin(1)
            stack += [(int(kid), rows[near == c]) for c, kid in enumerate(kids)]
        return out

    def visit(self, q: np.ndarray, most: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """Leaves for a query, best bin first: a queue of nodes by their centre's inner product.

        Goes on until `most` leaves were visited and, by `sizes`, `least` points seen.
        """
        value = self.centres @ q
        heap, out, seen = [(-value[0], 0)], [], 0
        while heap and (len(out) < most or seen < least):
            _, node = heapq.heappop(heap)
            if self.kids[node]:
                for kid in self.kids[node]:
                    heapq.heappush(heap, (-value[kid], kid))
            else:
                out.append(self.leaf[node])
                seen += sizes.get(self.leaf[node], 0) if sizes else 0
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as float64 of one width."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _best(q: np.ndarray, x: np.ndarray, ids: list, keep: int) -> list[list[tuple[float, int, bool]]]:
    """For each query the `keep` best (score, id, whether its vector is the query's): largest inner product, then smallest id. ids: each point's ids, ascending."""
    rough, out = q @ x.T, []
    firsts = np.array([i[0] for i in ids])
    for row, v in zip(rough, q):
        slack = 1e-9 * (1 + np.abs(row).max())
        if len(row) > keep:
            cut = np.partition(row, len(row) - keep)[len(row) - keep] - slack
            near = np.flatnonzero(row >= cut)
        else:
            near = np.arange(len(row))
        score = (x[near] * v).sum(1)  # one order of summation, whatever the block
        order = np.lexsort((firsts[near], -score))
        got = [(float(score[o]), i, bool((x[near[o]] == v).all())) for o in order for i in ids[near[o]]]
        out.append(sorted(got, key=lambda s: (-s[0], s[1]))[:keep])
    return out


def _search(keep: int):
    """Arrow mapper over rows (key, ids, embedding, qid, bar) sorted by key, a part's points (qid null) before the queries that meet it."""

    def run(batches):
        now, x, ids, points, asked, out = None, None, [], [], [], []

        def answer():
            nonlocal x, points
            if points:
                x, points = np.array(points), []
            if asked and x is not None:
                q = np.array([v for _, _, v in asked])
                for (name, bar, _), best in zip(asked, _best(q, x, ids, keep)):
                    out.extend((name, *found) for found in best if found[0] >= bar)
            asked.clear()

        def found():
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.bool_())
            rows = [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, names=["qid", "score", "vec_id", "same"])

        for batch in batches:
            keys, names, bars = (batch.column(c).to_pylist() for c in ("key", "qid", "bar"))
            vectors, own = _matrix(batch.column("embedding")), batch.column("ids").to_pylist()
            for i, key in enumerate(keys):
                if key != now:
                    answer()
                    now, x, ids, points = key, None, [], []
                if names[i] is None:
                    points.append(vectors[i])
                    ids.append(own[i])
                else:
                    asked.append((names[i], bars[i], vectors[i]))
                    if len(asked) == TOGETHER:
                        answer()
            yield found()
        answer()
        yield found()

    return lean(run)


_FOUND = "qid long, score double, vec_id long, same boolean"


def _top(found: DataFrame, keep: int) -> DataFrame:
    """The best `keep` of each query, with rank."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(finite).where(F.exists("embedding", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, k: int = 20, recall: float = RECALL, leaves: int = LEAVES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by inner product in double precision, ties to the smaller id.

    `is_query` is a predicate over vec_id; candidates are all rows but the query's own. Vectors that
    are null, empty, zero, or hold null or non-finite components take no part, nor do null ids. Rows
    that repeat a vec_id are candidates and queries each. Vectors of different lengths have no inner
    product: those of one length are searched among themselves. Other columns are ignored. Fewer
    candidates than k give all; an empty table gives none.
    """
    rows = stored(usable(vectors), "vectors")
    sizes = [r.n for r in rows.groupBy(F.size("embedding").alias("n")).count().orderBy("n").collect()]  # one row a length
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = None
    for n in sizes:
        own = _nearest(rows if len(sizes) == 1 else stored(rows.where(F.size("embedding") == n), "vectors"), is_query, k, recall, leaves)
        out = own if out is None else out.union(own)
    return out


def _nearest(rows: DataFrame, is_query, k: int, recall: float, leaves: int) -> DataFrame:
    """nearest() over a written table of usable rows of one length."""
    spark, keep = rows.sparkSession, k + 1
    w = Window.partitionBy("embedding").orderBy("vec_id")
    # no result can show more than k + 1 copies of one vector; the limit is applied before the shuffle too
    few = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= keep)
    groups = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    groups = stored(groups.withColumn("pid", F.col("ids")[0]), "points")
    n = groups.count()
    sample = groups.select("embedding").orderBy(F.xxhash64("pid"), "pid").limit(SAMPLE).toPandas()["embedding"]
    sample = np.array([np.asarray(v, np.float64) for v in sample])
    wanted = max(1, min(leaves, n // max(LEAF_POINTS, int(LEAF_ROOTS * n**0.5))))
    tree = MeansTree(sample, max(1, len(sample) // wanted))

    def to_leaf(batches):
        for b in batches:
            if b.num_rows:
                leaf = tree.assign(_matrix(b.column("embedding")))
                yield pa.RecordBatch.from_arrays([b.column("pid"), b.column("ids"), b.column("embedding"), pa.array(leaf)], names=["pid", "ids", "embedding", "leaf"])

    kind = groups.schema["embedding"].dataType.simpleString()
    points = stored(groups.select("pid", "ids", "embedding").mapInArrow(lean(to_leaf), f"pid long, ids array<long>, embedding {kind}, leaf long"), "leaves")
    sizes = {r.leaf: r["count"] for r in points.groupBy("leaf").count().collect()}  # at most a row for each leaf

    asked = rows.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "embedding")
    # a number of its own for each distinct vector: a repeated id may ask with several
    queries = stored(asked.groupBy("embedding").agg(F.min("query_id").alias("least")).withColumn("qid", F.monotonically_increasing_id()), "queries")
    visits = _calibrated(points, queries, tree, keep, recall)

    rank = 4 * keep

    def _bars(x):
        if len(sample) < rank or not len(x):
            return np.full(len(x), -np.inf)
        return np.concatenate([np.partition(x[i : i + 256] @ sample.T, len(sample) - rank, 1)[:, len(sample) - rank] for i in range(0, len(x), 256)])

    def to_visits(barred):
        def run(batches):
            for b in batches:
                x, ids = _matrix(b.column("embedding")), b.column("qid")
                bars = pa.array(_bars(x) if barred else np.full(len(x), -np.inf))
                for start in range(0, len(ids), 256):
                    seen = [(i, leaf) for i in range(start, min(start + 256, len(ids))) for leaf in tree.visit(x[i], visits, sizes, keep)]
                    take = pa.array([i for i, _ in seen], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.take(take), pa.array([leaf for _, leaf in seen], pa.int64()), bars.take(take)], names=["qid", "leaf", "bar"])

        return lean(run)

    def search(these, barred):
        visited = stored(these.select("qid", "embedding").mapInArrow(to_visits(barred), "qid long, leaf long, bar double"), "visits")
        asks = {r.leaf: r["count"] for r in visited.groupBy("leaf").count().collect()}  # at most a row for each leaf
        cells = [(leaf, -(-c // PART), -(-asks[leaf] // ASKED)) for leaf, c in sizes.items() if leaf in asks]
        # parts of a leaf's points, and of its queries: a point goes to each part of the queries and the other way round
        table = F.broadcast(spark.createDataFrame(cells, "leaf long, parts int, turns int"))  # at most a row for each leaf
        salt = F.pmod(F.xxhash64("pid"), F.col("parts")).cast("int")
        here = points.join(table, "leaf").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        here = here.select(F.xxhash64("leaf", salt, "turn").alias("key"), "ids", "embedding", F.lit(None).cast("long").alias("qid"), F.lit(None).cast("double").alias("bar"))
        salt = F.pmod(F.xxhash64("qid"), F.col("turns")).cast("int")
        there = visited.join(table, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        there = there.select(F.xxhash64("leaf", "part", salt).alias("key"), "qid", "bar").join(these.select("qid", "embedding"), "qid")
        there = there.select("key", F.lit(None).cast("array<long>").alias("ids"), "embedding", "qid", "bar")
        met = here.union(there).repartition("key").sortWithinPartitions("key", F.asc_nulls_first("qid"))
        return met.mapInArrow(_search(keep), _FOUND)

    found = stored(search(queries, True), "found")
    few = queries.select("qid", "embedding").join(found.groupBy("qid").count(), "qid", "left").where(F.coalesce("count", F.lit(0)) < keep).select("qid", "embedding")
    if few.limit(1).count():
        few = stored(few, "few")
        found = found.join(few.select("qid"), "qid", "left_anti").union(search(few, False))
    best = _top(found, keep).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", "same"))).alias("best"))
    named = asked.join(queries.select("embedding", "qid"), "embedding").select("query_id", "qid").join(best, "qid")
    # the query's own row is the first with its id and its vector; other rows of that id stay
    own = F.array_position(F.transform("best", lambda b: b["same"] & (b["vec_id"] == F.col("query_id"))), True)
    others = F.filter("best", lambda b, i: i + 1 != own)
    out = named.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def _calibrated(points: DataFrame, queries: DataFrame, tree: MeansTree, keep: int, recall: float) -> int:
    """Leaves to visit so that a bounded set of queries finds the wanted share of its true neighbours among all points."""
    probe = queries.orderBy(F.xxhash64("least"), "least", "embedding").limit(CALIBRATION).toPandas()
    if not len(probe):
        return 1
    q = np.array([np.asarray(v, np.float64) for v in probe["embedding"]])

    def brute(batches):
        for b in batches:
            if b.num_rows:
                x, leaf = _matrix(b.column("embedding")), b.column("leaf").to_pylist()
                pid = b.column("pid").to_pylist()
                rows = [(i, s, p, leaf[p]) for i, best in enumerate(_best(q, x, [[p] for p in range(len(pid))], keep)) for s, p, _ in best]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), pa.array([pid[r[2]] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], names=["qid", "score", "vec_id", "leaf"])

    truth = _top(points.select("pid", "embedding", "leaf").mapInArrow(lean(brute), "qid long, score double, vec_id long, leaf long"), keep).select("qid", "leaf").collect()
    place = [{leaf: i for i, leaf in enumerate(tree.visit(v, tree.leaves))} for v in q]
    need = sorted(place[r.qid][r.leaf] + 1 for r in truth)
    return min(tree.leaves, need[min(len(need) - 1, int(np.ceil(recall * len(need))))] + 1)
