"""Arrow-side text helpers that the operators share.

Every operator streams Arrow batches through ``mapInArrow``. A batch is cut into slices of
bounded text size before any per-word array is built, so a worker's memory does not depend on
the batch size that Spark picks; one very long text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are turned into per-word arrays at once.
SLICE_BYTES = 2 << 20


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that `column` holds about `limit` bytes at most, and a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, before + limit, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def lean(run):
    """The Arrow mapper `run`, after which its worker gives freed memory back: workers live on between tasks and stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Returns unused memory of Arrow's pool and of the C library to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column with null as the empty text."""
    return pc.fill_null(batch.column(column), "")


def split_words(array: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    r"""All words `[^\x20\x09-\x0D]+` in order, and the offsets of each text's words among them."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(array) if lower else array)
    flat = parts.flatten()
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        owner = np.repeat(np.arange(len(counts)), counts)[~empty]
        counts = np.bincount(owner, minlength=len(counts)).astype(np.int64)
        flat = flat.filter(pa.array(~empty))
    return flat, np.concatenate([[0], np.cumsum(counts)])


def coded(flat: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Codes of the words and the distinct words in order of their code."""
    if not len(flat):
        return np.empty(0, np.int64), []
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    used = lengths > 0
    s, n = starts[used], lengths[used]
    heads = np.concatenate([[0], np.cumsum(n)[:-1]])
    out[heads] = s
    out[heads[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(out)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums over [offsets[i], offsets[i+1]); an empty segment gives 0."""
    c = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary one; a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="basalt-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back: lineage ends there, and no executor's loss undoes it."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() returned; nothing that is still to be computed may read them."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def collected(spark: SparkSession) -> None:
    """Collects the driver's garbage: Spark deletes shuffle files of tables that are gone only after that."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def bitmap(numbers: DataFrame, bits: int) -> bytes:
    """A packed bitmap of the numbers (column k, below 2**bits). They are dealt by slice, so what is moved follows their count, not tasks times the bitmap's size."""
    from pyspark.sql import functions as F

    step = min(bits, max(10, bits - 9))
    width = 1 << step

    def own(batches):
        seen = {}
        for b in batches:
            if not b.num_rows:
                continue
            k = np.sort(b.column("k").to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(k >> step)) + 1).tolist(), len(k)]
            for start, stop in zip(cuts[:-1], cuts[1:]):
                at = k[start:stop] & (width - 1)
                part = seen.setdefault(int(k[start] >> step), np.zeros(width // 8, np.uint8))
                np.bitwise_or.at(part, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([x.tobytes() for x in seen.values()], pa.binary())], names=["slice", "bits"])

    dealt = numbers.select(F.col("k").cast("long").alias("k")).repartition(F.shiftright("k", step))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in dealt.mapInArrow(own, "slice int, bits binary").collect():  # the bitmap itself: 2**bits / 8 bytes at most
        out[r.slice * (width // 8) : (r.slice + 1) * (width // 8)] |= np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


_STEP = np.uint64(0x9E3779B97F4A7C15)


def hashed_ngrams(words: list[str], sizes: tuple[int, ...], buckets: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word's character n-grams, with `<` and `>` at its ends; `whole` adds the word itself.

    Returns all buckets, word after word, and each word's offsets among them. A power of two of buckets.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    starts, owner = ends - lengths, np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(points)) - starts[owner]
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    found, of = [], []
    with np.errstate(over="ignore"):
        for k in sizes:
            h = np.full(len(points), np.uint64(k))
            for j in range(k):
                h[: len(points) - j] = (h[: len(points) - j] ^ points[j:]) * _STEP
                h ^= h >> np.uint64(29)
            keep = place + k <= lengths[owner]
            found.append((h[keep] * _STEP) >> shift)
            of.append(owner[keep])
        if whole:
            h = (points + np.uint64(7)) * (_STEP + (place.astype(np.uint64) << np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
            h ^= h >> np.uint64(31)
            total = np.add.reduceat(h * _STEP, starts) if len(words) else np.empty(0, np.uint64)
            found.append(((total ^ (total >> np.uint64(33))) * _STEP) >> shift)
            of.append(np.arange(len(words)))
    of = np.concatenate(of) if of else np.empty(0, np.int64)
    order = np.argsort(of, kind="stable")
    flat = np.concatenate(found)[order].astype(np.int64) if found else np.empty(0, np.int64)
    return flat, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))])


def bounded_sample(rows: DataFrame, most_rows: int, most_chars: int, per: str | None = None, most_kinds: int = 1, members: DataFrame | None = None) -> list:
    """At most `most_rows` rows (for each value of `per`) of (doc_id, text, ...) and `most_chars` characters in all.

    `members`, a table with doc_id, restricts and widens the rows; only ids and lengths meet it before the choice.
    More than `most_kinds` values of `per` are an error: none is left out silently.

    The choice follows the hash of doc_id alone, so it does not depend on the layout of the input.
    Rows of a frequent value are thinned by that hash before they are ranked: no task ranks them all.
    """
    import hashlib

    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    rows = rows.where("text is not null")
    spark = rows.sparkSession
    if per:
        counts = rows.groupBy(per).count().limit(most_kinds + 1).collect()
        if len(counts) > most_kinds:
            raise ValueError(f"more than {most_kinds} values of {per}")
        if not counts:
            return []
        # twice the rows wanted, or all of them; a repeated id shares its hash, so a few more rows are let through
        shares = spark.createDataFrame([(r[per], min(1.0, 2 * (most_rows + 20) / r["count"])) for r in counts], f"{per} string, _share double")
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
        some = rows.join(F.broadcast(shares), per).where(place < F.col("_share"))  # most_kinds rows at most
        lengths = some.select("doc_id", per, F.length("text").alias("n"))
        lengths = lengths.withColumn("_nth", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("_nth") <= most_rows)
        sizes = lengths.orderBy("_nth", *order).collect()
    else:
        sizes = rows.select("doc_id", F.length("text").alias("n"))
        sizes = sizes if members is None else sizes.join(members.select("doc_id"), "doc_id", "left_semi")
        sizes = sizes.orderBy(*order).limit(most_rows).collect()
    ids, left = set(), most_chars
    for r in sizes:
        if r.n <= left:
            ids.add(r.doc_id)
            left -= r.n
    if not ids:
        return []
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in sorted(x for x in ids if x is not None)], "doc_id long"))
    out = rows.join(chosen, "doc_id")
    out = (out if members is None else out.join(F.broadcast(members.join(chosen, "doc_id")), "doc_id")).collect()
    return sorted(out, key=lambda r: (r.doc_id, hashlib.sha1((r.text or "").encode()).digest()))
