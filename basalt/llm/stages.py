"""The stages of corpus_pipeline.py: each applies one operator's decisions to the documents it gets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _same_row(docs: DataFrame) -> DataFrame:
    """The documents with `row_key`, which with doc_id tells rows apart by their text."""
    return docs.withColumn("row_key", F.xxhash64("text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: null texts, texts without a letter, and texts that a background in
    which all trigrams are alike explains clearly better (langid.FOREIGN) than the best mixture of languages.

    The models learn from the documents' own lang column; without any label only the first two go. A kept
    document without a lang gets its main language; one with a lang keeps it. An empty table gives none,
    repeated rows are judged alike, a null doc_id is kept, columns other than those of documents are left out.
    """
    from .langid import FOREIGN, UNKNOWN, fit_languages, weighed
    from .text import lean, slices, texts

    models = fit_languages(docs.select("doc_id", "text", "lang"))
    if not models.names:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in slices(batches):
            langs, _, _, evidence = weighed(texts(batch), models)
            told = pc.coalesce(batch.column("lang"), pa.array(langs, pa.string()))
            batch = batch.set_column(COLUMNS.index("lang"), "lang", told)
            yield batch.filter(pa.array([x != UNKNOWN and e >= -FOREIGN for x, e in zip(langs, evidence)], pa.bool_()))

    kept = docs.select(*COLUMNS)
    return kept.mapInArrow(lean(run), kept.schema)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that with the smallest doc_id, null last, then by its text's hash.

    Five words and a similarity of 0.8. Rows are grouped by their texts, each under a number of its
    own, so rows without a doc_id and rows that repeat one are compared like all others. Documents
    without words are in no group and stay, equal ones of one doc_id once. An empty table gives none.
    """
    from .jaccard import jaccard_groups
    from .text import stored

    rows = stored(docs.select(F.monotonically_increasing_id().alias("row_id"), *COLUMNS), "numbered")
    groups = jaccard_groups(rows.select(F.col("row_id").alias("doc_id"), "text"), n=5, percent=80)
    groups = groups.select(F.col("doc_id").alias("row_id"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component"))
    order = rows.select("row_id", F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text_hash"), F.xxhash64("lang", "source", "n_chars").alias("rest"))
    wordless = F.when(F.col("component").isNull(), F.struct("doc_id", "text_hash"))
    first = F.min(F.struct("no_id", "doc_id", "text_hash", "rest", "row_id"))["row_id"].alias("row_id")
    kept = groups.join(order, "row_id").groupBy("component", wordless.alias("wordless")).agg(first).select("row_id")
    return rows.join(kept, "row_id", "left_semi").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, re-parameterised ones as well.

    Rows of one doc_id, or without one, are told apart by their text. Null and empty texts hold nothing and stay,
    repeated rows stay or go together, an empty table on either side is no error.
    """
    from .decontam import contaminated

    hits = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("hit_id"), F.col("key").alias("row_key")).distinct()
    rows = _same_row(docs)
    return rows.join(hits, rows.doc_id.eqNullSafe(hits.hit_id) & (rows.row_key == hits.row_key), "left_anti").select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind in brackets; all documents stay.

    Null texts stay null, repeated rows repeat, a null doc_id is kept, an empty table gives none.
    """
    from .pii import redacted

    return redacted(docs)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each kept document, with the digests of the round trip.

    A null text counts as empty: no tokens. Repeated rows repeat, an empty table gives none.
    """
    from .bpe import bpe_round_trip
    from .queries import _vocabulary

    return bpe_round_trip(docs, _vocabulary(), keep_ids=True)
