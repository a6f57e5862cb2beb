"""All registered queries of the engine: name -> callable (spark, sf_dir), and the oracle's SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from .database import Database
from .plans.catalogue import QUERIES as CATALOGUE
from .plans.scripts import SCRIPTS
from .plans.surfaces import QUERIES as SURFACES
from .plans.surfaces import SQL as SURFACES_SQL
from .session import Engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: One engine for each session in use; a session that is gone takes its engine with it.
_ENGINES: WeakKeyDictionary[SparkSession, Engine] = WeakKeyDictionary()


def engine(spark: SparkSession, sf_dir: str, sql: str) -> Engine:
    """The session's engine with the tables that a query names read from sf_dir."""
    if spark not in _ENGINES:
        _ENGINES[spark] = Engine(spark)
    names = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    return _ENGINES[spark].load(sf_dir, *names)


def _runner(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, sql).query(sql)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q[0]: _runner(q[1]) for q in CATALOGUE}
SQL: dict[str, str] = {q[0]: q[-1] for q in CATALOGUE}


def _index(spark: SparkSession, sf_dir: str, tokenizer: str = "ascii"):
    from .functions.fts import TextIndex

    return TextIndex(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", tokenizer)


def x02_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).match_all("the token license").withColumnRenamed("doc", "doc_id")


def x03_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return _index(spark, sf_dir).bm25("license token reserved").select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def x04_bm25_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return _index(spark, sf_dir).bm25("license token", k1=1.5, b=0.5, idf="plain").select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


def x05_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).prefix("licen").withColumnRenamed("doc", "doc_id")


def x06_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).stats()


def x07_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).phrase("all rights reserved").withColumnRenamed("doc", "doc_id")


def x01_porter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, "porter").match_all("reserving rights").withColumnRenamed("doc", "doc_id")


_TERMS = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents"


def _bm25(terms: str, k1: str, b: str, idf: str) -> str:
    return f"""WITH t AS ({_TERMS}), len AS (SELECT d.doc_id, COUNT(t.term) AS length FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id),
whole AS (SELECT COUNT(*) AS n, AVG(length) AS mean FROM len), hit AS (SELECT doc_id, term, COUNT(*) AS tf FROM t WHERE term IN ({terms}) GROUP BY ALL), f AS (SELECT term, COUNT(*) AS df FROM hit GROUP BY term)
SELECT doc_id, ROUND(SUM({idf} * tf * ({k1} + 1.0) / (tf + {k1} * (1 - {b} + {b} * length / mean))), 6) AS score FROM hit JOIN f USING (term) JOIN len USING (doc_id), whole GROUP BY doc_id"""


QUERIES |= {f.__name__: f for f in (x01_porter, x02_match_all, x03_bm25, x04_bm25_plain, x05_prefix, x06_term_stats, x07_phrase)}
SQL |= {
    # the words of the two stems that the algorithm gives to "reserving" and "rights"
    "x01_porter": f"SELECT doc_id FROM ({_TERMS}) WHERE regexp_full_match(term, 'reserv(e|es|ed|ing|s|ings|ement)?|right(s|ed|ing|ings)?') GROUP BY doc_id HAVING COUNT(DISTINCT term[1:5]) = 2",
    "x02_match_all": f"SELECT doc_id FROM ({_TERMS}) WHERE term IN ('the', 'token', 'license') GROUP BY doc_id HAVING COUNT(DISTINCT term) = 3",
    "x03_bm25": _bm25("'license', 'token', 'reserved'", "1.2::DOUBLE", "0.75::DOUBLE", "LN((n - df + 0.5) / (df + 0.5) + 1)"),
    "x04_bm25_plain": _bm25("'license', 'token'", "1.5::DOUBLE", "0.5::DOUBLE", "LN((n - df + 1)::DOUBLE / (df + 1))"),
    "x05_prefix": f"SELECT DISTINCT doc_id FROM ({_TERMS}) WHERE starts_with(term, 'licen')",
    "x06_term_stats": f"SELECT term, COUNT(DISTINCT doc_id) AS df, COUNT(*) AS cf FROM ({_TERMS}) GROUP BY term",
    "x07_phrase": "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])all[^a-z0-9]+rights[^a-z0-9]+reserved($|[^a-z0-9])')",
}


def _script(script: str, final: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Database(spark)
        db.load(sf_dir, *[t for t in TABLES if re.search(rf"\bFROM {t}\b|\bUSING {t}\b", script)])
        db.execute(script)
        return db.query(final)

    return run


QUERIES |= {name: _script(script, final) for name, script, final, _ in SCRIPTS}
SQL |= {name: sql for name, _, _, sql in SCRIPTS}
QUERIES |= SURFACES
SQL |= SURFACES_SQL
