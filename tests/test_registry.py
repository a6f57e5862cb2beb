"""Registered queries against DuckDB on a few generated rows of every table, and full-text pieces."""

import os

import pytest

import __spark_entry__ as entry
from basalt import registry
from basalt.functions import fts

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")
@pytest.mark.parametrize("name", ["flagship", "s07_cte", "j04_full", "a20_cube", "w10_range_frame", "f15_all", "o02_null_smallest", "u06_except_all", "t04_substr", "d08_modifiers", "x03_bm25"])
def test_query_equals_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in registry.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = registry.QUERIES[name](spark, FOLDER)
    cur = con.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want


def test_entry_points():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(registry.QUERIES) > 150


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "triplicate": "triplic", "hopeful": "hope", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controll": "control"}
    assert {w: fts.porter(w) for w in pairs} == pairs


def test_text_index(spark):
    rows = [(1, "The quick brown fox"), (2, "quick quick foxes run"), (3, None), (4, "slow brown dog")]
    ix = fts.TextIndex(spark.createDataFrame(rows, "k long, body string"), "k", "body")
    ids = lambda df: sorted(r.doc for r in df.collect())
    assert ids(ix.match_all("brown quick")) == [1] and ids(ix.prefix("fox")) == [1, 2] and ids(ix.phrase("quick brown")) == [1]
    best = ix.bm25("quick").orderBy("score", ascending=False).collect()
    assert [r.doc for r in best] == [2, 1]
    porter = fts.TextIndex(spark.createDataFrame(rows, "k long, body string"), "k", "body", "porter")
    assert ids(porter.match_all("foxing")) == [1, 2] and ids(porter.match_all("runs")) == [2]
    marked = spark.createDataFrame(rows, "k long, body string").select(fts.highlight(__import__("pyspark.sql.functions", fromlist=["col"]).col("body"), ["fox"]).alias("h")).first().h
    assert marked == "The quick brown <b>fox</b>"


def test_stems_of_a_batch(monkeypatch):
    pa = pytest.importorskip("pyarrow")
    calls, porter = [], fts.porter
    monkeypatch.setattr(fts, "porter", lambda w: calls.append(w) or porter(w))
    lists = pa.array([["right", "rights"], None, [], ["rights"] * 500 + ["reserving"]])
    assert fts.stems(lists).to_pylist() == [["right", "right"], None, [], ["right"] * 500 + ["reserv"]]
    assert fts.stems(lists.slice(1)).to_pylist() == [None, [], ["right"] * 500 + ["reserv"]] and len(calls) == 5


def test_words_start_like_their_stems():
    import itertools

    ends = ["", "s", "e", "y", "ed", "ing", "eed", "ies", "sses", "ion", *fts._STEP2, *fts._STEP3, *fts._STEP4]
    starts = ["", "a", "y", "b", "is", "tr", "hop", "fall", "size", "probab", "conflat", "7a", "sens"]
    words = {a + b + c for a, b, c in itertools.product(starts, ends, [*ends, "ability", "ities"])} - {""}
    assert [w for w in words if not w.startswith(fts.word_start(fts.porter(w)))] == []


def test_match_all_of_stems_equals_the_index(spark):
    rows = [(1, "All Rights reserved."), (2, "right"), (2, "they RESERVE it"), (3, "rigid, reserves"), (4, None), (5, "preserve rights"), (6, "Right!reserving_right"), (7, "reservation rights"), (None, "reserve right")]
    for tokenizer, query in (("porter", "reserving rights"), ("ascii", "right reserving"), ("unicode61", "right reserved"), ("ascii", "")):
        ix = fts.TextIndex(spark.createDataFrame(rows, "k long, body string"), "k", "body", tokenizer)
        terms = ix.terms_of(query)
        want = [r.doc for r in ix.postings.where(ix.postings.term.isin(terms)).groupBy("doc").count().where(f"count = {len(terms)}").collect()]
        assert sorted(map(str, (r.doc for r in ix.match_all(query).collect()))) == sorted(map(str, want))
        assert tokenizer != "porter" or {1, 2, 6, 7, None} >= set(want) >= {1, 2, 6, None}
