"""The pipeline against a plain-Python version of its stages, and the registered queries."""

import random
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from basalt.llm import pii

public_tokenizers = pytest.importorskip("public_tokenizers")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages_follow_the_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "pii", "bpe_codec"]
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 11)) and "pipeline" in entry.queries()


def test_pipeline_equals_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(30)) for i in range(3)]
    docs = [(i, prose(rng.randint(20, 120)), "en") for i in range(40)]
    docs += [(100 + k, docs[k][1], "en") for k in range(0, 10, 3)]
    docs += [(200 + k, docs[k][1].rsplit(" ", 1)[0] + " changed", "en") for k in range(0, 12, 4)]
    docs += [(300 + i, f"{prose(15)} {t} {prose(15)}", "en") for i, t in items]
    docs += [(400, f"{prose(20)} mail a.b@example.com and +1 (017) 555-7713 {prose(5)}", "en"), (500, None, None), (501, "", "en"), (502, "123 456 !!", "en"), (503, "short", "en")]
    rows = [(i, t, g, "s", None if t is None else len(t)) for i, t, g in docs]
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = [(i, t) for i, t, _ in docs if t and re.search("[a-z]", t)]
    group = {i: i for i, _ in kept}
    top = lambda x: x if group[x] == x else top(group[x])
    for i, t in kept:
        for j, u in kept:
            a, b = shingles(t), shingles(u)
            if j < i and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = top(i), top(j)
                group[max(x, y)] = min(x, y)
    kept = [(i, t) for i, t in kept if top(i) == i]
    kept = [(i, t) for i, t in kept if not any(item in t for _, item in items)]
    field = pii.SegmentField()
    field.weights = pii.trained_field()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: tokenizer.encode(pii.redact(t, pii.find_spans(t, field)[1]), add_special_tokens=False).ids for i, t in kept}
    assert {i: r.ids for i, r in got.items()} == want
    assert 400 in got and 300 not in got and 100 not in got and 200 not in got and 503 in got


def test_jaccard_stage_keeps_one_row_of_null_and_repeated_ids(spark):
    from basalt.llm import stages

    rng = random.Random(8)
    prose = [" ".join(rng.choice("abcdefghij") * rng.randint(2, 9) for _ in range(40)) for _ in range(5)]
    rows = [(None, prose[0]), (None, prose[0]), (None, prose[0] + " more"), (7, prose[1]), (7, prose[1]), (7, prose[2]), (3, prose[3]), (None, prose[3]), (5, prose[3]), (None, prose[4]), (8, ""), (8, ""), (9, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS).repartition(3)
    got = [(r.doc_id, r.text) for r in stages.ngram_jaccard_join(spark, docs, "").collect()]
    near = [(i, t) for i, t in got if i is None and t and t.startswith(prose[0])]
    assert len(near) == 1
    rest = sorted((g for g in got if g not in near), key=repr)
    assert rest == sorted([(7, prose[1]), (7, prose[2]), (3, prose[3]), (None, prose[4]), (8, ""), (9, ""), (None, None)], key=repr)
