"""The registered queries over the small generated tables: columns, whole results, and plain versions of the contracts."""

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pytest

from basalt.llm import queries

public_tokenizers = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "", r.lang) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


def run(spark, name, *columns):
    df = queries.QUERIES[name](spark, FOLDER)
    assert set(columns) <= set(df.columns)
    return df.collect()


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def test_quality(spark, docs):
    got = run(spark, "op1_quality_classifier", "doc_id", "held_out", "score", "predicted")
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(d[0] for d in docs)
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_language(spark, docs):
    got = run(spark, "op2_language_id", "doc_id", "held_out", "lang_pred", "score")
    told = {i: g for i, _, g in docs}
    assert len(got) == len(docs) and all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == told[r.doc_id] for r in got if r.held_out and told[r.doc_id]]
    assert np.mean(held) > 0.95


def test_neighbours(spark):
    got = run(spark, "op3_ann_tree", "query_id", "rank", "vec_id", "score")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect() if r.embedding and any(r.embedding) and np.isfinite(np.array(r.embedding, float)).all()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    found = collections.defaultdict(dict)
    for r in got:
        found[r.query_id][r["rank"]] = (r.vec_id, r.score)
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    hits = total = 0
    for q, best in found.items():
        s = (x * x[ids == q][0]).sum(1)
        want = [(int(ids[k]), float(s[k])) for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        assert sorted(best) == list(range(1, len(want) + 1))
        hits, total = hits + len(set(want) & set(best.values())), total + len(want)
    assert hits / total >= 0.9


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    tokenizer, text = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {i: t for i, t, _ in docs}
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in text.items()}
    got = run(spark, "op4_bpe_codec", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.ids_sha256) == (len(ids[r.doc_id]), hashlib.sha256(np.array(ids[r.doc_id], "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids[r.doc_id], skip_special_tokens=False).encode()).hexdigest()
    at = 0
    for r in sorted(run(spark, "op5_token_files", "doc_id", "start", "n_tokens", "ids_crc32"), key=lambda r: r.doc_id):
        want = [*ids[r.doc_id], 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def spelled(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_personal_data(spark, docs):
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    text = {i: t for i, t, _ in docs}
    for r in run(spark, "op6_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"):
        base = [(k, m.start(), m.end()) for k, (p, keep) in patterns.items() for m in re.finditer(p, text[r.doc_id]) if keep(m.group())]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in base) for k in patterns]
        assert r.base_sha256 == hashlib.sha256(spelled(base).encode()).hexdigest()
        assert set(filter(None, spelled(base).split(","))) <= set(r.spans.split(","))


def test_secrets(spark, docs):
    patterns = {
        "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
    }
    text = {i: t for i, t, _ in docs}
    for r in run(spark, "op10_secret_scan", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"):
        base = sorted((m.start(), n, k, m.end()) for n, (k, (p, keep)) in enumerate(patterns.items()) for m in re.finditer(p, text[r.doc_id], re.ASCII) if keep(m))
        base = [(k, a, b) for a, _, k, b in base]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == s[0] for s in base) for k in patterns]
        assert r.base_sha256 == hashlib.sha256(spelled(base).encode()).hexdigest()
        assert set(filter(None, spelled(base).split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall())


def test_decontamination(spark, docs):
    """Every item that stands in a text word for word is found."""
    got = {(r.doc_id, r.item_id) for r in run(spark, "op8_decontamination", "doc_id", "item_id", "coverage", "reparameterised")}
    items = [(r.item_id, " ".join(r.text.split())) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() if r.text]
    flat = [(i, f" {' '.join(t.split())} ") for i, t, _ in docs]
    assert {(i, k) for i, t in flat for k, item in items if f" {item} " in t} <= got
