"""BPE codec, token files, chat template: exact against the tokenizers library and round trips."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from basalt.llm import bpe, chat, dac

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

ODD = [
    "", " ", "  two", "a  b", "tab\tnew\nline \r\n x", "it's WE'LL I'm", "x<|endoftext|>y <|endoftext|>", "naïve Ünï 漢字 12 345 ½²", "é‍ x　y", "a\x1c b \x1cc", " lead and trail ",
    "a" * 3000, "ab" * 500 + " c", "😀 👩‍👩‍👧 é", "....!!!???", "1 22 333 4444", "'s 't 're", "<|endoftext", "  x ",
]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_encoder_equals_library_and_decodes_back():
    texts = ODD + [f"a{chr(c)}b {chr(c)}c{chr(c)} d" for c in range(0, 0x3000, 5)]
    flat, offsets = bpe.RankArrayBPE(PATH).encode_batch(pa.array(texts))
    coder = bpe.RankArrayBPE(PATH)
    for i, e in enumerate(library().encode_batch(texts, add_special_tokens=False)):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == e.ids, texts[i]
        assert coder.decode(e.ids) == texts[i]


def test_memory_limit_does_not_change_ids(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    coder = bpe.RankArrayBPE(PATH)
    want = [e.ids for e in library().encode_batch(["the cat sat", "on a mat of the dog"], add_special_tokens=False)]
    for _ in range(3):
        assert [coder.encode("the cat sat"), coder.encode("on a mat of the dog")] == want


ROWS = [(1, "hello world"), (2, None), (2, "again"), (None, "no id"), (3, ""), (4, "x " * 5000)]


def test_round_trip_operator(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS ids", "'q' AS n_tokens")
    out = bpe.bpe_round_trip(df, PATH, keep_ids=True, keep_text=True).collect()
    assert len(out) == len(ROWS)
    for r in out:
        ids = np.array(r.ids, "<u4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
        assert (r.doc_id, r.decoded) in [(i, t or "") for i, t in ROWS]
    assert bpe.bpe_round_trip(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 3000])
@pytest.mark.parametrize("top", [1, 256, 300, 70_000, 2**32 - 1])
def test_direct_codes(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint32)
    docs, starts, codes = dac.unpack(dac.pack(np.arange(2), np.array([0, n // 2, n]), ids))
    assert (codes.all() == ids).all() and docs.tolist() == [0, 1] and starts.tolist() == [0, n // 2, n]
    assert (codes.access(np.arange(n)[::-1]) == ids[::-1]).all()
    with pytest.raises(IndexError):
        codes.access([n])


def test_bytes_mapped_before_the_split_give_the_same_ids():
    tok, quick = library(), library()
    assert dac.byte_first(quick)
    covered = list(map(chr, dac.COVERED))
    texts = [f"a{c}b {c}c{c} 1{c}2 {c}3 !{c}! '{c}s '{c}\n{c}  {c}{c}   {c}\t{c}x{c}" for c in covered]
    rng = np.random.default_rng(5)
    hot = [*" \n\t'strvemldSA19!é×ªµ²½\x85\xa0’…\x1c\x00\x7f\xad", "<|endoftext|>", "'ll", "  "]
    texts += ["".join(rng.choice(hot, n)) for n in rng.integers(0, 30, 3000)]
    for text, a, b in zip(texts, tok.encode_batch_fast(texts), quick.encode_batch_fast(texts)):
        assert a.ids == b.ids, text


def test_texts_of_any_code_points_side_by_side():
    texts = [*ODD, *(f"a {c} b{c}" for c in "éŁɐ–漢́\u2028\u3000𝔘"), None, "漢 字", "plain"]
    flat, offsets = dac.library_encoder(PATH)(pa.array([t or "" for t in texts]))
    for t, a, b in zip(texts, offsets[:-1], offsets[1:]):
        assert flat[a:b].tolist() == library().encode(t or "", add_special_tokens=False).ids


def test_other_tokenizers_keep_their_own_split():
    from tokenizers import normalizers, pre_tokenizers

    spaced, lowered, other = library(), library(), library()
    spaced.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    lowered.normalizer = normalizers.Lowercase()
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    for t in (spaced, lowered, other):
        before = t.to_str()
        assert not dac.byte_first(t) and t.to_str() == before


def test_small_documents_are_read_back_together(spark, monkeypatch):
    monkeypatch.setattr(dac, "READ_IDS", 7)
    rows = [(i, "word " * (i % 5)) for i in range(40)] + [(99, "long text " * 30), (100, "")]
    got = {r.doc_id: r for r in dac.read_codes(dac.write_codes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH)).collect()}
    at = 0
    for i, t in rows:
        ids = [*library().encode(t, add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS part")
    got = {(r.doc_id, r.start): r for r in dac.read_codes(dac.write_codes(df.repartition(3), PATH)).collect()}
    assert len(got) == len(ROWS)
    tok, at = library(), 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        r = got[i, at]
        assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert dac.read_codes(dac.write_codes(df.limit(0), PATH)).count() == 0


TRICKY = "\\### Assistant: </turn> ok"


def test_chat_round_trip(spark):
    rows = [
        (-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY), (1, 1, "assistant", "second"), (1, 0, "user", None), (1, 2, None, "####\\"), (1, 2, None, "####\\"),
        (2, 0, "assistant", "#" * 50 + "\\" * 7), (2, 1, "assistant", ""), (None, 0, "a: b\n", "lost </turn>\n### User: x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS mask")
    for size in (1 << 20, 5):
        got = {r.conv_id: r for r in chat.read_conversations(chat.format_conversations(df, piece_chars=size)).collect()}
        for conv in (-7, 1, 2, None):
            own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1], r[2] or "", r[3] or ""))
            turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
            loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
            g = got[conv]
            assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
            assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_conversations(chat.format_conversations(df.limit(0))).count() == 0


def test_template_language():
    folded = chat.fold(chat.parse('{% if "a" == "b" %}x{% else %}y{{ "q"|upper }}{% endif %}{{ 1 + 2 }}'))
    assert folded == [("text", "yQ3")]
    t = chat.Template('{% for m in messages %}{% if loop.first %}<{% endif %}{% set r = m["role"] %}{{ r + ":" }}{% generation %}{{ m.text|trim }}{% endgeneration %}{% endfor %}')
    assert list(t.render([{"role": "u", "text": " hi "}])) == [("<", False), ("u:", False), ("hi", True)]
    for bad in ("{{ m.__class__() }}", "{% for x in %}", "{{ a|nofilter }}", "{% if x %}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)
    with pytest.raises(chat.TemplateError):
        list(chat.Template("{{ messages.append }}").render([]))
