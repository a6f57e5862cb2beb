"""Quality, language ID, PII, secrets, Jaccard join, decontamination, nearest neighbours against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from basalt.llm import ann, decontam, jaccard, langid, pii, quality, secrets

DOCS = "doc_id long, text string"


def clashing(df):
    """Extra columns with names that operators use inside."""
    return df.selectExpr("*", "1 AS n", "'x' AS key", "2 AS token", "3 AS id", "4 AS label", "5 AS score", "6 AS h1")


WORDS = [f"w{i}" for i in range(400)]


def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice(WORDS) for _ in range(30)), 1) for i in range(150)]
    bad = [(1000 + i, " ".join(rng.choice(WORDS) + "%%%" for _ in range(30)), 0) for i in range(80)]
    again = [(2000 + i, " ".join([rng.choice(WORDS)] * 30), 0) for i in range(80)]
    rows = good + bad + again
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit_quality(df.where("doc_id % 5 <> 0").select("doc_id", "text"), df.select("doc_id", "quality"))
    got = {r.doc_id: r.score for r in quality.quality_scores(df, model).collect()}
    held = [(got[i], q) for i, _, q in rows if i % 5 == 0]
    assert np.mean([(s >= 0.7) == bool(q) for s, q in held]) > 0.95
    odd = clashing(spark.createDataFrame([(1, None), (1, ""), (None, "w1 w2"), (2, "w3 " * 30000)], DOCS))
    out = quality.quality_scores(odd, model).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert quality.quality_scores(odd.limit(0), model).count() == 0
    empty = quality.fit_quality(df.limit(0), df)
    assert [r.score for r in quality.quality_scores(odd, empty).collect()] == [0.5] * 4


def test_language_mixtures(spark):
    rng = random.Random(2)
    letters = {"aa": "abcde", "bb": "vwxyz", "cc": "mnopq"}
    say = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(6)) for _ in range(n))
    rows = [(i, say(k, 60), k) for i, k in enumerate(list(letters) * 30)] + [(999, "unknown tongue", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.fit_languages(df.where("doc_id % 5 <> 1"))
    got = {r.doc_id: r for r in langid.identify(df, models).collect()}
    assert all(got[i].lang_pred == k and got[i].score > 0.9 for i, _, k in rows if k)
    mixed = spark.createDataFrame([(1, say("aa", 320) + " " + say("bb", 80)), (2, None), (3, "123 !!"), (None, say("cc", 9))], DOCS)
    out = {r.doc_id: r for r in langid.identify(clashing(mixed), models).collect()}
    assert out[1].lang_pred == "aa" and abs(out[1].score - 0.8) < 0.05 and set(out[1].shares) == {"aa", "bb"}
    assert out[2].lang_pred == out[3].lang_pred == "und" and out[2].score == 0
    assert out[None].lang_pred == "cc"
    assert langid.identify(mixed.limit(0), models).count() == 0
    none = langid.fit_languages(df.limit(0))
    assert {r.lang_pred for r in langid.identify(mixed, none).collect()} == {"und"}


def test_language_id_finds_all_languages_of_a_text():
    rng = random.Random(4)
    letters = {f"l{i}": "abcdefghijklmnopqrstuvwxyz"[3 * i : 3 * i + 3] for i in range(8)}
    say = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(5)) for _ in range(n))
    counts = np.zeros((langid.BUCKETS, 8))
    for k in range(8):
        flat, _ = langid.hashed_ngrams(say(f"l{k}", 400).split(), (3,), langid.BUCKETS, whole=False)
        counts[:, k] = np.bincount(flat, minlength=langid.BUCKETS)
    models = langid.LanguageModels(list(letters), counts)
    seven = " ".join(say(f"l{k}", 80) for k in range(7))
    texts = [seven, say("l3", 40), "", say("l1", 8), seven + " " + say("l2", 560), say("l0", 8) + " " + say("l5", 8)]
    langs, score, sets = langid.infer(pa.array(texts), models)
    assert set(sets[0]) == {f"l{k}" for k in range(7)} and all(abs(v - 1 / 7) < 0.02 for v in sets[0].values())
    assert langs[4] == "l2" and abs(score[4] - 4 / 7) < 0.02 and len(sets[4]) == 7
    assert [langs[1], langs[2], langs[3]] == ["l3", "und", "l1"] and set(sets[1]) == {"l3"} and set(sets[5]) == {"l0", "l5"}


def luhn(x):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(x))) % 10 == 0


def brute_pii(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(x := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(x)]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_pii_base_equals_patterns():
    rng = random.Random(3)
    parts = ["a@b.c", "@", "x@y", ".", "1.2.3.4", "300.1.1.1", "4111111111111111", "4111-1111 1111 1111", "+1 (017) 555-7713", "+", " ", "é", "9", "-", "a.b+c@d-e.fr.de", "0001.2.3.4.5", "\n"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert pii.base_spans(t) == brute_pii(t), t


def test_pii_field_adds_and_keeps_base(spark):
    field = pii.SegmentField()
    field.weights = pii.trained_field()
    text = "card 9807915762804490, call (017) 555-7713 or mail was.91@mail6.example.com now"
    base, found = pii.find_spans(text, field)
    assert set(base) <= set(found) and ("card", 5, 21) in found and any(k == "phone" for k, _, _ in found)
    for clean in ("Licensed under CC BY-NC 4.0. version 3.", "plain words only", "42 of 100 items cost $30.50"):
        assert pii.find_spans(clean, field)[1] == []
    rows = [(1, text, "en", "s", 5), (2, None, None, None, None), (2, "", "en", "s", 0), (None, "a@b.cd " * 3000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS base", "2 AS found")
    out = {(r.doc_id, r.lang): r for r in pii.redacted(docs).collect()}
    assert out[1, "en"].text == "card [CARD], call [PHONE] or mail [EMAIL] now" and out[1, "en"].n_chars == len(out[1, "en"].text)
    assert out[2, None].text is None and out[None, "en"].text.count("[EMAIL]") == 3000
    assert len(pii.personal_spans(docs).collect()) == 4 and pii.personal_spans(docs.limit(0)).count() == 0


def brute_secrets(t):
    words = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api"))
    pattern = words.replace("[Aa][Pp][Ii]", "[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(rf"""({pattern})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 16]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_secrets_equal_patterns(spark):
    rng = random.Random(4)
    parts = ["token", "ToKeN", "passw", "ord", "api_key", "APIKEY", "=", ": ", '"', "abcdef0123456789", "AKIA", "AKIAABCDEFGHIJKLMN", "é", " ", "ſecret", "secret='", "shortval", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(2000)]
    scanner = secrets.Scanner()
    for t, spans in zip(texts, scanner.scan(pa.array(texts))):
        assert [s for s in spans if s[0] in secrets.BASE] == brute_secrets(t), t
    assert any(s[0] == "github" for spans in scanner.scan(pa.array(texts)) for s in spans)
    assert secrets.trigram_query(r"[0-9a-f]{16,}") == () and secrets.trigram_query("abcd") == ((frozenset({"abc", "bcd"}),),)
    df = clashing(spark.createDataFrame([(1, None), (1, "token=" + "x" * 20), (None, "y" * 200_000)], DOCS))
    assert sorted(len(r.found) for r in secrets.secret_spans(df).collect()) == [0, 0, 1]
    assert secrets.secret_spans(df.limit(0)).count() == 0


def brute_groups(rows, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    up = {i: i for i, _ in sets if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if i is not None and j is not None and s and u and 100 * len(s & u) >= percent * len(s | u):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return collections.Counter((i, len(s), None if i is None else top(i)) for i, s in sets)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_groups(spark, monkeypatch, n, percent):
    monkeypatch.setattr(jaccard, "BITMAP_BITS", 12)
    monkeypatch.setattr(jaccard, "BLOCK_POINTS", 8)
    monkeypatch.setattr(jaccard, "CENTRE_ROWS", 4)
    rng = random.Random(n)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "one"), (None, "one two"), (3, "One two")]
    passage = [rng.choice(WORDS) for _ in range(60)]
    at = 10
    for size in (3, 10, 40, 120, 400):
        for _ in range(4):
            base = [rng.choice(WORDS) for _ in range(size)]
            if size < 100:
                base += passage
            for _ in range(rng.randint(1, 9)):
                w = list(base)
                for _ in range(rng.randint(0, max(1, size // 60))):
                    w[rng.randrange(len(w))] = rng.choice(WORDS)
                rows.append((at, " ".join(w)))
                at += 1
    df = clashing(spark.createDataFrame(rows, DOCS)).repartition(3)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df, n, percent).collect())
    assert got == brute_groups(rows, n, percent)
    assert jaccard.jaccard_groups(df.limit(0), n, percent).count() == 0


@pytest.mark.parametrize("words", range(6))
def test_shingles_of_a_slice_with_few_words(words):
    text = " ".join("abcde"[:words])
    alone = jaccard.shingle_sets(pa.array([text]), 5)
    among = jaccard.shingle_sets(pa.array([text, "one two three four five six seven"]), 5)
    assert len(alone) == 1 and alone[0].tolist() == among[0].tolist() and len(alone[0]) == min(words, 1)


def test_groups_of_a_one_row_partition(spark):
    (row,) = jaccard.jaccard_groups(spark.createDataFrame([(3, "two words")], DOCS).coalesce(1), n=5, percent=80).collect()
    assert (row.doc_id, row.n_shingles, row.component_id) == (3, 1, 3)


def test_count_tree_bound_loses_nothing():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 5, (500, 16)).astype(np.uint16)
    sizes = points.sum(1).astype(np.int64)
    tree = jaccard.CountTree(sizes, points)
    for i in range(0, 500, 37):
        want = np.flatnonzero(190 * np.minimum(points, points[i]).sum(1) >= 90 * (sizes + sizes[i]))
        assert sorted(tree.search(sizes[i], points[i], 90)) == want.tolist()


ITEMS = [(1, "If Tom buys 12 apples at 3 dollars each and Mary sells 5 kg of pears to Tom how much does Mary earn in total"), (2, "The capital city of the northern province lies on the river that flows past seven old stone bridges"), (3, "Too short"), (4, None)]


def test_decontamination(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS h")
    other = "Words before. If Bob buys 99 apples at 4 dollars each and Jane sells 8 kg of pears to Bob how much does Jane earn in total\nand after"
    wrong = other.replace("to Bob how", "to Max how").replace("does Jane", "does Sue")
    rows = [(1, "lead in text here " + ITEMS[0][1] + " and more"), (2, other), (3, wrong), (4, ITEMS[1][1].lower()), (5, "clean text about the river and the old bridges of stone"), (6, None), (None, ITEMS[1][1]), (7, ""), (4, ITEMS[1][1].lower()), (8, "x " * 40000)]
    got = {(r.doc_id, r.item_id, r.reparameterised) for r in decontam.contaminated(clashing(spark.createDataFrame(rows, DOCS)), bench).collect()}
    assert {(1, 1, False), (2, 1, True), (4, 2, False), (None, 2, False)} == got
    df = spark.createDataFrame(rows, DOCS)
    assert decontam.contaminated(df.limit(0), bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


PLAIN = "old rivers carry fine sand past the quiet mills while farmers watch the slow water turn under grey clouds before winter brings its long frost"


def hits(spark, items, docs):
    """(doc_id, item_id, reparameterised) of texts numbered from 0."""
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontam.contaminated(spark.createDataFrame(list(enumerate(docs)), DOCS), bench).collect()
    return {(r.doc_id, r.item_id): (r.reparameterised, round(r.coverage, 3)) for r in rows}


def test_decontamination_leaves_out_conflicting_windows_only(spark):
    a, b = PLAIN[:70].rsplit(" ", 1)[0], PLAIN[71:].split(" ", 1)[1]
    same = f"there are 5 boats {a} and 5 men {b}"
    two = f"there are 3 boats {a} and 5 men {b}"
    got = hits(spark, [same, two], [same.replace("5 men", "7 men"), same.replace("5 boats", "4 boats").replace("5 men", "9 men"), two.replace("3 boats", "4 boats").replace("5 men", "4 men")])
    assert set(got) == {(d, i) for d in range(3) for i in range(2)}
    assert all(c < 1 for (d, i), (_, c) in got.items() if (d, i) in {(0, 0), (1, 0), (2, 1)})
    assert not got[0, 0][0]


def test_decontamination_allows_added_and_lost_words(spark):
    words = PLAIN.split()
    third = len(words) // 3
    added = " ".join(words[:third] + ["quite"] + words[third : 2 * third] + ["still"] + words[2 * third :])
    lost = " ".join(words[: len(words) // 2] + words[len(words) // 2 + 1 :])
    item = "one day near the old mill Tom sold 5000 ripe plums to Ann and then Tom gave the rest of his fruit to Ann for the feast"
    longer = item.replace("Tom", "Mary Ann").replace("5000", "5 000")
    got = hits(spark, [PLAIN, item], [added, lost, longer, " ".join(words[:8] * 9)])
    assert set(got) == {(0, 0), (1, 0), (2, 1)}
    assert got[0, 0] == (False, 1.0) and got[1, 0] == (False, round((len(words) - 1) / len(words), 3))
    assert got[2, 1] == (True, 1.0)


def test_decontamination_covers_in_order():
    one = lambda item_at, at: (item_at, at, [1] * 8, [""] * 8, [1] * 8, [""] * 8)
    assert decontam._covered([one(k, 5) for k in range(9)]) == 8
    assert decontam._covered([one(0, 30), one(8, 0)]) == 8
    assert decontam._covered([one(0, 3), one(8, 12)]) == 16
    assert decontam._covered([(0, 0, [3, 1], ["2a b c", ""], [1, 1], ["2d", ""])]) == 4


def test_decontamination_finds_verbatim_items_of_few_literals(spark):
    items = ["What is 12 + 7 * 3 - 4 / 2 + 9?", "Tom Ann Bob Mary Sue Jim Kate Paul Rose Fred", "北京是哪个国家的首都？", "Quantum entanglement", "Paris", "Count 1 2 3 4 5 6 7 8 9 10 11 12 13 14 now", "¿? …"]
    docs = [f"before it all, {t} after it" for t in items[:3]] + ["长江以北的北京是哪个国家的首都？答案在书里", "the quantum entanglement of spins", "in Paris, then", f"lead 3 {items[5]} and", "What is 12 - 7 / 3 + 4 * 2 - 9?", "clean text …"]
    got = hits(spark, items, docs)
    assert {k for k, (changed, c) in got.items() if not changed and c == 1} == {(0, 0), (1, 1), (2, 2), (3, 2), (4, 3), (5, 4), (6, 5)} == set(got)


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_POINTS", 20)
    monkeypatch.setattr(ann, "PART", 64)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(12, 8))[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 0.5).astype(np.float32)
    x[100:400] = x[100]  # one vector that a third of the rows share
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)]
    rows += [(2000, None, "z"), (2020, [0.0] * 8, "z"), (2040, [float("nan")] * 8, "z"), (2060, [1.0, None] + [0.0] * 6, "z"), (2080, [1.0], "z"), (None, [1.0] * 8, "z"), (5, x[5].tolist(), "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, ids string")
    out = ann.nearest(df, lambda i: i % 20 == 0, k=20).collect()
    by = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append((r.vec_id, r.score))
    assert set(by) == set(range(0, 900, 20))
    d, hits = x.astype(np.float64), 0
    for q, found in by.items():
        s = d @ d[q]
        want = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        assert len(found) == 20 and q not in [i for i, _ in found]
        assert [(-round(sc, 9), i) for i, sc in found] == sorted((-round(sc, 9), i) for i, sc in found)
        assert all(abs(sc - s[i]) < 1e-9 for i, sc in found)
        hits += len({i for i, _ in found} & set(want))
    assert hits / (20 * len(by)) >= 0.9
    assert ann.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0
    few = ann.nearest(df.where("vec_id < 4"), lambda i: i == 0).collect()
    assert len(few) == 3


def _segmentations(n, segments):
    """All ways to choose segments (start, end, score) that do not overlap: the best total, by trying each."""
    if not segments:
        return 0.0
    (a, b, score), rest = segments[0], segments[1:]
    return max(_segmentations(n, rest), score + _segmentations(n, [s for s in rest if s[0] >= b or s[1] <= a]))


def test_field_finds_the_best_segmentation():
    rng = np.random.default_rng(3)
    for text in ("call (017) 555-7713", "1 2@3.de", "a (at) b.fr 12", "4.5.6.7 8-9"):
        field = pii.SegmentField()
        field.weights = rng.normal(0, 1, field.weights.shape)
        tokens = pii._TOKEN.findall(text)
        free = np.zeros(len(tokens), bool)
        every = field.candidates(tokens, free)
        scores = field.scores(every)
        live = [(a, b, float(s.max())) for (a, b, _), s in zip(every, scores) if s.max() > 0]
        got = field.best(tokens, free)
        value = {(a, b, k): scores[i][k] for i, (a, b, _) in enumerate(every) for k in range(len(pii.KINDS))}
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        if len(live) <= 18:
            assert sum(value[g] for g in got) == pytest.approx(_segmentations(len(tokens), live))


def test_field_on_held_out_examples():
    field = pii.SegmentField()
    field.weights = pii.trained_field()
    right = told = real = 0
    for text, gold in pii._examples(random.Random(99), 300):
        base, found = pii.find_spans(text, field)
        assert set(base) <= set(found)
        right, told, real = right + len(set(found) & set(gold)), told + len(set(found)), real + len(set(gold))
    assert right / told > 0.95 and right / real > 0.92
    for text, kind in (("call 0171 555 7713 now", "phone"), ("john (at) example.com wrote", "email"), ("host 192 . 168 . 0 . 1 is up", "ip"), ("4111.1111.1111.1111 y", "card")):
        assert [s[0] for s in pii.find_spans(text, field)[1]] == [kind]
    for text in ("order 12345-678-901 shipped", "id 4111 1111 1111 1112 z"):
        assert pii.find_spans(text, field)[1] == []


def test_field_reads_whole_texts():
    """Reading the surroundings of marks gives what reading all tokens gives."""
    field, rng = pii.SegmentField(), random.Random(4)
    field.weights = pii.trained_field()
    for _ in range(20):
        text = " ".join(rng.choice(["word", "and", "x" * 50, "(017) 555-7713", "12.5", "b (at) c.de", "host 1 . 2 . 3 . 4", ""]) for _ in range(60))
        tokens = pii._TOKEN.findall(text)
        ends = np.cumsum([len(t) for t in tokens])
        barred = np.zeros(len(tokens), bool)
        base = pii.base_spans(text)
        for _, a, b in base:
            barred |= (ends - [len(t) for t in tokens] < b) & (ends > a)
        whole = [(pii.KINDS[k], int(ends[a - 1]) if a else 0, int(ends[b - 1])) for a, b, k in field.best(tokens, barred)]
        assert pii.find_spans(text, field)[1] == sorted(base + whole, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_long_runs_take_linear_time():
    import time

    field = pii.SegmentField()
    field.weights = pii.trained_field()
    for text in ("7" * 1_000_000, "a" * 1_000_000 + "@", "+1(" * 100_000, "ab@" * 50_000):
        began = time.perf_counter()
        pii.base_spans(text)
        assert time.perf_counter() - began < 5
    began = time.perf_counter()
    assert pii.find_spans("7" * 1_000_000, field)[0] == []
    assert time.perf_counter() - began < 5


def test_foreign_texts_have_no_evidence(spark):
    rng = random.Random(6)
    letters = {"aa": "abcde", "bb": "vwxyz"}
    say = lambda k, n: " ".join("".join(rng.choice(k) for _ in range(6)) for _ in range(n))
    rows = [(i, say(k, 60), n) for n, k in letters.items() for i in range(40)]
    models = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    told = langid.weighed(pa.array([say("abcde", 20), say("vwxyz", 3) + " 123 a@b.c", say("щдлйфы", 20), "", "12 34", say("mnopq", 30)]), models)[3]
    assert (told >= -langid.FOREIGN).tolist() == [True, True, False, True, True, False]


def test_sample_of_many_rows_and_values(spark):
    from basalt.llm.text import bounded_sample

    df = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id) AS text", "if(id % 10 = 0, 'b', 'a') AS lang")
    got = collections.Counter(r.lang for r in bounded_sample(df, 50, 10_000, per="lang", most_kinds=2))
    assert got == {"a": 50, "b": 50}
    with pytest.raises(ValueError):
        bounded_sample(df, 50, 10_000, per="lang", most_kinds=1)


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard_chains_and_hot_groups(spark, n, percent):
    """Chains of near copies, a passage in every text and large groups, in parts of a few points, against all pairs."""
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(12)]
    texts = []
    for _ in range(4):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(25):
            if rng.random() < 0.6:
                base = list(base)
                base[rng.randrange(len(base))] = rng.choice(words)
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own + passage * rng.randint(0, 2)))
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    sets = [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in (t.split() for t in texts)]
    top = list(range(len(texts)))
    find = lambda x: x if top[x] == x else find(top[x])
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    before = jaccard.BLOCK_POINTS, jaccard.HUBS, jaccard.NAMES
    try:
        for jaccard.BLOCK_POINTS, jaccard.HUBS, jaccard.NAMES in ((1024, 32, 256), (8, 2, 3)):
            got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(df, n, percent).collect()}
            assert got == {i: find(i) for i in range(len(texts))}
    finally:
        jaccard.BLOCK_POINTS, jaccard.HUBS, jaccard.NAMES = before


def test_neighbours_with_repeats_and_hot_leaves(spark):
    """Repeated ids, repeated vectors, two lengths, leaves dealt out in small parts: all leaves visited, so equal to brute force."""
    rng = np.random.default_rng(12)
    hub = rng.normal(0, 1, 8)
    rows = [(int(i), (hub + rng.normal(0, 0.01, 8)).round(2).tolist()) for i in range(120)] + [(int(i), rng.normal(0, 1, 8).round(1).tolist()) for i in range(120, 300)]
    rows += [(20, rows[20][1]), (20, rows[41][1]), (40, rows[299][1])] + [(500 + i, rng.normal(0, 1, 3).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before = ann.PART, ann.ASKED, ann.TOGETHER
    try:
        ann.PART, ann.ASKED, ann.TOGETHER = 16, 3, 2
        got = collections.Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.nearest(df, lambda i: i % 20 == 0, k=5, recall=1.0).collect())
    finally:
        ann.PART, ann.ASKED, ann.TOGETHER = before
    want = collections.Counter()
    for n, (i, v) in enumerate(rows):
        if i % 20 == 0:
            near = sorted((-float((np.array(u) * np.array(v)).sum()), j) for m, (j, u) in enumerate(rows) if m != n and len(u) == len(v))
            want.update((i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(near[:5]))
    assert sum((got & want).values()) >= 0.95 * sum(want.values()) and sum(got.values()) == sum(want.values())


def test_values_may_become_equal(spark):
    item = "If Anna buys 12 green apples and Ben sells 3 of the red pears to a market, how many fruits do they have together at the end"
    docs = [(1, "Today we ask this. " + item.replace("12", "3") + "?"), (2, "so: " + item.replace("12", "9").replace("3", "9") + "?"), (3, "nothing of the kind is said here at all, not even 12 or 3 words of it")]
    got = {r.doc_id: r.coverage for r in decontam.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2}


def test_long_texts_of_megabytes(spark):
    """One text of two million characters goes through each operator beside a short one."""
    rng = random.Random(9)
    words = [w.translate(str.maketrans("0123456789", "abcdefghij")) for w in WORDS]
    long = " ".join(rng.choice(words) for _ in range(450_000))
    df = spark.createDataFrame([(1, long), (2, "short text of some words here"), (3, long + " end")], DOCS)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    item = " ".join(long.split()[1000:1040])
    assert {r.doc_id for r in decontam.contaminated(df, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()} == {1, 3}
    assert len(pii.personal_spans(df).collect()) == len(secrets.secret_spans(df).collect()) == 3


def test_jaccard_blocks_of_shared_words(spark, monkeypatch):
    """Unrelated texts of few words share most of their shingles: nearly all of those name no block, and no link is lost."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(WORDS[:30]) for _ in range(80))) for i in range(300)]
    for i in range(0, 300, 10):
        w = rows[i][1].split()
        w[0] = "other"
        rows.append((1000 + i, " ".join(w + ["more"] * (i % 3))))
    sizes = {}

    def stored(df, name, *more):
        out = kept(df, name, *more)
        sizes.setdefault(name, out.count())
        return out

    kept = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", stored)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, DOCS)).collect())
    assert got == brute_groups(rows, 3, 90)
    assert sizes["shared"] < 300, sizes


def test_jaccard_blocks_of_copies(spark, monkeypatch):
    """Equal texts count once and a passage of all texts comes last, so neither makes blocks of texts that are not alike."""
    rng = random.Random(5)
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    rows = [(i + 1000 * k, f"{passage} " + " ".join(f"{w}{41 * i + j}" for j, w in enumerate(WORDS[:40]))) for i in range(120) for k in range(2)]
    rows += [(5000 + i, t + " more") for i, t in rows[:20:4]]
    sizes = {}

    def stored(df, name, *more):
        out = kept(df, name, *more)
        sizes.setdefault(name, out.count())
        return out

    kept = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", stored)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, DOCS)).collect())
    assert got == brute_groups(rows, 3, 90)
    assert sizes["different"] == 125 and sizes["shared"] < 60, sizes


@pytest.mark.parametrize("bits", [10, 12, 21])
def test_bitmap_of_numbers(spark, bits):
    numbers = random.Random(bits).sample(range(1 << bits), 900)
    df = spark.createDataFrame([(k,) for k in numbers * 2], "k long").repartition(7)
    assert np.flatnonzero(np.unpackbits(np.frombuffer(jaccard.bitmap(df, bits), np.uint8))).tolist() == sorted(numbers)


def test_token_bitmap_follows_the_tokens(spark):
    for count in (1, 100_000, 400_000):
        bits = np.unpackbits(np.frombuffer(jaccard._token_bitmap(spark.range(count).selectExpr("xxhash64(id) AS t")), np.uint8))
        assert 0.04 < bits.mean() < 0.25 or count == 1 and bits.sum() == 1
