"""Personal data by fixed patterns and a semi-Markov conditional random field.

The field segments whole texts: whole-span features (shape, lengths, checksum, borders, the word
before) score each candidate segment, and dynamic programming over segments of bounded length
chooses boundaries and types jointly. An entity holds a digit, `@` or a bracketed `at`, and at most
LONGEST tokens of at most WIDEST code points each; text further from such a mark than that cannot be in one, so
only the surroundings of the marks are read, with the same result. The weights are learned here by
stochastic gradient descent on generated examples, most of them in forms that the fixed patterns
miss. Spans of the fixed patterns stay as they are and are barred to the field, whose further spans
are added.
"""

from __future__ import annotations

import bisect
import functools
import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import lean, slices, texts

KINDS = ("email", "ip", "card", "phone")
#: Tokens of the longest entity, code points of its longest token, spaces within it, features of the hashed table.
LONGEST = 16
WIDEST = 40
SPACES = 6
FEATURES = 1 << 13
#: Tokens whose candidates are held at once.
STRETCH = 2048
#: Code points around a mark that hold all entities with it and the tokens that their features read.
AROUND = (LONGEST + 5) * WIDEST

_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only start where a run of digits does, and no run can give digits back: time follows the text's length
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s+|.", re.DOTALL)
_ANCHOR = re.compile(r"[0-9@]|(?<=[(\[{])[Aa][Tt](?=[)\]}])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str):
    """Matches of the address pattern, from each `@` outwards: the run before it, then the pattern after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _RIGHT.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by kind, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def _bracketed_at(tokens: list[str], k: int) -> bool:
    return len(tokens[k]) == 2 and tokens[k].lower() == "at" and 0 < k < len(tokens) - 1 and tokens[k - 1] in "([{" and tokens[k + 1] in ")]}"


def _span_features(tokens: list[str], a: int, b: int) -> list[str]:
    """Features of the whole span tokens[a:b], without its type."""
    text = "".join(tokens[a:b])
    shape = "".join(f"d{min(len(t), 20)}" if t[0] in "0123456789" else "a" if t[0].isascii() and t[0].isalpha() else "s" if t[0].isspace() else t[:1] for t in tokens[a:b])
    digits = [c for c in text if c in "0123456789"]
    before = tokens[a - 1] if a else " "
    after = tokens[b] if b < len(tokens) else " "
    word = next((t.lower() for t in reversed(tokens[max(0, a - 4) : a]) if t[0].isalpha()), "")
    f = [f"shape={shape}", f"n={len(digits)}", f"first={shape[0]}", f"last={shape[-1] if shape[-1].isalpha() else 'x'}"]
    f.append(f"kinds={'@' in text}{'.' in text}{' ' in text}{'-' in text}{'(' in text}{'+' in text}{'a' in shape}")
    f.append(f"n,kinds={len(digits)},{'.' in text}{'a' in shape}{'@' in text}")
    f.append(f"before={before.isspace() or before in '(,:;|'}{before[-1:].isalnum()}{before[-1:] in '.-@+'}")
    f.append(f"after={after.isspace() or after in '),:;|'}{after[:1].isalnum()}{after[:1] in '-@'}")
    if 13 <= len(digits) <= 19 and "a" not in shape:
        f.append(f"luhn={luhn(''.join(digits))}")
    if text.count(".") == 3 and "a" not in shape:
        f.append(f"octets={all(p.isdigit() and len(p) < 4 and int(p) <= 255 for p in text.split('.'))}")
    if word:
        f.append(f"word={word[:10]}")
    if any(_bracketed_at(tokens, k) for k in range(a, b)):
        f.append(f"spelt={shape.count('a')}{shape.count('s')}{'.' in text or 'dot' in text.lower()}{tokens[b - 1].isalpha()}")
    if text.count("@") == 1:
        local, host = text.split("@")
        f.append(f"at={bool(local)}{host.count('.') > 0}{host[-2:].isalpha()}{' ' in text}")
    return f


class SegmentField:
    """Semi-Markov conditional random field over tokens; type 0 is a single token outside any entity."""

    def __init__(self):
        self.weights = np.zeros((len(KINDS), FEATURES))

    @staticmethod
    def candidates(tokens: list[str], barred: np.ndarray, start: int = 0, stop: int | None = None) -> list[tuple[int, int, np.ndarray]]:
        """Segments that may be entities, by start: of bounded length, with a mark, no space at the ends, no line break.

        Of all tokens, or those that begin at tokens[start:stop].
        """
        stop = len(tokens) if stop is None else min(stop, len(tokens))
        reach = range(start, min(stop + LONGEST, len(tokens)))
        marks = [k for k in reach if tokens[k] == "@" or tokens[k][0] in "0123456789" or _bracketed_at(tokens, k)]
        out, at = [], 0
        for a in range(start, stop):
            first = tokens[a]
            while at < len(marks) and marks[at] < a:
                at += 1
            if at == len(marks):
                break
            if marks[at] >= a + LONGEST or barred[a] or not (first[0] in "+(" or first[0].isascii() and first[0].isalnum()):
                continue
            spaces = 0
            for b in range(a + 1, min(len(tokens), a + LONGEST) + 1):
                t = tokens[b - 1]
                if barred[b - 1] or "\n" in t:
                    break
                spaces += t[0].isspace()
                if len(t) > WIDEST or spaces > SPACES:
                    break
                if marks[at] < b and t[0].isascii() and t[0].isalnum():
                    ix = np.array([xxhash.xxh32_intdigest(f) % FEATURES for f in _span_features(tokens, a, b)])
                    out.append((a, b, ix))
        return out

    def scores(self, segments) -> np.ndarray:
        return np.array([self.weights[:, ix].sum(1) for _, _, ix in segments]).reshape(len(segments), len(KINDS))

    def best(self, tokens: list[str], barred: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, kind) of the best segmentation; an outside token scores 0. Candidates are held for a stretch of tokens at a time."""
        n = len(tokens)
        value, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        done = 0
        for start in range(0, n, STRETCH):
            segments = self.candidates(tokens, barred, start, start + STRETCH)
            for (a, b, _), row in zip(segments, self.scores(segments)):
                while done < a:
                    done += 1
                    if value[done - 1] >= value[done]:
                        value[done], back[done] = value[done - 1], None
                k = int(row.argmax())
                if row[k] > 0 and value[a] + row[k] > value[b]:
                    value[b], back[b] = value[a] + float(row[k]), (a, b, k)
        for b in range(done + 1, n + 1):
            if value[b - 1] >= value[b]:
                value[b], back[b] = value[b - 1], None
        out, b = [], n
        while b:
            if back[b]:
                out.append(back[b])
                b = back[b][0]
            else:
                b -= 1
        return out[::-1]

    def step(self, n: int, segments, gold: set[tuple[int, int, int]], rate: float) -> None:
        """A gradient step on one sequence's log-likelihood: gold features less expected ones."""
        s = np.clip(self.scores(segments), -30, 30)
        e = np.exp(s)
        ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
        ahead[0] = behind[n] = 1.0
        by_end: dict[int, list[int]] = {}
        by_start: dict[int, list[int]] = {}
        for i, (a, b, _) in enumerate(segments):
            by_end.setdefault(b, []).append(i)
            by_start.setdefault(a, []).append(i)
        total = e.sum(1)
        for b in range(1, n + 1):
            ahead[b] = ahead[b - 1] + sum(ahead[segments[i][0]] * total[i] for i in by_end.get(b, ()))
        for a in range(n - 1, -1, -1):
            behind[a] = behind[a + 1] + sum(behind[segments[i][1]] * total[i] for i in by_start.get(a, ()))
        for i, (a, b, ix) in enumerate(segments):
            expected = ahead[a] * e[i] * behind[b] / ahead[n]
            real = np.array([float((a, b, k) in gold) for k in range(len(KINDS))])
            gain = rate * (real - expected)
            if np.abs(gain).max() > 1e-6:
                np.add.at(self.weights.T, ix, np.broadcast_to(gain, (len(ix), len(KINDS))))


def _examples(rng: random.Random, n: int):
    """Generated texts with marked entities: (text, [(kind, start, end)]). A card passes its checksum or is announced as one (mistyped); numbers like cards, phones and addresses that are none stand between."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def digits(valid: bool) -> str:
        x = d(15)
        return x + rng.choice([c for c in "0123456789" if luhn(x + c) == valid])

    def card(valid: bool = True) -> str:
        x, sep = digits(valid), rng.choice(["", " ", "-", ".", ".", " - ", "/"])
        return sep.join(x[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = d(3), d(3), d(4)
        return rng.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a} {b} {c}", f"0{a}-{b} {c}", f"00{d(2)} {a} {b} {c}", f"+{d(2)} {a} {b} {c}", f"+1 ({a}) {b}-{c}"])

    def email() -> str:
        name, host, end = word() + rng.choice(["", d(2), "." + word(), "_" + word()]), word(), rng.choice(["com", "org", "net", "de", "fr"])
        o, c = rng.choice(["()", "[]", "{}"])
        return rng.choice([f"{name} {o}at{c} {host}.{end}", f"{name}{o}at{c}{host}.{end}", f"{name} {o}at{c} {host} {o}dot{c} {end}", f"{name} @ {host}.{end}", f"{name} @ {host} . {end}", f"{name}@{host}.{end}"])

    def address(limit: int = 255) -> str:
        sep = rng.choice([" . ", ". ", " .", "[.]", "."])
        return sep.join(str(rng.randint(0, limit)) for _ in range(4))

    make = {"email": email, "ip": address, "card": card, "phone": phone}
    other = [
        lambda: f"{d(1)}.{d(1)}", lambda: f"version {d(1)}", lambda: f"{d(4)}", lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"${d(3)}.{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(1)}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32)), lambda: f"{d(2)}:{d(2)}", lambda: f"{d(3)},{d(3)}", lambda: f"{d(2)}%", lambda: f"#{d(5)}", lambda: f"{d(7)}", lambda: f"{d(24)}",
        lambda: f"v{d(1)}.{d(2)}.{d(1)}.{d(3)}9{d(3)}", lambda: f"@{word()}", lambda: f"{d(3)} {word()} {d(2)}", lambda: f"{d(2)}.{d(3)}.{d(3)}", lambda: card(False), lambda: card(False), lambda: f"order {d(5)}-{d(3)}-{d(3)}",
        lambda: f"{d(5)}-{d(3)}-{d(3)}", lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)}-{d(3)}", lambda: f"{d(2)}.{d(4)}, {d(2)}.{d(4)}", lambda: f"{d(2)} . {d(2)}",
        lambda: f"{word()} (at) {word()}", lambda: f"{word()} @ {d(2)}", lambda: f"{d(1)} {d(2)} {d(1)} {d(2)}", lambda: f"{d(4)} {d(4)}", lambda: f"{rng.randint(256, 999)} . {d(3)} . {rng.randint(256, 999)} . {d(1)}",
    ]
    lead = {"email": ["mail", "contact", ""], "ip": ["host", "address", ""], "card": ["card", "visa", ""], "phone": ["tel", "phone", "call", ""]}
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + " "
            if rng.random() < 0.55:
                kind = rng.choice(KINDS)
                said = rng.choice([x + " " if x else "" for x in (*lead[kind], "", "")])
                text += said
                made = card(rng.random() < 0.5) if kind == "card" and said else make[kind]()
                spans.append((kind, len(text), len(text) + len(made)))
                text += made
            else:
                text += rng.choice(other)()
            text += rng.choice([" ", ". ", ", ", "!! ", "### "])
        yield text + word(), spans


@functools.lru_cache(1)
def trained_field(examples: int = 900, epochs: int = 4) -> np.ndarray:
    """Weights of a field fitted on generated examples; the same on every call."""
    rng = random.Random(11)
    field, data = SegmentField(), []
    for text, spans in _examples(rng, examples):
        tokens = _TOKEN.findall(text)
        ends = np.cumsum([len(t) for t in tokens])
        at = {0: 0} | {int(e): i + 1 for i, e in enumerate(ends)}
        gold = {(at[a], at[b], KINDS.index(k)) for k, a, b in spans if a in at and b in at}
        data.append((len(tokens), field.candidates(tokens, np.zeros(len(tokens), bool)), gold))
    for epoch in range(epochs):
        rng.shuffle(data)
        for n, segments, gold in data:
            if segments:
                field.step(n, segments, gold, 0.3 / (1 + epoch))
    return field.weights


def _regions(text: str, taken: list[list[int]]) -> list[tuple[int, int]]:
    """Surroundings of all marks outside the taken spans; overlapping ones are one region."""
    out = []
    k = at = 0
    while m := _ANCHOR.search(text, at):
        i = m.start()
        while k < len(taken) and taken[k][1] <= i:
            k += 1
        if k < len(taken) and taken[k][0] <= i:
            at = taken[k][1]
            continue
        end = i + 1
        while end < len(text) and text[end] in "0123456789":
            end += 1
        lo, hi = max(0, i - AROUND), min(len(text), end + AROUND)  # a run of digits over WIDEST is in no entity, its ends may border one
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
        at = end
    return out


def find_spans(text: str, field: SegmentField) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base, all): base spans, and all spans, each by kind as listed, then start. Empty text: none."""
    base = base_spans(text)
    taken: list[list[int]] = []  # base spans of all kinds, overlapping ones united
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    added = []
    for lo, hi in _regions(text, taken):
        while lo > 0 and text[lo - 1].isalnum() and text[lo].isalnum():
            lo -= 1
        while hi < len(text) and text[hi - 1].isalnum() and text[hi].isalnum():
            hi += 1
        tokens = _TOKEN.findall(text[lo:hi])
        ends = lo + np.cumsum([len(t) for t in tokens])
        starts = ends - np.array([len(t) for t in tokens])
        barred = np.zeros(len(tokens), bool)
        k = bisect.bisect_right(taken, lo, key=lambda t: t[1])
        while k < len(taken) and taken[k][0] < hi:
            barred[np.searchsorted(ends, taken[k][0], "right") : np.searchsorted(starts, taken[k][1], "left")] = True
            k += 1
        for a, b, k in field.best(tokens, barred):
            if not added or added[-1][2] <= starts[a]:
                added.append((KINDS[k], int(starts[a]), int(ends[b - 1])))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def personal_spans(documents: DataFrame) -> DataFrame:
    """doc_id, base and found: arrays of (kind, start, end) of each whole text, by kind as KINDS list them, then start.

    Offsets are code points, end exclusive. `found` holds all of `base` and the field's further
    spans. A null text has none. Repeated rows repeat, a null doc_id stays null, other columns are
    ignored, an empty table gives none.
    """
    weights = trained_field()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        field = SegmentField()
        field.weights = weights
        row = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in slices(batches):
            found = [find_spans(t, field) for t in texts(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([row(b) for b, _ in found], kind), pa.array([row(s) for _, s in found], kind)], names=["doc_id", "base", "found"])

    spans = "array<struct<kind:string,start:long,end:long>>"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), f"doc_id long, base {spans}, found {spans}")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones united) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(documents: DataFrame) -> DataFrame:
    """The documents' columns doc_id, text, lang, source, n_chars with personal data in text replaced; n_chars follows.

    A null text stays null, and its n_chars as it was.
    """
    weights = trained_field()
    columns = ["doc_id", "text", "lang", "source", "n_chars"]

    def run(batches):
        field = SegmentField()
        field.weights = weights
        for batch in slices(batches):
            out = [None if t is None else redact(t, find_spans(t, field)[1]) for t in batch.column("text").to_pylist()]
            n = [old if t is None else len(t) for t, old in zip(out, batch.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), batch.column("lang"), batch.column("source"), pa.array(n, pa.int64())], names=columns)

    return documents.select(*(F.col(c).cast("long").alias(c) if c in ("doc_id", "n_chars") else c for c in columns)).mapInArrow(lean(run), "doc_id long, text string, lang string, source string, n_chars long")
