"""Language ID by multilingual mixture inference.

Character trigram models give each run of a few words a likelihood under each language. For each
document, expectation-maximisation estimates the proportions of the languages among its runs; the
set of languages is chosen by likelihood less a penalty for each language (BIC). All documents of
a slice go through the iterations together. The mixture's likelihood against that of a background,
in which all trigrams are alike, tells whether a text is in any learned language at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import bounded_sample, coded, expand, hashed_ngrams, lean, segment_sums, slices, split_words, texts

#: Bounds of the labelled sample: rows of each language, characters in all; languages (more are an error).
SAMPLE_ROWS = 400
SAMPLE_CHARS = 8_000_000
LANGUAGES = 1000
#: Nats by which the background must be likelier than the best mixture for a text to be in no learned language.
FOREIGN = 10.0
BUCKETS = 1 << 16
#: Words in a run, the least number of languages from which elimination starts, rounds of expectation-maximisation.
RUN = 8
START = 4
ROUNDS = 8
UNKNOWN = "und"
#: A word of letters, with marks and punctuation around and within.
SPOKEN = r"^[\pP]*\pL[\pL\pM'’-]*[\pP]*$"


class LanguageModels:
    """Smoothed trigram log-probabilities, a row for each bucket and a column for each language."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        self.logs = np.log((counts + 0.1) / (counts + 0.1).sum(0)).astype(np.float32) if names else np.zeros((BUCKETS, 0), np.float32)


def fit_languages(labelled: DataFrame) -> LanguageModels:
    """Counts trigrams of a bounded sample of rows (doc_id, text, lang) with a non-null lang."""
    rows = bounded_sample(labelled.where("lang is not null").select("doc_id", "text", "lang"), SAMPLE_ROWS, SAMPLE_CHARS, per="lang", most_kinds=LANGUAGES)
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r.lang, []).append(r.text)
    names = sorted(by)
    counts = np.zeros((BUCKETS, len(names)))
    for k, name in enumerate(names):
        flat, _ = split_words(pc.utf8_lower(pa.array(by[name], pa.string())), lower=False)
        codes, words = coded(flat)
        features, of = hashed_ngrams(words, (3,), BUCKETS, whole=False)
        n = np.bincount(codes, minlength=len(words))
        counts[:, k] = np.bincount(features, np.repeat(n, np.diff(of)), BUCKETS)
    return LanguageModels(names, counts)


def _mixtures(runs: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the chosen languages for each document, from log-likelihoods of its runs.

    Languages are eliminated one by one from all that the document may hold. A run's likelihood
    is at most that of its best language, so sets whose penalty alone exceeds the loss of the best
    single language cannot be chosen, nor do more languages than runs help: none of these is tried.
    """
    n, k = np.diff(offsets), runs.shape[1]
    p = np.exp(runs - runs.max(1, keepdims=True))
    p = np.maximum(p, 1e-30)
    cost = 0.5 * np.log(np.maximum(n, 1) + 1) + 2.0
    alone = segment_sums(np.log(p), offsets).max(1)
    start = np.minimum(np.maximum(np.minimum(n, np.floor(1 - alone / cost + 1e-6)), START), k).astype(np.int64)
    best = np.full(len(n), -np.inf)
    chosen = np.zeros((len(n), k))

    def rounds(p, offsets, pi, times):
        sizes = np.diff(offsets)
        owner, weight = np.repeat(np.arange(len(sizes)), sizes), np.maximum(sizes, 1)[:, None]
        for _ in range(times):
            joint = p * pi[owner]
            joint /= joint.sum(1, keepdims=True)
            pi = segment_sums(joint, offsets) / weight
        return pi

    pi = rounds(p, offsets, np.full((len(n), k), 1 / k), ROUNDS)
    for size in range(int(start.max(initial=1)), 0, -1):
        live = np.flatnonzero(start >= size)
        own = np.concatenate([[0], np.cumsum(n[live])])
        part = p if len(live) == len(n) else p[expand(offsets[live], n[live])]
        now = pi[live]
        drop = np.argsort(-now, 1, kind="stable")[:, size:]
        np.put_along_axis(now, drop, 0.0, 1)
        now /= np.maximum(now.sum(1, keepdims=True), 1e-300)
        if size > 1:
            now = rounds(part, own, now, ROUNDS // 2)
        mixed = (part * now[np.repeat(np.arange(len(live)), n[live])]).sum(1)
        value = segment_sums(np.log(np.maximum(mixed, 1e-300)), own) - size * cost[live]
        better = value > best[live]
        best[live[better]], chosen[live[better]] = value[better], now[better]
        pi[live] = now
    return chosen, n


def weighed(array: pa.Array, models: LanguageModels) -> tuple[list[str], np.ndarray, list[dict[str, float]], np.ndarray]:
    """The main language, its share, all chosen languages with their shares, and the evidence for them against the background, for each text."""
    names = np.array(models.names, object)
    letters = pc.match_substring_regex(array, r"\p{L}").to_numpy(zero_copy_only=False)
    flat, offsets = split_words(pc.utf8_lower(array), lower=False)
    codes, words = coded(flat)
    if not len(names) or not len(codes):
        return [UNKNOWN] * len(array), np.zeros(len(array)), [{}] * len(array), np.zeros(len(array))
    features, of = hashed_ngrams(words, (3,), BUCKETS, whole=False)
    by_word = segment_sums(models.logs[features], of).astype(np.float32)
    sizes = np.diff(offsets)
    runs_of = (sizes + RUN - 1) // RUN
    run_offsets = np.concatenate([[0], np.cumsum(runs_of)])
    within = np.arange(len(codes)) - np.repeat(offsets[:-1], sizes)
    starts = np.flatnonzero(within % RUN == 0)
    runs = np.add.reduceat(by_word[codes], starts, axis=0)
    runs = runs.astype(np.float64)
    pi, n = _mixtures(runs, run_offsets)
    # numbers, addresses and the like are in no language: words of letters alone give the evidence
    spoken = pc.match_substring_regex(pa.array(words, pa.string()), SPOKEN).to_numpy(zero_copy_only=False)
    by_word *= spoken[:, None]
    said = np.add.reduceat(by_word[codes], starts, axis=0).astype(np.float64)
    likeliest = said.max(1)
    mixed = (np.exp(said - likeliest[:, None]) * pi[np.repeat(np.arange(len(n)), n)]).sum(1)
    grams = segment_sums((np.diff(of) * spoken)[codes], offsets)
    evidence = segment_sums(np.log(np.maximum(mixed, 1e-300)) + likeliest, run_offsets) + grams * np.log(BUCKETS)
    top = pi.argmax(1)
    known = letters & (n > 0)
    langs = [names[t] if ok else UNKNOWN for t, ok in zip(top, known)]
    shares = np.where(known, pi[np.arange(len(pi)), top], 0.0)
    sets = [{names[j]: float(row[j]) for j in np.flatnonzero(row > 0)} if ok else {} for row, ok in zip(pi, known)]
    return langs, np.clip(shares, 0, 1), sets, evidence


def infer(array: pa.Array, models: LanguageModels) -> tuple[list[str], np.ndarray, list[dict[str, float]]]:
    """The main language, its share, and all chosen languages with their shares, for each text."""
    return weighed(array, models)[:3]


def identify(documents: DataFrame, models: LanguageModels) -> DataFrame:
    """doc_id, lang_pred, score (share of that language) and shares (all chosen languages) of each whole text.

    A null text and one without a letter give `und` with score 0; so does any text if no language
    was learned. Ties go to the first name. Repeated rows repeat, a null doc_id stays null, other
    columns are ignored, an empty table gives none.
    """

    def run(batches):
        for batch in slices(batches):
            langs, shares, sets = infer(texts(batch), models)
            kinds = pa.map_(pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array([list(s.items()) for s in sets], kinds)], names=["doc_id", "lang_pred", "score", "shares"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double, shares map<string,double>")
