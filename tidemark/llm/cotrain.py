"""Quality classifier by co-training a text view and a metadata view.

The text view measures the content: surface counts, and a naive Bayes score of the words and word pairs, hashed, that
labelled documents hold. The metadata view sees language, source and length as the table states them. Both are
logistic models on a bounded sample of labelled documents. Over rounds, each
labels all unlabelled documents that it is sure of, by calibrated probability, for the other to
learn from; a view that carries no information is never sure and so teaches nothing. Tasks return sums of
gradients and Hessians only, so no document that a view is sure of is left out. Pseudo-labels are weighed to keep
the classes of the labels in proportion, and to weigh no more than the labels in all. Labels are dealt into four folds:
one fits the views, one calibrates them, one fits the logistic model that combines the calibrated views, and
the last is held out and measured.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, release

#: Bound of the labelled sample, in documents, taken in hash order. Unlabelled documents are all used.
LABELLED = 8_000
#: PASSES over the unlabelled documents a round at most; a step below ENOUGH ends the round.
ROUNDS, PASSES, ENOUGH, SURE, LEAST_LABELS = 5, 8, 1e-3, 0.98, 10
#: Ends of the folds that fit, calibrate and combine; the rest is held out.
FOLDS = (0.55, 0.75, 0.9)
THRESHOLD = 0.5
#: Places of hashed words and pairs, and their smoothing.
BUCKETS, SMOOTH = 1 << 13, 1.0
_SOURCES, _LANGS, _TEXT, _KNOWN, _SHORT, _FAN = 32, 16, 12, 200_000, 64, 64
_UPPER, _LOWER, _DIGITS, _SYMBOLS = (s.encode() for s in (string.ascii_uppercase, string.ascii_lowercase, string.digits, "#*$%&|<>"))


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(word.lower())
        if len(word) <= _SHORT:
            if len(self) > _KNOWN:
                self.clear()
            self[word] = code
        return code


_codes = _Codes()


def word_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, A-Z lower-cased, and of pairs of neighbours."""
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    return codes, codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]


def places_of(codes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The places of words and pairs, each once."""
    seen = np.zeros(BUCKETS, bool)
    for some in (codes, pairs):
        seen[(some >> np.uint64(40)).astype(np.int64) % BUCKETS] = True
    return np.flatnonzero(seen)


def word_places(text: str | None) -> np.ndarray:
    """The places of the words of a whole text and of its pairs of neighbours."""
    return places_of(*word_codes((text or "").encode("utf-8", "replace").split()))


@dataclass
class Words:
    """Naive Bayes on the places that documents of either class hold: counts by class, and documents' places in all."""

    counts: np.ndarray

    @classmethod
    def of(cls, places: list[np.ndarray], labels: np.ndarray) -> Words:
        counts = np.zeros((2, BUCKETS))
        for p, y in zip(places, labels, strict=True):
            counts[y, p] += 1
        return cls(counts)

    def __post_init__(self) -> None:
        rates = np.log(self.counts + SMOOTH) - np.log(self.counts.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
        self.weights = rates[1] - rates[0]

    def score(self, places: np.ndarray) -> float:
        """Mean log ratio of a document's places."""
        return float(self.weights[places].mean()) if len(places) else 0.0

    def score_without(self, places: np.ndarray, label: int) -> float:
        """The same of a document that was counted, as if it had not been."""
        if not len(places):
            return 0.0
        counts = self.counts[:, places].copy()
        totals = self.counts.sum(axis=1)
        counts[label] = np.maximum(0, counts[label] - 1)  # another row of the doc_id may hold other words
        totals[label] -= len(places)
        rates = np.log(counts + SMOOTH) - np.log(totals + SMOOTH * BUCKETS)[:, None]
        return float((rates[1] - rates[0]).mean())


def text_view(text: str | None, words_seen: Words | None = None, label: int | None = None) -> list[float]:
    """Measurements of a whole text, the score of its words last (0 without ``words_seen``; with a ``label``, as if it had not been seen); of an empty one, all zero."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return [0.0] * _TEXT
    n, chars = len(words), sum(map(len, words))
    count = lambda some: len(data) - len(data.translate(None, some))
    upper, lower = count(_UPPER), count(_LOWER)
    lines = [line for line in data.split(b"\n") if line.strip()]
    codes, pairs = word_codes(words)
    places = places_of(codes, pairs) if words_seen is not None else None
    threes = pairs[:-1] * np.uint64(0xD6E8FEB86659FD93) + codes[2:]
    return [
        math.log1p(n),
        chars / n,
        upper / max(1, upper + lower),
        count(_DIGITS) / chars,
        min(5.0, count(_SYMBOLS) / n),
        min(5.0, data.count(b"!") / n),
        min(5.0, (data.count(b".") + data.count(b",")) / n),
        len(np.unique(codes)) / n,
        1 - len(np.unique(threes)) / len(threes) if n > 2 else 0.0,
        1 - len(set(lines)) / len(lines),
        max(map(len, words)) > 100,
        0.0 if words_seen is None else words_seen.score(places) if label is None else words_seen.score_without(places, label),
    ]


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Hashed one-hot language and source, and the stated length; null is a value of its own."""
    row = [0.0] * (_LANGS + _SOURCES + 2)
    row[zlib.crc32(repr(lang).encode("utf-8", "replace")) % _LANGS] = 1.0
    row[_LANGS + zlib.crc32(repr(source).encode("utf-8", "replace")) % _SOURCES] = 1.0
    known = n_chars is not None and not math.isnan(n_chars)
    row[-2:] = [math.log1p(max(0, n_chars)) if known else 0.0, float(not known)]
    return row


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class Logistic:
    """Ridge-penalised logistic regression on standardised features, by Newton's method."""

    ridge: float = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.scale = np.where(self.scale < 1e-9, 1.0, self.scale)
        z = self._design(x)
        penalty = np.diag([*[self.ridge] * x.shape[1], 1e-6])
        self.weights = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-z @ self.weights))
            slope = z.T @ (p - y) + penalty @ self.weights
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, slope)
            self.weights -= step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, np.ones((len(z), 1))])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -30, 30)))


@dataclass
class View:
    """A classifier with its calibration."""

    model: Logistic
    calibration: Logistic

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.calibration.predict(logit(self.model.predict(x))[:, None])


@dataclass
class CoTrained:
    text: View
    meta: View
    combination: Logistic
    #: Of the held-out fold: documents, area under the curve and log loss; empty if there is none.
    report: dict[str, float]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, q = self.text.predict(text), self.meta.predict(meta)
        return p, q, self.combination.predict(np.column_stack([logit(p), logit(q)]))


Fold = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def pseudo_sums(models: list[Logistic], teachers: list[View], text: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """For each view and class: count, gradient and Hessian over the documents that the other view is sure of."""
    views, sums = (text, meta), []
    for k, model in enumerate(models):
        taught, z, p = teachers[1 - k].predict(views[1 - k]), model._design(views[k]), model.predict(views[k])
        for value, sure in ((0, 1 - taught >= SURE), (1, taught >= SURE)):
            zs, ps = z[sure], p[sure]
            sums += [np.array([len(zs)]), zs.T @ (ps - value), ((zs * (ps * (1 - ps))[:, None]).T @ zs).ravel()]
    return np.concatenate(sums)


def learn(models: list[Logistic], teachers: list[View], views: list[np.ndarray], labels: np.ndarray, fold: Fold) -> list[Logistic] | None:
    """Both views fitted to the labels and to what the other is sure of, by Newton's method; None if neither is sure."""
    models = [replace_weights(m, m.weights) for m in models]
    share = labels.mean()
    for _ in range(PASSES):
        sums, at, largest, taught = fold(partial(pseudo_sums, models, teachers)), 0, 0.0, False
        for k, (model, x) in enumerate(zip(models, views, strict=True)):
            d = len(model.weights)
            parts = []
            for _ in (0, 1):
                parts.append((sums[at], sums[at + 1 : at + 1 + d], sums[at + 1 + d : at + 1 + d + d * d].reshape(d, d)))
                at += 1 + d + d * d
            zeros, ones = parts[0][0], parts[1][0]
            if not zeros or not ones:
                continue
            taught = True
            weights = np.array([min(1.0, ones * (1 - share) / share / zeros), min(1.0, zeros * share / (1 - share) / ones)])
            weights *= min(1.0, len(labels) / (weights @ [zeros, ones]))
            z, p = model._design(x), model.predict(x)
            penalty = np.diag([*[model.ridge] * (d - 1), 1e-6])
            slope = z.T @ (p - labels) + penalty @ model.weights + sum(w * g for w, (_, g, _) in zip(weights, parts, strict=True))
            curve = (z * (p * (1 - p))[:, None]).T @ z + penalty + sum(w * h for w, (_, _, h) in zip(weights, parts, strict=True))
            step = np.linalg.solve(curve, slope)
            models[k] = replace_weights(model, model.weights - step)
            largest = max(largest, np.abs(step).max())
        if not taught:
            return None
        if largest < ENOUGH:
            break
    return models


def replace_weights(model: Logistic, weights: np.ndarray) -> Logistic:
    """A copy with the same scaling of features and other weights."""
    other = Logistic(model.ridge)
    other.mean, other.scale, other.weights = model.mean, model.scale, weights
    return other


def co_train(views: list[np.ndarray], labels: np.ndarray, pools: list[np.ndarray] | Fold, seed: int = 0) -> CoTrained | None:
    """Trains both views; None without enough labels of both kinds.

    ``pools`` are the unlabelled documents in both views, or a function that sums a function of
    such arrays over all of them.
    """
    if min((labels == 0).sum(), (labels == 1).sum()) < LEAST_LABELS:
        return None
    drawn = np.random.default_rng(seed).random(len(labels))
    fit, check, join, held = (np.digitize(drawn, FOLDS) == k for k in range(4))
    if any(len(set(labels[fold])) < 2 for fold in (fit, check, join)):  # too few labels to deal out
        fit = check = join = np.ones(len(labels), bool)
        held = ~fit
    fold = pools if callable(pools) else lambda f: f(*pools)
    models = [Logistic().fit(view[fit], labels[fit]) for view in views]
    calibrated = lambda: [View(m, Logistic(1e-3).fit(logit(m.predict(v[check]))[:, None], labels[check])) for m, v in zip(models, views, strict=True)]
    trained = calibrated()
    for _ in range(ROUNDS):
        if (learnt := learn(models, trained, [v[fit] for v in views], labels[fit], fold)) is None:
            break
        models = learnt
        trained = calibrated()
    both = np.column_stack([logit(t.predict(v[join])) for t, v in zip(trained, views, strict=True)])
    model = CoTrained(*trained, Logistic(1e-3).fit(both, labels[join]), {})
    if held.any():
        model.report = measured(model.scores(*(v[held] for v in views))[2], labels[held])
    return model


def measured(scores: np.ndarray, labels: np.ndarray) -> dict[str, float]:
    """Number of documents, area under the ROC curve (ties count half; nan with one class) and log loss."""
    p = np.clip(scores, 1e-6, 1 - 1e-6)
    ones, zeros = np.sort(scores[labels == 1]), scores[labels == 0]
    above = len(ones) - (np.searchsorted(ones, zeros, "left") + np.searchsorted(ones, zeros, "right")) / 2
    auc = float(above.sum() / (len(ones) * len(zeros))) if len(ones) and len(zeros) else math.nan
    return {"n": len(labels), "auc": auc, "log_loss": float(-np.mean(np.where(labels == 1, np.log(p), np.log(1 - p))))}


def _views(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The views of documents whose measurements ``_measure`` packed."""
    x = np.frombuffer(b"".join(packed), float).reshape(len(packed), _TEXT + 4)
    meta, every = np.zeros((len(x), _LANGS + _SOURCES + 2)), np.arange(len(x))
    meta[every, x[:, _TEXT].astype(int)] = 1.0
    meta[every, x[:, _TEXT + 1].astype(int)] = 1.0
    meta[:, -2:] = x[:, -2:]
    return x[:, :_TEXT], meta


def _summed(pool: DataFrame) -> Fold:
    """Sums over a table of packed measurements: a row of sums a task, and from many tasks ``_FAN`` rows, come back."""

    def fold(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = f(*_views([]))
            for batch in batches:
                total += f(*_views(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = f(*_views([]))
            for batch in batches:
                for sums in batch.column(0).to_pylist():
                    total += np.frombuffer(sums)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        sums = pool.select("x").mapInArrow(run, "sums binary")
        if sums.rdd.getNumPartitions() > 4 * _FAN:
            sums = sums.repartition(_FAN).mapInArrow(add, "sums binary")
        rows = [np.frombuffer(r["sums"]) for r in sums.collect()]
        return sum(rows) if rows else f(*_views([]))

    return fold


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[CoTrained, Words] | None:
    """A model from a sample of at most ``labelled`` of the documents that ``labels`` (doc_id, quality 0/1) names and all the others.

    Labels other than 0 and 1 are ignored; a document with both is labelled 0. Rows without a doc_id are unlabelled.
    """
    taught = train_and_measure(docs, labels, F.struct("doc_id"), labelled)
    return taught and taught[:2]


def train_and_measure(docs: DataFrame, labels: DataFrame, row: Column, labelled: int = LABELLED) -> tuple[CoTrained, Words, DataFrame] | None:
    """What ``train`` returns, and the table it wrote: a struct ``row`` (with the doc_id) and the measurements ``x`` of every row of ``docs``."""
    ws = Workspace(docs.sparkSession, "cotrain")
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    found = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = F.broadcast(found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    columns = ("text", "lang", "source", F.col("n_chars").cast("long"))
    sampled = docs.join(chosen, "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), *(F.first(c).alias(c) for c in ("text", "lang", "source", "n_chars")))
    rows = sampled.select("doc_id", "quality", _measure()(*columns, F.lit(None).cast("int")).alias("x"), _placed()("text").alias("places")).toPandas().sort_values("doc_id")
    if not len(rows):
        return None
    y, places = rows["quality"].to_numpy(int), [np.frombuffer(p, "<u2").astype(np.int64) for p in rows["places"]]
    words = Words.of(places, y)
    views = [v.copy() for v in _views([bytes(x) for x in rows["x"]])]
    views[0][:, -1] = [words.score_without(p, label) for p, label in zip(places, y, strict=True)]
    if min((y == 0).sum(), (y == 1).sum()) < LEAST_LABELS:
        return None
    label = chosen.select(F.col("doc_id").alias("known_id"), F.col("quality").alias("label"))  # whose words count without themselves, as when the views were fitted
    apart = docs.select(row.alias("row"), "doc_id", *columns[:3], columns[3].alias("n_chars"))
    labelled_rows = apart.join(F.broadcast(label), F.col("doc_id") == F.col("known_id"), "left")
    every = ws.save(labelled_rows.select("row", _measure(words)(*columns, "label").alias("x")))  # written, so that texts are measured once and the join below moves none
    pool = ws.save(every.select("row.doc_id", "x").join(known, "doc_id", "left_anti").select("x"))
    model = co_train(views, y, _summed(pool))
    ws.drop(pool)
    return model, words, every


def _measure(words: Words | None = None):
    """Both views of a document, with its label if its words were counted under one, as doubles: the text view, the places of the ones for language and source, the length."""

    @F.pandas_udf("binary")
    def measure(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, lang, source, n_chars, label in batches:
            packed = []
            for t, y, row in zip(text, label, zip(_none(lang), _none(source), n_chars, strict=True), strict=True):
                meta = meta_view(*row)
                packed.append(np.array([*text_view(t, words, None if pd.isna(y) else int(y)), meta.index(1.0), meta.index(1.0, _LANGS), *meta[-2:]], float).tobytes())
            yield pd.Series(packed, dtype=object)
        release(_codes)

    return measure


def _placed():
    """The places of a document's words as 16-bit integers, for the labelled sample alone."""

    @F.pandas_udf("binary")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            yield pd.Series([word_places(t).astype("<u2").tobytes() for t in text], dtype=object)
        release(_codes)

    return placed


def _none(values: pd.Series) -> list:
    return values.astype(object).where(values.notna(), None).tolist()


SCORE = "struct<p_text: double, p_meta: double, score: double, kept: boolean>"


def judged_rows(docs: DataFrame, labels: DataFrame, *columns: str, labelled: int = LABELLED) -> DataFrame:
    """Two structs a row of ``docs``: ``row``, all its columns or those named, and ``judged``, its scores. No name of a column can clash.

    The columns named must hold the doc_id. Rows are written once with what was measured of them, and scored from that table.
    """
    row = F.struct(*(columns or "*"))
    if (taught := train_and_measure(docs, labels, row, labelled)) is None:
        unknown = F.lit(None).cast("double")
        return docs.select(row.alias("row"), F.struct(unknown.alias("p_text"), unknown.alias("p_meta"), unknown.alias("score"), F.lit(True).alias("kept")).alias("judged"))
    model, _, every = taught

    @F.pandas_udf(SCORE)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            p, q, both = model.scores(*_views(x.tolist()))
            yield pd.DataFrame({"p_text": p, "p_meta": q, "score": both, "kept": both >= THRESHOLD})

    return every.select("row", score("x").alias("judged"))


def score_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) with a struct column ``quality_score``, which replaces one of that name.

    Its fields: p_text and p_meta, the calibrated views; score, their combination; kept (score >= THRESHOLD, so a tie is kept).
    Without enough labels of both kinds the numbers are null and every document is kept. Null columns and
    empty texts are measured as such. Rows are scored one by one, so repeats score alike.
    """
    return judged_rows(docs, labels, labelled=labelled).select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "quality_score"), F.col("judged").alias("quality_score"))


def accepted(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """The rows of ``docs`` that ``score_quality`` keeps, with their own columns, whatever their names."""
    return judged_rows(docs, labels, labelled=labelled).where("judged.kept").select("row.*")


def quality_scores(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """A row per document: doc_id, p_text, p_meta, score, kept."""
    return judged_rows(docs, labels, "doc_id", labelled=labelled).select("row.doc_id", "judged.*")
