"""Language identification by string kernels: ridge regression of one language against the rest in a Nyström space.

The kernel of two texts is a blended spectrum: how many different grams of one to ``LONGEST`` code points both hold, over the root of how
many each holds, so a text is a vector of presences. Landmarks are passages of training texts, a share for each language. A
text's kernel with the landmarks, times the inverse root of the landmarks' own kernel, is its place in the Nyström space, and ridge
regressions there, one for each language, give the scores.

Only bounded samples are ever fitted: ``LANDMARKS`` passages of at most ``PASSAGE`` code points, and ``SAMPLE`` training texts, whole, of
which tasks return sums of outer products. What goes to tasks is the landmarks' grams, at most LANDMARKS * PASSAGE * LONGEST hashes, and
their weights: since kernel and regression are linear in presences, they are multiplied once, and a batch of
texts is scored by one product of its presences with the weights. Long texts are read in pieces that overlap; no text is cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, bound_batches

#: Longest gram in code points; landmarks in all; code points of one; training texts in all; languages at most, the commonest.
LONGEST, LANDMARKS, PASSAGE, SAMPLE, LANGUAGES = 4, 128, 1_500, 4_000, 64
RIDGE, UNKNOWN = 1e-3, "und"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
_PIECE, _ROWS = 1 << 18, 32
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_codes(text: str) -> Iterator[np.ndarray]:
    """Hashes of all grams of a text, lower-cased, in pieces; a gram may come again."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    for low in range(0, len(points), _PIECE):
        piece = points[low : low + _PIECE + LONGEST - 1]
        state = np.zeros(len(piece), np.uint64)
        for n in range(1, LONGEST + 1):
            state = (state[: len(piece) - n + 1] + piece[n - 1 :] + np.uint64(n)) * _MIX
            state ^= state >> np.uint64(32)
            yield state * _STEP


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    codes = np.sort(np.concatenate(parts))  # far quicker than np.unique
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes


def distinct_codes(text: str) -> np.ndarray:
    """Hashes of the different grams of a whole text, sorted."""
    seen = np.zeros(0, np.uint64)
    held: list[np.ndarray] = []
    for codes in gram_codes(text):
        held.append(codes)
        if sum(map(len, held)) >= 4 * _PIECE:
            seen, held = _distinct([seen, *held]), []
    return _distinct([seen, *held])


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Table:
    """Places of hashes in a sorted array, looked up by their leading bits."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.bits = max(8, int(len(codes)).bit_length() + 1)
        self.first = np.searchsorted(codes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int64)
        ends = np.append(self.first[1:], len(codes))
        self.deepest = int((ends - self.first).max()) if len(codes) else 0
        self.padded = np.append(codes, np.zeros(self.deepest, np.uint64))

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Places of those of ``codes`` that are there."""
        at, found = self.first[(codes >> np.uint64(64 - self.bits)).astype(np.int64)], []
        for k in range(self.deepest):
            here = at + k
            found.append(here[(self.padded[here] == codes) & (here < len(self.codes))])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass
class Landmarks:
    """The landmarks' grams, which of them each landmark holds, and the map from kernels to the Nyström space."""

    table: Table
    holds: np.ndarray  # grams x landmarks
    sizes: np.ndarray
    root: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Landmarks:
        each = [distinct_codes(t) for t in texts]
        table = Table(_distinct(each))
        holds = np.zeros((len(table.codes), len(each)), np.uint8)
        for k, codes in enumerate(each):
            holds[np.searchsorted(table.codes, codes), k] = 1
        sizes = np.sqrt(np.maximum(1, holds.sum(axis=0, dtype=np.float64)))
        values, vectors = np.linalg.eigh((holds.T.astype(np.float64) @ holds.astype(np.float64)) / np.outer(sizes, sizes))
        keep = values > 1e-8 * values.max()
        return cls(table, holds, sizes, vectors[:, keep] / np.sqrt(values[keep]))

    def kernels(self, texts: list[str]) -> np.ndarray:
        """Kernels of whole texts with the landmarks."""
        rows = np.zeros((len(texts), len(self.sizes)))
        for k, text in enumerate(texts):
            codes = distinct_codes(text)
            rows[k] = self.holds[self.table.places(codes)].sum(axis=0, dtype=np.float64) / max(1.0, np.sqrt(len(codes)))
        return rows / self.sizes


@dataclass
class Model:
    """Languages, and what a text's presences are multiplied with."""

    languages: list[str]
    table: Table
    weights: np.ndarray  # grams x languages
    shares: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """A row per text: each language's regression, held to 0 to 1."""
        seen, sizes = np.zeros((len(texts), len(self.table.codes)), np.float32), np.ones(len(texts))
        for k, text in enumerate(texts):
            codes = distinct_codes(text)
            seen[k, self.table.places(codes)] = 1
            sizes[k] = max(1.0, np.sqrt(len(codes)))
        return np.clip((seen @ self.weights) / sizes[:, None] + self.shares, 0, 1)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: with a text that holds letters and a language, and not held out by the checksum of their doc_id."""
    return docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out()).where(F.regexp_like("text", F.lit(r"\p{L}")))


def held_out():
    """Whether a row is kept from training; rows without a doc_id are, as their checksum is none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def drawn(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> DataFrame:
    """At most ``sample`` training rows (lang, text, nth), the same number of each language, in the order of a hash of their doc_id.

    Of more than ``languages`` languages the commonest are learned. Rows are thinned by the hash before they meet.
    """
    rows = training_rows(docs).select("doc_id", "lang", "text")
    counted = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    each = sample // max(1, len(counted))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000))
    enough = F.lit(False)
    for r in counted:  # twice what is wanted on average, and so many more that too few are as good as impossible
        enough |= (F.col("lang") == r["lang"]) & (draw < int(1e6 * min(1.0, (2 * each + 50) / r["count"])))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    return rows.where(enough).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each).select("lang", "text", "nth")


def train(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model | None:
    """A model of the languages that training rows of ``docs`` (doc_id, text, lang) name; None without any.

    Landmarks are middle passages of the first texts drawn of each language.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "language")
    texts = ws.save(drawn(docs, sample))
    languages = sorted(r["lang"] for r in texts.select("lang").distinct().collect())  # at most LANGUAGES
    if not languages:
        return None
    middle = F.greatest(F.lit(1), ((F.length("text") - PASSAGE) / 2).cast("int") + 1)
    first = texts.where(F.col("nth") <= max(1, landmarks // len(languages))).orderBy("lang", "nth")
    marks = Landmarks.of([r["passage"] for r in first.select(F.substring("text", middle, F.lit(PASSAGE)).alias("passage")).collect()])
    shared = spark.sparkContext.broadcast((marks, languages))
    m, c = marks.root.shape[1], len(languages)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, languages = shared.value
        total = np.zeros((m + c + 1, m + c + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                langs, some = (x.to_pylist() for x in batch.slice(at, _ROWS).columns)
                x = np.zeros((len(some), m + c + 1))
                x[:, :m] = marks.kernels(some) @ marks.root
                x[np.arange(len(some)), m + np.array([languages.index(v) for v in langs])] = 1
                x[:, -1] = 1
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    spread = texts.select("lang", "text").repartition(min(64, max(1, sample // 100)))  # so that few matrices come back
    total = sum(np.frombuffer(r["sums"]).reshape(m + c + 1, -1) for r in spread.mapInArrow(sums, "sums binary").collect())
    n = total[-1, -1]
    mean_x, shares = total[-1, :m] / n, total[-1, m:-1] / n
    covariance, cross = total[:m, :m] - n * np.outer(mean_x, mean_x), total[:m, m:-1] - n * np.outer(mean_x, shares)
    weights = np.linalg.solve(covariance + RIDGE * n * np.eye(m), cross)
    return Model(languages, marks.table, (marks.holds @ (marks.root @ weights / marks.sizes[:, None])).astype(np.float32), shares - mean_x @ weights)


def identify(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score (0 to 1).

    ``lang_pred`` is the language of the highest score (ties: the first by name), ``und`` with score 0 for a null text, one without a
    letter, and where nothing can be learned. Predictions read the text alone. A null doc_id counts as held out.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample, landmarks))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                ids, held, texts = (x.to_pylist() for x in batch.slice(at, _ROWS).columns)
                known = [k for k, text in enumerate(texts) if model is not None and has_letter(text)]
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if known:
                    rows = model.scores([texts[k] for k in known])
                    for k, best, row in zip(known, rows.argmax(axis=1), rows, strict=True):
                        langs[k], scores[k] = model.languages[best], float(row[best])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(langs), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(predict, PREDICTED)


def accuracy(docs: DataFrame, predicted: DataFrame) -> DataFrame:
    """Of each language of held-out rows: n and right. ``docs`` (doc_id, lang) and what ``identify`` returned."""
    held = predicted.where("held_out AND doc_id IS NOT NULL").select("doc_id", "lang_pred").distinct()
    return held.join(docs.where("lang IS NOT NULL").select("doc_id", "lang").distinct(), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("lang_pred")).alias("right"))
