"""Language ID by a string kernel: blended spectrum, Nystroem landmarks, one-versus-rest kernel ridge.

Texts are lower-cased and everything that is no letter counts as a space.  The kernel of two
texts is the number of distinct 1- to 3-grams that both hold, divided by the root of the product of their own
numbers.  ``fit`` takes a bounded sample of labelled rows (``per_lang`` of each
label, by a hash of doc_id; with more than ``max_langs`` labels they share the rows and landmarks of so many; more labels than
rows of the sample are an error); the first of them in each language are landmarks, as many as keep the landmark
matrix within ``LANDMARK_BYTES``, so that what is broadcast is bounded whatever the scripts and labels.  Nystroem features of the sample are fitted to +1/-1
targets of each language by ridge regression.  ``predict`` reads every whole
text, forms the presence matrix of a batch over the landmarks' n-grams, and
multiplies it by the landmark matrix and the weights.

A text that is null or has no letter gets ``und`` and score 0; so does every
text when there was nothing to learn from.  Equal best scores go to the first
language in order.  Rows that repeat get the same answer; a null doc_id or null lang is not learned from.
An empty table gives no rows and nothing to learn.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import chunks, small_batches

ORDERS = 3
PER_LANG = 300
LANDMARKS_PER_LANG = 24
MAX_LANGS = 200
RIDGE = 1e-4
UNKNOWN = "und"
# Bytes of the landmark matrix (n-grams x landmarks).
LANDMARK_BYTES = 128 << 20
# Cells of a presence matrix that are held at once.
MATRIX_CELLS = 4 << 20

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is no letter."""
    if not _LETTERS:
        out = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _LETTERS.append(out)
    return _LETTERS[0]


def ngrams(text: str | None) -> np.ndarray | None:
    """The distinct 1- to 3-grams of a text, each packed into 63 bits; None if it has no letter."""
    if not text:
        return None
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = _letters()[codes]
    if not (codes != 32).any():
        return None
    codes = codes.astype(np.int64) + 1
    grams, total = [codes], codes
    for n in range(1, ORDERS):
        total = total[:-1] | (codes[n:] << (21 * n))
        grams.append(total)
    keys = np.sort(np.concatenate(grams))
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


@dataclass
class Model:
    """Languages, the landmarks' n-grams, the landmark matrix (n-grams x landmarks) and weights."""

    langs: list[str]
    vocabulary: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel values of n-gram sets and landmarks."""
        out = np.empty((len(sets), self.landmarks.shape[1]), dtype=np.float32)
        step = max(MATRIX_CELLS // max(len(self.vocabulary), 1), 1)
        for lo in range(0, len(sets), step):
            part = sets[lo:lo + step]
            present = np.zeros((len(part), len(self.vocabulary)), dtype=np.float32)
            for row, keys in zip(present, part):
                at = np.searchsorted(self.vocabulary, keys)
                at[at == len(self.vocabulary)] = 0
                row[at[self.vocabulary[at] == keys]] = 1
            scale = np.sqrt(np.array([len(x) for x in part], dtype=np.float32))
            out[lo:lo + step] = (present @ self.landmarks) / scale[:, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        sets = [ngrams(t) for t in texts]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [i for i, s in enumerate(sets) if s is not None] if self.langs else []
        if at:
            value = self.kernel([sets[i] for i in at]) @ self.weights
            best = value.argmax(axis=1)
            for i, b, v in zip(at, best.tolist(), value.max(axis=1).tolist()):
                langs[i], scores[i] = self.langs[b], min(max((1 + v) / 2, 0.0), 1.0)
        return langs, scores


def landmarks_of(sets: list[np.ndarray], labels: list[str], per_lang: int) -> list[np.ndarray]:
    """The first ``per_lang`` sets of each language; if their matrix would be too large, the languages' first ones before second ones."""
    seen: dict[str, int] = {}
    turn = []
    for i, y in enumerate(labels):
        seen[y] = seen.get(y, 0) + 1
        if seen[y] <= per_lang:
            turn.append((seen[y], i))
    turn.sort()

    def size(n: int) -> int:
        return 4 * n * len(np.unique(np.concatenate([sets[i] for _, i in turn[:n]])))

    n = len(turn)
    if size(n) > LANDMARK_BYTES:
        n = max(bisect.bisect_right(range(1, n + 1), LANDMARK_BYTES, key=size), 1)
    return [sets[i] for i in sorted(i for _, i in turn[:n])]


def solve(sets: list[np.ndarray], labels: list[str], per_lang: int = LANDMARKS_PER_LANG) -> Model:
    """The model of labelled n-gram sets."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    marks = landmarks_of(sets, labels, per_lang)
    vocabulary = np.unique(np.concatenate(marks))
    matrix = np.zeros((len(vocabulary), len(marks)), dtype=np.float32)
    for j, s in enumerate(marks):
        matrix[np.searchsorted(vocabulary, s), j] = 1 / np.sqrt(len(s))
    model = Model(langs, vocabulary, matrix, np.zeros((len(marks), len(langs)), np.float32))
    inner = model.kernel(marks).astype(np.float64)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    z = model.kernel(sets).astype(np.float64) @ root
    zy = np.hstack([z.T @ np.where(np.array(labels)[:, None] == np.array(langs[i:i + MAX_LANGS])[None, :], 1.0, -1.0)
                    for i in range(0, len(langs), MAX_LANGS)])
    w = np.linalg.solve(z.T @ z + RIDGE * len(sets) * np.eye(z.shape[1]), zy)
    model.weights = (root @ w).astype(np.float32)
    return model


def _ngram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        sets = [ngrams(t) for t in part.column("text").to_pylist()]
        yield pa.record_batch([part.column("lang"), part.column("place"), pa.array(
            [None if s is None else s.tobytes() for s in sets], pa.binary())], names=["lang", "place", "grams"])


def fit(labelled: DataFrame, per_lang: int = PER_LANG, max_langs: int = MAX_LANGS) -> Model:
    """Learn from a bounded sample of ``labelled`` (doc_id, text, lang): at most ``per_lang * max_langs`` rows.

    No label is left out; more labels than rows of the sample are an error.
    """
    rows = labelled.select("doc_id", "text", "lang").where(
        "lang is not null and doc_id is not null and text is not null")
    most = per_lang * max_langs
    top = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most + 1).collect()
    if not top:
        return solve([], [])
    if len(top) > most:
        raise ValueError(f"more than {most} languages to learn")
    marks = LANDMARKS_PER_LANG
    if len(top) > max_langs:
        per_lang, marks = per_lang * max_langs // len(top), max(marks * max_langs // len(top), 1)
    # A rate for each language keeps the rows that are ranked in proportion to per_lang.
    whole = 1 << 30
    rate = F.create_map(*[F.lit(x) for r in top for x in (
        r["lang"], whole if r["count"] <= 2 * per_lang else int(whole * 2 * per_lang / r["count"]))])
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(whole))
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "text")
    sample = (rows.withColumn("place", place).where(F.col("place") < rate[F.col("lang")])
              .where(F.col("text").rlike("\\p{L}"))
              .withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_lang)
              .select("lang", "place", "text"))
    got = sample.mapInArrow(_ngram_batches, "lang string, place long, grams binary").collect()
    got = sorted((r for r in got if r["grams"] is not None), key=lambda r: (r["place"], r["lang"], r["grams"]))
    return solve([np.frombuffer(r["grams"], np.int64) for r in got], [r["lang"] for r in got], marks)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) with lang_pred and score, from ``text`` alone.

    ``keep`` must not hold columns of these two names.

    The model is broadcast; its landmark matrix is at most ``LANDMARK_BYTES`` large.
    """
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            langs, scores = held.value.predict(part.column("text").to_pylist())
            yield pa.record_batch([*(part.column(c) for c in keep), pa.array(langs, pa.string()),
                                   pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = StructType([docs.schema[c] for c in keep]
                        + [StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(score, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a document belongs to the fold that is never learned from; a null doc_id doesn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
