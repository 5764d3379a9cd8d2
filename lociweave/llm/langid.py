"""Language identification in two steps: the family, then the language within it.

Texts are counts of hashed character 1- to 3-grams. Linear support vector machines, one for each two
classes, are trained here (dual coordinate descent on the squared hinge loss): between families, and
between the languages of each family. The family with most votes wins (ties: the larger sum of
margins), then the language likewise; the score is the product of the two steps' logistic margins.

Training reads the whole texts of at most ``PER_LANGUAGE`` documents of each language value and of about
``SAMPLE`` in all (at least ``LEAST`` of each), the first by a hash of their id; the counts are made on the executors. No value is left
out: values that ``FAMILIES`` doesn't name are families of their own up to ``OWN_FAMILIES`` of them, more are
put into families by their mean counts. Whole texts are classified.

Defined results: null text or one without a letter is ``und`` with score 0; without any training
row (an empty table) every text is ``und``; ties go to the name that is first in order; repeated rows give
repeated rows; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import doc_texts, first_by_hash, ids_and_texts, tidy

DIMS = 1 << 13
PER_LANGUAGE, SAMPLE, LEAST = 600, 6000, 8
#: Unnamed values that are families of their own.
OWN_FAMILIES = 12
UNKNOWN = "und"
#: Closely related languages; a value not named here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}


@functools.cache
def letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def counts(text: str) -> np.ndarray | None:
    """Hashed n-gram counts, damped and of length 1, with a constant; None without a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    a = letters()[c]
    if not a.any():
        return None
    c = np.where(a, c, 32)
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = a[1:] | a[:-1]
    c = np.concatenate([[32], c[keep], [32]]).astype(np.uint32)
    out = np.bincount((c * np.uint32(2654435761)) >> 19, minlength=DIMS)
    two = c[:-1] * np.uint32(31) + c[1:] * np.uint32(2246822519)
    out += np.bincount((two * np.uint32(2654435761)) >> 19, minlength=DIMS)
    three = two[:-1] * np.uint32(31) + c[2:] * np.uint32(3266489917)
    out += np.bincount((three * np.uint32(2654435761)) >> 19, minlength=DIMS)
    x = np.sqrt(out, dtype=np.float32)
    x /= np.sqrt(x @ x)
    return np.append(x, np.float32(0.3))


def train_pair(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 25, seed: int = 7) -> np.ndarray:
    """Weights of a linear SVM (y: 1 or -1)."""
    w, alpha, rng = np.zeros(x.shape[1], dtype=np.float32), np.zeros(len(x)), np.random.default_rng(seed)
    diagonal = 1 / (2 * cost)
    square = np.einsum("ij,ij->i", x, x) + diagonal
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            gradient = y[i] * float(w @ x[i]) - 1 + diagonal * alpha[i]
            new = max(alpha[i] - gradient / square[i], 0)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


class Pairs:
    """One machine for each two of the classes."""

    def __init__(self, x: np.ndarray, y: list[str]):
        self.names = sorted(set(y))
        self.pairs = list(combinations(range(len(self.names)), 2))
        own = np.array([self.names.index(v) for v in y])
        rows = [train_pair(x[m], np.where(own[m] == i, 1.0, -1.0)) for i, j in self.pairs for m in [np.isin(own, (i, j))]]
        self.w = np.array(rows, dtype=np.float32).reshape(len(rows), x.shape[1])

    def best(self, x: np.ndarray) -> tuple[str, float]:
        """The winner and how surely it won its closest decision."""
        if not self.pairs:
            return self.names[0], 1.0
        votes, sums = np.zeros(len(self.names)), np.zeros(len(self.names))
        margins = self.w @ x
        for (i, j), m in zip(self.pairs, margins, strict=True):
            votes[i if m >= 0 else j] += 1
            sums[i] += m
            sums[j] -= m
        k = max(range(len(votes)), key=lambda n: (votes[n], sums[n]))
        least = min(m if i == k else -m for (i, j), m in zip(self.pairs, margins, strict=True) if k in (i, j))
        return self.names[k], float(1 / (1 + np.exp(-4 * np.clip(least, -8, 8))))


def grouped(x: np.ndarray, y: list[str], names: list[str]) -> dict[str, str]:
    """A family for each of some languages: its own if they are few, else that of the nearest seed (the
    languages farthest from each other, about the square root of their number), by mean counts."""
    if len(names) <= OWN_FAMILIES:
        return {v: v for v in names}
    own = np.array(y)
    mean = np.array([x[own == v].mean(axis=0) for v in names])
    mean /= np.linalg.norm(mean, axis=1, keepdims=True)
    near, seeds = mean @ mean[0], [0]
    while len(seeds) < max(OWN_FAMILIES, round(len(names) ** 0.5)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, mean @ mean[seeds[-1]])
    best = np.argmax(mean @ mean[seeds].T, axis=1)
    return {v: f"like {names[seeds[k]]}" for v, k in zip(names, best.tolist(), strict=True)}


class Model:
    def __init__(self, rows: list[tuple[str, str]], families: dict[str, tuple[str, ...]] = FAMILIES):
        """rows: (text, lang)."""
        found = [(x, v) for t, v in rows if (x := counts(t)) is not None]
        self.train(np.array([a for a, _ in found]), [v for _, v in found], families)

    def train(self, x: np.ndarray, y: list[str], families: dict[str, tuple[str, ...]] = FAMILIES) -> None:
        """x: counts of each text; y: its language."""
        self.families: Pairs | None = None
        self.within: dict[str, Pairs] = {}
        if len(y):
            family = {v: f for f, names in families.items() for v in names}
            family |= grouped(x, y, sorted(set(y) - set(family)))
            f = [family[v] for v in y]
            self.families = Pairs(x, f)
            for name in self.families.names:
                own = [i for i, v in enumerate(f) if v == name]
                self.within[name] = Pairs(x[own], [y[i] for i in own])

    def predict(self, text: str) -> tuple[str, float]:
        x = counts(text) if self.families else None
        if x is None:
            return UNKNOWN, 0.0
        family, p = self.families.best(x)
        name, q = self.within[family].best(x)
        return name, p * q


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Train on a bounded sample of the rows given (held-out rows must be gone already)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("v")).where("v is not null and t is not null")
    languages = rows.agg(F.approx_count_distinct("v", 0.02)).first()[0]
    model = Model([])
    if not languages:
        return model
    most = min(per_language, max(LEAST, SAMPLE // languages))
    h = F.xxhash64("i", F.lit("language"))
    chosen = first_by_hash(rows.select("v", h.alias("h"), F.xxhash64("t").alias("k")), "v", ["h", "k"], F.lit(most)).distinct()  # at most ``most`` rows a language
    picked = rows.withColumn("h", h).withColumn("k", F.xxhash64("t")).join(F.broadcast(chosen), ["v", "h", "k"], "left_semi").dropDuplicates(["v", "h", "k"]).select("v", "h", "k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = counts(b.column(3)[i].as_py())
                if x is not None:
                    at = np.flatnonzero(x)
                    yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in b.columns[:3]), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([x[at].tobytes()], pa.binary())], ["v", "h", "k", "at", "x"])

    found = sorted(picked.mapInArrow(tidy(run), "v string, h long, k long, at binary, x binary").collect(), key=lambda r: (r.h, r.k, r.v))
    x = np.zeros((len(found), DIMS + 1), dtype=np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r.at, "<u2")] = np.frombuffer(r.x, np.float32)
    model.train(x, [r.v for r in found])
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred string, score double of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # weights: DIMS floats for each pair of related classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for ids, texts in ids_and_texts(batches):
            found = [own.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([v for v, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return doc_texts(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")
