"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is what is known of it (log odds and an embedding, by its hash) and of its characters
(the largest log odds and the summed embeddings of its 5-byte sequences, the byte before it included).
Windows of ``SPAN`` words, one at every word, run through a forward and a backward gated
recurrent layer; attention weights pool the states into one logit. A text's score is that of its
highest window, calibrated on the training texts. Words and sequences that don't tell the labels apart
have no entry and the input 0; windows of such words alone are equal inputs and share one evaluation.

Training is multiple-instance: a text marks only that some window of it is toxic, so in each round the
windows that score highest stand for their text. It reads at most ``PER_LABEL`` texts of each label,
the first by a hash of their id (of rows with one id, the least text); whole texts are read and scored.

Defined results: null and empty texts score 0; without training rows of both labels every text scores
0; repeated rows give repeated rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard_join import blocks
from .runtime import doc_texts, first_by_hash, tidy
from .shingles import SPACES, word_hashes

SPAN, HIDDEN = 16, 8
#: Training texts of each label.
PER_LABEL = 1200
#: Entries for words, and for character sequences, at most.
ENTRIES = 16_384
E_WORD, E_CHAR = 6, 4
INPUT = 2 + E_WORD + E_CHAR
THRESHOLD = 0.7
_SLOTS = 1 << 20
#: Slices of keys that are judged one after the other in training.
SLICES = 16

#: Bytes as the network sees them: A-Z as a-z, white space as a space.
_SEEN = np.arange(256, dtype=np.uint64)
_SEEN[ord("A") : ord("Z") + 1] += np.uint64(32)
_SEEN[SPACES] = 32
#: The same for word hashes; ASCII punctuation and digits count nothing there.
_WORDS = np.random.default_rng(77).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS[:128][~np.array([chr(i).isalpha() for i in range(128)])] = 0
_WORDS[ord("A") : ord("Z") + 1] = _WORDS[ord("a") : ord("z") + 1]


class Entries:
    """Exact lookup of 64-bit keys by a slot table; -1 where a key is not known."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.slots = np.full(_SLOTS, -1, dtype=np.int32)
        slot = self._slot(keys)
        self.slots[slot] = np.arange(len(keys))
        meet = np.flatnonzero(np.bincount(slot, minlength=1)[slot] > 1) if len(keys) else np.empty(0, dtype=np.int64)
        self.slots[slot[meet]] = -2  # of these slots keys are looked up in order
        self.shared = meet[np.argsort(keys[meet], kind="stable")]

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(keys)]
        if not len(self.keys):
            return at
        met = np.flatnonzero(at == -2)
        if len(met):
            own = self.shared[np.minimum(np.searchsorted(self.keys[self.shared], keys[met]), len(self.shared) - 1)]
            at[met] = own
        at[(at >= 0) & (self.keys[at] != keys)] = -1
        return at


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word keys, bounds by text, sequence keys, word of each sequence)."""
    words, bounds = word_hashes(texts, _WORDS)
    buf = np.frombuffer(b"\n".join([b"", *texts, b"    "]), dtype=np.uint8)
    b = _SEEN[buf]
    g = b[:-4].copy()
    for k in range(1, 5):
        g = g << np.uint64(8) | b[k : len(b) - 4 + k]
    space = SPACES[buf]
    own = np.cumsum(space[:-1] & ~space[1:])  # words begun up to the byte after
    inside = ~space[1 : len(g) + 1] & ~space[2 : len(g) + 2]  # begins with a word's byte, or right before one
    return words, bounds, g[inside], own[: len(g)][inside] - 1


def in_blocks(texts: list[bytes], size: int = 64) -> Iterator[list[bytes]]:
    """Training texts a few at a time: what is made of every byte is large."""
    for k in range(0, len(texts), size):
        yield texts[k : k + size]


def keys_by_text(texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text, its distinct word and sequence keys."""
    by_word: list[np.ndarray] = []
    by_gram: list[np.ndarray] = []
    for part in in_blocks(texts):
        words, bounds, grams, owner = features(part)
        cuts = np.searchsorted(owner, bounds)
        by_word += [np.unique(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        by_gram += [np.unique(grams[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return by_word, by_gram


def telling(own: list[np.ndarray], labels: np.ndarray, least: float = 24.0) -> tuple[np.ndarray, np.ndarray]:
    """(keys, log odds) of what tells the labels apart, by the texts that have it.

    ``least`` is the log-likelihood ratio (G squared) from which on a key counts; it is far above
    what the best of a million keys without meaning reaches.
    """
    found, g2, odds = (np.concatenate(x) for x in zip(*(_tell([k[k % np.uint64(SLICES) == r] for k in own], labels) for r in range(SLICES)), strict=True))
    keep = np.flatnonzero(g2 >= least)
    keep = keep[np.argsort(-g2[keep], kind="stable")][:ENTRIES]
    keep = keep[np.argsort(found[keep])]
    return found[keep], odds[keep].astype(np.float32)


def _tell(own: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, G squared, log odds); a slice of the keys at a time, which bounds the memory."""
    flat = np.concatenate(own)
    label = np.repeat(labels, [len(k) for k in own])
    found, inverse = np.unique(flat, return_inverse=True)
    pos, every = np.bincount(inverse, weights=label), np.bincount(inverse).astype(np.float64)
    p, t = labels.sum(), float(len(labels))
    neg = every - pos
    part = lambda seen, n, k: seen * np.log(np.maximum(seen, 1e-300) * t / (n * k))
    out_pos, out_neg, absent = p - pos, (t - p) - neg, np.maximum(t - every, 1e-300)
    g2 = 2 * (part(pos, p, every) + part(neg, t - p, every) + part(out_pos, p, absent) + part(out_neg, t - p, absent))
    odds = np.clip(np.log((pos + 0.5) / (p + 1)) - np.log((neg + 0.5) / (t - p + 1)), -4, 6)
    return found, g2, odds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, and passes over windows given as word places (a place past the last is no word)."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        r = lambda *s, f=0.3: (rng.standard_normal(s) * f).astype(np.float32)
        self.p = {"out": r(2 * HIDDEN), "bias": np.full(1, -1, dtype=np.float32), "look": r(2 * HIDDEN)}
        for d in "fb":
            self.p |= {f"w{d}": r(INPUT, 3 * HIDDEN), f"u{d}": r(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, dtype=np.float32)}

    def forward(self, x: np.ndarray, keep: bool = False):
        """Logits of windows x (n, SPAN, INPUT); with ``keep`` also what the way back needs."""
        n, p, h3 = len(x), self.p, 3 * HIDDEN
        states, tape = np.empty((n, SPAN, 2 * HIDDEN), dtype=np.float32), {}
        for d, order in (("f", range(SPAN)), ("b", range(SPAN - 1, -1, -1))):
            gates = (x.reshape(-1, INPUT) @ p[f"w{d}"] + p[f"c{d}"]).reshape(n, SPAN, h3)
            u, h = p[f"u{d}"], np.zeros((n, HIDDEN), dtype=np.float32)
            at = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
            for t in order:
                rz = _sigmoid(gates[:, t, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
                reset, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                new = np.tanh(gates[:, t, 2 * HIDDEN :] + (reset * h) @ u[:, 2 * HIDDEN :])
                if keep:
                    tape[d, t] = (h, reset, z, new)
                h = new + z * (h - new)
                states[:, t, at] = h
        look = states @ p["look"]
        a = np.exp(look - look.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", a, states)
        logits = pooled @ p["out"] + p["bias"][0]
        return (logits, (x, states, a, pooled, tape)) if keep else logits

    def backward(self, dl: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of the input, for those of the logits."""
        x, states, a, pooled, tape = kept
        p, n = self.p, len(x)
        g = {"out": pooled.T @ dl, "bias": dl.sum(keepdims=True)}
        dpool = dl[:, None] * p["out"]
        da = np.einsum("nth,nh->nt", states, dpool)
        dlook = a * (da - (a * da).sum(axis=1, keepdims=True))
        g["look"] = np.einsum("nt,nth->h", dlook, states)
        ds = a[:, :, None] * dpool[:, None, :] + dlook[:, :, None] * p["look"]
        dx = np.zeros_like(x)
        for d, order in (("f", range(SPAN - 1, -1, -1)), ("b", range(SPAN))):
            at = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
            u, w = p[f"u{d}"], p[f"w{d}"]
            dgates, du, dh = np.empty((n, SPAN, 3 * HIDDEN), dtype=np.float32), np.zeros_like(u), np.zeros((n, HIDDEN), dtype=np.float32)
            for t in order:
                h, reset, z, new = tape[d, t]
                dh = dh + ds[:, t, at]
                dnew = dh * (1 - z) * (1 - new * new)
                dz = dh * (h - new) * z * (1 - z)
                drh = dnew @ u[:, 2 * HIDDEN :].T
                dreset = drh * h * reset * (1 - reset)
                drz = np.concatenate([dreset, dz], axis=1)
                du[:, 2 * HIDDEN :] += (reset * h).T @ dnew
                du[:, : 2 * HIDDEN] += h.T @ drz
                dgates[:, t] = np.concatenate([drz, dnew], axis=1)
                dh = dh * z + drh * reset + drz @ u[:, : 2 * HIDDEN].T
            flat = dgates.reshape(-1, 3 * HIDDEN)
            g |= {f"w{d}": x.reshape(-1, INPUT).T @ flat, f"u{d}": du, f"c{d}": flat.sum(axis=0)}
            dx += (flat @ w.T).reshape(x.shape)
        return g, dx


class Model:
    """Entries, embeddings, network and calibration; picklable, of bounded size."""

    def __init__(self):
        self.net: Network | None = None

    def inputs(self, texts: list[bytes]):
        """(bounds by text, places of words with an input, their rows in the parts, sequences' parts)."""
        words, bounds, grams, owner = features(texts)
        at = self.words.find(words)
        g = self.grams.find(grams)
        hit = g >= 0
        return bounds, at, g[hit], owner[hit]

    def all_inputs(self, texts: list[bytes]):
        """The same for many texts, a few at a time."""
        parts, shift = [], 0
        for part in in_blocks(texts):
            bounds, at, g, owner = self.inputs(part)
            parts.append((bounds[:-1] + shift, at, g, owner + shift))
            shift += int(bounds[-1])
        bounds, at, g, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
        return np.append(bounds, shift), at, g, owner

    def vectors(self, n: int, at: np.ndarray, g: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Inputs of n words and of one more that stands for no word."""
        x = np.zeros((n + 1, INPUT), dtype=np.float32)
        known = np.flatnonzero(at >= 0)
        x[known, 0] = self.word_odds[at[known]]
        x[known, 2 : 2 + E_WORD] = self.word_vectors[at[known]]
        if len(g):
            np.maximum.at(x[:, 1], owner, self.gram_odds[g])
            np.add.at(x[:, 2 + E_WORD :], owner, self.gram_vectors[g])
        return x

    @staticmethod
    def windows(bounds: np.ndarray, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words, text of each window) of the windows with a known input, of all that begin at a
        word and end within the text (a shorter text has one); and the texts with others."""
        sizes, n = np.diff(bounds), int(bounds[-1])
        each = np.where(sizes > 0, np.maximum(1, sizes - SPAN + 1), 0)
        text = np.repeat(np.arange(len(sizes)), each)
        start = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each) + bounds[text]
        alive = np.zeros(n, dtype=bool)
        alive[at >= 0] = True
        alive[owner] = True
        seen = np.concatenate([[0], np.cumsum(alive)])
        some = seen[np.minimum(start + SPAN, bounds[text + 1])] > seen[start]
        plain = np.unique(text[~some])
        return start[some], text[some], plain

    @staticmethod
    def places(bounds: np.ndarray, start: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Words (n, SPAN) of some windows; past the text, the place after the last of all."""
        at = start[:, None] + np.arange(SPAN)
        return np.where(at < bounds[text + 1][:, None], at, bounds[-1])

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Each text's highest logit; -inf without words."""
        bounds, at, g, owner = self.inputs(texts)
        n = int(bounds[-1])
        out = np.full(len(texts), -np.inf, dtype=np.float32)
        if not n:
            return out
        x = self.vectors(n, at, g, owner)
        start, text, plain = self.windows(bounds, at, owner)
        out[plain] = self.plain
        for k in range(0, len(start), 4096):
            np.maximum.at(out, text[k : k + 4096], self.net.forward(x[self.places(bounds, start[k : k + 4096], text[k : k + 4096])]))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.net is None:
            return np.zeros(len(texts))
        raw = self.logits(texts).astype(np.float64)
        return np.where(np.isfinite(raw), _sigmoid(self.scale * np.where(np.isfinite(raw), raw, 0) + self.shift), 0.0)


def train(texts: list[bytes], labels: list[int], rounds: int = 6, seed: int = 5) -> Model:
    model, y = Model(), np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return model
    rng = np.random.default_rng(seed)
    by_word, by_gram = keys_by_text(texts)
    keys, model.word_odds = telling(by_word, y)
    model.words = Entries(keys)
    keys, model.gram_odds = telling(by_gram, y)
    model.grams = Entries(keys)
    del by_word, by_gram
    model.word_vectors = (rng.standard_normal((len(model.word_odds), E_WORD)) * 0.1).astype(np.float32)
    model.gram_vectors = (rng.standard_normal((len(model.gram_odds), E_CHAR)) * 0.1).astype(np.float32)
    net = model.net = Network(seed)
    bounds, at, g, owner = model.all_inputs(texts)
    start, text, _ = model.windows(bounds, at, owner)
    words_of = lambda which: model.places(bounds, start[which], text[which])
    by_owner = np.argsort(owner, kind="stable")
    g, owner = g[by_owner], owner[by_owner]
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in {**net.p, "E": model.word_vectors, "C": model.gram_vectors}.items()}
    step = 0

    def adam(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        m, v = moments[name]
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        value -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    for turn in range(rounds):
        value = [np.zeros(0)]
        for k in range(0, len(start), 4096):
            x = model.vectors_of(words_of(slice(k, k + 4096)), at, g, owner)
            value.append(net.forward(x) if turn else x[:, :, :2].sum(axis=(1, 2)))
        value = np.concatenate(value)
        order = np.lexsort((-value, text))
        place = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        picked = order[np.where(y[text[order]] > 0, place < 1, place < 2)]
        extra = np.flatnonzero(y[text] == 0)
        picked = np.concatenate([picked, rng.choice(extra, min(len(extra), len(picked) // 2), replace=False)]) if len(extra) else picked
        target = y[text[picked]]
        share = len(target) / (2 * max(1, target.sum())), len(target) / (2 * max(1, (1 - target).sum()))
        for _ in range(max(2, 60 * 128 // max(1, len(picked)))):
            for part in np.array_split(rng.permutation(len(picked)), max(1, len(picked) // 128)):
                if not len(part):
                    continue
                step += 1
                at_words = words_of(picked[part])
                x = model.vectors_of(at_words, at, g, owner)
                x = np.concatenate([x, np.zeros((4, SPAN, INPUT), dtype=np.float32)])  # windows of plain words
                want = np.append(target[part], np.zeros(4))
                logits, kept = net.forward(x, keep=True)
                dl = ((_sigmoid(logits) - want) * np.where(want > 0, share[0], share[1]) / len(want)).astype(np.float32)
                grads, dx = net.backward(dl, kept)
                for name, grad in grads.items():
                    adam(name, net.p[name], grad + 1e-4 * net.p[name])
                dx = dx[:-4].reshape(-1, INPUT)
                flat = at_words.ravel()
                real = np.flatnonzero(flat < len(at))
                ge = np.zeros_like(model.word_vectors)
                known = real[at[flat[real]] >= 0]
                np.add.at(ge, at[flat[known]], dx[known, 2 : 2 + E_WORD])
                adam("E", model.word_vectors, ge)
                gc = np.zeros_like(model.gram_vectors)
                lo, hi = np.searchsorted(owner, flat, side="left"), np.searchsorted(owner, flat, side="right")
                rep = np.repeat(np.arange(len(flat)), hi - lo)
                which = np.arange(len(rep)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
                np.add.at(gc, g[which], dx[rep, 2 + E_WORD :])
                adam("C", model.gram_vectors, gc)
    model.plain = np.float32(net.forward(np.zeros((1, SPAN, INPUT), dtype=np.float32))[0])
    model.calibrate(np.concatenate([model.logits(part) for part in in_blocks(texts)]), y)
    return model


def _vectors_of(self: Model, places: np.ndarray, at: np.ndarray, g: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Inputs of the words at some places only (owner sorted)."""
    flat, back = np.unique(places, return_inverse=True)
    lo, hi = np.searchsorted(owner, flat, side="left"), np.searchsorted(owner, flat, side="right")
    sizes = hi - lo
    which = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)
    own = np.append(at, -1)[np.minimum(flat, len(at))]
    return self.vectors(len(flat), own, g[which], np.repeat(np.arange(len(flat)), sizes))[back.reshape(places.shape)]


def _calibrate(self: Model, logits: np.ndarray, y: np.ndarray) -> None:
    """A logistic line over the training texts' logits, each label with equal weight."""
    z = np.clip(np.where(np.isfinite(logits), logits, -10), -10, 10).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    a, b = 1.0, 0.0
    for _ in range(300):
        e = weight * (_sigmoid(a * z + b) - y)
        a, b = min(2.0, max(0.3, a - 0.1 * ((e * z).sum() + 0.01 * (a - 1)))), b - 0.3 * (e.sum() + 0.01 * b)
    self.scale, self.shift = float(a), float(b)


Model.vectors_of, Model.calibrate = _vectors_of, _calibrate


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> Model:
    """Train on a bounded sample of the labelled rows given (held-out rows must be gone already)."""
    rows = labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    picked = first_by_hash(rows.withColumn("h", F.xxhash64("i", F.lit("toxicity"))), "y", ["h", "i"], F.when(F.col("y") == 1, per_label).otherwise(2 * per_label)).select("i", "y")
    own = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).where("t is not null")
    found = own.join(F.broadcast(picked), "i").groupBy("i", "y").agg(F.min("t").alias("t")).collect()  # at most 3 * per_label ids
    found.sort(key=lambda r: r.i)
    return train([r.t.encode() for r in found], [r.y for r in found])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score double of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # ENTRIES entries of each kind at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for ids, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own.score(texts), pa.float64())], ["doc_id", "score"])

    return doc_texts(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose whole text scores under the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            only = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), b.column(at)], ["i", "text"])
            keep = [i for ids, texts in blocks(iter([only])) for i, s in zip(ids, own.score(texts), strict=True) if s < threshold]
            yield b.take(pa.array(keep, pa.int64()))

    return docs.mapInArrow(tidy(run), docs.schema)
