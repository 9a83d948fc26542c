"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded (shares of character
classes, word lengths, repetition, hashed words), embedded, and weighted by gated attention;
the weighted sum of the embeddings gives the score. Weights are learned from document labels
only, by gradient descent on at most ``sample`` labelled documents (4,000: those with the
least hash of their doc_id) and, of a longer text among these, ``passages`` (64) passages
evenly spread over it: so the driver gets at most 50 MB. Every whole text is scored.

Defined results: a text without words (null, empty) is one empty passage; null labels are
not learned from, several labels of a document count by their mean; without both classes
among the labels every score is the labels' mean, or 0.5; repeated rows are scored each;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

PASSAGE = 64
HASHED = 32
DIM, GATE = 16, 8
SAMPLE, SAMPLE_PASSAGES = 4_000, 64
EPOCHS, RATE, DECAY = 150, 0.02, 1e-4


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.float64)
    out[list(chars)] = 1
    return out


#: Character classes whose shares of a passage's bytes are features.
CLASSES = np.stack([
    _class(bytes(range(0x61, 0x7B))), _class(bytes(range(0x41, 0x5B))), _class(bytes(range(0x30, 0x3A))),
    _class(b"#*$%&<>"), _class(b"|"), _class(b".,;:"), _class(b"!?"), _class(b"\n"), _class(bytes(range(0x80, 0x100))), _class(b"/\\@=_~^+-()[]{}\"'`"),
])
FEATURES = len(CLASSES) + 6 + HASHED


def encode(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Passages by features, and the number of each text's passages."""
    raw, bounds = wordhash.joined(texts)
    starts, ends = wordhash.words(raw)
    first = np.searchsorted(starts, bounds)
    n_words = np.diff(first)
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    out = np.zeros((int(n_pass.sum()), FEATURES), np.float32)
    head = np.concatenate([[0], np.cumsum(n_pass)])
    full = np.flatnonzero(n_words)
    out[head[:-1][n_words == 0], len(CLASSES)] = 1  # the sign of no words
    if not len(full):
        return out, n_pass
    h = wordhash.word_hashes(raw, starts, ends)
    doc = np.repeat(np.arange(len(texts)), n_words)
    passage = head[doc] + (np.arange(len(h)) - first[doc]) // PASSAGE
    own = np.flatnonzero(np.diff(np.concatenate([[-1], passage])))  # first word of each passage
    rows = passage[own]
    size = np.diff(np.append(own, len(h)))
    at = starts[own]
    stop = np.append(starts[own[1:]], len(raw))
    spans = np.minimum(stop, bounds[doc[own] + 1])
    edges = np.empty(2 * len(at), np.int64)
    edges[::2], edges[1::2] = at, np.minimum(spans, len(raw) - 1)
    n_bytes = np.maximum(1, spans - at)
    for k, c in enumerate(CLASSES):
        out[rows, k] = np.add.reduceat(c[raw], edges)[::2] / n_bytes
    k = len(CLASSES) + 1
    length = (ends - starts).astype(np.float64)
    mean = np.add.reduceat(length, own) / size
    out[rows, k] = np.log1p(mean)
    out[rows, k + 1] = np.sqrt(np.maximum(0, np.add.reduceat(length * length, own) / size - mean * mean)) / mean
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])])
    out[rows, k + 2] = np.add.reduceat(same.astype(np.float64), own) / size
    order = np.lexsort((h, passage))
    hs, ps = h[order], passage[order]
    new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ps[1:] != ps[:-1])])
    out[rows, k + 3] = np.add.reduceat(new.astype(np.float64), own) / size
    out[rows, k + 4] = size / PASSAGE
    slots = np.bincount(passage * HASHED + (h >> np.uint64(40)).astype(np.int64) % HASHED, minlength=len(out) * HASHED).reshape(-1, HASHED)
    out[:, k + 5 :] = slots / np.maximum(1, slots.sum(axis=1, keepdims=True))
    return out, n_pass


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """score = sigmoid(c . sum_k a_k h_k), h = tanh(W x), a = softmax(w . tanh(V h) * sigmoid(U h))"""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray]):
        self.mean, self.scale, self.w = mean, scale, weights

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        w = self.w
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        bag = np.repeat(np.arange(len(counts)), counts)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ w["W"] + w["b"])
        v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (v * u) @ w["w"]
        e = np.exp(e - np.maximum.reduceat(e, at)[bag])
        a = e / np.add.reduceat(e, at)[bag]
        m = np.add.reduceat(a[:, None] * h, at)
        return {"at": at, "bag": bag, "z": z, "h": h, "v": v, "u": u, "a": a, "m": m, "p": _sigmoid(m @ w["c"] + w["c0"])}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(x, counts)["p"]

    def gradient(self, f: dict, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, at what forward() gave."""
        w = self.w
        d = (f["p"] - y) / len(y)
        g = {"c": f["m"].T @ d, "c0": d.sum()}
        dm = d[:, None] * w["c"]
        da = (dm[f["bag"]] * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["at"])[f["bag"]])
        g["w"] = (f["v"] * f["u"]).T @ de
        dv = de[:, None] * w["w"] * f["u"] * (1 - f["v"] ** 2)
        du = de[:, None] * w["w"] * f["v"] * f["u"] * (1 - f["u"])
        g["V"], g["U"] = f["h"].T @ dv, f["h"].T @ du
        dh = f["a"][:, None] * dm[f["bag"]] + dv @ w["V"].T + du @ w["U"].T
        dz = dh * (1 - f["h"] ** 2)
        return g | {"W": f["z"].T @ dz, "b": dz.sum(axis=0)}

    @classmethod
    def fit(cls, x: np.ndarray, counts: np.ndarray, y: np.ndarray, seed: int = 1) -> Attention:
        rng = np.random.Generator(np.random.PCG64(seed))
        x = x.astype(np.float64)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        start = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        w = {"W": draw(x.shape[1], DIM), "b": np.zeros(DIM), "V": draw(DIM, GATE), "U": draw(DIM, GATE), "w": draw(GATE), "c": draw(DIM), "c0": np.array(start)}
        self = cls(x.mean(axis=0), x.std(axis=0) + 1e-3, w)
        m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
        for step in range(1, EPOCHS + 1):
            g = self.gradient(self.forward(x, counts), y)
            for k in w:
                own = g[k] + DECAY * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * own
                m2[k] = 0.999 * m2[k] + 0.001 * own * own
                w[k] = w[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def spread(n: int, most: int) -> np.ndarray:
    """At most ``most`` of the places 0..n-1, evenly spread."""
    return np.unique(np.arange(min(n, most)) * n // min(n, most))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passages: int = SAMPLE_PASSAGES) -> Attention | float:
    """The model, or a constant where the labels don't hold both classes. Of several texts of
    a doc_id it learns from the one of the least hash."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    known = known.select(F.col("doc_id").alias("label_id"), "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    bags = docs.select("doc_id", common.text_bytes().alias("t")).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    bags = bags.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t", "y")).alias("x")).select("id", "x.t", "x.y")

    def rows(parts: Iterator[dict]) -> Iterator[dict]:
        for p in parts:
            x, n = encode(p["t"])
            at = np.concatenate([[0], np.cumsum(n)])
            yield {"id": p["id"], "y": p["y"], "x": [x[a + spread(b - a, passages)].tobytes() for a, b in zip(at, at[1:])]}

    got = sorted(common.map_rows(bags, rows, common.schema_of(("id", docs.schema["doc_id"].dataType), "y double, x binary"), batch=500).collect(), key=lambda r: r.id)
    y = np.array([r.y >= 0.5 for r in got], float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    bags_ = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in got]
    return Attention.fit(np.concatenate(bags_), np.array([len(b) for b in bags_]), y)


def scored(docs: DataFrame, model: Attention | float, carry: list[str] | None = None) -> DataFrame:
    """doc_id, score of every row; ``carry`` names columns to keep."""
    keep = carry or []
    names = tuple(f"c{i}" for i in range(len(keep)))
    df = docs.select(F.col("doc_id").alias("id"), common.text_bytes().alias("t"), *[common.column(c).alias(n) for n, c in zip(names, keep)])

    def rows(parts: Iterator[dict]) -> Iterator[dict]:
        for p in parts:
            score = [model] * len(p["id"]) if isinstance(model, float) else model.score(*encode(p["t"])).tolist() if p["id"] else []
            yield {"id": p["id"], "score": score}

    out = common.map_rows(df, rows, common.schema_of(("id", docs.schema["doc_id"].dataType), "score double"), batch=500, keep=names)
    return out.select(F.col("id").alias("doc_id"), *[F.col(n).alias(c) for n, c in zip(names, keep)], "score")
