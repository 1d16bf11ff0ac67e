"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded: features of its bytes
and words, standardised, pass a learned layer. Gated attention, tanh(Vh) * sigmoid(Uh), weighs the
passages, and the weighted sum of their codes gives the document's score. Encoder, attention and
output are learned together from document labels, on the TRAIN_ROWS labelled rows with the smallest
hashes that are not held out. Labels, lang, source and doc_id are no inputs of a score.

Cases: null and empty texts are one passage of zeros and get a score. Rows that repeat get equal
scores. Null or repeated labels: null ones are left out, of several for a document the smallest
counts. Without labels of both kinds the score is the share of label 1, or 1 without any. A null
doc_id passes through. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, slices, utf8
from .words import PIECE, SPACED, _hashes, _spans

PASSAGE = 64
#: Labelled documents that the model is fitted on at most.
TRAIN_ROWS = 2500
#: Documents of more bytes are left out of the fit (not of scoring), which bounds what the driver reads.
TRAIN_BYTES = 40_000
THRESHOLD = 0.3
FOLDS = 5
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE = 40, 64, 0.01
_BIGRAMS = 32

# Classes of bytes: letters, digits, white space, sentence marks, other marks, other characters.
_KIND = np.full(256, 6, np.uint8)
_KIND[0:128] = 5
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[0x20, *range(0x09, 0x0E)]] = 3
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_KINDS = 7
WIDTH = _KINDS + 9 + _BIGRAMS


def passages(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For row ranges: the features of every passage, and the number of passages of each row."""
    raw, offsets = utf8(column)
    for lo, hi in slices(offsets, PIECE):
        part, begin = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if len(part) <= PIECE:
            yield _encoded(part, begin)
            continue
        # a long row is encoded in pieces that end after white space
        out, at = [], 0
        while at < len(part):
            end = at + PIECE
            if end < len(part):
                gap = np.flatnonzero(~SPACED[part[at:end]])
                end = at + int(gap[-1]) + 1 if len(gap) else end
            piece = part[at:end]
            out.append(_encoded(piece, np.array([0, len(piece)]))[0])
            at += len(piece)
        yield np.concatenate(out), np.array([sum(map(len, out))])


def _encoded(raw: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(begin) - 1
    if not len(raw):
        return np.zeros((n, WIDTH), np.float32), np.ones(n, np.int64)
    full = begin[1:] > begin[:-1]
    start, stop = _spans(raw, begin[:-1][full], begin[1:][full], SPACED)
    row = np.searchsorted(begin[1:], start, "right")
    words = np.bincount(row, minlength=n)
    bags = np.maximum(1, -(-words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(bags)])
    inside = np.arange(len(start)) - np.repeat(np.concatenate([[0], np.cumsum(words)[:-1]]), words)
    owner = first[row] + inside // PASSAGE
    total = int(first[-1])
    out = np.zeros((total, WIDTH), np.float32)
    if not len(start):
        return out, bags
    lead = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    tail = np.append(lead[1:], len(owner)) - 1
    used, count = owner[lead], (tail - lead + 1).astype(np.float32)
    at, end = start[lead], stop[tail]
    # bytes of a passage, with the white space between its words
    length = (end - at).astype(np.int64)
    spot = np.repeat(at - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    mine = np.repeat(np.arange(len(used)), length)
    kind = _KIND[raw[spot]]
    kinds = np.bincount(mine * _KINDS + kind, minlength=len(used) * _KINDS).reshape(-1, _KINDS)
    out[used, :_KINDS] = kinds / length[:, None]
    key = _hashes(raw, start, stop)
    same = np.append(False, (key[1:] == key[:-1]) & (owner[1:] == owner[:-1]))
    order = np.lexsort((key, owner))
    fresh = np.append(True, (key[order][1:] != key[order][:-1]) | (owner[order][1:] != owner[order][:-1]))
    distinct = np.bincount(owner[order][fresh], minlength=total)[used]
    size = (stop - start).astype(np.float32)
    last, head = _KIND[raw[stop - 1]], _KIND[raw[start]]
    mean = lambda x: np.bincount(owner, x, total)[used] / count
    average = mean(size)
    stats = [mean(same), distinct / count, average / 10, np.sqrt(np.maximum(0, mean(size**2) - average**2)) / 10, mean(last >= 5), mean((size == 1) & (head >= 5)), mean(head == 1), mean(last == 4), np.log1p(count) / 4]
    out[used, _KINDS : _KINDS + 9] = np.stack(stats, axis=1)
    pair = np.empty(len(spot), np.int64)
    code = raw[spot].astype(np.int64)
    pair[:-1], pair[-1] = (code[:-1] * 31 + code[1:] * 17) % 1021 % _BIGRAMS, 0
    out[used, _KINDS + 9 :] = np.bincount(mine * _BIGRAMS + pair, minlength=len(used) * _BIGRAMS).reshape(-1, _BIGRAMS) / length[:, None]
    return out, bags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """Encoder W, gates V and U with weights a, output o."""

    def __init__(self, width: int = WIDTH, seed: int = 5):
        rng = np.random.default_rng(seed)
        made = lambda *s: rng.normal(0, s[0] ** -0.5, s)
        self.mean, self.scale, self.flat = np.zeros(width), np.ones(width), None
        self.p = {"W": made(width, HIDDEN), "b": np.zeros(HIDDEN), "V": made(HIDDEN, GATE), "U": made(HIDDEN, GATE), "a": made(GATE), "o": made(HIDDEN), "c": np.zeros(1)}

    def _forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        p, at = self.p, np.concatenate([[0], np.cumsum(bags)[:-1]])
        bag = np.repeat(np.arange(len(bags)), bags)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, at)[bag])
        weight = e / np.add.reduceat(e, at)[bag]
        z = np.add.reduceat(weight[:, None] * h, at)
        return {"h": h, "t": t, "g": g, "w": weight, "z": z, "s": _sigmoid(z @ p["o"] + p["c"]), "bag": bag, "at": at}

    def _gradient(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self._forward(x, bags)
        d = (f["s"] - y) / len(y)
        dz = d[:, None] * p["o"]
        dh = f["w"][:, None] * dz[f["bag"]]
        dw = (f["h"] * dz[f["bag"]]).sum(axis=1)
        de = f["w"] * (dw - np.add.reduceat(f["w"] * dw, f["at"])[f["bag"]])
        dt, dg = de[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh += dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"W": x.T @ dx, "b": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "o": f["z"].T @ d, "c": np.array([d.sum()])}

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, seed: int = 5) -> Attention:
        """Adam on the logistic loss, with a little weight decay."""
        if len(set(y.tolist())) < 2:
            self.flat = float(y.mean()) if len(y) else 1.0
            return self
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x, rng, step = (x - self.mean) / self.scale, np.random.default_rng(seed), 0
        begin = np.concatenate([[0], np.cumsum(bags)])
        m, v = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
                step += 1
                rows = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in part])
                for k, g in self._gradient(x[rows], bags[part], y[part]).items():
                    g = g + 1e-4 * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        if self.flat is not None or not len(bags):
            return np.full(len(bags), self.flat if self.flat is not None else 1.0)
        return self._forward((x - self.mean) / self.scale, bags)["s"]


def held_out() :
    """Whether a document is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for x, bags in passages(batch.column("text")):
            cut = np.cumsum(bags)[:-1]
            yield pa.record_batch([batch.column("quality").slice(done, len(bags)), pa.array([v.astype("<f4").tobytes() for v in np.split(x, cut)], pa.binary())], names=["quality", "x"])
            done += len(bags)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Attention:
    """The model, from at most ``most`` labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality is not null and doc_id is not null").where(~held_out())
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # the limit is the size of the broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES)
    made = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(frugal(_features), "quality int, x binary").collect()
    made.sort(key=lambda r: (r.quality, r.x))
    x = [np.frombuffer(r.x, "<f4").reshape(-1, WIDTH) for r in made]
    bags = np.array([len(v) for v in x], np.int64)
    return Attention().fit(np.concatenate(x).astype(float) if x else np.zeros((0, WIDTH)), bags, np.array([float(r.quality > 0) for r in made]))


def scores(docs: DataFrame, labels: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text), and its ``key``, a long."""
    carried = [key] if key else []
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.score(x, bags) for x, bags in passages(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.concatenate(found) if found else [], pa.float64()), *map(batch.column, carried)], names=["doc_id", "score", *carried])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried)
    scored = rows.mapInArrow(frugal(run), ", ".join(["doc_id long, score double", *(f"{c} long" for c in carried)]))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), *carried)
