"""Quality classifier: a generalised additive model with pairwise interactions, from cyclic boosted shallow trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashes, mix, text_chunks, word_hashes
from .rules import COMMON

#: Labelled rows that the model is fitted on at most: the bound of what comes to the driver.
TRAIN_ROWS = 20_000
FOLDS, HELD = 4, 2
THRESHOLD = 0.7
CHUNK_BYTES = 1 << 21

FEATURES = ("words", "word_length", "upper", "non_ascii", "digits", "exclaimed", "bars", "symbols", "points", "distinct", "echoed", "commonest", "common", "double_lines", "line_words")
_KINDS = 8
_KIND = np.zeros(256, np.int64)
for _k, _chars in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b"!?"), (5, b"|"), (6, b"#*$%&<>=+_~^{}[]\\/@`"), (7, b".,;:'\"()-")):
    _KIND[list(_chars)] = _k
_START = np.zeros(256, bool)
_START[:0x80] = True
_START[0xC0:] = True


def _word_hash(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return np.sort(hashes(data, np.append(0, ends[:-1]), ends))


_COMMON = _word_hash(sorted({w for ws in COMMON.values() for w in ws}))


def _per_row(keys: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row, and how often its commonest one comes."""
    most = np.zeros(rows, np.int64)
    if not len(keys):
        return most, most.copy()
    _, at, n = np.unique(mix(keys ^ mix(row.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    np.maximum.at(most, row[at], n)
    return np.bincount(row[at], minlength=rows), most


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    rows = len(offsets) - 1
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    kinds = np.bincount(owner * _KINDS + _KIND[data], minlength=rows * _KINDS).reshape(rows, _KINDS)
    chars = np.bincount(owner[_START[data]], minlength=rows)
    wide = np.bincount(owner[data >= 0xC0], minlength=rows)
    words, bounds = word_hashes(data, offsets, lower=True)
    n = np.diff(bounds)
    of = np.repeat(np.arange(rows), n)
    distinct, most = _per_row(words, of, rows)
    echo = np.zeros(len(words), bool)
    echo[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    spot = np.minimum(np.searchsorted(_COMMON, words), len(_COMMON) - 1)
    common = np.bincount(of[_COMMON[spot] == words], minlength=rows)
    # Lines: cut after each line feed and at the end of each text.
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    starts = starts[starts < len(data)]
    ends = np.minimum(np.append(starts[1:], len(data)), len(data))
    ends = ends - ((ends > starts) & (data[ends - 1] == 10)) if len(starts) else ends
    own = owner[starts] if len(starts) else np.zeros(0, np.int64)
    full = ends > starts
    lines = np.bincount(own[full], minlength=rows)
    single, _ = _per_row(hashes(data, starts[full], ends[full]), own[full], rows)
    w, c, li = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    solid = kinds[:, 1] + kinds[:, 2] + wide
    return np.stack([
        np.log1p(n), (chars - kinds[:, 0]) / w * (n > 0) + wide / w, kinds[:, 2] / np.maximum(solid, 1), wide / c, kinds[:, 3] / c, kinds[:, 4] / w, kinds[:, 5] / w,
        kinds[:, 6] / w, kinds[:, 7] / w, distinct / w, np.bincount(of[echo], minlength=rows) / w, most / w, common / w, (lines - single) / li, np.log1p(n / li),
    ], 1).astype(np.float64)


@dataclass
class Gam:
    """Lookup tables: score = sigmoid(bias + sum of main[j][bin] + sum of pair[a, b][bin a, bin b])."""

    edges: list[np.ndarray]
    bias: float = 0.0
    main: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]

    def raw(self, bins: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(bins[0]), self.bias)
        for table, b in zip(self.main, bins, strict=True):
            out += table[b]
        for (i, j), table in self.pairs.items():
            out += table[bins[i], bins[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(self.bins(x)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins; place 0 is none."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(a):
        return 0.0, 0
    gain = a * a / (b + ridge) + (g.sum() - a) ** 2 / (h.sum() - b + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    best = int(np.argmax(gain))
    return float(gain[best]), best + 1 if gain[best] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Leaf values over ordered bins of a tree of some depth."""
    _, at = _cut(g, h, ridge) if depth else (0.0, 0)
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1, ridge), _tree(g[at:], h[at:], depth - 1, ridge)])


def _tree2(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree over two features that cuts one and then, on either side, the other."""
    def grow(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        gain, at = _cut(g.sum(1), h.sum(1), ridge)
        parts = [(slice(0, at), slice(at, None)) if at else (slice(None),)][0]
        out = np.empty(g.shape)
        for p in parts:
            more, cut = _cut(g[p].sum(0), h[p].sum(0), ridge)
            gain += more
            for q in (slice(0, cut), slice(cut, None)) if cut else (slice(None),):
                out[p, q] = g[p, q].sum() / (h[p, q].sum() + ridge)
        return gain, out

    one, two = grow(g, h), grow(g.T, h.T)
    return one if one[0] >= two[0] else (two[0], two[1].T)


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, depth: int = 2, rate: float = 0.1, ridge: float = 1.0) -> Gam:
    """Features take turns: in each round every feature's table gets a small step of a shallow tree fitted to the residuals. Then the
    pairs that explain most of what is left, by one tree on each, take turns the same way. Without rows, or with one label only, the
    model is the smoothed share of label 1."""
    edges = []
    for j in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)
        edges.append(cuts)
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges])
    if not len(y) or y.min() == y.max():
        return model
    at = model.bins(x)
    z = model.raw(at)
    for _ in range(rounds):
        for j, b in enumerate(at):
            p = _sigmoid(z)
            size = len(model.main[j])
            step = rate * _tree(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size), depth, ridge)
            model.main[j] += step
            z += step[b]
    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.main[i]), len(model.main[j]))
        flat, p = at[i] * shape[1] + at[j], _sigmoid(z)
        return np.bincount(flat, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(flat, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda ij: -_tree2(*sums(*ij), ridge)[0])
    for ij in ranked[:pairs]:
        model.pairs[ij] = np.zeros((len(model.main[ij[0]]), len(model.main[ij[1]])))
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            step = rate * _tree2(*sums(i, j), ridge)[1]
            table += step
            z += step[at[i], at[j]]
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, last, data, offsets in text_chunks(b.column(2), CHUNK_BYTES):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), b.column(1).slice(first, last - first), pa.array(list(x), pa.list_(pa.float64()))], names=["_key", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Gam:
    """Fit on at most `rows` labelled documents outside the held-out fold, those of the smallest hashes of their keys.

    One row a key (of repeated keys the one with the smallest hash of its text), and the limit comes after the join, so `rows` is the
    bound of what reaches the driver, whatever is repeated, and labels without a document use up nothing of it. Texts stay out of the
    join's top-k: keys are chosen first."""
    named = labels.select(labels[key].alias("_key"), labels[label].alias("_y")).where(f"_y IS NOT NULL AND pmod(crc32(CAST(CAST(_key AS STRING) AS BINARY)), {FOLDS}) != {HELD}")
    named = named.groupBy("_key").agg(F.max("_y").alias("_y"))
    there = docs.select(docs[key].alias("_key"), F.xxhash64(docs[text]).alias("_sum"))
    chosen = there.join(named, "_key").groupBy("_key", "_y").agg(F.min("_sum").alias("_sum")).orderBy(F.xxhash64("_key"), "_key").limit(rows)
    known = docs.select(docs[key].alias("_key"), docs[text].alias("_text")).withColumn("_sum", F.xxhash64("_text")).join(F.broadcast(chosen), ["_key", "_sum"])  # at most `rows` narrow rows
    featured = known.select("_key", F.col("_y").cast("double"), "_text").mapInArrow(_featured, f"_key {known.schema['_key'].dataType.simpleString()}, y double, x array<double>")
    got = featured.groupBy("_key").agg(F.first("y").alias("y"), F.first("x").alias("x")).toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = np.asarray(got.column("y"), np.float64)
    order = np.lexsort((*x.T, y))  # the sums do not depend on the order in which rows arrive
    return fit(x[order], y[order])


def scored(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Scores come from the whole text alone: features, bins, and sums of table entries. Null and empty texts have all-zero features and the
    score of those; a row with a null key is not held out; repeated rows are scored alike; very long texts are taken whole; an empty table gives no rows. Keys may be of any type. One pass, no
    shuffle; the tables travel with the code and their size is fixed by the numbers of bins and pairs."""
    model = train(docs, labels, key=key, text=text, **options)
    held = F.coalesce(F.pmod(F.crc32(docs[key].cast("string").cast("binary")), F.lit(FOLDS)) == HELD, F.lit(False))
    rows = docs.select(docs[key].alias("doc_id"), held.alias("held_out"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in text_chunks(b.column(2), CHUNK_BYTES):
                s = model.score(features(data, offsets))
                own = [b.column(i).slice(first, last - first) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
