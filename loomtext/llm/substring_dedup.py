"""Substring deduplication: Rabin-Karp hashes of every window of words, counted in Spark, merged into maximal removal intervals."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, grouped, hashes, mix, planes, powers, text_chunks, unplanes, word_spans

WIDTH = 35
#: Bytes of text whose windows a task hashes and sorts at once.
CHUNK_BYTES = 1 << 21
#: Windows that one bucket of the hash range should hold: the bound of what a counting task holds at once.
BUCKET_WINDOWS = 1 << 20

_Q = np.uint64(0xD6E8FEB86659FD93)
_QI = np.uint64(pow(int(_Q), -1, 1 << 64))
#: Sent: the sorted hashes (kind 1) or digests (kind 2) of a chunk in one bucket; answered: a bit for each, whether another chunk has it.
_SENT = "bucket int, kind int, chunk long, high binary, low binary"
_TOLD = "chunk long, kind int, bucket int, bits binary"


def window_hashes(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of every window of `width` word hashes inside a row, and the word that each begins with."""
    at = np.arange(len(words))
    at = at[at + width <= np.repeat(rows[1:], np.diff(rows))]
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers("q", _Q, len(words)), out=prefix[1:])
    return mix((prefix[at + width] - prefix[at]) * powers("qi", _QI, len(words))[at]), at


def _batch(rows: list[tuple], fields: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    named = [f.split() for f in fields.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in named]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, named, strict=True)], names=[n for n, _ in named])


class Chunk:
    """The windows of some documents, and which of them are repeated.

    Nothing depends on the order of the documents: what is sent and answered goes by the order of the hashes."""

    def __init__(self, texts: pa.ChunkedArray, width: int, buckets: int):
        self.width, self.buckets = width, buckets
        self.data, self.offsets = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        for _, _, self.data, self.offsets in text_chunks(texts, 1 << 62):
            pass
        self.starts, self.ends, self.rows = word_spans(self.data, self.offsets)
        found, self.at = window_hashes(hashes(self.data, self.starts, self.ends), self.rows, width)
        self.sent, self.place, times = np.unique(found, return_inverse=True, return_counts=True)
        self.again = times > 1

    def cuts(self, ordered: np.ndarray) -> np.ndarray:
        """Where each bucket of sorted numbers begins, and the end."""
        edges = np.array([-(-(k << 64) // self.buckets) for k in range(self.buckets)], np.uint64)
        return np.append(np.searchsorted(ordered, edges), len(ordered))

    def send(self, chunk: int, kind: int, high: np.ndarray, low: np.ndarray | None = None) -> list[tuple]:
        cuts, out = self.cuts(high), []
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            part = high[cuts[k] : cuts[k + 1]]
            step = part.copy()
            step[1:] -= part[:-1]
            out.append((k, kind, chunk, planes(step), low[cuts[k] : cuts[k + 1]].tobytes() if low is not None else None))
        return out

    def told(self, told: pa.Table, kind: int, high: np.ndarray) -> np.ndarray:
        """The answers to what was sent, in its order."""
        cuts, out = self.cuts(high), np.zeros(len(high), bool)
        for _, what, k, bits in zip(*(c.to_pylist() for c in told.columns), strict=True):
            if what == kind:
                out[cuts[k] : cuts[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=cuts[k + 1] - cuts[k])
        return out

    def digests(self, told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows with repeated hashes: their first words, the sorted digests of their words in two halves, the place of each
        window's digest among them, and which come twice here. Windows are repeated if their digests are."""
        suspect = (self.told(told, 1, self.sent) | self.again)[self.place]
        at = self.at[suspect]
        raw, size = self.data.tobytes(), self.ends - self.starts + 1
        plain = b" ".join([w for a, z in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True) for w in raw[a:z].split()])
        begin = np.append(0, np.cumsum(size))
        digest = hashlib.blake2b
        each = b"".join([digest(plain[a:z], digest_size=16).digest() for a, z in zip(begin[at].tolist(), (begin[at + self.width] - 1).tolist(), strict=True)])
        both = np.frombuffer(each, np.uint64).reshape(-1, 2)
        order = np.lexsort((both[:, 1], both[:, 0]))
        both = both[order]
        fresh = np.ones(len(both), bool)
        fresh[1:] = (both[1:] != both[:-1]).any(1)
        place = np.empty(len(both), np.int64)
        place[order] = np.cumsum(fresh) - 1
        both = both[fresh]
        return at, both[:, 0], both[:, 1], place, np.bincount(place, minlength=len(both)) > 1


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket by bucket, tells each chunk which of its hashes or digests another chunk has too."""
    for rows in grouped(batches, 2):
        if len(rows) < 2:
            continue
        parts = [unplanes(r[3]) for r in rows]
        high = np.concatenate(parts)
        if rows[0][1] == 1:
            order = np.argsort(high)
            alike = high[order][1:] == high[order][:-1]
        else:
            low = np.concatenate([np.frombuffer(r[4], np.uint64) for r in rows])
            order = np.lexsort((low, high))
            alike = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
        marks = np.zeros(len(high), bool)
        marks[order[1:][alike]] = True
        marks[order[:-1][alike]] = True
        at, out = 0, []
        for r, p in zip(rows, parts, strict=True):
            own = marks[at : at + len(p)]
            at += len(p)
            if own.any():
                out.append((r[2], r[1], r[0], np.packbits(own).tobytes()))
        if out:
            yield from _batch(out, _TOLD).to_batches()


def intervals(starts: np.ndarray, width: int) -> np.ndarray:
    """Maximal intervals (start, end) that windows at the sorted `starts` cover; windows that touch are one interval."""
    cut = np.flatnonzero(np.diff(starts) > width)
    return np.stack([starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + width], 1)


def _number(table: pa.Table) -> int:
    return table.column("chunk")[0].as_py()


def _hashed(width: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table.column("text"), width, buckets)
        return _batch(chunk.send(_number(table), 1, chunk.sent), _SENT)

    return run


def _digested(width: int, buckets: int):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _batch([], _SENT)
        chunk = Chunk(table.column("text"), width, buckets)
        _, high, low, _, _ = chunk.digests(told)
        return _batch(chunk.send(_number(table), 2, high, low), _SENT)

    return run


def _cut(width: int, buckets: int, with_text: bool):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(table.column("text"), width, buckets)
        at, high, _, place, again = chunk.digests(told)
        at = at[(chunk.told(told, 2, high) | again)[place]]
        edge = np.searchsorted(at, chunk.rows)
        raw = chunk.data.tobytes()
        n, gone, sums, texts, cuts = [], [], [], [], []
        for d, (a, z) in enumerate(zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True)):
            words = kept = raw[a:z].split()
            pairs = []
            if edge[d] < edge[d + 1]:
                pairs = intervals(at[edge[d] : edge[d + 1]] - chunk.rows[d], width).tolist()
                kept, end = [], 0
                for s, e in pairs:
                    kept += words[end:s]
                    end = e
                kept += words[end:]
            n.append(len(words))
            gone.append(len(words) - len(kept))
            whole = b" ".join(kept)
            sums.append(hashlib.sha256(whole).hexdigest())
            if with_text:
                texts.append(whole.decode())
                cuts.append(pairs)
        out = {"doc_id": table.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sums, pa.string())}
        if with_text:
            out |= {"kept_text": pa.array(texts, pa.string()), "spans": pa.array(cuts, pa.list_(pa.list_(pa.int32())))}
        return pa.table(out)

    return run


def cleaned(docs: DataFrame, width: int = WIDTH, *, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked, kept_text (kept words joined by one blank) and spans, for each document.

    A word goes if a window of `width` words that covers it occurs anywhere else, in the same document or another; all windows are judged
    on the input. Documents are dealt into chunks of text once. A chunk sends its distinct rolling hashes by range, one row a bucket, and
    hears which of them others have; of the windows with these hashes it sends 128-bit digests of the words themselves, the same way, and
    a window is repeated if its digest is. So two windows of different words are not taken for one, whatever their rolling hashes; and a
    passage that a third of the corpus shares is one entry a chunk.

    Null and empty texts have no words and keep nothing (the hash of no bytes); texts shorter than a window keep all; very long texts are
    taken whole. Repeated rows take each other's windows: both lose every word that a window covers. A null key stays null. An empty
    table gives no rows. Keys may be of any type."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, chunks = max(1, math.ceil(total / 6 / BUCKET_WINDOWS)), max(1, math.ceil(total / CHUNK_BYTES))
    # By the row's number, not by its content: a row that is repeated is no hot chunk. All is one query, so that this exchange is made once.
    dealt = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).alias("chunk"), "doc_id", "text").groupBy("chunk")

    def told(sent: DataFrame) -> DataFrame:
        return sent.repartition("bucket", "kind").sortWithinPartitions("bucket", "kind").mapInArrow(_answer, _TOLD)

    first = told(dealt.applyInArrow(_hashed(width, buckets), _SENT))
    second = told(dealt.cogroup(first.groupBy("chunk")).applyInArrow(_digested(width, buckets), _SENT))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, spans array<array<int>>" * with_text
    return dealt.cogroup(first.union(second).groupBy("chunk")).applyInArrow(_cut(width, buckets, with_text), schema)


def oracle(width: int = WIDTH) -> str:
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + {width - 1}], ' ') AS win FROM w, range(1, len(ws) - {width - 2}) t(i)),
d AS (SELECT win FROM x GROUP BY win HAVING count(*) > 1),
r AS (SELECT DISTINCT doc_id, i + k AS p FROM x JOIN d USING (win), range(0, {width}) u(k)),
g AS (SELECT doc_id, list(p) AS ps FROM r GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(ps, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id"""
