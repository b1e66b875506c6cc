"""Language-model scores by prediction by partial matching over byte contexts, beside a word-count base."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded_batches, materialise, mix, planes, text_chunks, unplanes, word_hashes

#: Bytes of context of the longest contexts.
ORDER = 5
#: Bytes that no UTF-8 text has: before the text, and after it. Only END is ever a symbol.
PAD, END = 0xFF, 0xFE
FOLDS, HELD = 7, 2
CHUNK_BYTES = 1 << 20
#: Bytes of text that are scored together against the counts that they need.
GROUP_BYTES = 8 << 20
#: Keys: a word's hash with the top bit set (negative), a gram's bytes (up to 56 bits), and for the number of training texts this.
_TOP, _DOCS = np.uint64(1 << 63), (1 << 62)
#: Keys that a bucket of the range of hashed keys should hold, keys that a task packs into one row for each bucket, and counts that a task
#: merges before it sends them.
BUCKET_KEYS, PACKED, MERGED = 100_000, 200_000, 2_000_000
#: Bytes of context, the last ones, by which grams are dealt out: bounds what a shard can hold by the alphabet.
DEEP = 3
#: What is known of a bucket's keys (kind 0), or what a group of documents asks for (kind 1).
_ASKED = "bucket int, kind int, g long, places binary, values binary"


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Context and symbol of every byte and of the end of each row, in order: `order` bytes, then the symbol in the lowest byte."""
    rows, lens = len(offsets) - 1, np.diff(offsets)
    laid = np.full(len(data) + (order + 1) * rows, PAD, np.uint8)
    row = np.repeat(np.arange(rows), lens)
    laid[np.arange(len(data)) + (order + 1) * row + order] = LOWER[data]
    ends = offsets[1:] + (order + 1) * np.arange(rows) + order
    laid[ends] = END
    out = np.zeros(len(laid), np.uint64)
    for k in range(order + 1):
        out[k:] |= laid[: len(laid) - k].astype(np.uint64) << np.uint64(8 * k)
    symbol = np.ones(len(laid), bool)
    starts = np.append(0, ends[:-1] + 1) if rows else ends
    for k in range(order):
        symbol[starts + k] = False
    return out[symbol]


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, rows = word_hashes(data, offsets, lower=True)
    return words | _TOP, rows


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting beats the hash table of np.unique here."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def _tally(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_counts=True)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Counts of the same key added up, in batches."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    keys, counts = keys[at], np.add.reduceat(counts, at)
    for k in range(0, len(keys), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)].view(np.int64)), pa.array(counts[k : k + (1 << 16)])], names=["key", "n"])


def _gather(order: int):
    """Training counts of words and grams; grams of held-out texts too, with count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            held_all = np.asarray(b.column(0), bool)
            for first, last, data, offsets in text_chunks(b.column(1), CHUNK_BYTES):
                trains = ~held_all[first:last]
                words, rows = word_keys(data, offsets)
                parts.append(_tally(words[np.repeat(trains, np.diff(rows))]))
                all_grams = grams(data, offsets, order)
                learned = np.repeat(trains, np.diff(offsets) + 1)
                parts.append(_tally(all_grams[learned]))
                if not trains.all():
                    rest = _distinct(all_grams[~learned])
                    parts.append((rest, np.zeros(len(rest), np.int64)))
                parts.append((np.array([_DOCS], np.uint64), np.array([trains.sum()], np.int64)))
                if sum(len(p[0]) for p in parts) > MERGED:
                    yield from _merged(parts)
                    parts = []
        if parts:
            yield from _merged(parts)

    return run


class Trie:
    """Counts of whole shards of contexts, for all orders from two on, over shared tables for orders one and zero.

    `low`: keys and counts of order two for these shards, where they are not the sums of what is here."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int, low: tuple[np.ndarray, np.ndarray] | None = None):
        seen = counts > 0
        self.order, self.levels = order, {}
        if low is not None:
            self.levels[2] = low
        for k in range(order, 1 if low is None else 2, -1):
            whole, back = np.unique(keys[seen] & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            self.levels[k] = (whole, np.bincount(back, counts[seen], len(whole)).astype(np.int64) if len(whole) else np.zeros(0, np.int64))
        self.pairs, self.singles = pairs, pairs.sum(0)

    def at(self, k: int, key: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols seen after the order-k context of `key`, with their counts."""
        if k >= 2:
            whole, counts = self.levels[k]
            context = (key >> 8) & ((1 << 8 * k) - 1)
            a, z = np.searchsorted(whole, np.array([context << 8, (context << 8) | 0xFF], np.uint64))
            z += z < len(whole) and int(whole[z]) == (context << 8) | 0xFF
            return (whole[a:z] & np.uint64(0xFF)).astype(np.int64), counts[a:z]
        row = self.pairs[(key >> 8) & 0xFF] if k else self.singles
        symbols = np.flatnonzero(row)
        return symbols, row[symbols]

    def log10(self, key: int) -> float:
        """Escape by method D (half a count of each distinct symbol goes to the escape), each escape excluding the symbols of the context left behind; below
        order 0 all symbols not excluded are equally likely."""
        symbol, out = key & 0xFF, 0.0
        excluded = np.zeros(256, bool)
        excluded[PAD] = True
        for k in range(min(self.order, max(self.levels, default=1)), -1, -1):
            symbols, counts = self.at(k, key)
            live = ~excluded[symbols]
            n, d = int(counts[live].sum()), int(live.sum())
            if not d:
                continue
            hit = np.flatnonzero(live & (symbols == symbol))
            if len(hit):
                return out + math.log10((2 * int(counts[hit[0]]) - 1) / (2 * n))
            out += math.log10(d / (2 * n))
            excluded[symbols] = True
        return out - math.log10(max(1, 256 - int(excluded.sum())))

    def all(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each key: at once where the longest context knows the symbol, one by one where it escapes."""
        context = keys >> np.uint64(8)
        which, back = np.unique(context, return_inverse=True)
        total = np.bincount(back, counts, len(which))
        kinds = np.bincount(back, counts > 0, len(which))
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.log10((2 * counts - 1) / (2 * total)[back])
        for i in np.flatnonzero(counts == 0):
            out[i] = self.log10(int(keys[i]))
        return out


def _price(pairs: np.ndarray, order: int, buckets: int):
    """Whole shards of grams (kind 1), after what their contexts of two bytes are followed by (kind 0), to log10 probabilities.

    Shards are solved some at a time; a context is never in two of them."""

    def solve(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        kind, keys, counts = (np.concatenate(x) for x in zip(*rows, strict=True))
        low = None
        if order >= DEEP:
            two, at = np.unique(keys[kind == 0], return_index=True)
            low = two, counts[kind == 0][at]
        keys, counts = keys[kind == 1], counts[kind == 1]
        return _pack(keys, Trie(keys, counts, pairs, order, low).all(keys, counts), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None
        for b in batches:
            shard, kind = np.asarray(b.column(0), np.int64), np.asarray(b.column(1), np.int64)
            keys, counts = np.asarray(b.column(2), np.int64).view(np.uint64), np.asarray(b.column(3), np.int64)
            at = 0
            while at < len(shard):
                if size >= PACKED and shard[at] != now:
                    yield solve(held)
                    held, size = [], 0
                # Once enough is held, only the rest of the shard that is open.
                end = len(shard) if size < PACKED else int(np.searchsorted(shard, now, "right"))
                if size < PACKED and size + end - at >= PACKED:
                    end = int(np.searchsorted(shard, shard[at + PACKED - size - 1], "right"))
                held.append((kind[at:end], keys[at:end], counts[at:end]))
                size, now, at = size + end - at, shard[end - 1], end
        if held:
            yield solve(held)

    return run


def _word_values(buckets: int):
    """Words' training counts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            done.append((np.asarray(b.column(0), np.int64).view(np.uint64), np.asarray(b.column(1), np.float64)))
            if sum(len(d[0]) for d in done) >= PACKED:
                yield _pack(*(np.concatenate(x) for x in zip(*done, strict=True)), buckets)
                done = []
        if done:
            yield _pack(*(np.concatenate(x) for x in zip(*done, strict=True)), buckets)

    return run


def _cuts(places: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of sorted places begins, and the end."""
    edges = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)
    return np.append(np.searchsorted(places, edges), len(places))


def _pack(keys: np.ndarray, values: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Values by bucket: rows of _ASKED with the sorted places of keys and their values."""
    places = mix(keys)
    order = np.argsort(places)
    places, values = places[order], values[order].astype("<f8")
    cuts = _cuts(places, buckets)
    own = np.flatnonzero(np.diff(cuts))
    return _batch([(int(k), 0, 0, places[cuts[k] : cuts[k + 1]].tobytes(), values[cuts[k] : cuts[k + 1]].tobytes()) for k in own])


def _coded(values: np.ndarray) -> bytes:
    """Numbers as their distinct values and a place in these for each: few are different."""
    some, code = np.unique(values, return_inverse=True)
    wide = "<u2" if len(some) <= 1 << 16 else "<u4"
    return len(some).to_bytes(4, "little") + some.astype("<f8").tobytes() + code.astype(wide).tobytes()


def _decoded(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    return np.frombuffer(b, "<f8", n, 4)[np.frombuffer(b, "<u2" if n <= 1 << 16 else "<u4", -1, 4 + 8 * n)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["bucket", "kind", "g", "places", "values"])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket by bucket: first what is known (kind 0), then what each group asks for, answered in its order, 0 for what is not known."""
    now, parts, known = None, [], None
    for b in batches:
        out = []
        for bucket, kind, g, places, values in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if bucket != now:
                now, parts, known = bucket, [], None
            if kind == 0:
                parts.append((np.frombuffer(places, np.uint64), np.frombuffer(values, "<f8")))
                continue
            if known is None:
                at = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
                order = np.argsort(at)
                known = at[order], np.concatenate([p[1] for p in parts])[order] if parts else np.zeros(0)
                parts = []
            asked = unplanes(places)
            reply = np.zeros(len(asked))
            if len(known[0]):
                spot = np.minimum(np.searchsorted(known[0], asked), len(known[0]) - 1)
                hit = known[0][spot] == asked
                reply[hit] = known[1][spot[hit]]
            out.append((g, bucket, _coded(reply)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["g", "bucket", "values"])


class Lookup:
    """Values at sorted places: a table of guesses, and a binary search for what shares a slot."""

    def __init__(self, places: np.ndarray, values: np.ndarray):
        self.places, self.values = places, values
        bits = max(8, int(len(places)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)  # places are spread evenly already
        self.guess = np.zeros(1 << bits, np.int32)
        self.guess[places >> self.shift] = np.arange(len(places))

    def __call__(self, places: np.ndarray) -> np.ndarray:
        """All places asked for must be there."""
        at = self.guess[places >> self.shift]
        wrong = np.flatnonzero(self.places[at] != places)
        if len(wrong):
            at[wrong] = np.searchsorted(self.places, places[wrong])
        return self.values[at]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each row's values; rows may be empty."""
    total = np.append(values, 0.0)
    out = np.add.reduceat(total, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
    out[np.diff(bounds) == 0] = 0.0
    return out


def _places(texts: pa.ChunkedArray, order: int) -> np.ndarray:
    """Sorted distinct places of all words and grams of a group's texts."""
    own = []
    for _, _, data, offsets in text_chunks(texts, CHUNK_BYTES):
        own += [_distinct(word_keys(data, offsets)[0]), _distinct(grams(data, offsets, order))]
    return np.sort(mix(_distinct(np.concatenate(own))))


def _ask(order: int, buckets: int):
    """A group's places by bucket, as rows of _ASKED."""

    def run(table: pa.Table) -> pa.Table:
        g, places = table.column("g")[0].as_py(), _places(table.column("text"), order)
        cuts = _cuts(places, buckets)
        rows = []
        for k in np.flatnonzero(np.diff(cuts)):
            own = places[cuts[k] : cuts[k + 1]]
            step = own.copy()
            step[1:] -= own[:-1]
            rows.append((int(k), 1, g, planes(step), None))
        return pa.Table.from_batches([_batch(rows)])

    return run


def _score(order: int, n: int, v: int, train_docs: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        places = _places(docs.column("text"), order)
        replies = sorted(zip(answers.column("bucket").to_pylist(), answers.column("values").to_pylist(), strict=True))
        known_at = Lookup(places, np.concatenate([np.zeros(0), *(_decoded(r[1]) for r in replies)]))
        tokens, known, base, score = [], [], [], []
        bottom = math.log10(n + v + 1)
        for _, _, data, offsets in text_chunks(docs.column("text"), CHUNK_BYTES):
            words, rows = word_keys(data, offsets)
            counts = known_at(mix(words))
            size = np.diff(rows) + 1
            tokens.append(size)
            known.append(_sums((counts > 0).astype(np.float64), rows).astype(np.int64) + (train_docs > 0))
            base.append(_sums(np.log10(counts + 1), rows) + math.log10(train_docs + 1) - size * bottom)
            score.append(_sums(known_at(mix(grams(data, offsets, order))), offsets + np.arange(len(offsets))))
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0)
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": join(tokens), "n_known": join(known), "train_tokens": np.full(docs.num_rows, n, np.int64), "base_score": join(base), "score": join(score)})

    return run


def scored(docs: DataFrame, *, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    The model is a trie of byte contexts up to `order` bytes, learned from the whole training texts (crc32 of the key as text, modulo 7,
    is not 2), A-Z lower-cased; `score` is the log10 probability of all bytes of the text and of its end. The counts of the longest
    contexts are summed over the corpus and hold those of the shorter ones. They are never gathered in one place: grams whose contexts end
    in the same DEEP bytes form a shard, bounded by the alphabet (256^3 grams at five bytes), and come together with what the last two of these
    bytes are followed by; only the table of byte pairs, of 256 x 256 at most, goes to the driver. Documents are scored in groups of about
    GROUP_BYTES, dealt by row numbers: a group asks each bucket of the hashed keys for what it needs of it, in one row, and gets the values back
    in that order; a frequent word is one entry a group. The buckets grow in number with the distinct keys. Words are told apart by 63-bit hashes.
    Null texts count as empty: one token, the end; very long texts are taken whole. A row with a null key is a training text. Repeated rows are
    scored alike. An empty table gives no rows. Keys may be of any type."""
    bounded_batches(docs.sparkSession)
    held = F.coalesce(F.pmod(F.crc32(docs[key].cast("string").cast("binary")), F.lit(FOLDS)) == HELD, F.lit(False))
    rows = docs.select(docs[key].alias("doc_id"), held.alias("held_out"), docs[text].alias("text"))
    sent = rows.select("held_out", "text").mapInArrow(_gather(order), "key long, n long")
    counted = materialise(sent.groupBy("key").agg(F.sum("n").alias("n")), "ppm-counts")
    is_word, is_docs = F.col("key") < 0, F.col("key") == _DOCS
    facts = counted.agg(F.sum(F.when(is_word | is_docs, F.col("n"))), F.sum(is_word.cast("long")), F.sum(F.when(is_docs, F.col("n"))), F.count("*")).first()
    train_docs = facts[2] or 0
    n, v = facts[0] or 0, (facts[1] or 0) + (train_docs > 0)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    all_grams = counted.where(~is_word & ~is_docs)
    low = all_grams.where("n > 0").groupBy(F.col("key").bitwiseAND(0xFFFFFF).alias("key")).agg(F.sum("n").alias("n"))
    if order >= DEEP:
        low = materialise(low, "ppm-low")
    pairs = np.zeros((256, 256), np.int64)
    for r in low.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).collect():  # 256 * 256 at most
        pairs[r["pair"] >> 8, r["pair"] & 0xFF] = r["n"]
    groups = max(1, math.ceil(size / GROUP_BYTES))
    buckets = max(16, math.ceil(facts[3] / BUCKET_KEYS))
    of = lambda k: F.shiftright("key", 8).bitwiseAND((1 << 8 * k) - 1)
    sharded = all_grams.select(of(min(order, DEEP)).alias("shard"), F.lit(1).alias("kind"), "key", "n")
    if order >= DEEP:
        # Each shard gets what its context of two bytes is followed by: 256 rows at most.
        shards = sharded.select("shard", F.col("shard").bitwiseAND(0xFFFF).alias("two")).distinct()
        sharded = sharded.union(shards.join(low.select(of(2).alias("two"), "key", "n"), "two").select("shard", F.lit(0).alias("kind"), "key", "n"))
    priced = sharded.repartition("shard").sortWithinPartitions("shard").mapInArrow(_price(pairs, order, buckets), _ASKED)
    known = priced.union(counted.where(is_word).mapInArrow(_word_values(buckets), _ASKED))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))).groupBy("g")
    asked = dealt.applyInArrow(_ask(order, buckets), _ASKED)
    answers = known.union(asked).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answer, "g long, bucket int, values binary")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.cogroup(answers.groupBy("g")).applyInArrow(_score(order, n, v, train_docs), schema)
