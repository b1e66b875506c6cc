"""MinHash near-deduplication with odd sketches, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded_batches, distinct, grouped, materialise, mix, spread_join, text_chunks, word_hashes, word_spans
from .graph import components

#: Words of a shingle by op8's contract; the pipeline's stage has its own width.
SHINGLE = 4
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A pair of similarity 0.8 shares none of 30 bands of 4 samples once in 7 million times.
BANDS, ROWS = 30, 4
#: Samples that are folded into a sketch, those of the bands among them, and its bits.
SAMPLES, SKETCH_BITS = 256, 2048
#: Bands by which large groups are first joined.
FIRST = 6
#: Standard errors below the bound at which a sketch still lets a pair through to the confirmation.
SLACK = 5.0
#: Sketches of one band, and texts of one candidate group, that a task holds at once, times two.
BUCKET, BLOCK = 512, 256
#: Classes of a candidate group up to which all its sketches are compared, and not only those that share a band.
WHOLE = 1 << 14
CHUNK_BYTES = 1 << 21

_K = BANDS * ROWS
_SEED = mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _MUL = (_SEED[:SAMPLES] >> np.uint64(32)).astype(np.uint32), (_SEED[SAMPLES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ODD = mix(np.arange(101, 101 + 16, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(words: np.ndarray, rows: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after the other, and where each row's begin.

    A row with fewer words than `width` has its whole sequence as its one shingle, a row without words has none."""
    n = np.diff(rows)
    total = len(words)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    at = np.arange(total)
    left = np.repeat(rows[1:], n) - at  # words from here to the end of the row
    hashes = np.zeros(total, np.uint64)
    for k in range(width):
        hashes += np.where(left > k, padded[k : k + total] * _ODD[k % len(_ODD)], np.uint64(k + 1))
    hashes = mix(hashes)
    parts, sizes = [], np.zeros(len(n), np.int64)
    for r in range(len(n)):
        if n[r]:
            own = np.unique(hashes[rows[r] : rows[r] + max(1, n[r] - width + 1)])
            sizes[r] = len(own)
            parts.append(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.append(0, np.cumsum(sizes))


def exact_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """Each row's shingles as sorted distinct numbers that are equal if and only if the shingles' words are, within one call."""
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    first, kind = distinct(data, starts, ends)
    n, kinds = np.diff(rows), len(first) + 1
    at = np.arange(len(kind))
    left = np.repeat(rows[1:], n) - at
    use = (left >= width) | (at == np.repeat(rows[:-1], n))
    at, left = at[use], left[use]
    padded = np.concatenate([kind + 1, np.zeros(width, np.int64)])
    code, below = padded[at], kinds
    for k in range(1, width):
        if below * kinds >= 1 << 62:
            some, code = np.unique(code, return_inverse=True)
            below = len(some)
        code, below = code * kinds + np.where(left > k, padded[at + k], 0), below * kinds
    cuts = np.append(0, np.cumsum(np.maximum(n - width + 1, (n > 0).astype(np.int64))))
    return [np.unique(code[a:z]) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def signatures(sets: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each non-empty set in turn: the band keys, and the odd sketch of its MinHash samples."""
    at = begins[:-1][np.diff(begins) > 0]
    bands = np.zeros((len(at), BANDS), np.uint64)
    flips = np.zeros((len(at), SKETCH_BITS), np.uint8)
    every, narrow = np.arange(len(at)), (sets >> np.uint64(32)).astype(np.uint32)
    for k in range(SAMPLES):
        least = np.minimum.reduceat((narrow ^ _XOR[k]) * _MUL[k], at).astype(np.uint64)
        if k < _K:
            bands[:, k // ROWS] += least * _SEED[(k * 7 + 3) % SAMPLES]
        flips[every, (mix(least ^ _SEED[k]) % np.uint64(SKETCH_BITS)).astype(np.int64)] ^= 1
    bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return bands, np.packbits(flips, axis=1)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the bits in which two odd sketches differ: the share of equal samples is 1 + bits / (4 k) * ln(1 - 2 d / bits)."""
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(np.maximum(1e-9, 1 - 2 * differing / SKETCH_BITS))


def most_differing(percent: int = PERCENT, slack: float = SLACK) -> int:
    """Sketch bits in which a pair at the bound may differ, with `slack` standard errors of samples and folding on top."""
    j = percent / 100
    unlike = 2 * SAMPLES * (1 - j)
    expected = SKETCH_BITS / 2 * (1 - math.exp(-2 * unlike / SKETCH_BITS))
    spread = math.sqrt(4 * SAMPLES * j * (1 - j) + expected)
    return int(expected + slack * spread)


def _sign(batches: Iterator[pa.RecordBatch], width: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, last, data, offsets in text_chunks(b.column(1), CHUNK_BYTES):
            sets, begins = shingle_sets(*word_hashes(data, offsets, lower=True), width)
            sizes = np.diff(begins)
            filled = iter(zip(*signatures(sets, begins), strict=True)) if len(sets) else iter(())
            raw = LOWER[data].tobytes()
            digests, bands, sketches = [], [], []
            for n, a, z in zip(sizes.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                k, s = next(filled) if n else (None, None)
                digests.append(hashlib.sha256(b" ".join(raw[a:z].split())).digest() if n else None)
                bands.append(None if k is None else k.tobytes())
                sketches.append(None if s is None else s.tobytes())
            own = [b.column(k).slice(first, last - first) for k in (0, 2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, bands, sketches))], names=["doc_id", "pick", "n_shingles", "digest", "bands", "sketch"])


def _band_rows(batches: Iterator[pa.RecordBatch], first: int = 0, last: int = BANDS) -> Iterator[pa.RecordBatch]:
    """A row for each of some bands (the second column) with the other columns."""
    for b in batches:
        keys = b.column(1).to_pylist()
        if keys:
            flat = np.frombuffer(b"".join(keys), np.int64).reshape(-1, BANDS)[:, first:last].ravel()
            times = pa.array(np.repeat(np.arange(len(keys)), last - first))
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([pa.array(flat), *(b.column(k).take(times) for k in range(len(names)) if k != 1)], names=["band", *(n for k, n in enumerate(names) if k != 1)])


def near_pairs(sizes: np.ndarray, sketches: list[bytes], root: np.ndarray, percent: int, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose sizes and sketches do not rule a link out, the likeliest first; of different roots only, and of different `sides` if given."""
    limit, words = most_differing(percent), np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    firsts, seconds, bits = [], [], []
    for x in range(len(sizes) - 1):
        ok = (100 * np.minimum(sizes[x + 1 :], sizes[x]) >= percent * np.maximum(sizes[x + 1 :], sizes[x])) & (root[x + 1 :] != root[x])
        if sides is not None:
            ok &= sides[x + 1 :] != sides[x]
        y = np.flatnonzero(ok) + x + 1
        differ = np.bitwise_count(words[y] ^ words[x]).sum(1, dtype=np.int64)
        y, differ = y[differ <= limit], differ[differ <= limit]
        if len(y):
            firsts.append(np.full(len(y), x, np.int32))
            seconds.append(y.astype(np.int32))
            bits.append(differ.astype(np.int16))
    if not firsts:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    order = np.argsort(np.concatenate(bits), kind="stable")
    return np.concatenate(firsts)[order], np.concatenate(seconds)[order]


def spanning(first: np.ndarray, second: np.ndarray, root: np.ndarray, linked: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (those that are `linked`, if given), in their order; pairs that are connected already are passed over."""
    root, out = root.copy(), []
    at, step = 0, 256
    while at < len(first):
        a, b = first[at : at + step], second[at : at + step]
        apart = root[a] != root[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            if root[x] != root[y] and (linked is None or linked(x, y)):
                out.append((x, y))
                root[root == root[y]] = root[x]
        at += step
        step = min(2 * step, 1 << 16)
    return out


def _pairs(found: list[tuple[int, ...]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=names)


def _likely(percent: int):
    """Bands, dealt as pairs of blocks, to a spanning forest of the pairs that the sketches let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for rows in grouped(batches, 3):
            rows.sort(key=lambda r: r[5])
            root = np.arange(len(rows))
            sides = np.array([r[4] for r in rows]) if rows[0][1] != rows[0][2] and not rows[0][3] else None
            pairs = near_pairs(np.array([r[6] for r in rows]), [r[7] for r in rows], root, percent, sides)
            found += [(rows[x][5], rows[y][5]) for x, y in spanning(*pairs, root)]
            if len(found) > 10_000:
                yield _pairs(found, ["u", "v"])
                found = []
        if found:
            yield _pairs(found, ["u", "v"])

    return run


def _doubtful(percent: int):
    """Bands, dealt as pairs of blocks, to where each node has a partner that the sketches let through but that is not known to be connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int, int, int]] = set()
        for rows in grouped(batches, 3):
            rows.sort(key=lambda r: r[5])
            sides = np.array([r[4] for r in rows]) if rows[0][1] != rows[0][2] and not rows[0][3] else None
            label, spot = np.array([r[9] for r in rows]), np.array([r[10] for r in rows])
            first, second = near_pairs(np.array([r[6] for r in rows]), [r[7] for r in rows], label, percent, sides)
            i, j = np.minimum(spot[first], spot[second]), np.maximum(spot[first], spot[second])
            for end in (first, second):
                for x, a, z in np.unique(np.stack([end, i, j], 1), axis=0).tolist():
                    found.add((rows[x][8], a, z, rows[x][5]))
            if len(found) > 10_000:
                yield _pairs(list(found), ["component", "i", "j", "node"])
                found = set()
        if found:
            yield _pairs(list(found), ["component", "i", "j", "node"])

    return run


def _confirm(percent: int, width: int = SHINGLE):
    """Candidate groups, each in neighbouring rows, to a spanning forest of their links by exact comparison of the shingle sets."""

    def solve(held: list[list[tuple]]) -> Iterator[tuple[int, int]]:
        texts = pa.array([r[6] for rows in held for r in rows], pa.large_string())
        sets = [s for _, _, data, offsets in text_chunks(texts, 1 << 62) for s in exact_sets(data, offsets, width)]
        at = 0
        for rows in held:
            own = sets[at : at + len(rows)]
            at += len(rows)

            def linked(x: int, y: int, own: list = own) -> bool:
                p, q = (own[x], own[y]) if len(own[x]) <= len(own[y]) else (own[y], own[x])
                spot = np.searchsorted(q, p)
                spot[spot == len(q)] = 0
                both = int((q[spot] == p).sum())
                return 100 * both >= percent * (len(p) + len(q) - both)

            label = np.array([r[5] for r in rows])
            pairs = near_pairs(np.array([len(s) for s in own]), [r[4] for r in rows], label, percent)
            for x, y in spanning(*pairs, label, linked):
                yield rows[x][3], rows[y][3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = []
        size = 0
        for rows in grouped(batches, 3):
            if len(rows) > 1:
                held.append(sorted(rows, key=lambda r: r[3]))
                size += sum(len(r[6]) for r in rows)
            if size > CHUNK_BYTES:
                if found := list(solve(held)):
                    yield _pairs(found, ["u", "v"])
                held, size = [], 0
        if held and (found := list(solve(held))):
            yield _pairs(found, ["u", "v"])

    return run


def _by_band(members: DataFrame, most: int, *more: str, own: Column | None = None) -> DataFrame:
    """Members of bands, each as often as it is needed for its band's pairs of blocks (i, j), with `own`, its block, in order of the pairs.

    A band of up to `most` is one block; `own` says which block a member is in, if it is not to be drawn. Pair (i, j) also compares within i and within j (`within`) if j follows i; others only across."""
    rows = members.withColumn("blocks", F.ceil(F.col("n") / most).cast("int")).withColumn("own", (F.pmod(F.xxhash64("node"), F.col("blocks")) if own is None else own).cast("int"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    follows = (j == i + 1) | ((i == 0) & (j == F.col("blocks") - 1)) | (F.col("blocks") == 1)
    rows = rows.withColumn("other", F.explode(other))
    rows = rows.select("band", i.alias("i"), j.alias("j"), follows.alias("within"), "own", "node", "size", "sketch", *more)
    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


def _groups(docs: DataFrame, key: str, text: str, percent: int, block: int, bucket: int, width: int) -> DataFrame:
    """What groups() says, and `pick`, which tells rows of one key apart by their texts."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).withColumn("pick", F.xxhash64("doc_id", "text"))
    signed = rows.mapInArrow(partial(_sign, width=width), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, pick long, n_shingles long, digest binary, bands binary, sketch binary")
    signed = materialise(signed, "signatures")
    real = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = real.groupBy("digest").agg(F.min(F.struct("doc_id", "pick", "n_shingles", "bands", "sketch")).alias("c"), F.count("*").alias("rows"))
    classes = materialise(classes.select("digest", "rows", F.monotonically_increasing_id().alias("node"), "c.doc_id", "c.pick", F.col("c.n_shingles").alias("size"), "c.bands", "c.sketch"), "classes")
    banded = classes.select("node", "bands").mapInArrow(_band_rows, "band long, node long")
    shared = materialise(banded.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("last"), F.count("*").alias("n")).where("least < last").select("band", "least", "n"), "bands")
    stars = spread_join(banded, shared, "band", "n", F.col("node")).where("own.least != node").select(F.col("own.least").alias("u"), F.col("node").alias("v"))
    coarse = materialise(components(stars, "candidates"), "candidates")
    count = materialise(coarse.groupBy("component").agg(F.count("*").alias("n")), "counts")
    placed = spread_join(coarse, count, "component", "n", F.col("node")).select("node", "component", F.ceil(F.col("own.n") / block).cast("int").alias("blocks"))
    placed = materialise(placed.withColumn("spot", F.pmod(F.xxhash64("node"), F.col("blocks"))), "placed")
    zero = F.lit(0).cast("long")
    small = placed.where("blocks = 1").select("component", zero.alias("i"), zero.alias("j"), "node", F.col("node").alias("label"))
    # The texts of all candidates are fetched once.
    need = materialise(placed.join(classes.select("node", "doc_id", "pick", "rows", "size", "bands", "sketch"), "node"), "needed")
    wanted = need.select("node", "doc_id", "pick", "rows", "sketch")
    met = spread_join(rows.where("doc_id IS NOT NULL"), wanted, "pick", "rows", F.monotonically_increasing_id(), merge=True).where("own.doc_id = doc_id")
    texts = materialise(met.groupBy(F.col("own.node").alias("node")).agg(F.first("own.sketch").alias("sketch"), F.first("text").alias("text")), "texts")

    def confirmed(where: DataFrame) -> DataFrame:
        """Links among nodes that are placed in pairs of blocks."""
        ready = where.join(texts, "node").select("component", "i", "j", "node", "sketch", "label", "text")
        return ready.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(_confirm(percent, width), "u long, v long")

    def by_band(nodes: DataFrame, first: int, last: int, *more: str) -> DataFrame:
        """Some bands of nodes that come with their bands and sketches, in order, dealt out where they are large."""
        types = {f.name: f.dataType.simpleString() for f in nodes.schema}
        own = nodes.select("node", "bands", "size", "sketch", *more)
        spread = own.mapInArrow(partial(_band_rows, first=first, last=last), f"band long, node long, size long, sketch binary{''.join(f', {m} {types[m]}' for m in more)}")
        return _by_band(spread_join(spread, shared, "band", "n", F.col("node")).where("own IS NOT NULL").withColumn("n", F.col("own.n")), bucket, *more)

    if placed.where("blocks > 1").isEmpty():
        links = confirmed(small)
    else:
        # The first bands join nearly all of a group of near copies. Where they do, the others have nothing to tell.
        large = materialise(need.where("blocks > 1").select("node", "component", "blocks", "spot", "size", "bands", "sketch"), "large")
        likely = materialise(by_band(large, 0, FIRST).mapInArrow(_likely(percent), "u long, v long").distinct(), "likely")
        ends = likely.join(large.select(F.col("node").alias("u"), "component", F.col("spot").alias("a")), "u").join(large.select(F.col("node").alias("v"), F.col("spot").alias("b")), "v")
        ends = ends.select("component", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), F.explode(F.array("u", "v")).alias("node")).distinct()
        first = materialise(confirmed(small.union(ends.withColumn("label", F.col("node")))), "links")
        label = materialise(components(first, "labels").withColumnRenamed("component", "label"), "labels")
        labelled = materialise(large.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
        apart = labelled.groupBy("component").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("rows")).where("lo < hi")
        open_ = spread_join(labelled, apart, "component", "rows", F.col("node")).where("own IS NOT NULL").drop("own")
        doubtful = lambda dealt: dealt.mapInArrow(_doubtful(percent), "component long, i long, j long, node long")
        # A group of up to WHOLE is compared whole, by pairs of blocks of which each holds two blocks of texts; a larger one band by band.
        whole = open_.where(F.col("blocks") * block <= WHOLE).withColumn("band", F.col("component")).withColumn("n", F.col("blocks"))
        doubt = doubtful(_by_band(whole, 2, "component", "label", "spot", own=F.floor(F.col("spot") / 2)))
        giant = open_.where(F.col("blocks") * block > WHOLE)
        if not giant.isEmpty():
            doubt = doubt.union(doubtful(by_band(giant, 0, BANDS, "component", "label", "spot")))
        doubt = doubt.distinct()
        doubt = materialise(doubt.join(label, "node", "left").select("component", "i", "j", "node", F.coalesce("label", "node").alias("label")), "doubtful")
        links = first if doubt.isEmpty() else first.union(confirmed(doubt))
    linked = components(links, "links")
    named = classes.select("digest", "rows", "node", "doc_id").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialise(named, "named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    reached = materialise(spread_join(named, materialise(least, "least"), "component", "n", F.col("node")).select("digest", "rows", "own.component_id"), "reached")
    full = spread_join(real.select("doc_id", "pick", "n_shingles", "digest"), reached, "digest", "rows", F.col("pick")).select("doc_id", "n_shingles", "own.component_id", "pick")
    rest = signed.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "pick")
    return full.union(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT, block: int = BLOCK, bucket: int = BUCKET, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of `docs`; shingles are of `width` words.

    Documents with equal words form one class, and the class stands for them from there on. Classes that share a band, directly or over
    others, form a candidate group. The texts of a group of up to `block` classes come together once; size and odd sketch rule out most
    pairs, the others are confirmed on the full sets, words and all, until they are known to be connected. In a larger group classes are compared by size and
    sketch within each band only, on narrow rows; a band of more than `bucket` classes is dealt out as pairs of blocks. The group is confirmed in two
    steps, in pairs of blocks: a text goes where it has a partner in a spanning forest of the pairs that FIRST bands let through; then, where it has
    one (in a band, or in the group up to WHOLE classes) that is let through and not connected to it by then. So texts travel in proportion to their number, but for
    large groups of which many pairs are near the bound and not linked: these all have to be looked at.

    A link is missed if its pair shares no band (1.4e-7 at the bound, by (1 - 0.8^4)^30) or if its sketch is off by over SLACK standard
    errors (3e-7); none is invented. Null and empty texts have no shingles and are linked with nothing; very long texts are taken whole;
    rows with a null key are linked with nothing either and stay; repeated rows are of one class; rows that share a key but not their
    words are documents of their own. An empty table gives no rows. Keys may be of any ordered type."""
    return _groups(docs, key, text, percent, block, bucket, width).select("doc_id", "n_shingles", "component_id", "kept")


def unique(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """The rows of `docs`, unchanged, without those that another document of their group stands for."""
    gone = _groups(docs, key, text, percent, BLOCK, BUCKET, width).where("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("pick").alias("_pick")).distinct()
    return docs.join(gone, (docs[key] == gone["_gone"]) & (F.xxhash64(docs[key], docs[text]) == gone["_pick"]), "left_anti")


def oracle() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({low}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS g FROM w, range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * k >= {PERCENT} * (a.n + b.n - k)),
c AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT c.d, l.y FROM c JOIN l ON c.r = l.x),
m AS (SELECT d, min(r) AS component_id FROM c GROUP BY d)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN m ON w.doc_id = m.d LEFT JOIN n ON w.doc_id = n.doc_id"""
