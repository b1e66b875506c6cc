"""What the training-data operators share: table reading, the shared folder, vectorised word hashing."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space, in every operator of this package.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: list[str] = []


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, else the one given to setCheckpointDir().

    Only where there is no cluster, a folder of this machine takes its place if neither is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomtext-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    _MADE.append(f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clean(spark: SparkSession) -> None:
    """Remove what this process wrote to the shared folder. Results that were not written elsewhere cannot be read any more."""
    while _MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, rows: int = 1024, size: int = 8 << 20) -> None:
    """Bound what goes to Python at once: texts are long, and the session's default counts rows only."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(name, None) or ""
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def grouped(batches: Iterable[pa.RecordBatch], keys: int, at_once: int = 512) -> Iterator[list[tuple]]:
    """Lists of neighbouring rows that share the values of the first `keys` columns."""
    held: list[tuple] = []
    for b in batches:
        for at in range(0, b.num_rows, at_once):
            for row in zip(*(c.to_pylist() for c in b.slice(at, at_once).columns), strict=True):
                if held and held[0][:keys] != row[:keys]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


@contextmanager
def partitions(spark: SparkSession, rows: int, each: int = 250_000) -> Iterator[None]:
    """Shuffles of what is run inside get a partition for `each` rows, 8 at least, whatever the session has for its large tables."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(8, -(-rows // each))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread_join(many: DataFrame, few: DataFrame, key: str, rows: str, salt, share: float = 1 / 1000, merge: bool = False) -> DataFrame:
    """Left join of `many` with `few` (one row a key; its column `rows` says how many of `many` have the key), whose columns come as struct `own`.

    Keys with over `share` of all rows are few, 1 / share at most, and broadcast; their rows are dealt out by `salt` past the join of the
    others, so no task gets a hot key whole. A null key joins nothing. `few` is read three times: write it first if it is dear. `merge`:
    the others are joined by sort and merge at every size."""
    kind = few.schema[key].dataType
    most = share * (few.agg(F.sum(rows)).first()[0] or 0)
    known = few.select(key, F.col(rows).alias("_rows"), F.struct(*[c for c in few.columns if c != key]).alias("own"))
    hot = F.broadcast(known.where(F.col("_rows") > most).select(key, F.col("own").alias("_hot")))
    cold = known.where(F.col("_rows") <= most).select(F.col(key).alias("_dealt"), "own")
    dealt = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(salt).cast("string").cast(kind))
    joined = many.join(hot, key, "left").withColumn("_dealt", dealt).join(cold.hint("merge") if merge else cold, "_dealt", "left")
    return joined.withColumn("own", F.coalesce("_hot", "own")).drop("_hot", "_dealt")


def lower_ascii(col):
    """A-Z to a-z and nothing else, unlike lower()."""
    return F.translate(col, _UP, _LOW)


# --- vectorised hashing over Arrow string buffers -------------------------------------------------------------------

_TABLES: dict[str, np.ndarray] = {}
_KEY, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
#: Pieces of more bytes than this go one by one to a keyed hash of the library.
LONG = 1024
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(name: str, step: np.uint64, n: int) -> np.ndarray:
    """step to the powers 0 to n - 1, modulo 2**64."""
    have = _TABLES.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        one = np.full(size, step, np.uint64)
        one[0] = 1
        have = _TABLES[name] = np.cumprod(one, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros past the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded.data, strides=(1,))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the pieces of `data` from starts to ends.

    Eight bytes after the other go through a mixing step that is no polynomial, so no input has known partners; who needs to be certain
    compares what shares a hash (same(), distinct())."""
    size = ends - starts
    eights = _eights(data)
    out = mix(eights[starts] & _MASKS[np.minimum(size, 8)] ^ (size.astype(np.uint64) + np.uint64(1)) * _KEY)
    rest = np.flatnonzero((size > 8) & (size <= LONG))
    at = 8
    while len(rest):
        out[rest] = mix((out[rest] ^ (eights[starts[rest] + at] & _MASKS[np.minimum(size[rest] - at, 8)])) * _STEP + _KEY)
        at += 8
        rest = rest[size[rest] > at]
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=b"piece").digest(), "little")
    return out


def same(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether piece k has the same bytes as piece others[k]."""
    size = ends - starts
    eights, there = _eights(data), starts[others]
    out = size == size[others]
    at, rest = 0, np.flatnonzero(out & (others != np.arange(len(others))))
    while len(rest):
        mask = _MASKS[np.minimum(size[rest] - at, 8)]
        like = (eights[starts[rest] + at] & mask) == (eights[there[rest] + at] & mask)
        out[rest[~like]] = False
        at += 8
        rest = rest[like & (size[rest] > at)]
    return out


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of pieces, and the kind of each piece: by hash, then every piece compared with the first of its kind."""
    _, first, kind = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
    if len(starts) and not same(data, starts, ends, first[kind]).all():
        raw, known = data.tobytes(), {}
        kind = np.array([known.setdefault(raw[a:z], len(known)) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)])
        first = np.unique(kind, return_index=True)[1]
    return first, kind


def text_chunks(texts: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows first to last of a string array with their UTF-8 bytes and offsets (from 0); null is empty.

    A chunk holds at most `most` bytes, or one row, so temporaries stay bounded whatever the size of a batch."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the number of words before it (one more entry than rows)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True  # a word never runs over the end of its row
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | begins[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | begins[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets, "left")


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in order, and the words before each row."""
    if lower:
        data = LOWER[data]
    s, e, rows = word_spans(data, offsets)
    return hashes(data, s, e), rows


def planes(x: np.ndarray) -> bytes:
    """The bytes of each place together, so that what sorted differences leave empty costs nothing once compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    """Sorted unsigned 64-bit numbers from the planes of their differences."""
    steps = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)
    return np.cumsum(steps, dtype=np.uint64)
