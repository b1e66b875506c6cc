"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Rows that a salt should stand for, and the least number of salts.
SALT_ROWS, SALTS = 100_000, 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def salt_of(key: Column, salts: int) -> Column:
    """A number below `salts` from the key's digest: keys in sequence, in steps or of equal remainders are spread alike."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return (F.conv(head, 16, 10).cast("long") % salts).cast("int")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Target words of each source. `sizes`: source, source_size (one row a source).

    The share of all words is dealt out by weight (the weights repeat over the sources by code point, null last); a target stops at
    `cap` times its source's size and the excess is dealt out again until none is above. That fixed point is found in closed form:
    with sources by size over weight, a prefix of them is capped, and the rest share what is left by weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1).cast("long"))
    filling = Window.orderBy((F.col("source_size") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_w").over(after)
    leveled = ranked.withColumn("_level", level).withColumn("_i", F.row_number().over(filling))
    free = F.col("_level") * F.col("_w") <= F.lit(cap) * F.col("source_size")
    # The level of the first source that stays below its cap holds for all from it on.
    leveled = leveled.withColumn("_level", F.min(F.when(free, F.struct("_i", "_level"))).over(whole)["_level"])
    target = F.least(F.col("_level") * F.col("_w"), F.lit(cap) * F.col("source_size"))
    return leveled.select("source", "source_size", F.coalesce(target, F.lit(cap) * F.col("source_size")).cast("double").alias("target"))


def copies(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 17, salts: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Rows of `docs` (columns `keep`, all by default) with _size, _source_size, _target and _copies, how often the mix takes each.

    Every document of a source expects target / size copies. Documents stand in a fixed order within their source (size class, salt,
    size, key), the prefix sum of the expectations is shifted by one random offset, and a document is emitted once for each integer
    boundary that its own stretch crosses. A prefix sum over a hot source is two-level: within buckets of one size class and salt, plus
    the sum of the buckets before, so no task sees a whole source. Salts are digests of the keys, as many as the rows need. Null texts have
    size 0; a null source is a source; null keys come first. An empty table gives an empty result. Repeated rows are separate documents
    (they share a salt). Keys may be of any ordered type; very long texts are counted whole."""
    salts = salts or max(SALTS, -(-docs.count() // SALT_ROWS))
    kept = [docs[c].alias(f"k_{c}") for c in (keep if keep is not None else docs.columns)]
    rows = docs.select(*kept, docs[source].alias("source"), docs[key].alias("_key"), size_of(docs[text]).alias("_size"))
    rows = rows.withColumn("_class", F.length(F.bin("_size")).cast("int")).withColumn("_salt", salt_of(F.col("_key"), salts))
    if keep is not None:
        rows = materialise(rows, "sizes")  # narrow: the texts are measured once
    buckets = materialise(rows.groupBy("source", "_class", "_salt").agg(F.count("*").alias("_n"), F.sum("_size").alias("_words")), "buckets")
    plan = targets(buckets.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, cap)
    ahead = Window.partitionBy("source").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    same = F.col("b.source").eqNullSafe(F.col("p.source"))
    buckets = buckets.alias("b").join(plan.alias("p"), same).select("b.source", "b._class", "b._salt", "b._before", "p.source_size", "p.target")
    inside = Window.partitionBy("source", "_class", "_salt").orderBy("_size", F.col("_key").asc_nulls_first())
    rows = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    near = F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r._class") == F.col("b._class")) & (F.col("r._salt") == F.col("b._salt"))
    joined = rows.alias("r").join(buckets.alias("b"), near)
    offset = random.Random(seed).random()
    each = F.when(F.col("b.source_size") > 0, F.col("b.target") / F.col("b.source_size")).otherwise(F.lit(0.0))
    place = F.col("b._before") + F.col("r._rank")
    crossed = F.floor((place + 1) * each + F.lit(offset)) - F.floor(place * each + F.lit(offset))
    return joined.select(*[F.col(f"r.k_{c}").alias(c) for c in (keep if keep is not None else docs.columns)], F.col("r._size").alias("_size"), F.col("b.source_size").alias("_source_size"), F.col("b.target").alias("_target"), crossed.cast("long").alias("_copies"))


def mix(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mixed documents themselves: each row of `docs`, unchanged, as often as the mix takes it."""
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), docs[text].alias("text"), docs[key].alias("key"), docs[source].alias("source"))
    taken = copies(packed.select("doc", "text", "key", "source"), text="text", key="key", source="source", **options).where("_copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("doc.*")


def report(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document."""
    out = copies(docs, key=key, keep=[key], **options)
    return out.select(F.col(key).alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"))


def oracle(seed: int = 17) -> str:
    salts = f"greatest({SALTS}, (count(*) OVER () + {SALT_ROWS - 1}) // {SALT_ROWS})"
    offset = repr(random.Random(seed).random())
    return rf"""
WITH d AS (SELECT doc_id, source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {salts} AS salt, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / sum(w) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS lev,
  row_number() OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST) AS i FROM w),
g AS (SELECT lev AS level FROM l WHERE lev * w <= 2.0::DOUBLE * source_size ORDER BY i LIMIT 1),
f AS (SELECT l.*, level FROM l LEFT JOIN g ON true),
t AS (SELECT source, source_size, coalesce(least(level * w, 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size) AS target FROM f),
r AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)), salt, size, doc_id NULLS FIRST) - 1 AS place FROM d),
j AS (SELECT r.doc_id, r.size, t.source_size, t.target, r.place, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS e FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor((place + 1) * e + {offset}::DOUBLE) - floor(place * e + {offset}::DOUBLE))::BIGINT AS copies FROM j)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c"""
