"""Joins of texts with vocabularies and pattern tables.

Every join is an equi-join on a token or a gram, so it scales with the hits and not with texts times words. Grams and tokens travel with
the key and a hash of the text, never with the text: what is left as a candidate is joined back to its text and confirmed there. A
vocabulary is broadcast only after a look at its size; beyond it the join is by sort and merge, in which Spark splits a token that is hot
(spark.sql.adaptive.skewJoin). Texts may share a key, and keys may be null."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from ..functions import columns as C
from ..pattern.engine import compile, escape
from ..pattern.flags import Flag

TOKEN = r"\w+"
#: Rows and bytes of a vocabulary up to which it is broadcast. The engine cannot judge this by itself: it takes the exploded texts for small.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Words that may stand in a plan as a list.
FEW_WORDS = 1000


def _with(many: DataFrame, few: DataFrame, words: DataFrame, word: str, times: int, on: str) -> DataFrame:
    """Join of many rows with those of a vocabulary (up to `times` for a word): broadcast if it is known to be small, else by sort and merge."""
    rows, size = words.select(F.length(word).alias("n")).limit(BROADCAST_ROWS // times + 1).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    small = rows * times <= BROADCAST_ROWS and 4 * size * times <= BROADCAST_BYTES
    return many.join(F.broadcast(few) if small else few.hint("merge"), on)


@arrow_udf(StringType())
def _casefold(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t.casefold() for t in texts.to_pylist()], pa.string())


def _folded(c: Column, flags: Flag | int) -> Column:
    """Full case folding, as the matcher folds: \u00df and ss are alike. Plain ASCII is lowered in the JVM."""
    if not Flag(flags) & Flag.IGNORECASE:
        return c
    return F.coalesce(_casefold(F.when(F.octet_length(c) != F.length(c), c)), F.lower(c))


def _texts(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(F.col(key).alias("_k"), F.col(text).alias("_text")).where("_text IS NOT NULL").withColumn("_h", F.xxhash64("_text"))


def _back(own: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates (_k, _h and more) with the texts that they came from."""
    found = found.withColumnRenamed("_k", "_k2").withColumnRenamed("_h", "_h2")
    return own.join(found, F.col("_h").eqNullSafe(F.col("_h2")) & F.col("_k").eqNullSafe(F.col("_k2"))).drop("_k2", "_h2")


def _tester(pattern, flags: Flag | int, kind: str):
    """A UDF over texts and words that runs the words' patterns; each is compiled once a batch."""

    @arrow_udf(kind)
    def run(texts: pa.Array, words: pa.Array) -> pa.Array:
        coded = words.dictionary_encode()
        own = [compile(pattern(w), flags) for w in coded.dictionary.to_pylist()]
        test = [p.is_match if kind == "boolean" else p.count for p in own]
        return pa.array([test[k](t) for k, t in zip(coded.indices.to_pylist(), texts.to_pylist(), strict=True)], pa.bool_() if kind == "boolean" else pa.int64())

    return run


def named_list_join(texts: DataFrame, key: str, text: str, words: DataFrame, word: str, flags: Flag | int = 0, *, token: str = TOKEN) -> DataFrame:
    """key, word, hits: every whole-word occurrence of a vocabulary, counted: the join form of \\b\\L<words>\\b, word by word.

    Words that are one token are joined with the texts' tokens. Others, such as `new york` or `e-mail`, are looked for by grams like parts
    of texts, and what is found is counted with its boundaries by the matcher."""
    vocabulary = words.select(F.col(word)).where(F.length(word) > 0).distinct()
    single = C.is_full_match(word, token)
    found = C.findall(text, token)
    few = [] if Flag(flags) & Flag.IGNORECASE else [r[0] for r in vocabulary.limit(FEW_WORDS + 1).collect()]
    if 0 < len(few) <= FEW_WORDS:  # tokens of no word are not even made rows
        found = F.filter(found, lambda t: t.isin(few))
    tokens = texts.select(F.col(key), F.explode(found).alias("_t")).withColumn("_t", _folded(F.col("_t"), flags))
    # Joined before they are counted: most tokens are in no vocabulary and go no further.
    hits = _with(tokens, vocabulary.where(single).withColumn("_t", _folded(F.col(word), flags)), words, word, 1, "_t").groupBy(key, word).agg(F.count("*").alias("hits"))
    several = vocabulary.where(~single)
    if several.isEmpty():
        return hits
    count = _tester(lambda w: rf"\b(?:{escape(w)})\b", flags, "long")
    parts = _holding(texts, key, text, several, word, flags).withColumn("hits", count(F.col("_text"), F.col(word))).where("hits > 0")
    return hits.unionByName(parts.groupBy(F.col("_k").alias(key), word).agg(F.sum("hits").alias("hits")))


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of `size` characters, in one pass: substring() would walk from the start for each."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _holding(texts: DataFrame, key: str, text: str, words: DataFrame, word: str, flags: Flag | int = 0) -> DataFrame:
    """_k, _text, word of every text that holds a word anywhere, case folded if flagged. Words are found by their first characters, as many
    as the shortest has."""
    own = _texts(texts, key, text)
    known = words.select(F.col(word)).where(F.length(word) > 0).distinct().withColumn("_w", _folded(F.col(word), flags))
    least = known.agg(F.min(F.length("_w"))).first()[0]
    if least is None:
        return own.limit(0).select("_k", "_text").withColumn(word, F.lit(""))
    heads = known.withColumn("_g", F.substring("_w", 1, least))
    low = own.select("_k", "_h", _folded(F.col("_text"), flags).alias("_low"))
    grams = low.select("_k", "_h", F.explode(_grams(F.col("_low"), least)).alias("_g"))
    found = _with(grams, heads, words, word, 1, "_g").select("_k", "_h", word, "_w").distinct()
    return _back(own, found).where(_folded(F.col("_text"), flags).contains(F.col("_w"))).select("_k", "_text", word)


def substring_join(texts: DataFrame, key: str, text: str, words: DataFrame, word: str) -> DataFrame:
    """key, word of every text that holds a word anywhere, once for each such text."""
    return _holding(texts, key, text, words, word).select(F.col("_k").alias(key), word)


def fuzzy_join(texts: DataFrame, key: str, text: str, words: DataFrame, word: str, errors: int, flags: Flag | int = 0) -> DataFrame:
    """key, word of every text with a part within `errors` errors of a word, once for each such text: the join form of
    \\L<words>{e<=errors}.

    Each word is cut into errors + 1 pieces, one of which any such part holds unchanged. Pieces are joined with the texts' grams of the
    same length, the distinct candidates are confirmed by the matcher. A word of fewer than errors + 1 characters would match everywhere and
    raises ValueError. With case ignored, pieces and grams are those of the full foldings."""
    count = errors + 1
    vocabulary = words.select(F.col(word)).where(F.col(word).isNotNull()).distinct().withColumn("_w", _folded(F.col(word), flags)).withColumn("_n", F.length("_w"))
    if not vocabulary.where(F.col("_n") < count).isEmpty():
        raise ValueError(f"a word of fewer than {count} characters is within {errors} errors of any text")
    cut = F.array(*[F.struct(F.floor(F.col("_n") * k / count).cast("int").alias("a"), F.floor(F.col("_n") * (k + 1) / count).cast("int").alias("z")) for k in range(count)])
    pieces = vocabulary.select(word, "_w", F.explode(cut).alias("_c")).select(word, F.expr("substring(_w, _c.a + 1, _c.z - _c.a)").alias("_g"))
    sizes = sorted(r[0] for r in pieces.select(F.length("_g")).distinct().collect())  # lengths of pieces, not pieces
    own = _texts(texts, key, text)
    if not sizes:
        return own.limit(0).select(F.col("_k").alias(key)).withColumn(word, F.lit(""))
    low = own.select("_k", "_h", _folded(F.col("_text"), flags).alias("_low"))
    grams = F.array_distinct(F.flatten(F.array(*[_grams(F.col("_low"), n) for n in sizes])))
    found = _with(low.select("_k", "_h", F.explode(grams).alias("_g")), pieces, words, word, count, "_g").select("_k", "_h", word).distinct()
    near = _tester(lambda w: f"(?:{escape(w)}){{e<={errors}}}", flags, "boolean")
    return _back(own, found).where(near(F.col("_text"), F.col(word))).select(F.col("_k").alias(key), word)


def pattern_join(texts: DataFrame, key: str, text: str, patterns: list[tuple[object, str]], flags: Flag | int = 0) -> DataFrame:
    """key, pattern_id, n: how often each of a table of patterns matches each text (pairs without a match left out).

    The patterns are part of the plan, so there is one pass over the texts: those that the JVM can run are counted there, the others in
    one Python call a batch each."""
    counts = [F.struct(F.lit(name).alias("pattern_id"), C.count(text, p, flags).alias("n")) for name, p in patterns]
    return texts.select(key, F.explode(F.array(*counts)).alias("_c")).where("_c.n > 0").select(key, "_c.pattern_id", "_c.n")
