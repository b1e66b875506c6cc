"""Quality rules: distribution divergence from language references, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialise

#: Character classes that are counted once runs of a-z are gone; a-z is the first class, what is in none of them the last.
CLASSES = ("[A-Z]", "[^\\x00-\\x7F]", "[0-9]", "[.,;:'\"()-]", "[!?]", "[#*$%&|<>=+_~^{}\\[\\]\\\\/@`]", SPACE)
SIZE = len(CLASSES) + 2
#: Common words by language: fixed values.
COMMON: Mapping[str, Sequence[str]] = {
    "en": ("the", "of", "and", "to", "in", "is", "a", "that", "it", "for", "was", "with", "on", "as", "this", "be"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "nicht", "ein", "eine"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"),
}
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
#: Below these lengths a histogram says too little to reject a document; from LONG_CHARS on the tighter bound of the classes holds.
MIN_CHARS_FOR_CLASSES = 40
MIN_WORDS_FOR_COMMON = 40
LONG_CHARS = 300
#: Least distance from any language that rejects by itself: classes of short and of long texts, common words.
MAX_CLASS_DISTANCE = (0.60, 0.27)
MAX_COMMON_DISTANCE = 0.45
#: Farthest from its language's histograms that a document of the second and third reference round may be.
TRIM = ((0.25, 0.45), (0.25, 0.25))
#: Distances that reject if both are passed.
MAX_BOTH_DISTANCES = (0.17, 0.215)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, whatever the optimiser inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def repeated_words(words: Column, width: int = REPEAT_WINDOW) -> Column:
    """Words that lie in a window of `width` words found twice or more in the array.

    Windows are told apart by 64-bit hashes. Most documents end at the comparison of their windows with the distinct ones. Else the
    sorted (hash, position) pairs show the repeated windows, and their sorted positions p add up to sum(min(width, next p - p))."""
    def covered(spots: Column) -> Column:
        step = F.aggregate(spots, F.struct(F.lit(0).alias("sum"), F.lit(-width).alias("last")),
                           lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(width), p - acc["last"])).alias("sum"), p.alias("last")))
        return step["sum"]

    def marked(pairs: Column) -> Column:
        same = lambda i, j: (i >= 0) & (j < F.size(pairs)) & (F.get(pairs, i)["h"] == F.get(pairs, j)["h"])
        spots = F.filter(F.transform(pairs, lambda p, i: F.when(same(i - 1, i) | same(i, i + 1), p["p"])), lambda p: p.isNotNull())
        return bound(F.array_sort(spots), covered)

    def of(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bound(pairs, marked))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - F.lit(width)), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(bound(hashes, of)).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bound(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, f"{pattern}+", "")


def class_counts(text: Column) -> Column:
    """How many characters of each class; regexp_count would make a string of every match."""
    def of(rest: Column) -> Column:
        known = [F.length(rest) - F.length(without(rest, c)) for c in CLASSES]
        return bound(F.array(F.length(text) - F.length(rest), *known), lambda a: F.concat(a, F.array(F.length(text) - F.aggregate(a, F.lit(0), lambda x, y: x + y))))

    return bound(without(text, "[a-z]"), of)


def vocabulary(common: Mapping[str, Sequence[str]] = COMMON) -> list[str]:
    return sorted({w for ws in common.values() for w in ws})


def common_counts(words: Column, vocab: Sequence[str]) -> Column:
    """Counts of each common word in lower case, with a capital or in capitals, then of all other words."""
    forms = sorted({f for w in vocab for f in (w, w.capitalize(), w.upper())})

    def of(found: Column) -> Column:
        each = [F.size(found) - F.size(F.array_remove(found, w)) for w in vocab]
        return F.array(*each, F.size(words) - F.size(found))

    return bound(F.transform(F.filter(words, lambda w: w.isin(forms)), F.lower), of)


def normalised(counts: Column) -> Column:
    return bound(counts, lambda a: bound(F.aggregate(a, F.lit(0), lambda x, y: x + y), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n))))


def distance(p: Column, q: Sequence[float]) -> Column:
    """Jensen-Shannon distance: the root of the divergence, base 2, from 0 to 1."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, F.array(*[F.lit(float(x)) for x in q]), lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda x, y: x + y)))


def measures(text: Column, common: Mapping[str, Sequence[str]] = COMMON, base: bool = True) -> Column:
    """A struct of all that a text is measured by, its words split once."""
    body, vocab = F.coalesce(text, F.lit("")), vocabulary(common)

    def of(words: Column) -> Column:
        own = [
            F.size(words).cast("long").alias("n_words"),
            F.length(body).cast("long").alias("chars"),
            class_counts(body).alias("c"),
            common_counts(words, vocab).alias("v"),
        ]
        if base:
            own += [
                F.length(without(body, SPACE)).cast("long").alias("word_chars"),
                (F.length(body) - F.length(without(body, "[#*$%&|<>]"))).cast("long").alias("n_symbols"),
                repeated_lines(body).alias("n_dup_lines"),
                repeated_words(words).alias("n_repeat_words"),
            ]
        return F.struct(*own)

    return bound(words_of(body), of)


Reference = dict[str, tuple[list[float], list[float]]]


def references(counts: DataFrame, common: Mapping[str, Sequence[str]] = COMMON) -> Reference:
    """Mean class and common-word histograms of each known language. `counts`: lang, m, narrow and cheap to read again.

    The first means are over all documents that are long enough; two more rounds leave out what is far from its language's means so far,
    so that a minority of junk does not shape them. Sums are partial; one short row for each language of `common` at most comes back to
    the driver in a round, whatever the corpus."""
    size = len(vocabulary(common)) + 1
    rows = counts.where(F.col("lang").isin(list(common)) & (F.col("m.n_words") >= MIN_WORDS_FOR_COMMON))
    rows = rows.select("lang", normalised(F.col("m.c")).alias("c"), normalised(F.col("m.v")).alias("v"))
    means = [F.avg(F.col(k)[i]).alias(f"{k}{i}") for k, n in (("c", SIZE), ("v", size)) for i in range(n)]
    found: Reference = {}
    for bounds in (None, *TRIM):
        near = rows
        if bounds:
            far = [F.coalesce(*[F.when(F.col("lang") == name, distance(F.col(k), q[w])) for name, q in found.items()]) for w, k in enumerate("cv")] if found else None
            near = rows.where((far[0] <= bounds[0]) & (far[1] <= bounds[1])) if far else rows
        got = near.groupBy("lang").agg(*means).collect()
        found |= {r["lang"]: ([r[f"c{i}"] for i in range(SIZE)], [r[f"v{i}"] for i in range(size)]) for r in got}
    return found


def verdict(m: Column, refs: Reference, lang: Column) -> Column:
    """struct(base_failed, class_distance, common_distance, kept) of measured text. See judge()."""
    comparable = lang.isNull() | lang.isin(list(refs)) if refs else F.lit(True)

    def least(counts: Column, which: int) -> Column:
        if not refs:
            return F.lit(0.0)
        return bound(normalised(counts), lambda p: F.least(*[distance(p, r[which]) for r in refs.values()], F.lit(1.0)))

    def decide(d: Column) -> Column:
        classes, words = F.coalesce(d["classes"], F.lit(0.0)), F.coalesce(d["words"], F.lit(0.0))
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
        alone = (classes > F.when(m["chars"] >= LONG_CHARS, MAX_CLASS_DISTANCE[1]).otherwise(MAX_CLASS_DISTANCE[0])) | (words > MAX_COMMON_DISTANCE)
        both = (classes > MAX_BOTH_DISTANCES[0]) & (words > MAX_BOTH_DISTANCES[1])
        return F.struct(failed.alias("base_failed"), d["classes"].alias("class_distance"), d["words"].alias("common_distance"), (~failed & ~alone & ~both).alias("kept"))

    classes = F.when(comparable & (m["chars"] >= MIN_CHARS_FOR_CLASSES), least(m["c"], 0))
    words = F.when(comparable & (m["n_words"] >= MIN_WORDS_FOR_COMMON), least(m["v"], 1))
    return bound(F.struct(classes.alias("classes"), words.alias("words")), decide)


def judge(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", common: Mapping[str, Sequence[str]] = COMMON) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, common_distance, kept.

    A document's histograms of character classes and of common words are compared with those of each language, taken from all documents
    of the corpus; it is kept if it passes the base rules and its least distances are within the bounds. Below the length guards, and for
    a named language that there is no reference of, a distance is null and rejects nothing. Null texts count as empty and fail the base rules; with no reference (an empty table, only
    unknown languages) the distances are 0. Rows are judged alone: repeated rows each get a row. Texts are read once: their counts are
    written to the shared folder, and references and verdicts come from there."""
    counts = materialise(docs.select(docs[key].alias("doc_id"), docs[lang].alias("lang"), measures(docs[text], common).alias("m")), "rule-counts")
    refs = references(counts, common)
    out = counts.select("doc_id", "m", verdict(F.col("m"), refs, F.col("lang")).alias("r"))
    return out.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "r.base_failed", "r.class_distance", "r.common_distance", "r.kept")


def passing(docs: DataFrame, *, text: str = "text", lang: str = "lang", common: Mapping[str, Sequence[str]] = COMMON) -> DataFrame:
    """The rows of `docs`, unchanged, that judge() keeps. Texts are measured once and written beside their counts, from which references
    and verdicts come."""
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")
    counted = materialise(docs.select(whole, docs[lang].alias("lang"), measures(docs[text], common).alias("m")), "rule-counts")
    refs = references(counted.select("lang", "m"), common)
    return counted.where(verdict(F.col("m"), refs, F.col("lang"))["kept"]).select("doc.*")
