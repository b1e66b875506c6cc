"""URL filter: a weighted vocabulary counted by Aho-Corasick, behind host and path rules."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Terms of which one hit rejects, and terms of which several different ones do.
STRICT = tuple(
    """adultfilm bestiality camgirl camgirls casino casinos cialis cracked-apk crackz cumshot escort escorts fakeid footfetish gambling-site hentai hardcore-sex incest-porn keygen keygens livesex
    malware milf milfs nudes onlinecasino payday-loan phishing porn porno pornhub pornos pornstar pornstars putlocker ransomware redtube sexcam sexcams sexshop sexvideo sexvideos spyware tramadol
    upskirt viagra warez webcamsex xhamster xnxx xvideos xxx youporn""".split()
)
SOFT = tuple(
    """adult ads affiliate baccarat bet bets betting binary-options bingo blackjack bonus bonuses cheap clickbait cracked dating deals debt discount discounts download-now forex free fuck
    gambling giveaway gossip hacks hot-girls jackpot keno loan loans lottery naked nude odds payday pharmacy pills poker popups prizes promo-code replica replicas roulette seo sexy sex slot slots spam
    sportsbook sweepstakes torrent torrents track tracker tracking wager weightloss win winner""".split()
)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DISTINCT_SOFT = 2

_WORD_BYTES = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none. A rule fits its host and all subdomains if the path starts
    with the rule's; of rules of one length the earlier wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def hits(text: str, automaton: ahocorasick.Automaton) -> tuple[int, int, int]:
    """Strict hits, soft hits and distinct soft terms; a hit has no ASCII letter or digit right before or after it."""
    strict, soft, kinds = 0, 0, set()
    for end, (term, weight) in automaton.iter(text):
        begin = end - len(term) + 1
        if (begin and text[begin - 1] in _WORD_BYTES) or (end + 1 < len(text) and text[end + 1] in _WORD_BYTES):
            continue
        if weight > 1:
            strict += 1
        else:
            soft += 1
            kinds.add(term)
    return strict, soft, len(kinds)


def build(strict: Iterable[str], soft: Iterable[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for term in soft:
        a.add_word(term, (term, 1))
    for term in strict:
        a.add_word(term, (term, 2))
    a.make_automaton()
    return a


def judge(pages: DataFrame, *, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, distinct_soft: int = DISTINCT_SOFT) -> DataFrame:
    """key, host, path, rule, verdict, strict_hits, soft_hits, soft_terms of every row.

    Terms are counted in host and path together, A-Z lower-cased. A URL is blocked by one strict hit or by `distinct_soft` different soft
    terms, unless a rule decides. Null, empty and malformed URLs have empty host and path, no hits, and are allowed; very long ones are searched whole; repeated rows are
    judged alike; an empty table gives no rows. One pass, no shuffle."""
    parts = pages.select(pages[key].alias(key), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    kind = parts.schema[key].dataType.simpleString()
    terms = (tuple(strict), tuple(soft))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build(*terms)
        low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        for b in batches:
            found = [hits((h + p).translate(low), automaton) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            cols = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[key, "host", "path", "strict_hits", "soft_hits", "soft_terms"])

    counted = parts.mapInArrow(count, f"`{key}` {kind}, host string, path string, strict_hits long, soft_hits long, soft_terms long")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when((F.col("strict_hits") > 0) | (F.col("soft_terms") >= distinct_soft), "block").otherwise("allow")
    return counted.withColumn("_r", rule).select(key, "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), method).alias("verdict"), "strict_hits", "soft_hits", "soft_terms")


def oracle() -> str:
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    any_of = lambda ts: f"regexp_matches(u, '(^|[^a-z0-9])({'|'.join(ts)})([^a-z0-9]|$)')"
    soft = " + ".join(f"{any_of([t])}::BIGINT" for t in SOFT)
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    by = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in by) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in by) + f" WHEN {any_of(STRICT)} OR soft_terms >= {DISTINCT_SOFT} THEN 'block' ELSE 'allow' END"
    return rf"""
WITH p AS (SELECT page_id, {low.format(r"regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
q AS (SELECT *, {low.format("host || path")} AS u FROM p),
s AS (SELECT *, {soft} AS soft_terms FROM q)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, soft_terms FROM s"""
