"""HTML main text by consensus host paths: pages vote on container paths, then are extracted by what their host agreed on."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .url_filter import host_of

#: Elements whose content is raw text and no text of the page; they end at their own end tag only, or with the page.
RAW = "script style iframe textarea title".split()
#: Elements whose content is no text of the page if they end in the container that they begin in; if not, only their tags are passed over.
SKIPPED = frozenset("noscript template object svg canvas select button audio video math datalist".split())
#: Elements that are never the article.
OUTSIDE = frozenset("nav footer aside form dialog menu".split())
#: Containers: elements that a path is made of.
CONTAINERS = frozenset("html body main article section div table tbody tr td center fieldset details header nav footer aside form dialog menu ul ol dl blockquote".split())
#: Elements whose begin and end end a block of text.
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address figure figcaption caption thead tfoot th hr summary hgroup legend optgroup option".split())
#: Class or id names that mark what is around an article, also with a further part behind them or one of BEFORE in front.
AROUND = frozenset(
    """ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies
    disclaimer disqus footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices alert pager pagination popup promo promos promotion recommended
    related share sharing sidebar signup social sponsor sponsored subscribe subscription tags teaser toolbar widget widgets""".split()
)
BEFORE = frozenset("site page main top bottom global primary secondary left right".split())
#: Of these, names that hold as a whole only, and names of what readers write.
WHOLE, TALK = frozenset(["hidden"]), frozenset("comment comments commentlist disqus".split())
#: Paths that a host's pages are tried with, most voted first.
PATHS = 3
#: Share of a page's text that may lie outside an elected container that is in no article or main element.
LITTLE = 0.1
#: A host with more than this share of all pages is hot; so at most 1 / HOT_SHARE hosts are.
HOT_SHARE = 1 / 1000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({'|'.join(RAW)})(?=[\s/>])[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>|<(?=[a-zA-Z/!?])[^>]*\Z|([^<]+|<)",
    re.S | re.I,
)
_MAYBE = re.compile(rf"<(?:{'|'.join(sorted(SKIPPED))})[\s/>]", re.I)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z]+")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"}


def _named(attrs: str) -> str | None:
    """The word of AROUND that a class or id has as its name or as the first part of it."""
    for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
        if name.lower() != "role":
            for value in (a or b or c).lower().split():
                if value in AROUND:
                    return value
                parts = _SPLIT.split(value)
                word = parts[1] if len(parts) > 1 and parts[0] in BEFORE else parts[0]
                if word in AROUND and word not in WHOLE:
                    return word
    return None


def _around(tag: str, attrs: str, inside: bool) -> str | None:
    """What marks an element as not the article, by itself: 'tag' (or role), 'name' or 'talk'; `inside`: it is in an article or main element."""
    if tag in OUTSIDE or (tag == "header" and not inside):
        return "name" if tag == "form" else "tag"
    if not attrs or tag in ("html", "body", "article", "main"):
        return None
    if any(name.lower() == "role" and (a or b or c).lower() in _ROLES for name, a, b, c in _ATTR.findall(attrs)):
        return "tag"
    word = _named(attrs)
    if word is None or (word == "header" and inside):
        return None
    return "talk" if word in TALK else "name"


class _Mark:
    """A container that is marked as around an article, and what it holds: articles and main elements, headings of level 1, paragraph text."""

    __slots__ = ("kind", "articles", "titles", "text")

    def __init__(self, kind: str) -> None:
        self.kind, self.articles, self.titles, self.text = kind, 0, 0, 0

    def drops(self, page: _Mark) -> bool:
        """Whether it is left out, given what the page holds."""
        if self.articles or (self.titles and self.kind != "tag"):
            return False
        return 2 * self.text <= page.text or page.articles > 0 or (self.kind == "talk" and page.titles > self.titles)


def _step(tag: str, attrs: str) -> str:
    """An element's part of a path: tag and first class, with digits generalised."""
    for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
        if name.lower() == "class" and (value := (a or b or c).lower().split()):
            return f"{tag}.{re.sub('[0-9]+', '#', value[0])}"
    return tag


def _spans(page: str) -> dict[int, int]:
    """Where skipped elements begin and, for these, end: those with an end tag in the container that they begin in, or in one inside it."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for m in _TOKEN.finditer(page):
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag in SKIPPED or tag in CONTAINERS:
            if not m[2]:
                if not m[4].endswith("/"):
                    stack.append((tag, m.start()))
            elif any(s[0] == tag for s in stack):
                while (gone := stack.pop())[0] != tag:
                    pass
                if tag in SKIPPED:
                    out[gone[1]] = m.end()
    return out


def blocks(page: str | None) -> list[tuple[tuple[tuple[str, int], ...], str, int, int]]:
    """Text blocks in page order: the containers around each (path step and number in the page), text, length in links, 1 for a paragraph and
    2 for a heading, 3 for a heading of level 1.

    Raw and skipped elements and what is around an article are left out. What is marked as such stays if it holds an article (that is not
    marked itself) or main element, a heading of level 1 (but for elements and roles that are never the article), or, where the page has no
    article or main element, most of its paragraph text (readers' comments do so only where no heading of level 1 is outside them). Tags that never end, ends that never began and a page cut in the middle
    of a tag or reference are taken as far as they go."""
    out: list = []
    stack: list[tuple[str, str, int, bool]] = []  # tag, step, number, marked
    marks: list[_Mark] = []  # of the marked containers that are open
    around: list[tuple[_Mark, ...]] = []  # of each block
    whole = _Mark("tag")
    number, inside = 0, 0
    pieces: list[str] = []
    linked, link, proper = 0, False, 0

    def end() -> None:
        nonlocal linked, proper
        if pieces:
            text = _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
            if text:
                out.append((tuple((s, n) for _, s, n, _ in stack), text, linked, proper))
                around.append(tuple(marks))
                if proper == 1:
                    for x in (whole, *marks):
                        x.text += len(text)
            pieces.clear()
        linked, proper = 0, 0

    page = page or ""
    spans = _spans(page) if _MAYBE.search(page) else {}
    past = 0  # end of the skipped element
    for m in _TOKEN.finditer(page):
        if spans:
            if m.start() < past:
                continue
            past = spans.get(m.start(), 0)
            if past:
                continue
        text = m[5]
        if text is not None:
            pieces.append(text)
            if link:
                linked += len(text)
            continue
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            link = not m[2]
        elif tag in BLOCKS:
            end()
            proper = 0 if m[2] else 1 if tag == "p" else 3 if tag == "h1" else 2 * (tag[0] == "h" and tag[1:].isdigit())
            if proper == 3 and not any(x.kind == "tag" for x in marks):
                for x in (whole, *marks):
                    x.titles += 1
            if tag in CONTAINERS:
                if not m[2]:
                    if not m[4].endswith("/"):
                        number += 1
                        kind = _around(tag, m[4], inside > 0)
                        stack.append((tag, _step(tag, m[4]), number, kind is not None))
                        if tag == "main" or (tag == "article" and not _named(m[4])):
                            for x in (whole, *marks):
                                x.articles += 1
                        if kind:
                            marks.append(_Mark(kind))
                        inside += tag in ("article", "main")
                elif any(s[0] == tag for s in stack):
                    while True:
                        gone = stack.pop()
                        if gone[3]:
                            marks.pop()
                        inside -= gone[0] in ("article", "main")
                        if gone[0] == tag:
                            break
    end()
    return [b for b, held in zip(out, around, strict=True) if not any(x.drops(whole) for x in held)]


def votes(found: list) -> dict[str, float]:
    """Score of each container path of a page: its text outside links, twice that of paragraphs, in full for the nearest container and
    half for the one around it."""
    out: dict[str, float] = {}
    for around, text, linked, proper in found:
        worth = max(0, len(text) - 2 * linked) * (2 if proper else 1)
        path = [s for s, _ in around]
        for up in range(min(2, len(path))):
            key = ">".join(path[: len(path) - up])
            out[key] = out.get(key, 0.0) + worth / (1 + up)
    return out


def climb(found: list, path: str) -> str:
    """The container that holds the whole article of which `path` is the loudest part.

    That is the outermost article or main element of the path. Where there is none, it is the nearest container around it outside which
    LITTLE of the page's text lies, then the outermost one that adds a heading of level 1, if that has none, or, below body, that has
    headings or paragraphs of its own; so no more than LITTLE is added by the second step."""
    steps = path.split(">")
    for k, step in enumerate(steps):
        if step.split(".", 1)[0] in ("article", "main"):
            return ">".join(steps[: k + 1])
    text = [0] * (len(steps) + 1)  # by the number of steps that a block shares with the path
    first = [False] * (len(steps) + 1)
    own = [False] * (len(steps) + 1)
    for around, t, linked, proper in found:
        k = 0
        while k < len(steps) and k < len(around) and around[k][0] == steps[k]:
            k += 1
        text[k] += max(0, len(t) - 2 * linked)
        first[k] |= proper == 3
        own[k] |= proper > 0 and len(around) == k
    at, inner, total = len(steps), text[-1], sum(text)
    while at > 1 and inner < (1 - LITTLE) * total:
        at -= 1
        inner += text[at]
    titled, top = any(first[at:]), at
    for k in range(at - 1, 0, -1):
        if (first[k] and not titled) or (own[k] and steps[k - 1].split(".", 1)[0] not in ("html", "body")):
            top = k
    return ">".join(steps[:top])


def best(found: list) -> tuple[str, float] | None:
    """A page's vote: the path that climb() finds from the one with the highest score, and that score."""
    ranked = sorted(votes(found).items(), key=lambda kv: (-kv[1], kv[0]))
    return (climb(found, ranked[0][0]), ranked[0][1]) if ranked and ranked[0][1] > 0 else None


def within(found: list, paths: list[str]) -> str:
    """Text of all blocks under the first of `paths` that the page has, else under its own best path, else all of them."""
    own = best(found)
    for path in [*paths, *([own[0]] if own else [])]:
        steps = path.split(">")
        n = len(steps)
        hit = [text for around, text, _, _ in found if len(around) >= n and [s for s, _ in around[:n]] == steps]
        if hit:
            return "\n".join(hit)
    return "\n".join(text for _, text, _, _ in found)


def host_votes(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """host, path, n: each page votes for its best path (null if it has no text); votes are counted with partial sums."""
    rows = pages.select(host_of(pages[url]).alias("host"), pages[html].alias("html"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [best(blocks(h.as_py())) for h in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g and g[0] for g in got], pa.string())], names=["host", "path"])

    return rows.mapInArrow(vote, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("n"))


def host_paths(votes: DataFrame, paths: int = PATHS) -> DataFrame:
    """host, pages, paths (most voted first) from host_votes(). A host's different paths are few, whatever the number of its pages."""
    own = F.filter(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))), lambda x: x["path"].isNotNull())
    ranked = votes.groupBy("host").agg(F.sum("n").alias("pages"), F.slice(own, 1, paths).alias("p"))
    return ranked.select("host", "pages", F.transform("p", lambda x: x["path"]).alias("paths"))


def extracted(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", paths: int = PATHS, hot_share: float = HOT_SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    A host's winning paths are joined to its pages. The hot hosts, of which the share of pages proves that there are few, are broadcast,
    and their pages are dealt out evenly; the others are joined by host. Null, empty and text-free pages give an empty text; pages with a
    null or malformed URL share the empty host; repeated rows are extracted alike; an empty table gives no rows. All text under the
    winning path is taken, in page order, whatever its length."""
    winners = materialise(host_paths(host_votes(pages, url=url, html=html), paths), "host-paths")
    total = winners.agg(F.sum("pages")).first()[0] or 0
    hot = winners.where(F.col("pages") > hot_share * total).select("host", F.col("paths").alias("hot_paths"))
    cold = winners.where(F.col("pages") <= hot_share * total).select(F.concat(F.lit("h"), "host").alias("dealt"), "paths")
    rows = pages.select(pages[key].alias("page_id"), pages[url].alias("url"), pages[html].alias("html"), host_of(pages[url]).alias("host"))
    rows = rows.join(F.broadcast(hot), "host", "left")  # at most 1 / hot_share rows
    even = F.concat(F.lit("r"), F.xxhash64("page_id", "url").cast("string"))
    rows = rows.withColumn("dealt", F.when(F.col("hot_paths").isNull(), F.concat(F.lit("h"), "host")).otherwise(even))
    joined = rows.join(cold, "dealt", "left").select("page_id", "url", "html", F.coalesce("hot_paths", "paths").alias("paths"))
    kind = joined.schema["page_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [within(blocks(h.as_py()), p or []) for h, p in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
