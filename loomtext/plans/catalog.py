"""Registered queries over the standard tables, one or more for each operator, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fz
from ..operators import explode_matches, explode_splits, fuzzy_join, named_list_join, next_match, pattern_join, substring_join
from ..pattern.engine import compile
from ..pattern.errors import MatchTimeout, PatternError
from ..pattern.flags import Flag
from ..sources import dealt_out, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Tables with the key and the text column that the one-column queries read.
_TEXTS = {
    "part": ("p_partkey", "p_name"), "customer": ("c_custkey", "c_name"), "orders": ("o_orderkey", "o_orderpriority"), "events": ("event_id", "props"), "pages": ("page_id", "url"),
    "documents": ("doc_id", "text"), "supplier": ("s_suppkey", "s_name"), "nation": ("n_nationkey", "n_name"),
}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    assert name not in _QUERIES, name
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def _column(name: str, source: str, make: Callable[[Column], Column], sql: str | None = None, *, dealt: bool = False) -> None:
    """key, x: one expression over the text column of a table, `dealt` out over tasks first; in `sql` it is called t."""
    key, text = _TEXTS[source]
    own = dealt_out if dealt else lambda df: df
    _add(name, lambda spark, d: own(table(spark, d, source).select(key, text)).select(key, make(F.col(text)).alias("x")), None if sql is None else f"SELECT {key}, {sql.replace('{t}', text)} AS x FROM {source}")


def _near(t: str, word: str, k: int) -> str:
    """SQL: some part of t is within k edits of a word."""
    m = len(word)
    return f"coalesce((SELECT bool_or(levenshtein(substr({t}, i::INT, n::INT), '{word}') <= {k}) FROM range(1, length({t}) + 2) r(i), range({max(0, m - k)}, {m + k + 1}) u(n)), false)"


def _joined(c: Column) -> Column:
    return F.array_join(c, "|", "~")


# --- matching, scanning, rewriting ----------------------------------------------------------------------------------

_column("a01_is_match_literal", "documents", lambda t: fz.is_match(t, "tion"), "contains({t}, 'tion')")
_column("a01_is_match_regex", "pages", lambda t: fz.is_match(t, r"https?://\w+\.example\.(?:com|org)/"), r"regexp_matches({t}, 'https?://[0-9A-Za-z_]+\.example\.(?:com|org)/')")
_column("a01_is_match_slice", "part", lambda t: fz.is_match(t, "o", beginning=2, length=3), "contains(substr({t}, 3, 3), 'o')")
_column("a02_is_match_at_start", "orders", lambda t: fz.is_match_at_start(t, r"[1-3]-"), "regexp_matches({t}, '^[1-3]-')")
_column("a03_is_full_match", "orders", lambda t: fz.is_full_match(t, r"\d-[A-Z]+"), "regexp_full_match({t}, '[0-9]-[A-Z]+')")
_add(
    "a04_search",
    lambda s, d: table(s, d, "customer").withColumn("m", fz.search("c_name", r"[1-9]\d*")).select("c_custkey", F.col("m.index").alias("index"), F.col("m.length").alias("length"), F.col("m.value").alias("value")),
    "SELECT c_custkey, strpos(c_name, v)::INT - 1 AS index, length(v)::INT AS length, v AS value FROM (SELECT *, nullif(regexp_extract(c_name, '[1-9][0-9]*'), '') AS v FROM customer)",
)
_column("a05_match_at_start", "part", lambda t: fz.match_at_start(t, r"(\w+) ")["value"], "nullif(regexp_extract({t}, '^[a-z]+ '), '')")
_column("a06_full_match", "part", lambda t: fz.full_match(t, r"(\w+) (\w+t)")["groups"][2]["value"], "CASE WHEN regexp_full_match({t}, '[a-z]+ [a-z]+t') THEN regexp_extract({t}, ' (.*)', 1) END")
_column("a07_matches", "part", lambda t: _joined(F.transform(fz.matches(t, "[aeiou]"), lambda m: m["value"])), "array_to_string(regexp_extract_all({t}, '[aeiou]'), '|')")
_column("a07_matches_overlapped", "part", lambda t: F.size(fz.matches(t, "[a-z]{3}", overlapped=True)), "(SELECT count(*) FROM range(1, length({t})) r(i) WHERE regexp_matches(substr({t}, i::INT, 3), '^[a-z]{3}'))::INT")
_add(
    "a08_enumerate_matches",
    lambda s, d: explode_matches(table(s, d, "pages").select("page_id", "url"), "url", r"[a-z]+").select("page_id", "ordinal", F.col("match.value").alias("value")),
    "SELECT page_id, (o - 1)::INT AS ordinal, v AS value FROM (SELECT page_id, unnest(m) AS v, generate_subscripts(m, 1) AS o FROM (SELECT page_id, regexp_extract_all(url, '[a-z]+') AS m FROM pages))",
)
_column("a09_spans", "part", lambda t: _joined(F.transform(fz.spans(t, "[lgr]"), lambda m: m["index"].cast("string"))),
        "coalesce((SELECT string_agg((i - 1)::VARCHAR, '|' ORDER BY i) FROM range(1, length({t}) + 1) r(i) WHERE substr({t}, i::INT, 1) IN ('l', 'g', 'r')), '')")
_column("a10_count", "documents", lambda t: fz.count(t, r"[A-Z][a-z]+"), "len(regexp_extract_all({t}, '[A-Z][a-z]+'))::INT")
_column("a10_count_char", "documents", lambda t: fz.count(t, "e"), "(length({t}) - length(replace({t}, 'e', '')))::INT")
_add(
    "a10_count_total",
    lambda s, d: table(s, d, "documents").groupBy("lang").agg(F.sum(fz.count("text", r"\bth\w*")).alias("n")),
    r"SELECT lang, sum(len(regexp_extract_all(' ' || text, '[^\pL\pM\pN_]th[\pL\pM\pN_]*')))::BIGINT AS n FROM documents GROUP BY lang",
)
_column("a11_replace_template", "part", lambda t: fz.replace(t, r"(\w+) (\w+)", r"\2, \1"), r"regexp_replace({t}, '([a-z]+) ([a-z]+)', '\2, \1', 'g')")
_column("a11_replace_first", "pages", lambda t: fz.replace(t, "[./]", "_", count=1), "regexp_replace({t}, '[./]', '_')")
_column("a12_replace_evaluator", "customer", lambda t: fz.replace_with(t, r"\d", lambda m: str(9 - int(m.value))), "translate({t}, '0123456789', '9876543210')")
_add(
    "a13_replace_n",
    lambda s, d: table(s, d, "customer").select("c_custkey", fz.replace_n("c_name", "0+", "o").alias("r")).select("c_custkey", "r.text", "r.n"),
    "SELECT c_custkey, regexp_replace(c_name, '0+', 'o', 'g') AS text, len(regexp_extract_all(c_name, '0+'))::INT AS n FROM customer",
)
_column("a14_replace_format", "part", lambda t: fz.replace_format(t, r"(?<a>\w+) (\w+)", "{2}-{a}"), r"regexp_replace({t}, '([a-z]+) ([a-z]+)', '\2-\1')")
_column("a15_split", "pages", lambda t: _joined(fz.split(t, r"[/.]+")), "array_to_string(regexp_split_to_array({t}, '[/.]+'), '|')")
_column("a15_split_groups", "orders", lambda t: _joined(fz.split(t, "(-)")), "replace({t}, '-', '|-|')")
_add(
    "a16_enumerate_splits",
    lambda s, d: explode_splits(table(s, d, "pages").select("page_id", "url"), "url", "/").select("page_id", "ordinal", "piece"),
    "SELECT page_id, (o - 1)::INT AS ordinal, v AS piece FROM (SELECT page_id, unnest(m) AS v, generate_subscripts(m, 1) AS o FROM (SELECT page_id, string_split(url, '/') AS m FROM pages))",
)
_column("a17_escape", "pages", fz.escape, r"regexp_replace({t}, '([]()\[{}?*+|^$\\.\-#&~\s])', '\\\1', 'g')")
_add(
    "a18_next_match",
    lambda s, d: next_match(explode_matches(table(s, d, "pages").select("page_id", "url"), "url", r"[a-z]+"), ["page_id"]).where("ordinal = 0").select("page_id", F.col("match.value").alias("first"), F.col("next.value").alias("second")),
    "SELECT page_id, m[1] AS first, m[2] AS second FROM (SELECT page_id, regexp_extract_all(url, '[a-z]+') AS m FROM pages)",
)
_column("a19_result", "part", lambda t: fz.expand(fz.search(t, r"(\w+) (\w+)"), r"(\w+) (\w+)", r"\2/\1"), "regexp_extract({t}, ' (.*)', 1) || '/' || regexp_extract({t}, '^[a-z]+')")
_column("a20_result_format", "part", lambda t: fz.expand_format(fz.search(t, r"(\w)+"), r"(\w)+", "{1[0]}{1[-1]}"), "substr({t}, 1, 1) || right(regexp_extract({t}, '^[a-z]+'), 1)")
_add(
    "a21_groups",
    lambda s, d: table(s, d, "events").select("event_id", fz.group_value("props", r'"(?<key>\w+)": (?<val>\d+)', "key").alias("k"), fz.group_value("props", r'"(?<key>\w+)": (?<val>\d+)', "val").alias("v")),
    """SELECT event_id, regexp_extract(props, '"([a-z]+)": ([0-9]+)', 1) AS k, regexp_extract(props, '"([a-z]+)": ([0-9]+)', 2) AS v FROM events""",
)
_column("a22_captures", "part", lambda t: _joined(F.transform(fz.search(t, r"(?:(\w)\w* ?)+")["groups"][1]["captures"], lambda c: c["value"])), "array_to_string(list_transform(string_split({t}, ' '), lambda w: w[1]), '|')")
_add(
    "a23_fuzzy_counts",
    lambda s, d: table(s, d, "customer").withColumn("m", fz.full_match("c_name", "(?:Customer#000000111){s<=2}")).select("c_custkey", F.col("m.subs").alias("subs"), F.col("m.ins").alias("ins"), F.col("m.dels").alias("dels")),
    "SELECT c_custkey, CASE WHEN h <= 2 THEN h END AS subs, CASE WHEN h <= 2 THEN 0 END AS ins, CASE WHEN h <= 2 THEN 0 END AS dels FROM (SELECT c_custkey, hamming(c_name, 'Customer#000000111')::INT AS h FROM customer)",
)
_column("a24_fuzzy_changes", "customer", lambda t: _joined(F.transform(fz.full_match(t, "(?:Customer#000000111){s<=2}")["changes"]["subs"], lambda i: i.cast("string"))),
        "CASE WHEN hamming({t}, 'Customer#000000111') <= 2 THEN coalesce((SELECT string_agg((i - 1)::VARCHAR, '|' ORDER BY i) FROM range(1, 19) r(i) WHERE substr({t}, i::INT, 1) <> substr('Customer#000000111', i::INT, 1)), '') END")
_add(
    "a25_last_group",
    lambda s, d: table(s, d, "part").withColumn("m", fz.search("p_name", "(?<cold>cold)|(?<hot>hot)")).select("p_partkey", F.col("m.last_group").alias("n"), F.col("m.last_group_name").alias("name")),
    "SELECT p_partkey, CASE WHEN v = 'cold' THEN 1 WHEN v = 'hot' THEN 2 END AS n, v AS name FROM (SELECT p_partkey, nullif(regexp_extract(p_name, 'cold|hot'), '') AS v FROM part)",
)
_add(
    "a26_partial_match",
    lambda s, d: table(s, d, "part").withColumn("m", fz.full_match("p_name", r"(?:small|red|blue) (?:widget|bolt|ring)s|old \w+", partial=True)).select("p_partkey", F.col("m.partial").alias("partial")),
    "SELECT p_partkey, CASE WHEN regexp_full_match(p_name, 'old [a-z]+') THEN false WHEN regexp_full_match(p_name, '(small|red|blue) (widget|bolt|ring)') THEN true END AS partial FROM part",
)


def _about(spark: SparkSession, _: str) -> DataFrame:
    p = compile(r"(?i)(?<word>\w+) (\d+)\L<w>", lists={"w": ["a", "b"]})
    rows = [(p.pattern, p.group_count, ",".join(p.group_names), p.group_numbers["word"], bool(p.flags & Flag.IGNORECASE), ",".join(sorted(p.named_lists["w"])))]
    return spark.createDataFrame(rows, "pattern string, n_groups int, names string, word int, ignore_case boolean, list string")


_add("a27_introspection", _about, r"SELECT '(?i)(?<word>\w+) (\d+)\L<w>' AS pattern, 2 AS n_groups, '0,word,2' AS names, 1 AS word, true AS ignore_case, 'a,b' AS list")
#: Why a pattern is refused.
_WRONG = {
    "(abc": "missing )", "a**": "multiple repeat", "*a": "nothing to repeat", "a[": "unterminated character set", "a[b-a]": "bad character range", "abc)": "unbalanced parenthesis",
    r"\1": "invalid group reference", "(?P<1>a)": "bad character in group name", "(a)(?P=x)": "unknown group", "a\\": "bad escape (end of pattern)", r"(?V0)(a\1)": "cannot refer to an open group",
    "a{e<=1x}": "expected }", r"\p{Nonsense}": "unknown property", "[[:foo:]]": "unknown property", "(?Lu)a": "ASCII, LOCALE and UNICODE flags are mutually incompatible", "(?Li)a": "LOCALE cannot be used with IGNORECASE",
}


def _errors(spark: SparkSession, _: str) -> DataFrame:
    rows = []
    for p in _WRONG:
        try:
            compile(p)
            rows.append((p, None))
        except PatternError as e:
            rows.append((p, e.message))
    return spark.createDataFrame(rows, "pattern string, error string")


_add("a28_compile_errors", _errors, "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{m}')" for p, m in _WRONG.items()) + ") t(pattern, error)")


def _cache(spark: SparkSession, _: str) -> DataFrame:
    return spark.createDataFrame([(compile("(a|b)+c") is compile("(a|b)+c"), compile("x") is compile("x", Flag.IGNORECASE))], "same boolean, mixed boolean")


_add("a29_pattern_cache", _cache, "SELECT true AS same, false AS mixed")


def _timeout(spark: SparkSession, _: str) -> DataFrame:
    try:
        compile(r"(?:(x+)+\1)+y", steps=2000).is_match("x" * 40)
        ended = "answered"
    except MatchTimeout:
        ended = "timeout"
    return spark.createDataFrame([(ended,)], "ended string")


_add("a30_timeout", _timeout, "SELECT 'timeout' AS ended")
_column("a30_timeout_null", "part", lambda t: fz.is_match(F.concat(F.repeat(F.lit("x"), 30), t), compile(r"(?:(x+)+\1)+y", steps=500, on_timeout="null")), "NULL::BOOLEAN", dealt=True)

# --- pattern constructs ---------------------------------------------------------------------------------------------

_WORDS = {"lists": {"w": ["ring", "rod", "bolt"]}}
_CONSTRUCTS: list[tuple[str, str, str, str, dict]] = [
    # name, table, pattern, SQL for is_match
    ("p01_literal", "part", "red", "contains({t}, 'red')", {}),
    ("p02_any", "part", "l.t", "regexp_matches({t}, 'l.t')", {}),
    ("p03_alternation", "part", "gear|gizmo|plate", "regexp_matches({t}, 'gear|gizmo|plate')", {}),
    ("p04_sequence", "part", "ld (?:b)(?:o)lt", "contains({t}, 'ld bolt')", {}),
    ("p05_greedy_repeat", "part", "^[a-z]{4,} [a-z]{,4}$", "regexp_matches({t}, '^[a-z]{4,} [a-z]{0,4}$')", {}),
    ("p06_lazy_repeat", "part", "^.+?l.??d", "regexp_matches({t}, '^.+?l.??d')", {}),
    ("p07_possessive_repeat", "part", "^(?:[a-z]*+d|old) ", "starts_with({t}, 'old ')", {}),
    ("p10_scoped_flags", "part", "(?i:RED) b", "regexp_matches({t}, '(?i:RED) b')", {}),
    ("p11_inline_flags", "part", "red (?i)BOLT", "regexp_matches({t}, 'red (?i:BOLT)')", {}),
    ("p12_branch_reset", "part", r"(?|(s)mal|(l)arg)\w+ \w*\1", "regexp_matches({t}, 'small .*s|large .*l')", {}),
    ("p13_atomic", "part", "(?>o|ol)d ", "regexp_matches({t}, 'od ')", {}),
    ("p14_lookahead", "part", "^(?=.*d)(?!.*bolt)", "regexp_matches({t}, 'd') AND NOT contains({t}, 'bolt')", {}),
    ("p15_lookbehind", "part", "(?<=small|red) r", "regexp_matches({t}, '(small|red) r')", {}),
    ("p15_lookbehind_unbounded", "part", "(?<=l.*)g", "regexp_matches({t}, 'l.*g')", {}),
    ("p16_backreference", "part", r"(.)\1", "EXISTS (SELECT 1 FROM range(1, length({t})) r(i) WHERE substr({t}, i::INT, 1) = substr({t}, i::INT + 1, 1))", {}),
    ("p17_conditional_group", "part", r"^(red )?(?(1)bolt|\w+ ring)$", "regexp_full_match({t}, 'red bolt|[a-z]+ ring')", {}),
    ("p18_conditional_look", "part", "^(?(?=red).* ring|.* rod)$", "regexp_full_match({t}, 'red.* ring') OR (NOT starts_with({t}, 'red') AND regexp_full_match({t}, '.* rod'))", {}),
    ("p19_define", "part", r"(?(DEFINE)(?<thing>bolt|rod))^\w+ (?&thing)$", "regexp_full_match({t}, '[a-z]+ (bolt|rod)')", {}),
    ("p23_verb_fail", "part", "red(*FAIL)|hot", "contains({t}, 'hot')", {}),
    ("p23_verb_prune", "part", r"^\w+(*PRUNE)d|bolt", "contains({t}, 'bolt')", {}),
    ("p24_string_anchors", "part", r"\Ahot|ring\Z", "regexp_matches({t}, '^hot|ring$')", {}),
    ("p25_line_anchors", "documents", r"(?m)^The\b", "regexp_matches({t}, '(?m)^The([^\\pL\\pM\\pN_]|$)')", {}),
    ("p26_word_boundary", "documents", r"\bidiot\b", "regexp_matches({t}, '(^|[^\\pL\\pM\\pN_])idiot([^\\pL\\pM\\pN_]|$)')", {}),
    ("p27_word_start_end", "part", r"\mold\M", "regexp_matches({t}, '\\bold\\b')", {}),
    ("p30_newline", "documents", r"\R", "contains({t}, chr(10))", {}),
    ("p31_class_escapes", "orders", r"^\d\W\D+\s\w+$", "regexp_matches({t}, '^[0-9]-[A-Z]+ [A-Z]+$')", {}),
    ("p32_class_range", "part", "^[^a-m][a-e]", "regexp_matches({t}, '^[^a-m][a-e]')", {}),
    ("p33_set_difference", "part", "^[[a-z]--[aeiou]]{3} ", "regexp_matches({t}, '^[b-df-hj-np-tv-z]{3} ')", {}),
    ("p33_set_intersection", "part", "^[[a-m]&&[g-z]]", "regexp_matches({t}, '^[g-m]')", {}),
    ("p33_set_symmetric", "part", "^[[a-m]~~[g-z]]", "regexp_matches({t}, '^[a-fn-z]')", {}),
    ("p33_set_union", "part", "^[[a-c]||[n-s]]", "regexp_matches({t}, '^[a-cn-s]')", {}),
    ("p34_posix_class", "orders", r"^[[:digit:]][[:^alpha:]][[:upper:]]+$", "regexp_matches({t}, '^[0-9][^A-Za-z][A-Z]+$')", {}),
    ("p35_property", "documents", r"\p{Lu}\p{Ll}\p{P}", "regexp_matches({t}, '\\p{Lu}\\p{Ll}\\p{P}')", {}),
    ("p36_named_character", "documents", r"\N{LATIN SMALL LETTER SHARP S}", "contains({t}, 'ß')", {}),
    ("p37_numeric_escape", "part", r"\x72e\144", "contains({t}, 'red')", {}),
    ("p38_named_list", "part", r"\b\L<w>\b", "regexp_matches({t}, '\\b(ring|rod|bolt)\\b')", _WORDS),
    ("p39_verbose", "part", "(?x) ^ red # colour\n [ ] (?#thing) bolt $", "{t} = 'red bolt'", {}),
    ("f_ignore_case", "part", "(?i)OLD B", "contains({t}, 'old b')", {}),
    ("f_ascii", "documents", r"(?a)\b\w+\W\w{20,}\b", r"regexp_matches({t}, '\b\w+\W\w{20,}\b')", {}),
    ("f_single_line", "documents", r"(?s)^Th.*\.$", "regexp_matches({t}, '(?s)^Th.*\\.$')", {}),
    ("f_full_case", "documents", r"(?i)STRASSE|GROSS", "contains(replace(lower({t}), 'ß', 'ss'), 'strasse') OR contains(replace(lower({t}), 'ß', 'ss'), 'gross')", {}),
    ("f_version0", "part", r"(?V0)[[a-c]", "regexp_matches({t}, '[a-c\\[]')", {}),
]
for _name, _table, _pattern, _sql, _more in _CONSTRUCTS:
    _column(_name, _table, lambda t, p=_pattern, m=_more: fz.is_match(t, p, **m), _sql)

_column("p08_capture_group", "part", lambda t: fz.group_value(t, r"(\w+) (\w)", 2), "regexp_extract({t}, ' (.)', 1)")
_column("p09_named_group", "customer", lambda t: fz.group_value(t, r"#0*(?<n>\d+)$", "n"), "regexp_extract({t}, '#0*([0-9]+)$', 1)")
_column("p21_keep", "part", lambda t: fz.replace(t, r"\w+ \K\w+", "thing"), "regexp_replace({t}, '([a-z]+ )[a-z]+', '\\1thing')")
_column("p22_search_anchor", "customer", lambda t: fz.count(t, r"\G[A-Za-z]"), "length(regexp_extract({t}, '^[A-Za-z]*'))::INT")
_column("p20_recursion", "events", lambda t: fz.is_match(F.concat(F.lit("{x"), t, t, F.when(F.length(t) % 2 == 0, "}").otherwise("")), r"^(\{(?:[^{}]|(?1))*\})$"), r"regexp_full_match({t}, '\{[^{}]*\}') AND length({t}) % 2 = 0")
_column("p23_verb_skip", "part", lambda t: _joined(fz.findall(t, r"l\w(*SKIP)(*FAIL)|\w")), "array_to_string(regexp_extract_all(regexp_replace({t}, 'l[a-z]', '', 'g'), '[a-z]'), '|')")
#: A letter, an apostrophe and a letter are one word by default boundaries, an apostrophe ahead of a word is not part of it.
_column("p28_default_word_boundary", "part", lambda t: fz.is_match(F.translate(t, "o", "'"), r"(?w)\bld\b|\bring\b"), r"regexp_matches({t}, '\bold\b|\bring\b')")
#: Letters with marks and a flag are a cluster each.
_column("p29_grapheme", "part", lambda t: fz.count(F.concat(F.replace(t, F.lit("o"), F.lit("o\u0301\u0323")), F.lit("\U0001f1e6\U0001f1e7")), r"\X"), "length({t})::INT + 1")
_column("f_reverse", "part", lambda t: fz.group_value(t, r"(?r)\w+"), "regexp_extract({t}, '[a-z]+$')")
_column("f_posix", "part", lambda t: fz.group_value(t, "(?p)s|small|smal|r|red"), "nullif(regexp_extract({t}, 'small|s|red|r'), '')")
_column("f_multiline", "documents", lambda t: fz.count(t, r"(?m)\.$"), "(len(string_split({t}, '.' || chr(10))) - 1 + ends_with({t}, '.')::INT)::INT")
_column("f_word_lines", "documents", lambda t: fz.count(t, r"(?wm)\w$"), r"len(regexp_extract_all({t} || chr(10), '[\pL\pM\p{Nd}\p{Nl}\p{Pc}][\n\x0b\x0c\r\x{85}\x{2028}\x{2029}]'))::INT")

# --- fuzzy constructs -----------------------------------------------------------------------------------------------

_column("z01_fuzzy_section", "part", lambda t: fz.is_match(t, "(?:widget){e<=1}"), _near("{t}", "widget", 1))
_column("z02_total_limit", "part", lambda t: fz.is_match(t, "(?:wodgit){e<3}"), _near("{t}", "wodgit", 2))
_column("z02_full_distance", "part", lambda t: fz.is_full_match(t, "(?:cold bold){e<=2}"), "levenshtein({t}, 'cold bold') <= 2")
_column("z03_kind_limits", "part", lambda t: fz.is_match(t, "(?:bald){s<=1}"), "coalesce((SELECT bool_or(hamming(substr({t}, i::INT, 4), 'bald') <= 1) FROM range(1, length({t}) - 2) r(i)), false)")
_column("z03_insertions", "part", lambda t: fz.is_full_match(t, "(?:re ring){i<=2}"), "length({t}) BETWEEN 7 AND 9 AND regexp_full_match({t}, '.{0,2}r.{0,2}e.{0,2} .{0,2}r.{0,2}i.{0,2}n.{0,2}g.{0,2}')")
_column("z03_deletions", "part", lambda t: fz.is_full_match(t, "(?:blue bolts){d<=2}"), "length({t}) BETWEEN 8 AND 10 AND regexp_full_match({t}, 'b?l?u?e? ?b?o?l?t?s?')")
_column("z04_minimum", "part", lambda t: fz.is_full_match(t, "(?:red bold){1<=s<=2}"), "CASE WHEN length({t}) = 8 THEN hamming({t}, 'red bold') BETWEEN 1 AND 2 ELSE false END")
_column("z05_cost_equation", "part", lambda t: fz.is_full_match(t, "(?:old gear){2s+9i+9d<=4}"), "CASE WHEN length({t}) = 8 THEN hamming({t}, 'old gear') <= 2 ELSE false END")
_column("z06_edit_test", "part", lambda t: fz.is_full_match(t, "(?:rod bolt){s<=1:[aeiou]}"), "{t} = 'rod bolt' OR regexp_full_match({t}, '[aeiou]od bolt|r[aeiou]d bolt|ro[aeiou] bolt|rod[aeiou]bolt|rod [aeiou]olt|rod b[aeiou]lt|rod bo[aeiou]t|rod bol[aeiou]')")
_column("z07_exact_section", "part", lambda t: fz.is_match(t, "(?:old){e<=0} r"), "contains({t}, 'old r')")
_column("z08_nested_sections", "part", lambda t: fz.is_full_match(t, "(?:red (?:bolt){s<=2}){s<=1}"), "CASE WHEN length({t}) = 8 THEN hamming({t}, 'red bolt') <= 1 AND (hamming({t}, 'red bolt') = 0 OR starts_with({t}, 'red ')  OR hamming(substr({t}, 1, 4), 'red ') = 1) ELSE false END")
_column("z09_fuzzy_named_list", "part", lambda t: fz.is_match(t, r"\L<w>{e<=1}", lists={"w": ["gizmos", "anvils"]}), f"{_near('{t}', 'gizmos', 1)} OR {_near('{t}', 'anvils', 1)}")
_column("z10_enhance", "part", lambda t: fz.search(t, "(?e)(?:red){e<=1}")["value"])
_column("z11_best", "part", lambda t: (lambda m: m["subs"] + m["ins"] + m["dels"])(fz.search(t, "(?b)(?:widget){e<=4}")),
        "(SELECT CASE WHEN min(levenshtein(substr({t}, i::INT, n::INT), 'widget')) <= 4 THEN min(levenshtein(substr({t}, i::INT, n::INT), 'widget')) END FROM range(1, length({t}) + 2) r(i), range(0, 11) u(n))::INT", dealt=True)
_column("z12_fuzzy_backreference", "part", lambda t: fz.is_match(t, r"(\w\w)\w* \w*(?:\1){s<=1}"),
        "coalesce((SELECT bool_or(substr(a, i::INT, 1) = substr(b, j::INT, 1) OR substr(a, i::INT + 1, 1) = substr(b, j::INT + 1, 1)) FROM (SELECT string_split({t}, ' ')[1] AS a, string_split({t}, ' ')[2] AS b), range(1, 20) x(i), range(1, 20) y(j) WHERE i < length(a) AND j < length(b)), false)")
_column("z12_fuzzy_set", "part", lambda t: fz.is_full_match(t, "(?:[a-d]+ [p-s]+){s<=5}"),
        "coalesce((SELECT bool_or(length(regexp_replace(substr({t}, 1, k::INT - 1), '[a-d]', '', 'g')) + (substr({t}, k::INT, 1) <> ' ')::INT + length(regexp_replace(substr({t}, k::INT + 1), '[p-s]', '', 'g')) <= 5) FROM range(2, length({t})) r(k)), false)", dealt=True)
#: SQL: documents with a part within two edits of the phrase. One of its three pieces is unchanged in any, so only what is around these is compared.
_PHRASED = """WITH p AS (SELECT doc_id, piece, string_split(lower(text), piece) AS s FROM documents, (VALUES ('licens'), ('ed und'), ('er the')) v(piece) WHERE contains(lower(text), piece)),
w AS (SELECT DISTINCT doc_id, right(CASE WHEN k > 1 THEN s[k - 1] || piece ELSE '' END || s[k], 14) || piece || left(s[k + 1] || CASE WHEN k + 2 <= len(s) THEN piece || s[k + 2] ELSE '' END, 14) AS x FROM p, range(1, len(s)) r(k)),
h AS (SELECT DISTINCT doc_id FROM w, range(1, 35) a(i), range(16, 21) u(n) WHERE levenshtein(substr(x, i::INT, n::INT), 'licensed under the') <= 2)"""
_add("z_fuzzy_phrase_case", lambda s, d: table(s, d, "documents").select("doc_id", fz.is_match("text", "(?i)(?:licensed under the){e<=2}").alias("x")), f"{_PHRASED} SELECT doc_id, doc_id IN (SELECT doc_id FROM h) AS x FROM documents")

# --- joins, aggregation, windows ------------------------------------------------------------------------------------


def _list(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


_VALUES = "(VALUES ('tion'), ('the'), ('ention'), ('und'), ('des')) v(word)"
_add(
    "j01_named_list_join",
    lambda s, d: named_list_join(table(s, d, "documents"), "doc_id", "text", _list(s, ["tion", "the", "ention", "und", "des"]), "word"),
    r"SELECT doc_id, word, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\pL\pM\pN_]+')) AS t FROM documents) JOIN " + _VALUES + " ON t = word GROUP BY ALL",
)
_add(
    "j02_substring_join",
    lambda s, d: substring_join(table(s, d, "part"), "p_partkey", "p_name", _list(s, ["old", "bolt", "ld g", "ring"]), "word"),
    "SELECT p_partkey, word FROM part JOIN (VALUES ('old'), ('bolt'), ('ld g'), ('ring')) v(word) ON contains(p_name, word)",
)
_add(
    "j03_fuzzy_join",
    lambda s, d: fuzzy_join(table(s, d, "part"), "p_partkey", "p_name", _list(s, ["widgets", "platter", "gizmoes"]), "word", 2),
    "SELECT p_partkey, word FROM part, (VALUES ('widgets'), ('platter'), ('gizmoes')) v(word) WHERE (SELECT bool_or(levenshtein(substr(p_name, i::INT, n::INT), word) <= 2) FROM range(1, length(p_name) + 2) r(i), range(5, 10) u(n))",
)
_add(
    "j04_pattern_table",
    lambda s, d: pattern_join(table(s, d, "pages"), "page_id", "url", [("word", "[a-z]+"), ("digit", r"\d"), ("https", "^https")]),
    """SELECT page_id, pattern_id, n FROM (SELECT page_id, 'word' AS pattern_id, len(regexp_extract_all(url, '[a-z]+'))::INT AS n FROM pages UNION ALL SELECT page_id, 'digit', len(regexp_extract_all(url, '[0-9]'))::INT FROM pages
UNION ALL SELECT page_id, 'https', starts_with(url, 'https')::INT FROM pages) WHERE n > 0""",
)
_add(
    "g01_group_by_capture",
    lambda s, d: table(s, d, "orders").groupBy(fz.group_value("o_orderpriority", r"-(.+)", 1).alias("priority")).agg(F.count("*").alias("n")),
    "SELECT regexp_extract(o_orderpriority, '-(.+)', 1) AS priority, count(*) AS n FROM orders GROUP BY ALL",
)
_add(
    "g02_cube",
    lambda s, d: table(s, d, "part").withColumn("colour", fz.group_value("p_name", r"^\w+")).cube("colour", "p_type").agg(F.count("*").alias("n")),
    "SELECT regexp_extract(p_name, '^[a-z]+') AS colour, p_type, count(*) AS n FROM part GROUP BY CUBE (1, 2)",
)
_add(
    "g03_first_n",
    lambda s, d: table(s, d, "documents").select("doc_id", F.size(fz.matches("text", r"\b\w{9,}\b", most=3)).alias("n")),
    r"SELECT doc_id, least(3, len(list_filter(regexp_extract_all(text, '[\pL\pM\pN_]+'), lambda w: length(w) >= 9)))::INT AS n FROM documents",
)
_add(
    "g04_window",
    lambda s, d: table(s, d, "conversations").withColumn("n", fz.count("text", "[.!?]")).select("conv_id", "turn", F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)).alias("total")),
    "SELECT conv_id, turn, sum(len(regexp_extract_all(text, '[.!?]'))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS total FROM conversations",
)
_add(
    "g05_best_across_rows",
    lambda s, d: dealt_out(table(s, d, "part").select("p_type", "p_name")).withColumn("m", fz.full_match("p_name", "(?b)(?:cold bald){e}")).withColumn("e", F.col("m.subs") + F.col("m.ins") + F.col("m.dels")).groupBy("p_type").agg(F.min_by("p_name", F.struct("e", "p_name")).alias("best"), F.min("e").alias("errors")),
    "SELECT p_type, arg_min(p_name, (levenshtein(p_name, 'cold bald'), p_name)) AS best, min(levenshtein(p_name, 'cold bald'))::INT AS errors FROM part GROUP BY p_type",
)
_add(
    "g06_set_operations",
    lambda s, d: table(s, d, "part").where(fz.is_match("p_name", "^(?:red|hot)")).select("p_name").intersect(table(s, d, "part").where(fz.is_match("p_name", "(?:bolt|ring)$")).select("p_name")),
    "SELECT p_name FROM part WHERE regexp_matches(p_name, '^(red|hot)') INTERSECT SELECT p_name FROM part WHERE regexp_matches(p_name, '(bolt|ring)$')",
)


def _sql_surface(spark: SparkSession, d: str) -> DataFrame:
    fz.register(spark)
    table(spark, d, "part").createOrReplaceTempView("loomtext_part")
    return spark.sql("SELECT p_partkey, m.ordinal, m.value FROM loomtext_part, LATERAL fz_matches(p_name, '[aeiou]+') m WHERE fz_is_match(p_name, '(?i)^(?:RED|BLUE)')")


_add(
    "u01_sql_functions", _sql_surface,
    "SELECT p_partkey, (o - 1)::INT AS ordinal, v AS value FROM (SELECT p_partkey, unnest(m) AS v, generate_subscripts(m, 1) AS o FROM (SELECT p_partkey, regexp_extract_all(p_name, '[aeiou]+') AS m FROM part WHERE regexp_matches(p_name, '^(red|blue)')))",
)


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """Conversations' texts as a stream of turns: matches over the turns' borders are found in the joined text."""
    from ..streaming.run import scan_table

    turns = table(spark, d, "conversations")
    last = F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))
    chunks = turns.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").alias("chunk"), last.alias("last"))
    return scan_table(spark, chunks, r"[a-z]+\.[A-Z][a-z]*")


_add(
    "s01_stream_chunks", _streamed,
    r"SELECT conv_id AS stream_id, v AS value, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(string_agg(text, '' ORDER BY turn), '[a-z]+\.[A-Z][a-z]*')) AS v FROM conversations GROUP BY conv_id) GROUP BY ALL",
)


def _stream_columns(spark: SparkSession, d: str) -> DataFrame:
    """Operators without state over a stream of files."""
    from ..streaming.run import stream_table

    return stream_table(spark, table(spark, d, "part").select("p_partkey", "p_name"), lambda s: s.where(fz.is_match("p_name", "(?:widgit){e<=1}")).select("p_partkey", fz.replace("p_name", r"(\w+) (\w+)", r"\2 \1").alias("t"), fz.count("p_name", "[aeiou]").alias("n")))


_add("s02_stream_columns", _stream_columns, f"SELECT p_partkey, regexp_replace(p_name, '([a-z]+) ([a-z]+)', '\\2 \\1', 'g') AS t, len(regexp_extract_all(p_name, '[aeiou]'))::INT AS n FROM part WHERE {_near('p_name', 'widgit', 1)}")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Text files in, matches out, partitioned by a column of few values."""
    from .. import sources
    from ..streaming.run import shared_dir

    at = shared_dir(spark, "lines")
    table(spark, d, "pages").where("url IS NOT NULL").select("url").write.text(f"{at}/in")
    found = sources.lines(spark, f"{at}/in").where(fz.is_match("line", r"^https?://\w+\.example")).select("line", fz.group_value("line", r"^(\w+)://", 1).alias("scheme"))
    sources.write(found, f"{at}/out", by=["scheme"])
    return spark.read.schema("line string, scheme string").parquet(f"{at}/out")


_add("src01_lines", _lines, "SELECT url AS line, regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM pages WHERE regexp_matches(url, '^https?://[0-9A-Za-z_]+[.]example')")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and quality that hold a phrase within two errors, with the number of their licence lines."""
    docs = table(spark, sf_dir, "documents").where(fz.is_match("text", "(?i)(?:licensed under the){e<=2}"))
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").groupBy("lang", "quality").agg(F.count("*").alias("documents"), F.sum(fz.count("text", "(?i)licen[cs]e")).alias("mentions"))


_add("flagship", flagship, f"""{_PHRASED} SELECT lang, quality, count(*) AS documents, sum(len(regexp_extract_all(text, '(?i)licen[cs]e')))::BIGINT AS mentions
FROM documents JOIN h USING (doc_id) LEFT JOIN labels USING (doc_id) GROUP BY lang, quality""")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

