"""However a text is cut into chunks, the matches are those of the whole."""

from __future__ import annotations

import random

import pytest

import loomtext.functions as fz
from loomtext import sources
from loomtext.pattern.engine import compile
from loomtext.streaming import Feed
from loomtext.streaming.run import scan_table

TEXT = "the cat sat on 123 mats; foo foobar fooxbar 2026-09-01 and 12 ... aaa bbb " * 3


@pytest.mark.parametrize("pattern", [r"\w+", r"\d{4}-\d\d-\d\d", "(?:foobar){e<=1}", r"\b\w{3}\b", "a+", "(?<=o)o|x*", r"^the|\s$", "[a-z]+ [a-z]+"])
def test_any_chunks(pattern):
    rng = random.Random(pattern)
    p = compile(pattern)
    want = [(m.index, m.value) for m in p.iterate(TEXT)]
    for _ in range(5):
        feed, got, i = Feed(p), [], 0
        while i < len(TEXT):
            n = rng.randint(1, 25)
            got += feed.push(TEXT[i : i + n])
            i += n
        assert got + feed.push("", True) == want


@pytest.mark.parametrize("pattern", [r"\w+ |(?<=X.{100})b", r"(?<!X.{80}a)b", r"(?<=(?<=X.{70}).{9})."])
@pytest.mark.parametrize("size", [1, 10, 64])
def test_far_lookbehind(pattern, size):
    rng = random.Random(size)
    text = "".join(rng.choice("ab X" if rng.random() < 0.1 else "ab ") for _ in range(700))
    p = compile(pattern)
    feed, got = Feed(p), []
    for k in range(0, len(text), size):
        got += feed.push(text[k : k + size])
    assert got + feed.push("", True) == [(m.index, m.value) for m in p.iterate(text)]


def test_lookbehind_without_bound_is_refused():
    with pytest.raises(ValueError, match="lookbehind"):
        Feed(compile("(?<=l.*)g")).push("a l g")


def test_columns_under_a_stream(spark, tmp_path):
    """Operators without state run on a stream of files as they do on a table."""
    texts = ["one 12 two 345", None, "no digits", "7"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string").write.parquet(f"{tmp_path}/in")
    view = lambda df: df.where(fz.is_match("text", r"\d")).select("id", fz.count("text", r"\d+").alias("n"), fz.replace("text", "(?:two){e<=1}", "2").alias("t"), fz.search("text", r"(\d)(?=\d)")["index"].alias("s"))
    stream = view(spark.readStream.schema("id long, text string").parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    got = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, view(spark.read.parquet(f"{tmp_path}/in")).collect())) and len(got) == 2


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.log").write_text("x=1\ny=2\n")
    (tmp_path / "b.log").write_text("x=3")
    lines = sources.lines(spark, f"{tmp_path}/*.log")
    assert sorted((r.file.rsplit("/", 1)[1], r.line) for r in lines.collect()) == [("a.log", "x=1"), ("a.log", "y=2"), ("b.log", "x=3")]
    whole = sources.whole_files(spark, f"{tmp_path}/*.log")
    assert sorted((r.file.rsplit("/", 1)[1], r.text) for r in whole.collect()) == [("a.log", "x=1\ny=2\n"), ("b.log", "x=3")]
    sources.write(lines.selectExpr("line", "substring(line, 1, 1) AS name"), f"{tmp_path}/out", by=["name"])
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, back.select("line", "name").collect())) == [("x=1", "x"), ("x=3", "x"), ("y=2", "y")]
    assert (tmp_path / "out" / "name=x").is_dir()


def test_stream(spark):
    rows = [(s, i, c, i == 3) for s in (1, 2) for i, c in enumerate(["ab12", "34 x", None, f"y{s}99"])]
    out = scan_table(spark, spark.createDataFrame(rows, "stream_id long, seq int, chunk string, last boolean"), r"\d+")
    assert sorted(map(tuple, out.collect())) == [(1, "1234", 1), (1, "199", 1), (2, "1234", 1), (2, "299", 1)]
