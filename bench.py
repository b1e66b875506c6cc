"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each query is run twice, the second run counts."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import loomtext.functions as fz  # noqa: E402
from loomtext.plans import catalog  # noqa: E402
from loomtext.sources import table  # noqa: E402

WORDS = ["ring", "rod", "bolt", "gear", "plate", "anvil", "gizmo", "widget", "lamp", "nail"]


def records(spark: SparkSession, d: str) -> DataFrame:
    """100,000 short texts, as the many-inputs baselines have: event rows with a part's name."""
    events, part = table(spark, d, "events"), table(spark, d, "part")
    n = part.count()
    named = events.withColumn("p_partkey", F.col("event_id") % n).join(part.select("p_partkey", "p_name"), "p_partkey")
    return named.select("event_id", F.concat_ws(" ", "event_type", "p_name", "props", F.col("ts").cast("string")).alias("t"))


def own(make):
    return lambda spark, d: records_of[d].select(F.sum(make(F.col("t")).cast("long")))


def texts(make):
    return lambda spark, d: documents_of[d].select(F.sum(make(F.col("text")).cast("long")))


#: In memory and over all cores, as the baselines' subjects are in memory: the table is one row group, which one task would read.
records_of: dict[str, DataFrame] = {}
documents_of: dict[str, DataFrame] = {}
QUERIES = {
    "fuzzy_phrase_is_match": own(lambda t: fz.is_match(t, "(?i)(?:purchase small){e<=2}")),
    "fuzzy_three_alternation": own(lambda t: fz.is_match(t, "(?i)(?:purchase small|signup large|error cold){e<=2}")),
    "fuzzy_three_named_list": own(lambda t: fz.is_match(t, r"(?i)\L<p>{e<=2}", lists={"p": ["purchase small", "signup large", "error cold"]})),
    "validate_records": own(lambda t: fz.is_full_match(t, r"[a-z]+ [a-z]+ [a-z]+ \{\"k\": \d+\} \d{4}-\d\d-\d\d [\d:.]+")),
    "parse_log_lines": own(lambda t: F.length(fz.group_value(t, r'(?<event>\w+) (?<item>\w+ \w+) \{"k": (?<value>\d+)\}', "value"))),
    "redact_digits": own(lambda t: F.length(fz.replace(t, r"\d+", "#"))),
    "case_fold": own(lambda t: fz.is_match(t, "(?i)STRASSE|GIZMO")),
    "whole_words": own(lambda t: fz.is_match(t, r"\b\L<w>\b", lists={"w": WORDS})),
    "literal": own(lambda t: fz.is_match(t, "needle")),
    "class_scan": texts(lambda t: fz.count(t, "[a-z]{3}[^a-z]")),
    "matches_to_end": texts(lambda t: fz.count(t, r"\w+")),
    "replace_template": texts(lambda t: F.length(fz.replace(t, r"(\w+) (\w+)", r"\2 \1"))),
    "split_long": texts(lambda t: F.size(fz.split(t, r"\w+"))),
    "fuzzy_documents": texts(lambda t: fz.is_match(t, "(?:licensed under){e<=1}")),
    "fuzzy_spans": lambda s, d: table(s, d, "part").select(F.sum(F.size(fz.spans("p_name", "(?:widgit){e<=2}")))),
    "best_match": lambda s, d: table(s, d, "part").select(F.sum(fz.search("p_name", "(?b)(?:widget){e<=3}")["subs"])),
    "named_list_join": catalog.queries()["j01_named_list_join"],
    "fuzzy_join": catalog.queries()["j03_fuzzy_join"],
    "flagship": catalog.flagship,
}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.files.maxPartitionBytes", "4m").config("spark.sql.execution.arrow.maxRecordsPerBatch", "20000").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    records_of[sf_dir] = records(spark, sf_dir).repartition(int(cpus)).cache()
    documents_of[sf_dir] = table(spark, sf_dir, "documents").repartition(int(cpus)).cache()
    records_of[sf_dir].count(), documents_of[sf_dir].count()
    took = {}
    for name, query in QUERIES.items():
        for _ in range(2):
            began = time.time()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline pattern queries, total of second runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
