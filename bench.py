"""Seconds of each headline query at $BENCH_SF_DIR on local[$BENCH_CPUS], as one line of JSON."""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lautwerk import workload
from lautwerk.operators import roles
from lautwerk.session import local_session
from lautwerk.sources import corpus

HEADLINE = ["feature_scan", "unit_counts", "tokenize_words", "find_vowels", "query_word_final", "rewrite_final_devoicing", "rewrite_trace_counts", "to_xsampa", "mora_counts", "manner_by_language", "obstruents_by_part"]


def corpus_times(spark, n: int = 5000) -> dict[str, float]:
    """The published corpus benchmark: entries of the form ``ana`` put, all of them got by id in one read, ``[nasal]`` asked of all."""
    entries = spark.range(n).selectExpr("concat('e', lpad(cast(id as string), 8, '0')) AS entry_id", "'{}' AS meta", "'ana' AS form").coalesce(1)
    took = {}
    with tempfile.TemporaryDirectory() as folder:
        c = corpus.create(spark, f"{folder}/c")
        began = time.time()
        c.add(entries, {"cited": "form"}, "bench", "1")
        took[f"corpus_put_{n}"] = round(time.time() - began, 3)
        began = time.time()
        got = c.read_all(entries, "cited").collect()
        took[f"corpus_get_{n}"] = round(time.time() - began, 3)
        assert len(got) == n
        began = time.time()
        roles.query(c, "[nasal]", "cited").write.format("noop").mode("overwrite").save()
        took[f"corpus_query_{n}"] = round(time.time() - began, 3)
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    took = {}
    run = workload.queries()
    run[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    for name in HEADLINE:
        began = time.time()
        run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    took |= corpus_times(spark)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
