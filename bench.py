"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS set data and cores.
Every query is run to a sink that reads all its rows; the first one is run once
before to start the engine and the Python workers.
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from jobpanel.plans import QUERIES  # noqa: E402
from jobpanel.session import get_spark  # noqa: E402

HEADLINE = [
    "entropy_by_group_and_year", "txt5_requirement_section", "txt9_skill_text", "flt3_rule_chain",
    "dup3_exact_text", "dup4_near_duplicates", "nlp2_phrases_by_pmi", "nlp5_merge_phrases",
    "nlp6_vocabulary", "nlp10_verb_noun_pairs", "mdl2_inference", "met_all_metrics", "mdl20_skill_profile",
    "cls13_task_counts", "agg1_cell_panel", "agg18_quartile_summary", "jon9_nearest_vectors",
    "reg13_individual_twfe",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[names[0]](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    n_docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus), "documents": n_docs}))
    spark.stop()


if __name__ == "__main__":
    main()
