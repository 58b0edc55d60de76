"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from inkveil.queries.registry import QUERIES
from inkveil.session import local_session

HEADLINE = (
    "flagship",
    "scan_common",
    "scan_names",
    "scan_intel",
    "keyword_values",
    "ner_merge",
    "scan_fast",
    "scan_combined",
    "dedup_normalized",
    "paginate_entities",
    "mask_preview",
    "redact_pages",
    "verify_redaction",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(int(cpus), 8) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["flagship"](spark, sf).write.format("noop").mode("overwrite").save()  # start the workers
    took: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    size = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("count(*) n", "sum(n_chars) c").first()
    records = spark.read.parquet(f"{sf}/orders.parquet").count()
    texts = size["n"] + records
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "texts": texts,
                "document_chars": size["c"],
                "pattern_scan_ms_per_text": round(1000 * took["scan_intel"] / texts, 4),
            }
        )
    )


if __name__ == "__main__":
    main()
