"""Wall seconds of the headline queries, warm, the median of three; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemill.plans import registry
from tidemill.session import session

HEADLINE = (
    "pricing_summary", "scan_filtered", "agg_group_by", "agg_count_distinct", "agg_having", "agg_order_limit", "join_inner", "join_three_way", "join_multi_key", "join_aggregate", "exists_correlated",
    "not_in_subquery", "topk", "json_exists", "key_set_lookup", "kv_scan_range", "hash_getall", "sets_inter", "zset_rank", "zset_union_sum", "list_range", "geo_search", "bit_count",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false", spark_driver_memory=os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(runs[1:]), 4)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "lineitem_rows": rows, "rows_per_sec_pricing_summary": round(rows / seconds["pricing_summary"])}))


if __name__ == "__main__":
    main()
