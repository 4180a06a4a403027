"""Write the executed (AQE final) physical plans of headline queries to docs/PLANS.md.

Usage: python tools/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfwise.operators import metrics  # noqa: E402
from shelfwise.operators.star import fact_internal_sales  # noqa: E402
from shelfwise.plans import catalog  # noqa: E402
from shelfwise.session import clear_stages, get_spark  # noqa: E402
from shelfwise.sources.sales_feed import sales_lines  # noqa: E402

NAMES = ["total_revenue_filtered", "yoy_growth_by_brand", "market_share_by_year_category",
         "internal_vs_competitor_volume", "top_k_per_group", "hierarchy_rollup",
         "kpi_requests", "resolve_substring", "clean_internal", "fact_internal_sales"]


def tree(df) -> str:
    df.collect()
    jvm = df.sparkSession.sparkContext._jvm
    text = jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    head, _, details = text.partition("\n\n\n")
    keep = [ln for ln in details.splitlines()
            if re.match(r"^\(\d+\) (Scan|BroadcastHashJoin|SortMergeJoin|Exchange|HashAggregate)", ln)
            or ln.startswith(("ReadSchema", "PushedFilters", "PartitionFilters", "Join type",
                              "Arguments: hashpartitioning", "Arguments: rangepartitioning", "Keys"))]
    return head.strip() + "\n\n" + "\n".join(keep)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark(master="local[8]", shuffle_partitions=16,
                      extra={"spark.driver.memory": "12g"})
    out = ["# Executed plans", "",
           f"AQE final plans after execution on `{sf}` (local[8], 16 shuffle partitions), "
           "written by `tools/dump_plans.py`. Only joins, exchanges, aggregates and scans are "
           "detailed below each tree.", ""]
    qs = catalog.queries()
    parts = [("sales_lines (feed derivation)", sales_lines(spark, sf))]
    built = catalog.build(spark, sf)
    dims = {k: built["star"][k] for k in ("dim_time", "dim_product", "dim_category",
                                          "dim_retailer")}
    parts.append(("fact_internal_sales build (cleaned feed joined to the four dimensions)",
                  fact_internal_sales(built["internal"], dims)))
    parts += [(n, qs[n](spark, sf)) for n in NAMES]
    # facts are partitioned by date_id, so a year filter on dim_time prunes
    # fact partitions at run time
    fact = {k: v for k, v in built["star"].items() if k != "fact_weekly_summary"}
    parts.append(("total_revenue(year, brand) on the date_id-partitioned fact",
                  metrics.total_revenue(fact, year=catalog.YEAR, brand=catalog.BRAND)))
    for name, df in parts:
        out += [f"## {name}", "", "```", tree(df), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs",
                        "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    clear_stages(spark)
    print("wrote", path)


if __name__ == "__main__":
    main()
