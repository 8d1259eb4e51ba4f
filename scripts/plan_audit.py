"""Summarise the physical plan of registered queries.

Usage: python scripts/plan_audit.py [sf_dir] [name ...]
Per query: exchanges by kind, broadcast exchanges, window partition specs,
scan read schemas and pushed filters, Python (Arrow) operators, and whether a
window has no partition key (one task; acceptable only over tables bounded
by the partition count, such as the prefix-sum offsets over ``_pid``).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from attrition.plans import catalog  # noqa: E402
from attrition.session import get_spark  # noqa: E402

DEFAULT = ["customers_raw", "prepare_features", "profile_numeric", "chi_square", "mann_whitney",
           "spearman_matrix", "auc", "ks_normal", "risk_segments", "score_rejects", "request_verdicts", "choose_rounds", "profile_sketches"]


def summarise(plan: str) -> dict:
    lines = plan.splitlines()
    ex = [ln for ln in lines if "Exchange " in ln and "BroadcastExchange" not in ln]
    kinds = {}
    for ln in ex:
        m = re.search(r"Exchange (\w+)", ln)
        if m:
            kinds[m.group(1)] = kinds.get(m.group(1), 0) + 1
    windows = [re.sub(r"#\d+L?", "", m.group(1)) for ln in lines
               for m in [re.search(r"windowspecdefinition\(([^,]+(?:, [^,]+)?)", ln)] if m]
    # a window spec whose first element is an ORDER BY has no partition key: one task
    unpartitioned = [w.split(",")[0] for w in windows if re.search(r" (ASC|DESC)", w.split(",")[0])]
    return {
        "exchanges": kinds,
        "broadcasts": sum("BroadcastExchange" in ln for ln in lines),
        "windows": windows,
        "read_schemas": sorted({m.group(1) for ln in lines for m in [re.search(r"ReadSchema: (struct<[^>]*>)", ln)]
                                if m}),
        "pushed_filters": sorted({m.group(1) for ln in lines
                                  for m in [re.search(r"PushedFilters: (\[[^\]]*\])", ln)] if m and m.group(1) != "[]"}),
        "python_ops": sum(("ArrowEvalPython" in ln or "MapInPandas" in ln or "MapInArrow" in ln) for ln in lines),
        "unpartitioned_windows": unpartitioned,
    }


def main():
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.1"
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    spark = get_spark()
    for name in args or DEFAULT:
        df = catalog.QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()  # final (AQE) plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(name, summarise(plan))
    spark.stop()


if __name__ == "__main__":
    main()
