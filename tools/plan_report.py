"""Write PLANS.md: plan-shape facts for every registered query (static physical plan).

Usage: python tools/plan_report.py [sf_dir]
Columns: shuffle exchanges, broadcast exchanges, Python evaluation nodes, window
group limits (pre-shuffle dedup), top-k nodes, scans and the widest ReadSchema.
Counts are of the initial adaptive plan; AQE may still turn a shuffle join into a
broadcast join at runtime.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.plans import registry  # noqa: E402
from quarry.session import get_spark  # noqa: E402


def facts(plan: str) -> dict:
    plan = plan.split("== Initial Plan ==")[-1]
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    widest = max((s.count(":") for s in schemas), default=0)
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "python": len(re.findall(r"ArrowEvalPython|BatchEvalPython|MapInPandas|PythonMapInArrow", plan)),
        "group_limits": plan.count("WindowGroupLimit"),
        "topk": plan.count("TakeOrderedAndProject"),
        "scans": plan.count("FileScan"),
        "widest_scan_cols": widest,
        "pair_joins": plan.count("CartesianProduct") + plan.count("BroadcastNestedLoopJoin"),
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    rows = []
    for name, fn in sorted(registry.queries().items()):
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        rows.append((name, facts(plan)))
    cols = ["shuffles", "broadcasts", "python", "group_limits", "topk", "scans", "widest_scan_cols", "pair_joins"]
    out = ["# PLANS — plan-shape facts per registered query", "",
           f"Generated by `tools/plan_report.py {sf}` from the static physical plans (before AQE",
           "re-planning). `python` counts Arrow/Python evaluation nodes; `group_limits` counts",
           "WindowGroupLimit nodes (partial + final dedup around a shuffle); `widest_scan_cols` is the",
           "largest number of columns any scan reads; `pair_joins` must be 0. What a query writes while it is",
           "built (`materialize`: embedded rows and resolved events of the change queries, a model's flags) is",
           "not in its last plan, so those queries show fewer nodes than they run.", "",
           "| query | " + " | ".join(cols) + " |", "|---|" + "---|" * len(cols)]
    for name, f in rows:
        out.append(f"| `{name}` | " + " | ".join(str(f[c]) for c in cols) + " |")
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w").write(
        "\n".join(out) + "\n")
    print("\n".join(out[-len(rows):]))


if __name__ == "__main__":
    main()
