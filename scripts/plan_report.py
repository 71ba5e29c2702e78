"""Summarise the final (post-AQE) physical plan of every registered query.

usage: python scripts/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FEATURES = [
    ("shuffles", r"^\s*[:+\- ]*Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)"),
    ("broadcasts", r"BroadcastExchange"),
    ("reused", r"Reused(Exchange|Subquery)"),
    ("SMJ", r"SortMergeJoin"),
    ("BHJ", r"BroadcastHashJoin"),
    ("SHJ", r"ShuffledHashJoin"),
    ("WindowGroupLimit", r"WindowGroupLimit"),
    ("TakeOrdered", r"TakeOrderedAndProject"),
    ("scalar subquery", r"^\s*[:+\- ]*Subquery subquery"),
    ("python", r"(BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas)"),
    ("cartesian", r"(CartesianProduct|BroadcastNestedLoopJoin)"),
]


def final_only(plan: str) -> str:
    """Drop every "== Initial Plan ==" section (AQE prints both plans, also
    for each subquery), keeping the final plans."""
    keep, skip_at = [], None
    for line in plan.split("\n"):
        indent = len(line) - len(line.lstrip(" :|+-"))
        if skip_at is not None:
            if indent > skip_at:
                continue
            skip_at = None
        if "== Initial Plan ==" in line:
            skip_at = len(line) - len(line.lstrip(" :|"))  # column of its "+-"
            continue
        keep.append(line)
    return "\n".join(keep)


def summarise(plan: str) -> dict[str, int]:
    plan = final_only(plan)
    out = {}
    for name, pat in FEATURES:
        rx = re.compile(pat, re.M)
        out[name] = len(rx.findall(plan))
    return out


def main() -> None:
    from reelrank.plans import queries as Q
    from reelrank.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    print("# Physical plans of the registered queries\n")
    print(f"Final adaptive plans after execution at `{sf}`, local[8], produced by "
          "`scripts/plan_report.py`. Counts are plan nodes (subqueries included). "
          "Exchanges reused by AQE count once. FP-Growth and ALS run inside Spark ML "
          "and are not part of these DataFrame plans (their outputs are).\n")
    names = [n for n, _ in FEATURES]
    print("| query | " + " | ".join(names) + " |")
    print("| --- |" + " --- |" * len(names))
    for q in sorted(Q.REGISTRY):
        df = Q.REGISTRY[q](spark, sf)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        print(f"| {q} | " + " | ".join(str(s[n]) for n in names) + " |")
    flagship = Q.REGISTRY["popular_movies"](spark, sf)
    flagship.collect()
    tree = final_only(flagship._jdf.queryExecution().executedPlan().toString())
    tree = "\n".join(line[:160] for line in tree.split("\n"))
    print("\n## Flagship query `popular_movies`, final plan\n")
    print("```")
    print(tree)
    print("```")
    print("""
Reading notes:

* Joins show as broadcast hash joins because AQE measured the build sides
  below the broadcast threshold at this scale; at full scale the same plans
  keep sort-merge joins where sides are large, with AQE's skew splitting.
* Most shuffles in the ratings-based queries come from the test adapter that
  derives ratings from lineitem and orders (one join and one aggregate per
  use); on a real ratings table those are plain column-pruned scans.
* `WindowGroupLimit` appears in pairs: a partial limit before the shuffle and
  a final one after it.
* `ranked_best` / `ranked_recent`: the range-partitioned sort runs before the
  checkpoint (a separate job), so the plan shown starts from the checkpointed
  table; the offsets join disappears when no user spans two partitions.
* `cartesian` in the ALS queries is Spark ML's blocked user x item scoring
  for exact top-k (`recommendForAllUsers` / `recommendForUserSubset`).
* FP-Growth queries show no shuffles here because the itemsets are cached by
  `rules.mine_rules`; the mining itself is Spark ML's job.""")


if __name__ == "__main__":
    main()
