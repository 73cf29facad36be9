"""Physical-plan summaries: what each registered query shuffles, joins and pushes down.

``python -m stockroom.plans.inspect [sf_dir] > PLANS.md`` regenerates the table.
Each query is built and run, and every SQL execution that either started is
counted with the plan it ended with (after AQE), from Spark's event log in a
scratch folder.  So the work of jobs that checkpoint on the way counts in full, subqueries too.
"""

from __future__ import annotations

import glob
import json
import re
import sys
import tempfile
import time
from collections import Counter

COLUMNS = {
    "executions": None, "exchanges": r"^Exchange$", "broadcasts": r"^BroadcastExchange$",
    "sort-merge joins": r"^SortMergeJoin$", "hash joins": r"^(Broadcast|Shuffled)HashJoin$",
    "top-k": r"^TakeOrderedAndProject$", "windows": r"^Window$",
    "python": r"Pandas|Arrow|PythonUDF", "cartesian": r"^(CartesianProduct|BroadcastNestedLoopJoin)$",
}


def _walk(plan: dict, out: Counter, pushed: set[str]) -> None:
    name = plan["nodeName"].split(" (")[0].strip()
    out[name] += 1
    if name.startswith("Scan"):
        m = re.search(r"\[(.*)\]$", plan.get("metadata", {}).get("PushedFilters", ""))
        if m:
            pushed.update(f for f in re.split(r", (?=[A-Z])", m[1]) if f and not f.startswith("IsNotNull"))
    for child in plan["children"]:
        _walk(child, out, pushed)


def executions(folder: str) -> list[tuple[float, dict]]:
    """(start time in seconds, last plan) of every SQL execution in an event log."""
    began, plans = {}, {}
    for path in glob.glob(f"{folder}/*"):
        with open(path, errors="replace") as lines:
            for line in lines:
                e = json.loads(line)
                if "sparkPlanInfo" in e:
                    plans[e["executionId"]] = e["sparkPlanInfo"]
                    if "time" in e:
                        began[e["executionId"]] = e["time"] / 1000
    return [(began[k], plans[k]) for k in sorted(began)]


def summarize(plans: list[dict]) -> dict:
    nodes, pushed = Counter(), set()
    for p in plans:
        _walk(p, nodes, pushed)
    out = {c: sum(n for k, n in nodes.items() if re.search(pattern, k)) for c, pattern in COLUMNS.items() if pattern}
    return {"executions": len(plans), **out, "pushed": "; ".join(sorted(pushed))[:120]}


def main(argv) -> None:
    from ..session import get_spark
    from ..sources import RetailTables
    from . import REGISTRY

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    folder = tempfile.mkdtemp(prefix="stockroom-events-")
    spark = get_spark("local[8]", 8, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{folder}",
        "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false"})
    spans = {}
    for name, q in sorted(REGISTRY.items()):
        start = time.time()
        q.build(RetailTables.from_testdata(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        spans[name] = (start, time.time())
    spark.stop()
    found = executions(folder)
    print(f"# Physical plans at {sf_dir.rsplit('/', 1)[-1]} (generated by `python -m stockroom.plans.inspect`)\n")
    print("Operators in the final plans of all SQL executions that building and running a query started, the")
    print("adapter's own included. `pushed` lists filters that reach the Parquet scan.\n")
    names = list(COLUMNS) + ["pushed"]
    print("| query | " + " | ".join(names) + " |")
    print("|---" * (len(names) + 1) + "|")
    for name, (a, b) in spans.items():
        s = summarize([p for t, p in found if a - 0.001 <= t <= b])
        print(f"| `{name}` | " + " | ".join(str(s[c]) for c in names) + " |")


if __name__ == "__main__":
    main(sys.argv)
