"""Print, for every registered query, what its final plan does across the cluster."""

from __future__ import annotations

import re
import sys

from compare import ROOT  # noqa: F401


def main() -> None:
    import __spark_entry__ as entry
    from causalrisk import build_session

    folder = sys.argv[1]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("WARN")
    for name, run in entry.queries().items():
        if sys.argv[2:] and not any(c in name for c in sys.argv[2:]):
            continue
        plan = run(spark, folder)._jdf.queryExecution().executedPlan().toString()
        counts = {k: len(re.findall(k, plan)) for k in (
            "Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "BroadcastExchange",
            "CartesianProduct", "BroadcastNestedLoopJoin", "Window ", "InPandas", "PythonUDF",
        )}
        print("PLAN", name, {k: v for k, v in counts.items() if v}, flush=True)


if __name__ == "__main__":
    main()
