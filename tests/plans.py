"""How often executed plans read a table."""

from __future__ import annotations

import re
import time
from collections import defaultdict
from contextlib import contextmanager


@contextmanager
def scans(spark):
    """Inside the block queries run; afterwards ``seen(name)`` is the number of scans of files whose path holds the name.

    Counts the scan nodes of the plans as they ran, without those that reuse another one's exchange. A command and the query that it
    runs are one.
    """
    store = spark._jsparkSession.sharedState().statusStore()

    def executions() -> list:
        found = store.executionsList()
        return [found.apply(i) for i in range(found.size())]

    # By number, not by place in the list: a session keeps its last 1,000 only, so in a long one places shift.
    before = max((e.executionId() for e in executions()), default=-1)

    def plans() -> list[tuple[int, str]]:
        ran = [e for e in executions() if e.executionId() > before]
        return [(e.rootExecutionId(), e.physicalPlanDescription() or "") for e in ran]

    def seen(name: str, kind: str = "parquet") -> int:
        totals = defaultdict(int)
        for root, plan in plans():
            if not plan:  # its events are not all in
                continue
            tree, *details = plan.split("\n\n\n", 1)
            ran, total = tree.split("== Initial Plan ==")[0], 0
            for number in re.findall(rf"Scan {kind} .*?\((\d+)\)", ran):
                detail = re.search(rf"^\({number}\) Scan {kind}.*?^Location: (.*?)$", details[0], re.S | re.M)
                total += name in detail.group(1)
            totals[root] = max(totals[root], total)
        return sum(totals.values())

    yield seen
    for _ in range(50):  # the last query's events are on their way
        if all(plan for _, plan in plans()):
            break
        time.sleep(0.1)
