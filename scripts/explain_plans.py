"""Write docs/PLANS.md: exchanges, joins, pushed filters and read schemas of the main plans.

usage: python scripts/explain_plans.py [sf_dir]
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from sessionlog.config import ADAPTER_AGG, ADAPTER_FILTER, ExecConfig  # noqa: E402
from sessionlog.spark import get_session  # noqa: E402


def summary(df, run=True):
    if run:
        df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = []
    for m in re.finditer(r"(Exchange \w+\([^)]*\)[^\n]*|BroadcastExchange[^\n]*|BroadcastHashJoin[^\n]*"
                         r"|SortMergeJoin[^\n]*|ShuffledHashJoin[^\n]*|Window \[[^\n]{0,80})", plan):
        txt = re.sub(r"#\d+L?", "", m.group(1))
        txt = re.sub(r", \[plan_id=\d+\]", "", txt)
        lines.append(txt[:160])
    scans = [re.sub(r"#\d+L?", "", x)[:200] for x in re.findall(r"(PushedFilters: [^\n,]*[^\n]*?(?=, ReadSchema|$)|ReadSchema: [^\n]*)", plan, re.M)]
    return lines, scans


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session()
    from sessionlog.operators.analytics import session_analytics
    from sessionlog.operators.blocks import activity_blocks
    from sessionlog.operators.corrections import error_corrections
    from sessionlog.operators.denoise import cursor_decisions
    from sessionlog.operators.scan import SCAN_INPUT, scan
    from sessionlog.sources.adapter import canonical_from_driver, load_driver_events

    raw = spark.read.parquet(f"{sf}/events.parquet")
    ev = load_driver_events(spark, sf)
    hot = canonical_from_driver(raw.withColumn("user_id", F.lit(0).cast("bigint")), max_group_rows=1000)
    cases = [
        ("adapter + sequencing, bounded groups (lazy)", lambda: canonical_from_driver(raw, materialize=False)),
        ("adapter + sequencing, one hot key: range path (lazy)",
         lambda: canonical_from_driver(raw.withColumn("user_id", F.lit(0).cast("bigint")), materialize=False,
                                       max_group_rows=1000)),
        ("chunked scan, every session in one chunk (lazy)", lambda: scan(ev, ADAPTER_AGG, ExecConfig())),
        ("chunked scan, hot session over 1000-row chunks (materialize=False: the local pass runs for the "
         "summaries and for the rows; the default persists it once and writes the result)",
         lambda: scan(hot.select(*SCAN_INPUT), ADAPTER_AGG, ExecConfig(chunk_rows=1000), materialize=False)),
        ("activity_blocks", lambda: activity_blocks(ev, ADAPTER_AGG, ExecConfig())),
        ("error_corrections", lambda: error_corrections(ev, ADAPTER_AGG, ExecConfig())),
        ("session_analytics (after its scan is materialized)", lambda: session_analytics(ev, ADAPTER_AGG, ExecConfig())),
        ("cursor_decisions", lambda: cursor_decisions(ev, ADAPTER_FILTER, ExecConfig())),
    ]
    out = ["# Physical plans (generated by scripts/explain_plans.py)", "",
           f"Input: `{sf}` through the driver-table adapter; AQE on; plans after execution (final AQE plans).",
           "Attribute ids are removed. Exchanges and joins are listed in plan order (top = last).", ""]
    for title, make in cases:
        lines, scans = summary(make())
        out += [f"## {title}", "", "```"] + lines + ["```", ""]
        if scans:
            out += ["Scans:", ""] + [f"- `{s}`" for s in dict.fromkeys(scans)] + [""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    print("written docs/PLANS.md")


if __name__ == "__main__":
    main()
