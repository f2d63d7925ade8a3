"""Write PLANS.md: physical-plan excerpts of the key operators (sf0.01).

    python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

def plan_text(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode="formatted")
    text = buf.getvalue().replace("== Physical Plan ==\n", "")
    tree_lines = text.split("\n\n")[0].splitlines()
    tree = "\n".join(tree_lines[:45] + (["   ... (cached input plan continues)"] if len(tree_lines) > 45 else []))
    details, seen = [], set()
    for line in text.splitlines():
        m = re.match(r"\s*(PushedFilters|ReadSchema|DataFilters|Arguments): (.*)", line)
        if m and "RebalancePartitions" not in line and line not in seen:
            seen.add(line)
            details.append(f"{m.group(1)}: {m.group(2)[:180]}")
    return tree + ("\n\n" + "\n".join(details[:8]) if details else "")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from pyspark.sql import functions as F

    from tidewarp.config import RunConfig
    from tidewarp.operators import drift as J
    from tidewarp.operators import kmeans as km
    from tidewarp.operators import profile as A
    from tidewarp.plans.series import fixture_series
    from tidewarp.session import build_session, cut_lineage
    from tidewarp.sources import sinks as W
    from tidewarp.sources.tables import fx1_panel

    spark = build_session("local[8]")
    s = cut_lineage(fixture_series(spark, sf, "fx1"))
    sk = km.fan_out_k(s, [4])
    init = km.lowest_id_centres(s, [4])
    fit = km.fit(sk, init, ["time_point", "k"], RunConfig(eta=0.0, max_iter=1), with_stats=False)
    a = cut_lineage(fit.assignments)
    keys = ["time_point", "k"]
    sections = [
        ("FX-1 fixture scan: only 4 columns read, the time range pushed to Parquet, partial + final aggregate",
         fx1_panel(spark, sf)),
        ("Dense series + windows: one groupBy(id) of (pos, value) entries, explode of the windows",
         fixture_series(spark, sf, "fx1")),
        ("One k-means pass: Arrow map over the cached series, partial sums, small aggregate",
         km._pass_plan(sk, keys, RunConfig(), 12, "series_norm", spark.sparkContext.broadcast({})).groupBy("_m", "cluster_id").agg(F.sum("s0"))),
        ("K1 nearest samples: WindowGroupLimit Partial before the shuffle, Final after",
         A.nearest_samples(a, keys, 5)),
        ("J5 companion stability: time-point set broadcast, one id join, small count tables",
         J.companion_ratio(a.select("time_point", "k", "id", "cluster_id"), 1, keys)),
        ("A2 member blocks: partial aggregate per (cluster, id block)", A.member_lists(a, keys)),
        ("K2 ranks: range-partitioned global sort, broadcast cluster means and group starts",
         A.rank_by_own_mean(a, keys, 12, RunConfig())),
        ("W-sinks: rebalance by the partition columns before the partitioned write",
         W.with_run_columns(A.cluster_size(a, keys), "random", "random", 12).hint("rebalance", *W.PARTITION_COLS)),
    ]
    out = ["# Physical plans of the key operators", "",
           "Generated by `python tools/plans.py` on sf0.01 (`explain('formatted')`, operator lines only).", ""]
    for title, df in sections:
        out += [f"## {title}", "", "```", plan_text(df), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    print("wrote PLANS.md")


if __name__ == "__main__":
    main()
