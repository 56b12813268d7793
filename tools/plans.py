"""Write the physical plan trees of the headline queries to PLANS.md.

    python tools/plans.py [sf_dir]

Only the operator tree and the scan lines (ReadSchema, PushedFilters) are
kept, which is what a plan review needs.
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wren.plans.catalog import load_all  # noqa: E402
from wren.session import get_session  # noqa: E402

#: The plans worth reviewing: one of each shape, and those that shuffle most.
REVIEWED = ("top_topics", "engagement_stats", "feature_importance", "iqr_outliers", "cap_per_author", "upsert_features",
            "insert_new_posts", "feedback_match", "valid_requests", "reuse_scored")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", shuffle_partitions=16)
    qs = load_all()
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/plans.py` at `{sf_dir}` (local[8], 16 shuffle partitions, AQE on; the trees are",
           "the initial adaptive plans, so broadcast choices reflect this scale).", ""]
    for name in REVIEWED:
        buf = io.StringIO()
        with redirect_stdout(buf):
            qs[name].build(spark, sf_dir).explain("formatted")
        text = buf.getvalue()
        tree = text.split("\n\n")[0]
        scans = sorted(set(re.findall(r"(ReadSchema: .*|PushedFilters: \[.+\])", text)))
        out += [f"## {name}", "", "```", tree.strip(), "```", ""]
        if scans:
            out += ["Scans:", ""] + [f"- `{s}`" for s in scans] + [""]
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w").write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
