"""Write PLANS.md: physical plan trees of the headline queries with the scan
details (ReadSchema, PushedFilters) — the review loop for pushdown, pruning,
codegen spans and exchanges.

usage: python scripts/show_plans.py [sf_dir]
"""
from __future__ import annotations

import contextlib
import io
import re
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from bench import HEADLINE  # noqa: E402
from tokenloom.plans.registry import QUERIES  # noqa: E402
from tokenloom.session import get_spark  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark()
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `scripts/show_plans.py` on `{sf_dir}` (after execution, so AQE decisions are final).", ""]
    for name in HEADLINE:
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        tree, _, details = text.partition("\n\n\n")
        scans = []
        for block in details.split("\n\n"):
            if "Scan parquet" in block.split("\n")[0] or "Scan " in block.split("\n")[0]:
                keep = [ln for ln in block.split("\n") if re.match(r"^\(\d+\)|^(ReadSchema|PushedFilters|Location)", ln)]
                scans.append("\n".join(keep))
        exchanges = tree.count("Exchange")
        out += [f"## {name}", "", f"exchange nodes (incl. the lineage of persisted inputs): {exchanges}, whole-stage codegen stages: {len(set(re.findall(r'codegen id : (\d+)', text)))}",
                "", "```", tree.strip()[:12000], "```", "", "Scans:", "", "```", "\n\n".join(scans)[:4000], "```", ""]
    (ROOT / "PLANS.md").write_text("\n".join(out))
    print("wrote PLANS.md")


if __name__ == "__main__":
    main()
