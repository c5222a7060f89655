"""Print the formatted physical plan of registered queries.

    python explain_plans.py column_profile,stratified_split [sf_dir]

Fits that run while a query is built (quantiles, vocabularies) execute as
jobs; the plan printed is the final query's.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright.registry import QUERIES  # noqa: E402
from tablewright.session import build_session  # noqa: E402


def main() -> None:
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else sorted(QUERIES)
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.001"
    spark = build_session("local[4]", 8)
    for name in names:
        print(f"===== {name} =====")
        QUERIES[name](spark, sf_dir).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
