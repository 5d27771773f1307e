"""Write the formatted physical plan of headline queries to docs/plans/.

    python tools/explain_plans.py [sf_dir] [key ...]

Plans are taken after execution (``noop`` write), so the AQE final plan is
shown: broadcasts chosen at run time, coalesced shuffle reads, skew splits.
Where a query reads a stored table or fitted numbers, a ``work_*`` dump shows
the plan that computes them.
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from bench import HEADLINE  # noqa: E402
from tarmac.operators import aggregates as agg  # noqa: E402
from tarmac.operators import classify as cls  # noqa: E402
from tarmac.operators import clean  # noqa: E402
from tarmac.plans import dims  # noqa: E402
from tarmac.plans import features as feat  # noqa: E402
from tarmac.plans.context import Ctx  # noqa: E402
from tarmac.registry import QUERIES, all_queries  # noqa: E402
from tarmac.session import local_session  # noqa: E402
from tarmac.sources import tables  # noqa: E402


#: the work behind results that come from stored tables or fitted numbers
WORK = {
    "work_flights": lambda c: tables.flights(c.spark, c.sf_dir),
    "work_airport_base": lambda c: feat.airport_base(c.fl, c.airports),
    "work_route_aggregate": lambda c: agg.per_route_v2(c.fl),
    "work_modes": lambda c: clean.mode_table(c.camel, c.camel.columns),
    "work_gnb_moments": lambda c: c.train.groupBy(cls.TARGET).agg(
        F.count(F.lit(1)).alias("N"), *[F.avg(f).alias(f"M_{f}") for f in cls.FEATURES],
        *[F.var_pop(f).alias(f"V_{f}") for f in cls.FEATURES]),
    "work_flights_subset": lambda c: dims.flights_subset(c.fl, c.major_airlines, c.major_airports),
}


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    keys = args or [*HEADLINE, *WORK]
    out_dir = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "plans")
    os.makedirs(out_dir, exist_ok=True)
    spark = local_session()
    all_queries()
    for k in keys:
        df = (WORK.get(k) or QUERIES[k])(Ctx(spark, sf_dir))
        df.write.format("noop").mode("overwrite").save()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue().replace(os.path.dirname(sf_dir), "<data>")
        with open(os.path.join(out_dir, f"{k}.txt"), "w") as fh:
            fh.write(text)
        print(k, len(text))


if __name__ == "__main__":
    main()
