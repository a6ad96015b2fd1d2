"""Headline figures: building views, applying small batches, and evaluating again; one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rivulet.engine import Engine
from rivulet.functions import zset as Z
from rivulet.operators import matrix
from rivulet.plans.nodes import Table as T

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    out: dict[str, float] = {}

    def timed(name, f):
        began = time.time()
        value = f()
        out[name] = round(time.time() - began, 3)
        return value

    line = spark.read.parquet(f"{SF}/lineitem.parquet")
    # The tracked table is nine tenths; batches come from the rest, in parts of the table's rows.
    e = Engine(spark)
    timed("track_lineitem_orders", lambda: (e.track("lineitem", line.where("l_orderkey % 10 <> 0")), e.track("orders", spark.read.parquet(f"{SF}/orders.parquet"))))
    views = {
        "filter": T("lineitem").where("l_quantity > 25").select("l_orderkey", "l_quantity"),
        "aggregate": T("lineitem").select("l_returnflag", f"{matrix.CENTS} AS c").sums(["l_returnflag"], s=("sum", "c"), n=("count", None)),
        "join": matrix.revenue(e),
    }
    for name, plan in views.items():
        timed(f"build_{name}", lambda name=name, plan=plan: e.create_view(name, plan))
    late = line.where("l_orderkey % 10 = 0")
    for label, part in (("0.1pct", 100), ("1pct", 10), ("9pct", 1)):
        batch = late.where(F.pmod(F.floor(F.col("l_orderkey") / 10), F.lit(100)) < {100: 1, 10: 10, 1: 89}[part]) if part != 1 else late
        timed(f"batch_insert_{label}", lambda b=batch: e.apply_batch({"lineitem": Z.weighted(b)}))
        timed(f"batch_delete_{label}", lambda b=batch: e.apply_batch({"lineitem": Z.weighted(b, -1)}))
    timed("recompute_join", lambda: Z.consolidate(views["join"].full(e.snapshot())).collect())
    timed("query_join", lambda: e.query("join").collect())
    for name in ("full_outer_join", "window_sum_rows", "distinct_on", "recursive_union"):
        timed(name, lambda name=name: matrix.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "seconds, all queries", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": SF}))


if __name__ == "__main__":
    main()
