"""Results on odd figures: halves, and sizes whose products pass 64 bits."""

import duckdb
from conftest import same_rows

from assetloom.operators import budget
from assetloom.plans import registry


def lines(spark, tmp_path, rows):
    """A table of order lines with these (orderkey, quantity, price), for both engines."""
    spark.createDataFrame([(k, 1 + k % 7, q, p, 0.04, 0.02, "ANR"[k % 3], "OF"[k % 2]) for k, q, p in rows], "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    return c


def test_split_beyond_64_bits(spark):
    """Sizes of 200 GB: a whole product is 10^22."""
    rows = spark.createDataFrame([(200_000_000_001, 100_000_000_000, 150_000_000_000), (30, 20, 10)], "v long, i long, t long")
    wanted = []
    for v, i, t in ((200_000_000_001, 100_000_000_000, 150_000_000_000), (30, 20, 10)):
        vr, ir, need = v - int(v * 0.5), i - int(i * 0.82), v + i - t
        first = min(need, vr + ir)
        vs = int(first * vr / (vr + ir))
        left, mv, mi = need - first, v - vs, i - (first - vs)
        ev = min(mv, int(left * mv / (mv + mi))) if left > 0 else 0
        wanted.append((v - vs - ev, mi - (min(mi, left - ev) if left > 0 else 0)))
    found = budget.split(rows, "v", "i", "t", "balanced", "balanced").orderBy("v").collect()
    assert [(r["video_budget"], r["image_budget"]) for r in found] == wanted[::-1]


def test_tier_plan_at_halves(spark, tmp_path):
    """A rate of 5,000.5 is rounded to the even 5,000, as the SQL's cast does."""
    c = lines(spark, tmp_path, [(k, 10.0, p) for k, p in enumerate([50005.0] * 6 + [50015.0, 5.0, 15.0, 49995.0, 50004.9, 50005.1])])
    assert registry.QUERIES["tier_plan"](spark, str(tmp_path)).where("fits").count() > 0
    same_rows(registry.QUERIES["tier_plan"](spark, str(tmp_path)), c, registry.ORACLE["tier_plan"])
