"""Percentiles of price over groups without region or retailer."""

import datetime
from decimal import Decimal

from larder.llm import queries as P


def test_groups_without_region_are_reported(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    keys = [("А", "юг"), ("А", None), (None, "юг"), (None, None)]
    rows = [(n, k[0], k[1], Decimal(100 * i + j), day) for i, k in enumerate(keys, 1) for n, j in enumerate(range(1, 10))]
    rows += [rows[9], (1, "А", None, Decimal(0), day), (1, "А", None, None, day)]  # sent again, no price
    spark.createDataFrame(rows, "product_id int, retailer_name string, region string, price decimal(12,2), observed_at timestamp_ntz").write.parquet(f"{tmp_path}/price_observations.parquet")
    got = {(r["retailer_name"], r["region"]): (r["n"], r["p50"]) for r in P.p5_percentiles(spark, str(tmp_path)).collect()}
    assert got == {k: (9, 100.0 * i + 5) for i, k in enumerate(keys, 1)}
    assert {tuple(r) for r in P.p5_daily_digests(spark, str(tmp_path)).select("retailer_name", "region").distinct().collect()} == set(keys)
    assert P.p5_found(spark, str(tmp_path)).count() == 0
