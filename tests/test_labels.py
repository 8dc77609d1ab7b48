"""Labels of users whose mean lies just beside a class's bound."""

import duckdb

from chronoweave import catalog_models


def test_values_of_many_decimals_are_not_rounded_for_labels(spark, tmp_path):
    values = {1: [45.7999999999], 2: [53.6000000001], 3: [45.8], 4: [53.6], 5: [45.7999999999, 45.7999999999], 6: [1e-9, 91.599999998], 7: [53.60000000000001, 53.60000000000001], 8: [45.79, 45.81], 9: [45.7999999999, None], 10: [45.79999999]}
    rows = [(u, "error", v) for u, own in values.items() for v in own]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    events = duckdb.sql(f"SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = duckdb.sql("SELECT user_id, CASE WHEN y < 45.8 THEN 0 WHEN y > 53.6 THEN 2 ELSE 1 END FROM (SELECT user_id, avg(value) AS y FROM events GROUP BY 1)").fetchall()
    assert dict(want) == {u: r for r, own in enumerate(([1, 5, 6, 9, 10], [3, 4, 8], [2, 7])) for u in own}
    assert {x.user_id: x.label for x in catalog_models.labelled(spark, str(tmp_path)).collect()} == dict(want)
