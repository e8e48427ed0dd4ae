"""Means that are zero but for rounding: their signs hang on the order of the sum, not on how a table is split."""

import random

from tidemark.plans import governance


def test_sign_test_sums_in_the_order_of_events(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.randrange(300), "click" if rng.random() < 0.7 else "view") for i in range(9000)]
    events = [*rows, (None, 1, "click"), (None, 999, "view"), (9001, None, "click")]
    for part in range(9):
        frame = spark.createDataFrame(events[part * 1001 : (part + 1) * 1001], "event_id long, user_id long, event_type string")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    total, exact = {}, {}
    for i, user, kind in events:
        if i is not None:
            total[kind, user] = total.get((kind, user), 0.0) + (float(i % 7) - 3 + (0.2 if kind == "click" else 0.0))
            exact[kind, user] = exact.get((kind, user), 0) + 5 * (i % 7 - 3) + (kind == "click")
    assert sum(total[u] != 0 and exact[u] == 0 for u in total) >= 3
    for size in ("128m", "16k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found = {r.event_type: (r.ups, r.downs) for r in governance.sign_test(spark, str(tmp_path)).collect()}
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert found == {kind: (sum(x > 0 for (k, _), x in total.items() if k == kind), sum(x < 0 for (k, _), x in total.items() if k == kind)) for kind in ("click", "view")}
