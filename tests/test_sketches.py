import random
from collections import Counter
from datetime import datetime, timedelta

from tallyloom.operators import runs, sketches


def test_merged_sketches_stay_within_the_bound(spark, tmp_path):
    """Five-minute sketches, stored, merged into hours and over all methods; exact values from the runs."""
    r = random.Random(4)
    rows = [(datetime(2024, 1, 1) + timedelta(seconds=i * 4), r.choice("ab"), r.random() < 0.8, float(r.expovariate(0.01)), None if i % 3 else f"E{r.randint(0, 9) ** 2 // 9}") for i in range(5000)]
    history = spark.createDataFrame(rows, "ts timestamp, method string, success boolean, time_ms double, error string")
    sketches.sketched(history).write.parquet(f"{tmp_path}/windows")
    stored = spark.read.parquet(f"{tmp_path}/windows")
    hours = sketches.estimated(sketches.merged(stored), k=20).collect()
    for h in hours:
        own = [x for x in rows if x[1] == h.method and h.start <= x[0] < h.start + timedelta(hours=1)]
        times = sorted(x[3] for x in own)
        assert h.runs == len(own) and h.success_rate == round(sum(x[2] for x in own) / len(own), 6)
        for q, share in ((h.p50, 0.5), (h.p95, 0.95)):
            assert abs(sum(t <= q for t in times) / len(times) - share) <= 3 * sketches.rank_error() + 1 / len(times)
        assert [(e.error, e.n) for e in h.top_errors] == sorted(Counter(x[4] for x in own if x[4]).items(), key=lambda x: (-x[1], x[0]))
    (whole,) = sketches.estimated(sketches.merged(sketches.merged(stored), "1 day", keys=()), k=3).collect()
    assert (whole.method, whole.runs, len(whole.top_errors)) == ("ALL", 5000, 3)
    assert all(x.near for x in sketches.within_error(sketches.estimated(sketches.merged(stored)), history).collect())
    assert {x.start for x in runs.dashboard(history, "1 hour").select("start").collect()} == {h.start for h in hours}


def test_windows_without_errors_and_no_runs(spark):
    schema = "ts timestamp, method string, success boolean, time_ms double, error string"
    one = spark.createDataFrame([(datetime(2024, 1, 1), "a", True, 5.0, None)], schema)
    (row,) = sketches.estimated(sketches.merged(sketches.sketched(one))).collect()
    assert (row.runs, row.p50, row.top_errors) == (1, 5.0, [])
    assert sketches.estimated(sketches.merged(sketches.sketched(one.limit(0)))).count() == 0
