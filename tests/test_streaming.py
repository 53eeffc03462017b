import random
from datetime import date, timedelta
from decimal import Decimal

from tallyloom.operators import linkage
from tallyloom.sources.golden_store import read_golden
from tallyloom.streaming import clusters

SCHEMA = "doc_id string, idx long, date date, description string, amount_brl decimal(18,2)"


def rows(n, seed):
    r = random.Random(seed)
    return [(f"d{i % 5}", i, date(2024, 1, 1) + timedelta(r.randint(0, 3)), " ".join(r.sample(["UBER", "PADARIA", "LOJA", "CASA", "X"], 2)), Decimal(r.randint(100, 103)) / 100) for i in range(n)]


def test_arrivals_in_any_order_equal_the_batch(spark, tmp_path):
    """Rows come shuffled, so many are late; a batch that comes twice changes nothing."""
    made = rows(120, 7)
    random.Random(1).shuffle(made)
    source, path = f"{tmp_path}/in", f"{tmp_path}/table"
    for k in range(0, 120, 50):
        spark.createDataFrame(made[k : k + 50], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = clusters.clustered(arriving, path, f"{tmp_path}/checkpoint", buckets=3)
    query.processAllAvailable()
    query.stop()
    got = {(r.doc_id, r.idx): r.leader for r in read_golden(spark, path).collect()}
    want = {(r.doc_id, r.idx): r.leader for r in linkage.leader_clusters(spark.createDataFrame(made, SCHEMA), "idx").collect()}
    assert got == want and len(got) == 120
    clusters.merge(spark.createDataFrame(made[:50], SCHEMA), path, "idx", buckets=3)
    assert {(r.doc_id, r.idx): r.leader for r in read_golden(spark, path).collect()} == want
    first = min(i for (_, i) in want)
    late = [("d0", first - 1, *next(x for x in made if x[0] == "d0")[2:])]
    clusters.merge(spark.createDataFrame(late, SCHEMA), path, "idx", buckets=3)
    want = {(r.doc_id, r.idx): r.leader for r in linkage.leader_clusters(spark.createDataFrame(made + late, SCHEMA), "idx").collect()}
    assert {(r.doc_id, r.idx): r.leader for r in read_golden(spark, path).collect()} == want
