"""Near-duplicates: the sets of a few nodes are made without moving the other texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.near_dedup import _sets, id_filter, passes, shingle_sets, signatures
from tessera.session import ship


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_sets_move_no_other_texts(spark, no_broadcast):
    ship(spark)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{x:08x}" for x in rng.integers(0, 1 << 32, 300)) for _ in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), (7, "another text under this id"), (None, texts[9])], "doc_id long, text string")
    classes = signatures(docs, 2).where("doc_id is not null").select("f1", "f2", F.col("doc_id").alias("least"), F.when(F.col("n_shingles") > 10, F.col("doc_id")).otherwise(1000).alias("node")).localCheckpoint()
    before = shuffled(spark)
    sets = _sets(spark, docs, spark.createDataFrame([(7,), (9,), (9,)], "node long"), classes, 2)
    moved = shuffled(spark) - before
    import pyarrow as pa

    expected = {i: shingle_sets(pa.array([texts[i]]), 2)[0].astype("<u8").tobytes() for i in (7, 9)}
    assert {r["node"]: bytes(r["shingles"]) for r in sets.collect()} == expected and sets.count() == 2
    assert 0 < moved < sum(map(len, texts)) / 10


def test_id_filter_misses_none(spark):
    ship(spark)
    ids = np.random.default_rng(4).integers(-(1 << 62), 1 << 62, 5000)
    words = id_filter(spark.createDataFrame([(int(x),) for x in ids[:3000]], "doc_id long"))
    found = passes(words, ids)
    assert found[:3000].all() and found[3000:].mean() < 0.05
    assert not passes(id_filter(spark.createDataFrame([], "doc_id long")), ids).any()
