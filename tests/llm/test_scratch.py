"""What the training-data operators leave on disk while they run."""

import time

from pyspark.sql import functions as F

from lorefield.llm import jaccard_join
from lorefield.llm.common import stored


def shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if "shuffle_" in files.apply(i).getName())


def test_stored_tables_leave_no_shuffle_files(spark):
    """The files of a shuffle, some 20 MB, are gone soon after the table that needed them is written, while the plan is still held; the session's setting stays."""
    before, key = shuffle_bytes(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key, None)
    plan = spark.range(2_000_000).select(F.xxhash64("id").alias("a"), "id").repartition("a").sortWithinPartitions("a").mapInArrow(lambda x: x, "a long, id long")
    table = stored(plan)
    for _ in range(20):
        if shuffle_bytes(spark) < before + 1_000_000:
            break
        time.sleep(0.5)
    assert shuffle_bytes(spark) < before + 1_000_000
    assert table.count() == plan.count() == 2_000_000 and spark.conf.get(key, None) == setting


def test_signatures_meet_in_rounds(spark, monkeypatch):
    """Whatever the number of rounds, the same nodes share signatures, and no round takes much more than its part of them."""
    rows = [(k, [(x * 2_654_435_761 % 2**40) << 1 | 1 for x in range(k % 50, k % 50 + 30)], []) for k in range(400)]
    rows = [(node, sigs[5:], sigs[:5]) for node, sigs, _ in rows]
    signed = stored(spark.createDataFrame(rows, "node long, sigs array<long>, more array<long>"))
    sizes, keep = [], stored

    def counted(df):
        out = keep(df)
        if out.columns == ["sig", "node"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", counted)
    found = {}
    for rounds in (1, 4):
        monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
        sizes.clear()
        found[rounds] = sorted(map(tuple, jaccard_join.sharing(signed).collect()))
        found[rounds, "sizes"] = sizes[:rounds]
    assert found[1] == found[4] and len(found[1]) > 400
    assert sum(found[4, "sizes"]) == found[1, "sizes"][0] and max(found[4, "sizes"]) < 0.5 * found[1, "sizes"][0]
