from pathlib import Path

from pyspark.sql import functions as F

from nidalytics.plans import stages


def shuffled(spark):
    """Shuffle files that lie in the session's local folder."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {p for d in manager.localDirs() for p in Path(d.getPath()).rglob("shuffle_*")}


def test_what_a_stage_shuffles_goes_with_it(spark):
    before = shuffled(spark)
    rows = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    assert stages.cut(rows).agg({"n": "sum"}).first()[0] == 1000
    with stages.tidy(spark):
        assert rows.filter("n = 10").groupBy("n").agg(F.count(F.lit(1))).first()[1] == 100
    # cut's query left nothing; the one on its table that is outside of tidy may leave its one row
    assert all("shuffle" in p.name for p in shuffled(spark)) and len(shuffled(spark) - before) <= 3
    assert spark.conf.get(stages.CLEANUP) == "false"
