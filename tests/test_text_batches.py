"""Python gets texts in small batches, by rows and by bytes, so that its memory does not follow the texts of a task."""

import pandas as pd
from pyspark.sql import functions as F

from rosterlake.functions import automaton


def test_batches_of_texts_are_small(spark):
    names = list(automaton.BATCH)
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "10000")
        spark.conf.set(names[1], str(64 << 20))
        rows = spark.range(0, 6000, 1, 1).select("id", F.repeat(F.lit("needle and hay "), F.when(F.col("id") < 500, 6000).otherwise(1)).alias("text"))
        found = rows.select("id", automaton.found(F.col("text"), ["hay", "needle", "pin"]).alias("found"))
        sizes = F.pandas_udf(lambda t: pd.Series([f"{len(t)} {t.str.len().sum()}"] * len(t)), "string")
        got = [tuple(map(int, r[0].split())) for r in rows.select(sizes("text")).distinct().collect()]
        assert max(n for n, _ in got) <= 1024 and max(b for _, b in got) <= 2 * (8 << 20)
        assert found.filter(F.col("found") == F.array(F.lit("hay"), F.lit("needle"))).count() == 6000
        automaton.small_batches()
        spark.conf.set(names[0], "100")
        spark.conf.set(names[1], "1m")
        automaton.small_batches()
        assert [spark.conf.get(n) for n in names] == ["100", "1m"]
    finally:
        for n in names:
            spark.conf.set(n, before[n])
