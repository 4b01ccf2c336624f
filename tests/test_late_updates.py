"""Updates refused by state, with a restart between batches, against one pass over all of them."""

import random

from pyspark.sql import functions as F

from tidemark.operators import nowcast
from tidemark.streaming import late

SCHEMA = "block string, sent long, new_date string, new_yoy double"


def updates(n, seed):
    r = random.Random(seed)
    date = lambda i: r.choice([f"20{20 + i // 60}-{r.randint(5, 6):02d}", f"20{20 + i // 60}-06", f"20{20 + i // 80}-01", "2022-13", None, "1999-01"])
    return [(r.choice("abcd"), i, date(i), r.choice([r.uniform(-25, 35), 5.0, None, float("nan")])) for i in range(n)]


def run(spark, source, out, checkpoint):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
    late.judged(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def plain(rows):
    out, last = [], {}
    for block, sent, date, value in rows:
        why = late.refusal(date, value, last.get(block))
        if why is None:
            last[block] = (date, round(value, 4))
        out.append((block, sent, why is None, why, *last.get(block, (None, None))))
    return sorted(out)


def test_state_holds_across_batches_and_restarts(spark, tmp_path):
    rows, source, out, checkpoint = updates(300, 3), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    for part in (rows[:120], rows[120:121], rows[121:]):  # the query ends and starts again between them
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(source)
        run(spark, source, out, checkpoint)
    got = [(r.block, r.sent, r.taken, r.reason, r.latest_date, r.latest_yoy) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == plain(rows) and {r[3] for r in got} == {None, "invalid month", "date regression", "implausible growth", "same-month revision too large"}
    run(spark, source, out, checkpoint)  # nothing new: nothing is judged twice
    assert spark.read.parquet(out).count() == 300


def test_rules_are_those_of_the_batch(spark):
    rows = [(d, v) for d in ("2026-06", "2026-05", "2026-07", "2026-13", None) for v in (5.0, -20.0, -20.01, 30.0, 30.01, 10.0, 10.01, float("nan"), float("inf"), None)]
    df = spark.createDataFrame(rows, "d string, v double").select("d", "v", nowcast.refusal(F.lit("2026-06"), F.lit(5.0), F.col("d"), F.col("v")).alias("r"))
    assert [r.r for r in df.collect()] == [late.refusal(d, v, ("2026-06", 5.0)) for d, v in rows]
