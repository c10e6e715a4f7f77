"""Rates, early stops and keyed state of streams."""

import json
import os
import random
import tempfile
from collections import defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioworks.operators import pacing
from folioworks.operators.scan import ordered_scan
from folioworks.streaming import ingest


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-")


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    Path(folder, name).write_text(text)


@pytest.mark.parametrize("rows_per_block", [None, 40])
def test_climbs_equal_a_loop(spark, rows_per_block):
    rng = random.Random(5)
    steps = {"a": 7, "b": 0, "c": 1000, None: 3}
    rows = [(k, rng.randrange(2000), i, steps[k]) for i, k in enumerate(rng.choices(list(steps), [6, 2, 1, 1], k=700))]
    df = spark.createDataFrame(rows, "k string, v long, i long, step long").repartition(4)
    got = ordered_scan(
        df, ["k"], ["v", "i"], {"n": F.lit(1)}, {"before": "i"}, rows_per_block, {"at": (F.col("v"), F.col("step"))}
    )
    want, last, count = {}, {}, defaultdict(int)
    for k, v, i, step in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        last[k] = v if k not in last else max(v, last[k] + step)
        count[k] += 1
        want[i] = (last[k], count[k])
    assert {r["i"]: (r["at"], r["n"]) for r in got.collect()} == want


def test_rates_and_missing_values(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", t, 1), ("a", t, 2), ("a", None, 3), ("a", t + timedelta(seconds=90), 4), ("b", t, 5), ("b", t, 6)]
    df = spark.createDataFrame(rows, "k string, at timestamp, i int")
    rate = F.when(F.col("k") == "a", 1.0)
    got = pacing.rate_schedule(df, ["k"], "at", ["at", "i"], rate).collect()
    assert {r["i"]: r["waited"] for r in got} == {1: 0.0, 2: 60.0, 3: None, 4: 30.0, 5: 0.0, 6: 0.0}
    assert {r["i"]: r["admitted"] for r in got}[4] == t + timedelta(seconds=120)
    assert pacing.rate_schedule(df.where("false"), ["k"], "at", ["at", "i"], rate).count() == 0


def test_results_stop_early_and_go_on(spark, folder):
    src, out, ck = folder + "/in", folder + "/out", folder + "/ck"
    bad = {0: 0, 1: 1, 2: 3, 3: 0, 4: 4, 5: 0}  # rows of four that fail
    for n, fails in bad.items():
        put(src, f"{n}.json", "".join(json.dumps({"n": 10 * n + i, "ok": i >= fails}) + "\n" for i in range(4)))
        os.utime(f"{src}/{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))

    def run():
        rows = spark.readStream.schema("n int, ok boolean").option("maxFilesPerTrigger", 1).json(src)
        done = ingest.save_until(rows, out, ck, ~F.col("ok"), most_failed=0.5)
        return done, sorted(r["n"] for r in ingest.read_batches(spark, out).collect())

    def upto(n):
        return [10 * k + i for k in range(n + 1) for i in range(4)]

    assert run() == (False, upto(2))
    assert run() == (False, upto(4))
    assert run() == (True, upto(5))
    assert run() == (True, upto(5))


def test_failures_that_are_no_stop_are_raised(spark, folder):
    put(folder + "/in", "1.json", '{"n": 1}\n')
    rows = spark.readStream.schema("n int").json(folder + "/in")
    broken = rows.select(F.raise_error(F.lit("broken input")).cast("int").alias("n"))
    with pytest.raises(Exception, match="broken input"):
        ingest.save_until(broken, folder + "/out", folder + "/ck", F.col("n") > 0, 0.5)


def test_a_batch_reads_nothing_of_earlier_ones(spark, folder):
    """Results of earlier batches are overwritten with junk: later ones still know what is done and what failed."""
    src, out = folder + "/in", folder + "/out"
    asked = folder + "/asked"

    def extractor(text, schema):
        with open(asked, "a") as f:
            f.write(text + "\n")
        if text == "bad" and open(asked).read().count("bad") < 3:
            raise ValueError("no answer")
        return "{}"

    def run(n, ids):
        put(src, f"{n}.json", "".join(json.dumps({"id": i, "chunk_text": i}) + "\n" for i in ids))
        chunks = spark.readStream.schema("id string, chunk_text string").json(src)
        ingest.extract_pending(chunks, out, folder + "/ck", "RemedyRecipe", extractor).awaitTermination()
        rows = spark.read.parquet(f"{out}/batch={n}").collect()
        for file in Path(out).rglob("*.parquet"):
            file.write_bytes(b"junk")
        return sorted((r["id"], r["data"] is not None, r["error"]) for r in rows)

    assert run(0, ["a", "bad"]) == [("a", True, None), ("bad", False, "no answer")]
    assert run(1, ["a", "b"]) == [("b", True, None), ("bad", False, "no answer")]
    assert run(2, ["bad", "a"]) == [("bad", True, None)]
    assert run(3, ["bad", "c"]) == [("c", True, None)]
    assert sorted(open(asked).read().split()) == ["a", "b", "bad", "bad", "bad", "c"]


def test_first_of_each_key_within_the_delay(spark, folder):
    """Repeats go while their key is remembered, late rows go, forgotten and NULL-key rows come again."""
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    loads = [
        [("a", at(0)), ("a", at(0)), ("b", at(100)), (None, at(90))],
        [("a", at(95)), ("b", at(101)), ("c", at(80)), (None, at(99)), ("d", at(200))],
        [("b", at(250)), ("c", at(150)), ("d", at(205))],
    ]
    for rows in loads:
        spark.createDataFrame(rows, "k string, at timestamp").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("k string, at timestamp").parquet(f"{folder}/in")
        ingest.append_first(
            stream, f"{folder}/out", f"{folder}/checkpoint", ["k"], "at", "10 seconds"
        ).awaitTermination()
    got = sorted(((r["k"] or "", r["at"]) for r in ingest.read_batches(spark, f"{folder}/out").collect()))
    # The watermark is 90 before the second load and 190 before the third: c at 80 and at 150 are late.
    assert got == [("", at(90)), ("a", at(0)), ("a", at(95)), ("b", at(100)), ("b", at(250)), ("d", at(200))]
