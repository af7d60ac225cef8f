"""The store of answers: versions, fitness, buckets, and what of it a lookup moves."""

import random

import pytest
from pyspark.sql import functions as F

from rinse.errors import RinseError
from rinse.plans.answers import AnswerStore
from rinse.session import scratch
from tests.conftest import values


def batch(spark, rows):
    return spark.createDataFrame(rows, "fingerprint string, answer string, state string, extra int")


def test_the_latest_fit_entry_holds(spark):
    path = scratch(spark, "answers")
    store = AnswerStore(spark, path, ["answer", "state"], buckets=4)
    requests = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4), ("c", 5)], "fingerprint string, n int")
    assert sorted(values(store.unknown(requests))) == [("a", 2), ("b", 1), ("c", 1)]
    store.append(batch(spark, [("a", "a1", "good", 0), ("b", "b1", "good", 0), (None, "x", "good", 0)]), 1)
    store.append(batch(spark, [("a", "a2", "bad", 0), ("c", None, "good", 0)]), 2)
    store.append(batch(spark, [("a", "a2", "bad", 0), ("c", None, "good", 0)]), 2)  # a run that was repeated
    fit = F.col("state") == "good"
    again = AnswerStore(spark, path, ["answer", "state"], buckets=4)
    found = sorted(values(again.answer(requests, fit=fit).select("n", "answer", "version", "cached")))
    assert found == [(1, "a1", 1, True), (2, "b1", 1, True), (3, "a1", 1, True), (4, None, None, False), (5, None, 2, True)]
    assert sorted(values(again.latest())) == [("a", 2, "a2", "bad"), ("b", 1, "b1", "good"), ("c", 2, None, "good")]
    assert sorted(values(again.unknown(requests, oldest=2, fit=fit))) == [("a", 2), ("b", 1)]
    assert again.entries().count() == 6


def test_another_session_and_refused_names(spark):
    path = scratch(spark, "answers")
    store = AnswerStore(spark, path, ["answer"], buckets=3)
    store.append(batch(spark, [("a", "x", "", 0)]), 7)
    other = AnswerStore(spark.newSession(), path, ["answer"], buckets=3)
    assert values(other.latest()) == [("a", 7, "x")]
    with pytest.raises(RinseError):
        AnswerStore(spark, path, ["answer", "version"])


def test_a_lookup_does_not_shuffle_the_store(spark):
    store = AnswerStore(spark, scratch(spark, "answers"), ["answer"], buckets=4)
    for version in range(3):
        store.append(batch(spark, [(str(at), f"{version}", "", 0) for at in range(50)]), version)
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            requests = spark.range(90).select(F.col("id").cast("string").alias("fingerprint"))
            plan = store.unknown(requests)._jdf.queryExecution().executedPlan().toString()
            lines = plan.split("\n")
            scan = next(at for at, line in enumerate(lines) if "Bucketed: true" in line)
            depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
            above, level = [], depth(lines[scan])
            for line in reversed(lines[:scan]):
                if depth(line) < level:
                    above.append(line)
                    level = depth(line)
            assert not any("Exchange" in line for line in above[: next(at for at, line in enumerate(above) if "Join" in line)])
            assert store.unknown(requests).count() == 40
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_random_batches_against_a_dictionary(spark):
    rng = random.Random(3)
    store, known = AnswerStore(spark, scratch(spark, "answers"), ["answer", "state"], buckets=2), {}
    for version in (4, 1, 3):
        rows = {rng.choice("abcdefgh"): (f"{version}{rng.random()}", rng.choice(["good", "bad"])) for _ in range(5)}
        store.append(batch(spark, [(key, *entry, 0) for key, entry in rows.items()]), version)
        for key, (answer, state) in rows.items():
            if state == "good" and version >= 2:
                known.setdefault(key, []).append((version, answer))
    requests = spark.createDataFrame([(key,) for key in "abcdefghij" * 3], "fingerprint string")
    for limit in (0, 1 << 20):
        found = store.answer(requests, oldest=2, fit=F.col("state") == "good", limit=limit)
        assert sorted(values(found.select("fingerprint", "version", "answer", "cached")), key=repr) == sorted(
            [(key, *max(known.get(key, [(None, None)])), key in known) for key in "abcdefghij" * 3], key=repr
        )
