import pytest
from pyspark.sql import functions as F

from rinse import (
    RinseError,
    clean_stream,
    csv_stream,
    find_replace,
    mask,
    windowed_matches,
    with_row_id,
)
from rinse.session import scratch
from rinse.streaming.streams import (
    clean_stream_counted,
    cleaned_rows,
    dropped_groups,
    keep_windows,
    kept_windows,
    stream_stats,
)
from tests.conftest import values


def test_a_restarted_stream_takes_each_file_once(spark, tmp_path):
    output, checkpoint = scratch(spark, "stream"), scratch(spark, "checkpoint")
    seen = []

    def finish():
        stream = csv_stream(spark, str(tmp_path), ["ID", "Email"], max_files=1)
        build = lambda df: mask(df, {"Email": ["email"]})
        query = clean_stream(stream, build, output, checkpoint)
        query.awaitTermination()
        seen.extend(dict(one.observedMetrics)["counts"] for one in query.recentProgress if one.numInputRows)
        return sorted(values(spark.read.parquet(output)))

    (tmp_path / "a.csv").write_text("ID,Email\n1,a@x.org\n2,\n")
    (tmp_path / "notes.txt").write_text("ID,Email\n9,z@x.org\n")
    assert finish() == [("1", "a***@x.org", True), ("2", None, False)]
    (tmp_path / "b.csv").write_text("ID,Email\n3,none\n")
    assert finish()[2] == ("3", "none", False)
    assert len(finish()) == 3
    assert [tuple(one) for one in seen] == [(2, 1), (1, 0)]


def test_rules_are_the_same_on_both(spark, tmp_path):
    (tmp_path / "a.csv").write_text("v\nab\nb\n")
    stream = csv_stream(spark, str(tmp_path), ["v"])
    assert stream.isStreaming
    output = scratch(spark, "stream")
    query = clean_stream(
        stream, lambda df: find_replace(df, ["v"], "a", "$1"), output, scratch(spark, "checkpoint")
    )
    query.awaitTermination()
    batch = find_replace(spark.read.option("header", True).csv(str(tmp_path)), ["v"], "a", "$1")
    assert sorted(values(spark.read.parquet(output))) == sorted(values(batch))


def test_no_row_ids_on_streams(spark, tmp_path):
    stream = csv_stream(spark, str(tmp_path), ["__row_id"])
    with pytest.raises(RinseError):
        clean_stream(stream, lambda df: df, "unused", "unused")
    with pytest.raises(Exception, match="(?i)monotonically|streaming"):
        with_row_id(csv_stream(spark, str(tmp_path), ["v"])).writeStream.format("noop").start()


def test_windows(spark):
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "b"), ("2024-01-01 01:00:00", None)]
    df = spark.createDataFrame(rows, "ts string, v string").withColumn("ts", F.to_timestamp_ntz("ts"))
    found = windowed_matches(df, "ts", F.col("v").rlike("a"), "1 hour", lateness="5 minutes")
    shown = found.select(F.date_format("start", "HH:mm"), "rows", "matched")
    assert sorted(values(shown)) == [("00:00", 2, 1), ("01:00", 1, 0)]


def events_of(spark, rows):
    return spark.createDataFrame(rows, "ts string, v string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_rows_after_the_watermark_are_dropped(spark):
    folder, output, checkpoint = (scratch(spark, name) for name in ("events", "windows", "checkpoint"))
    arrivals = [
        [("2024-01-01 00:10:00", "a"), ("2024-01-01 05:00:00", "b")],
        # the watermark is at 03:00: the first row is too late, the others are not
        [("2024-01-01 00:20:00", "a"), ("2024-01-01 02:59:00", "b"), ("2024-01-01 03:30:00", "a")],
        [("2024-01-01 05:10:00", "a")],
    ]
    dropped = 0
    for rows in arrivals:
        events = events_of(spark, rows)
        events.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        query = keep_windows(windowed_matches(stream, "ts", F.col("v") == "a", "1 hour", "2 hours"), output, checkpoint)
        query.awaitTermination()
        dropped += dropped_groups(query)
    shown = kept_windows(spark, output).select(F.date_format("start", "HH:mm"), "rows", "matched")
    assert sorted(values(shown)) == [("00:00", 1, 1), ("03:00", 1, 1), ("05:00", 2, 1)]
    assert dropped == 2  # 00:20 and 02:59, whose windows end at or before the watermark


def test_counts_of_batches_stay_right_when_one_is_repeated(spark, tmp_path):
    places = [scratch(spark, name) for name in ("stream", "stats", "checkpoint")]
    build = lambda df: find_replace(df, ["v"], "a", "b")

    def finish(places):
        clean_stream_counted(csv_stream(spark, str(tmp_path), ["v"]), build, *places).awaitTermination()

    (tmp_path / "1.csv").write_text("v\na\nc\n")
    finish(places)
    (tmp_path / "2.csv").write_text("v\nxax\n")
    finish(places)
    finish(places)
    assert sorted(values(stream_stats(spark, places[1]))) == [(0, 2, 1), (1, 1, 1)]
    # the same input once more, as after a failure before the end of a batch
    finish([*places[:2], scratch(spark, "checkpoint")])
    found = values(stream_stats(spark, places[1]))
    assert (0, 3, 2) in found and sorted(values(cleaned_rows(spark, places[0]))).count(("b", True)) == 1
    with pytest.raises(RinseError):
        clean_stream_counted(csv_stream(spark, str(tmp_path), ["__row_id"]), build, *places)
