import random

import pytest
from pyspark.sql import functions as F

from rinse import (
    ROW_ID,
    RinseError,
    Stats,
    count_result,
    find_replace,
    number_rows,
    number_rows_by,
    page_index,
    read_page,
    read_page_of,
    sample_values,
    with_row_id,
    write_counted,
)
from rinse.operators import paging
from rinse.operators.footers import read_offsets, write_offsets
from rinse.operators.lookup import fits_broadcast, hot_keys, lookup
from rinse.operators.paging import clamp_page_size, id_range, offsets_of, total_pages
from rinse.session import scratch, stored
from tests.conftest import values

def tasks_with(*sizes: int) -> list[tuple]:
    """Rows as tasks number them, a third of them hits; every task has ids of its own."""
    return [(task * 2**33 + at, f"{task}/{at}", (task + at) % 3 == 0) for task, size in enumerate(sizes) for at in range(size)]


SCHEMA = f"{ROW_ID} long, place string, __matched boolean"


@pytest.fixture(scope="module")
def result(spark):
    return stored(spark.createDataFrame(tasks_with(4, 0, 1, 7), SCHEMA).repartition(3), "parts")


@pytest.mark.parametrize("size", [1, 5, 11, 12, 13])
def test_pages_cover_the_rows_in_order(result, size):
    rows = [(at, hit, place) for at, (_, place, hit) in enumerate(tasks_with(4, 0, 1, 7), 1)]
    pages = -(-len(rows) // size)
    offsets = offsets_of(result)
    for page in range(1, pages + 2):
        found = read_page(result, page, size, offsets if page % 2 else None)
        assert values(found.rows) == rows[(page - 1) * size : page * size]
        assert found.rows.columns == ["row_number", "__matched", "place"]
        assert (found.columns, found.total_rows, found.total_pages) == (["place"], len(rows), pages)
    assert values(read_page(result, -3, size).rows) == rows[:size]


def test_sizes_of_pages(result):
    for asked, given in ((-7, 1), (0, 1), (1, 1), (499, 499), (500, 500), (9_999, 500)):
        assert clamp_page_size(asked) == read_page(result, 1, asked).page_size == given
    for rows in range(30):
        assert total_pages(rows, 7) == max(1, len(range(0, rows, 7)))
    assert read_page(result.limit(0), 1, 50).total_pages == 1


# offsets from footers


def kept_result(spark, rows, files, **options):
    """A result as tasks write it, with the offsets beside it."""
    path = scratch(spark, "kept")
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartitionByRange(files, ROW_ID).sortWithinPartitions(ROW_ID).write.options(**options).parquet(path)
    write_offsets(spark, path)
    return path


def test_pages_by_footers(spark):
    rows = tasks_with(40, 0, 3, 1, 90)
    path = kept_result(spark, rows, 4, **{"parquet.block.row.count.limit": 7})
    ranges = read_offsets(spark, path).orderBy("low").collect()
    assert len(ranges) > 15 and all(one.fit and one.rows <= 7 for one in ranges)
    assert [one.before for one in ranges] == [sum(o.rows for o in ranges[:at]) for at in range(len(ranges))]
    assert spark.read.parquet(path).count() == len(rows)
    for size in (1, 7, 50, 134, 500):
        pages = -(-len(rows) // size)
        for page in {1, 2, pages // 2 + 1, pages, pages + 1}:
            found = read_page_of(spark, path, page, size)
            wanted = rows[(page - 1) * size : page * size]
            assert values(found.rows) == [((page - 1) * size + at, hit, place) for at, (_, place, hit) in enumerate(wanted, 1)]
            assert (found.total_rows, found.total_pages) == (len(rows), pages)


def test_a_page_reads_its_files_only(spark):
    path = kept_result(spark, tasks_with(50, 50, 50, 50), 4)
    page = read_page_of(spark, path, 20, 10)
    assert len(page.rows.inputFiles()) == 1
    plan = page.rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(__row_id), GreaterThanOrEqual(__row_id" in plan and "Window" not in plan


@pytest.mark.parametrize("broken", ["gaps", "overlap", "no statistics", "nothing kept"])
def test_pages_where_footers_do_not_say(spark, broken):
    rows = tasks_with(30, 20)
    if broken == "gaps":
        rows = [row for row in rows if row[0] % 3]
    if broken == "overlap":
        path = scratch(spark, "overlap")
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
        write_offsets(spark, path)
        assert not all(row.fit for row in read_offsets(spark, path).collect())
    elif broken == "nothing kept":
        path = scratch(spark, "none")
        spark.createDataFrame(rows, SCHEMA).write.parquet(path)
        assert read_offsets(spark, path) is None
    else:
        options = {f"parquet.column.statistics.enabled#{ROW_ID}": "false"} if broken == "no statistics" else {}
        path = kept_result(spark, rows, 2, **options)
    found = read_page_of(spark, path, 2, 9)
    assert values(found.rows) == [(9 + at, hit, place) for at, (_, place, hit) in enumerate(rows[9:18], 1)]
    assert found.total_rows == len(rows)


def test_a_run_leaves_offsets_and_replaces_them(spark):
    path = scratch(spark, "run")
    for many in (25, 10, 0):
        table = with_row_id(spark.range(many).select(F.col("id").cast("string").alias("v")))
        write_counted(find_replace(table, ["v"], "1", "x"), path)
        found = read_page_of(spark, path, 1, 20)
        assert found.total_rows == many and len(found.rows.collect()) == min(many, 20)
        assert found.rows.columns == ["row_number", "__matched", "v"]


def random_ids(seed: int, count: int) -> list[int]:
    """Ids of several tasks, some with gaps, one task with most of the rows."""
    draw = random.Random(seed)
    ids = set(range(5 * 2**33, 5 * 2**33 + count))
    for task in (0, 1, 2, 9, 4000):
        kept = draw.choice([1, 1, 2, 300_000])
        ids.update(task * 2**33 + at * kept for at in range(draw.randint(1, 60)))
    return sorted(draw.sample(sorted(ids), len(ids) - draw.choice([0, 1, 40])))


@pytest.mark.parametrize("seed", range(4))
def test_numbers_and_pages_against_brute_force(spark, seed):
    ids = random_ids(seed, 300)
    df = spark.createDataFrame([(one, str(one)) for one in ids], f"{ROW_ID} long, v string")
    df = stored(df.repartition(3), "random")
    wanted = [(at + 1, one, str(one)) for at, one in enumerate(ids)]
    assert sorted(values(number_rows(df))) == wanted
    size = 37
    pages = [ids[at : at + size] for at in range(0, len(ids), size)]
    index = sorted(values(page_index(df, size)))
    assert index == [(at + 1, p[0], p[-1], len(p)) for at, p in enumerate(pages)]
    for at in (0, 3, len(pages) - 1):
        rows = values(read_page(df, at + 1, size).rows)
        assert rows == [(at * size + n + 1, str(one)) for n, one in enumerate(pages[at])]


def test_numbers_by_key_with_a_hot_key(spark):
    rows = [(0 if at % 3 else at, at) for at in range(400)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    found = sorted(values(number_rows_by(df, ["k", F.desc("v")])))
    wanted = sorted(rows, key=lambda row: (row[0], -row[1]))
    assert [(k, v) for _, k, v in found] == wanted
    assert [n for n, _, _ in found] == list(range(1, 401))


@pytest.fixture
def as_planned(spark):
    """Small partitions stay apart, so a test can see where rows go."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def test_numbers_by_a_key_that_all_rows_share(spark, monkeypatch, as_planned):
    rows = spark.range(0, 3000, 1, 3).select(F.lit("same").alias("k"), F.col("id").alias("v"))
    written = []
    keep = paging.stored
    monkeypatch.setattr(paging, "stored", lambda df, label: written.append(keep(df, label)) or written[-1])
    found = number_rows_by(rows, ["k"])
    assert all(row["v"] + 1 == row["row_number"] for row in found.collect())
    tasks = written[0].groupBy(F.shiftright(ROW_ID, 33)).count()
    assert max(row["count"] for row in tasks.collect()) < 1500, "the sort must split equal keys"


def test_ids_of_a_split_file_follow_the_rows(spark, write_csv):
    path = write_csv("ID,Email\n" + "".join(f"{i},user{i}@example.com\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = with_row_id(spark.read.option("header", True).csv(path))
        assert df.rdd.getNumPartitions() > 4
        written = stored(df, "split")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    ids = [int(row["ID"]) for row in written.orderBy(ROW_ID).collect()]
    assert ids == list(range(5000))
    assert sorted(int(row["ID"]) + 1 - row["row_number"] for row in number_rows(written).collect())[::4999] == [0, 0]


def test_id_range_reaches_the_scan(result):
    plan = id_range(result, 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual({ROW_ID},1)" in plan and f"LessThanOrEqual({ROW_ID},2)" in plan


def test_numbering_does_not_shuffle_rows(spark):
    written = stored(with_row_id(spark.range(1000).toDF("v")), "plain")
    plan = number_rows(written)._jdf.queryExecution().executedPlan().toString()
    join, below = plan.split("BroadcastHashJoin [bucket", 1)[1].split("\n", 2)[:2]
    assert "LeftOuter" in join and "Project" in below, "the rows must reach the join as read"


# --- counts -----------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("emails", "wanted"), [(["a@example.com", "not an email", None], (3, 1)), ([], (0, 0))]
)
def test_counts_during_the_write_and_after(spark, emails, wanted):
    df = spark.createDataFrame([(one,) for one in emails], "Email string")
    path = scratch(spark, "counts")
    stats = write_counted(find_replace(df, ["Email"], "@", " at "), path)
    assert stats == Stats(*wanted)
    assert values(count_result(spark, path)) == [wanted]
    again = write_counted(find_replace(df, ["Email"], "@", " at "), path)
    assert again == stats and spark.read.parquet(path).count() == wanted[0]


def test_counting_reads_one_column(spark, result):
    path = scratch(spark, "flags")
    result.write.parquet(path)
    plan = count_result(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<__matched:boolean>" in plan


# --- samples ----------------------------------------------------------------------------


def test_samples_in_the_order_asked_for(spark, table):
    rows = [("a", "x"), ("a", None), (" ", "y"), ("b", "x"), ("c", "z")]
    df = table(["First", "Second"], *rows).coalesce(1)
    wanted = [("Second", ["x", "y"]), ("First", ["a", "b"])]
    assert values(sample_values(df, ["Second", "First"], 2)) == wanted
    keyed = df.withColumn("key", F.monotonically_increasing_id()).repartition(3)
    assert values(sample_values(keyed, ["Second", "First"], 2, order_by="key")) == wanted


def test_samples_stop_after_some_rows_and_cut_values(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("v"), "id")
    for order in (None, "id"):
        [(_, found)] = values(sample_values(df, ["v"], 20, 10, order_by=order))
        assert found == [str(at) for at in range(10)]
    long = spark.createDataFrame([(" " + "x" * 500 + "\n",), ("é" * 199 + " y",)], "v string")
    [(_, cut)] = values(sample_values(long.coalesce(1), ["v"]))
    assert cut == ["x" * 200, "é" * 199 + " "]


def test_samples_of_nothing(spark, table):
    assert values(sample_values(table(["a", "b"]), ["b", "a"])) == [("b", []), ("a", [])]
    with pytest.raises(RinseError):
        sample_values(table(["a"]), ["z"])


# --- lookups ----------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [0, 10**6])
def test_lookup_with_a_hot_key(spark, limit):
    rows = spark.range(900).select(
        F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k")
    )
    answers = spark.createDataFrame([(7, "hot"), (10, "ten"), (5000, "none")], "k long, a string")
    found = lookup(rows, answers, "k", limit, per_task=50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan or "ShuffledHashJoin" in plan) == (not limit)
    wanted = sorted((7 if n % 3 == 0 else n, n) for n in range(900))
    got = sorted(values(found), key=lambda row: (row[0], row[1]))
    assert [(k, n) for k, n, _ in got] == wanted
    assert all(a == {7: "hot", 10: "ten"}.get(k) for k, _, a in got)


def test_hot_keys_are_few_and_spread(spark, as_planned):
    keys = F.when(F.col("id") < 400, "hot").otherwise(F.col("id").cast("string"))
    rows = spark.range(0, 1000, 1, 8).select(keys.alias("k"))
    assert hot_keys(rows, "k", 100) == {"hot": 4}
    answers = spark.createDataFrame([("hot", 1), ("999", 2)], "k string, a long")
    found = lookup(rows, answers, "k", limit=0, per_task=100)
    assert found.count() == 1000 and found.where("a = 2").count() == 1
    spread = found.groupBy(F.spark_partition_id().alias("task"), "k", "a").count().where("k = 'hot'")
    counts = [row["count"] for row in spread.collect()]
    assert sum(counts) == 400 and len(counts) > 1


def test_lookup_of_rows_without_a_key(spark):
    rows = spark.range(0, 300, 1, 4).select("id", F.when(F.col("id") < 5, "a").alias("k"))
    answers = spark.createDataFrame([("a", 1), (None, 2)], "k string, a long")
    for limit in (0, 10**6):
        found = {row["id"]: row["a"] for row in lookup(rows, answers, "k", limit).collect()}
        assert found == {n: 1 if n < 5 else None for n in range(300)}


def test_measuring_a_table(spark):
    df = spark.createDataFrame([("x" * 1000, [1, 2])], "s string, a array<int>")
    assert not fits_broadcast(df, 1000) and fits_broadcast(df, 2000)
    assert fits_broadcast(df.limit(0), 0)
