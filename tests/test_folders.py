"""Folders of CSV files: headers that differ, and the beginnings of files."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from rinse.errors import RinseError
from rinse.sources.beginnings import BYTES, beginnings, column_names, first_lines, header_lines
from rinse.sources.catalogue import file_beginnings, preview_folder
from rinse.sources.tables import files_below, read_csv, read_csv_folder, read_folder
from tests.conftest import values


def rows_by_name(df, names):
    return sorted((tuple(row[name] for name in names) for row in df.collect()), key=repr)


def test_files_are_put_together_by_name(spark, tmp_path, write_csv):
    (tmp_path / "deep [1]{a}").mkdir()
    write_csv("ID,V\n1,a\n2,\n", "one.csv")
    write_csv("V,ID,W\r\nb,3,x\r\n", "deep [1]{a}/two*.CSV")
    write_csv('"ID","V"\n4,"c, ""d"""\n', "three.csv")
    write_csv("id,w\n5,y\n", "four.csv")
    write_csv("ID,Z\n", "no rows.csv")
    write_csv("", "empty.csv")
    write_csv("ID,V\n9,no\n", "notes.txt")
    whole = read_folder(spark, str(tmp_path))
    assert sorted(name.upper() for name in whole.columns) == ["ID", "V", "W", "Z"]
    assert rows_by_name(whole, ["ID", "V", "W", "Z"]) == sorted(
        [("1", "a", None, None), ("2", None, None, None), ("3", "b", "x", None), ("4", 'c, "d"', None, None), ("5", None, "y", None)], key=repr
    )


def test_one_header_is_one_scan(spark, tmp_path, write_csv):
    for at in range(5):
        write_csv(f"a,b\n{at},x\n", f"{at}.csv")
    plan = read_csv_folder(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "Union" not in plan
    write_csv("b,a\nx,5\n", "5.csv")
    whole = read_csv_folder(spark, str(tmp_path))
    assert whole._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2
    assert rows_by_name(whole, ["a", "b"]) == [(str(at), "x") for at in range(6)]


@pytest.mark.parametrize("line", ["a,b", "a,,b", "A,a,b", ",", '"x, y","say ""hi"""', "a,a,a", "é,b ", "\ufeffa,b"])
def test_names_are_those_of_the_reader(spark, write_csv, line):
    path = write_csv(line + "\n1,2,3\n")
    assert column_names(line.lstrip("\ufeff")) == read_csv(spark, path).columns
    [found] = header_lines(spark, files_below(spark, path, "*")).collect()
    assert found.line == line.lstrip("\ufeff") and found.path.endswith("source.csv")


def test_headers_by_the_reader_where_tasks_cannot_open_files(spark, tmp_path, write_csv, monkeypatch):
    (tmp_path / "in+put %41").mkdir()
    for at, line in enumerate(["a,b", "\ufeffb,c", "\n\na,b"]):
        write_csv(line + "\n1,2\n" * 50, f"in+put %41/{at}.csv")
    files = files_below(spark, str(tmp_path), "*.csv")
    wanted = sorted(map(tuple, header_lines(spark, files).collect()))
    monkeypatch.setattr("rinse.sources.beginnings.in_reach", lambda path: False)
    assert sorted(map(tuple, header_lines(spark, files).collect())) == wanted


def test_what_is_read_does_not_grow_with_the_file(spark, tmp_path):
    for name, lines in (("short", 5), ("long", 200_000)):
        (tmp_path / f"{name}.csv").write_text("n,word\n" + "".join(f"{at},{'w' * (at % 30)}\n" for at in range(lines)))
    found = {row.path.rsplit("/", 1)[1]: row for row in file_beginnings(spark, str(tmp_path), 4).collect()}
    assert found["short.csv"].bytes_read == found["short.csv"].length < 100
    assert found["long.csv"].bytes_read == BYTES < found["long.csv"].length
    assert found["long.csv"].lines == ["n,word", "0,", "1,w", "2,ww"]
    shown = preview_folder(spark, str(tmp_path), 3)
    assert values(shown.where(F.col("file").endswith("long.csv")).orderBy("row").select("row", "n", "word")) == [
        (1, "0", None), (2, "1", "w"), (3, "2", "ww"),
    ]


def test_first_lines_of_any_bytes():
    rng = random.Random(11)
    for _ in range(300):
        data = "".join(rng.choice(["a", "é", "\n", "\r\n", "\r", " ", "bc"]) for _ in range(rng.randint(0, 60))).encode()
        size = rng.randint(1, 40)
        lines, used = first_lines(io.BytesIO(data), len(data), 3, size)
        every = [line for line in data.decode().replace("\r\n", "\n").replace("\r", "\n").split("\n") if line.strip()]
        assert lines == every[: len(lines)]
        assert used <= max(size, len(data))
        if len(data) <= size:
            assert lines == every[:3]
        assert lines or not every


def test_previews_of_files_that_differ(spark, tmp_path, write_csv):
    write_csv('a,b\n1,"x, y"\n2\n3,z,more\n', "one.csv")
    write_csv("b,c\nq,r\n", "two.csv")
    write_csv("", "empty.csv")
    shown = preview_folder(spark, str(tmp_path), 2).orderBy("file", "row")
    assert values(shown.select("row", "a", "b", "c")) == [(1, "1", "x, y", None), (2, "2", None, None), (1, None, "q", "r")]
    with pytest.raises(RinseError):
        preview_folder(spark, str(tmp_path / "none"))


def test_random_tables_come_back(spark, tmp_path):
    rng, wanted = random.Random(5), []
    for at in range(12):
        names = rng.sample(["p", "q", "r", "s"], rng.randint(1, 4))
        with open(tmp_path / f"{at}.csv", "w", newline="") as file:
            out = csv.writer(file)
            out.writerow(["id", *names])
            for row in range(rng.randint(0, 5)):
                cells = [rng.choice(["x", "a,b", 'say "x"', "ü"]) for _ in names]
                out.writerow([f"{at}-{row}", *cells])
                wanted.append((f"{at}-{row}", *(dict(zip(names, cells)).get(name) for name in "pqrs")))
    assert rows_by_name(read_csv_folder(spark, str(tmp_path)), ["id", "p", "q", "r", "s"]) == sorted(wanted, key=repr)


def test_beginnings_of_no_files(spark, tmp_path):
    assert beginnings(files_below(spark, str(tmp_path), "*.csv"), 3).count() == 0


def test_short_files_are_written_by_several_tasks(spark, tmp_path):
    from types import SimpleNamespace

    from rinse.queries.files import _by_chunk

    customer = spark.range(1200).selectExpr("id c_custkey", "concat('Customer', id) c_name")
    rows = _by_chunk(SimpleNamespace(spark=spark, customer=customer), 60)
    rows.write.partitionBy("chunk").csv(f"{tmp_path}/chunks")
    parts = {path.name[:10] for path in tmp_path.glob("chunks/chunk=*/part-*")}
    assert len(list(tmp_path.glob("chunks/chunk=*/part-*"))) == 20 and len(parts) > 1
