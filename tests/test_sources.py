import os

import pytest
from pyspark.sql import functions as F

from rinse import (
    ROW_ID,
    Replace,
    RinseError,
    Stats,
    customers,
    file_page,
    find_replace,
    list_files,
    number_rows_of_files,
    preview,
    preview_folder,
    read_csv,
    read_folder,
    read_source,
    read_xlsx,
    round_trip,
    run,
    run_replace,
    with_row_id,
)
from rinse.queries.files import workbook
from rinse.session import scratch
from rinse.sources.catalogue import LARGEST_WORKBOOK
from rinse.sources.tables import file_type, file_type_of
from rinse.sources.workbooks import column_names
from tests.conftest import values

EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,7}\b"
BRIEF = (
    "ID,Name,Email\n1,John Doe,john.doe@example.com\n"
    "2,Jane Smith,jane_smith@domain.com\n3,Alice Brown,alice.brown@website.org\n"
)
BRIEF_ROWS = [line.split(",") for line in BRIEF.strip().split("\n")]


@pytest.fixture
def write_xlsx(tmp_path):
    def write(rows: list[list], name: str = "source.xlsx") -> str:
        path = tmp_path / name
        path.write_bytes(workbook(rows[0], rows[1:]))
        return str(path)

    return write


# --- CSV --------------------------------------------------------------------------------


def test_csv_is_all_strings_and_empty_cells_are_null(spark, write_csv):
    df = read_csv(spark, write_csv('ID,V,W\n001,1.50,"x ""y"", z"\n002,,é\n'))
    assert df.dtypes == [("ID", "string"), ("V", "string"), ("W", "string")]
    assert values(df) == [("001", "1.50", 'x "y", z'), ("002", None, "é")]


def test_byte_order_mark_is_no_part_of_the_header(spark, write_csv):
    path = write_csv("\ufeffID,V\n1,x\n")
    assert read_csv(spark, path).columns == ["ID", "V"]
    assert values(read_csv(spark, path, multi_line=True).select("ID")) == [("1",)]


def test_line_breaks_only_if_asked_for(spark, write_csv):
    path = write_csv('ID,V\n1,"a\nb"\n')
    assert values(read_csv(spark, path, multi_line=True)) == [("1", "a\nb")]
    assert read_csv(spark, path).count() == 2


def test_files_of_a_folder_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,V\n1,x\n")
    (tmp_path / "b.csv").write_text("ID,V\n2,y\n")
    assert sorted(values(read_csv(spark, str(tmp_path)))) == [("1", "x"), ("2", "y")]
    assert sorted(values(read_csv(spark, str(tmp_path)).select("V"))) == [("x",), ("y",)]
    (tmp_path / "c.csv").write_text("V,ID\nz,3\n")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(tmp_path)).collect()


def test_numbers_across_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("v\n1\n2\n")
    (tmp_path / "b.csv").write_text("v\n" + "".join(f"{n}\n" for n in range(3, 3000)))
    (tmp_path / "c.csv").write_text("v\n3000\n")
    found = number_rows_of_files(read_csv(spark, str(tmp_path)))
    assert found.columns == ["row_number", "v"]
    assert sorted(values(found)) == [(n, str(n)) for n in range(1, 3001)]


def test_missing_file(spark, tmp_path):
    with pytest.raises(RinseError) as caught:
        read_source(spark, str(tmp_path / "none.csv"))
    assert caught.value.code == "SOURCE_READ_ERROR"


def test_row_ids_refuse_reserved_names(spark):
    df = with_row_id(spark.range(3).toDF("v").coalesce(1))
    assert values(df) == [(0, 0), (1, 1), (2, 2)]
    with pytest.raises(RinseError) as caught:
        with_row_id(df)
    assert (caught.value.code, caught.value.names) == ("RESERVED_COLUMN", [ROW_ID])


PATHS = {
    "a.csv": "csv", "dir/B.CSV": "csv", "x.tar.Xlsx": "xlsx", "notes.txt": None, "csv": None,
    "dir.csv/file": None, ".csv": None, "a/.xlsx": None, "": None,
}


def test_file_types(spark):
    assert {path: file_type(path) for path in PATHS} == PATHS
    df = spark.createDataFrame([(path,) for path in PATHS], "p string")
    assert dict(values(df.select("p", file_type_of(F.col("p"))))) == PATHS
    with pytest.raises(RinseError) as caught:
        read_source(spark, "notes.txt")
    assert caught.value.code == "UNSUPPORTED_FILE_TYPE"


# --- workbooks --------------------------------------------------------------------------


def test_workbook_equals_csv(spark, write_csv, write_xlsx, tmp_path):
    results = []
    for source in (write_csv(BRIEF), write_xlsx(BRIEF_ROWS)):
        spec = Replace(source, ("Email",), EMAIL, "REDACTED", scratch(spark, "out"))
        assert run_replace(spark, spec) == Stats(3, 3)
        results.append(values(spark.read.parquet(spec.output).orderBy(ROW_ID)))
    assert results[0] == results[1]
    assert results[0][0] == (0, "1", "John Doe", "REDACTED", True)


def test_numbers_nulls_and_other_workbooks(spark, write_xlsx, tmp_path):
    path = write_xlsx([["ID", "Email"], [1, "a@example.com"], [2, None], [2.5, " <é> "]])
    wanted = [("1", "a@example.com"), ("2", None), ("2.5", " <é> ")]
    assert values(read_xlsx(spark, path)) == wanted
    write_xlsx([["Email", "More", None], ["b", "c", "cut"]], "two.XLSX")
    whole = read_xlsx(spark, str(tmp_path))
    assert whole.columns == ["ID", "Email", "More"]
    assert sorted(values(whole), key=str) == sorted([(*row, None) for row in wanted] + [(None, "b", "c")], key=str)


def test_header_names():
    assert column_names(["ID", "ID", None, "x", "", None]) == ["ID0", "ID1", "_c2", "x"]
    assert column_names([]) == []


def test_dates_and_formatted_text(spark, tmp_path):
    """What spreadsheets write themselves: styles, inline and formatted strings, gaps in rows."""
    import io
    import zipfile

    plain = zipfile.ZipFile(io.BytesIO(workbook(["a"], [["b"]])))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = {name: plain.read(name).decode() for name in plain.namelist()}
    parts["xl/styles.xml"] = (
        f'<styleSheet {main}><numFmts><numFmt numFmtId="165" formatCode="yyyy\\-mm"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="165"/></cellXfs></styleSheet>'
    )
    parts["xl/sharedStrings.xml"] = (
        f"<sst {main}><si><t>when</t></si><si><r><t>a</t></r><r><t>b</t></r>"
        "<rPh><t>no</t></rPh></si></sst>"
    )
    parts["xl/worksheets/sheet1.xml"] = (
        f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c>'
        '<c r="B1" t="inlineStr"><is><t>what</t></is></c></row>'
        '<row r="2"><c r="A2" s="1"><v>44000</v></c><c r="B2" t="s"><v>1</v></c></row>'
        '<row r="4"><c r="A4" s="2"><v>44000.5</v></c><c r="B4" t="b"><v>1</v></c></row>'
        "</sheetData></worksheet>"
    )
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as archive:
        for name, content in parts.items():
            archive.writestr(name, content)
    assert values(read_xlsx(spark, str(tmp_path / "s.xlsx"))) == [
        ("2020-06-18T00:00:00", "ab"), (None, None), ("2020-06-18T12:00:00", "True"),
    ]


def test_corrupt_workbook(spark, tmp_path):
    (tmp_path / "bad.xlsx").write_bytes(b"not a zip")
    with pytest.raises(RinseError) as caught:
        read_xlsx(spark, str(tmp_path / "bad.xlsx"))
    assert caught.value.code == "SOURCE_READ_ERROR"


def test_mixed_folder(spark, write_csv, write_xlsx, tmp_path):
    write_csv("ID,V\n1,x\n", "one.CSV")
    write_csv("ignored", "notes.txt")
    write_xlsx([["ID", "W"], [2, "y"]])
    os.makedirs(tmp_path / "deep")
    write_csv("ID,V\n3,z\n", "deep/three.csv")
    whole = read_folder(spark, str(tmp_path))
    assert whole.columns == ["ID", "V", "W"]
    assert sorted(values(whole)) == [("1", "x", None), ("2", None, "y"), ("3", "z", None)]


# --- catalogue --------------------------------------------------------------------------


def test_walking_through_a_folder_by_pages(spark, tmp_path):
    kinds = ["csv", "parquet", "XLSX", "log", "CSV"]
    for at in range(23):
        (tmp_path / f"{at * 7 % 23:02d}-report.{kinds[at % 5]}").write_bytes(b"_" * (at + 1))
    every = sorted(path.name for path in tmp_path.iterdir() if path.suffix.lower() in (".csv", ".xlsx"))
    for size in (1, 4, len(every) - 1, len(every), 100):
        seen, cursor = [], None
        while True:
            page = file_page(spark, str(tmp_path), cursor=cursor, page_size=size)
            seen.append([row["key"] for row in page.files])
            assert all(row["size"] == (tmp_path / row["key"]).stat().st_size for row in page.files)
            assert all(row["file_type"] == row["key"].rsplit(".", 1)[1].lower() for row in page.files)
            cursor = page.next_cursor
            if cursor is None:
                break
            assert cursor == seen[-1][-1]
        assert sum(seen, []) == every
        assert [len(one) for one in seen[:-1]] == [size] * (len(seen) - 1)


def test_keys_and_prefixes(spark, tmp_path):
    os.makedirs(tmp_path / "in put/deep")
    for name in ["b.xlsx", "a.csv", "in put/c+d %41.csv", "in put/deep/e.csv"]:
        (tmp_path / name).write_bytes(b"x")
    wanted = ["a.csv", "b.xlsx", "in put/c+d %41.csv", "in put/deep/e.csv"]
    for root in (str(tmp_path), f"file:{tmp_path}/", f"file://{tmp_path}"):
        assert [row["key"] for row in list_files(spark, root).orderBy("key").collect()] == wanted
    found = file_page(spark, str(tmp_path), prefix="in put/d")
    assert [row["key"] for row in found.files] == ["in put/deep/e.csv"]
    os.makedirs(tmp_path / "empty")
    assert file_page(spark, f"{tmp_path}/empty").files == []
    for size in (0, 1001):
        with pytest.raises(RinseError):
            file_page(spark, str(tmp_path), page_size=size)
    with pytest.raises(RinseError):
        list_files(spark, "relative/folder")


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x")
    plan = list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_previews(spark, write_csv, write_xlsx, tmp_path):
    for lines in (0, 1, 9, 10, 11, 400):
        squares = [(str(at), str(at * at)) for at in range(lines)]
        shown = preview(spark, write_csv("\n".join(["n,square", *map(",".join, squares)]) + "\n", f"squares-{lines}.csv"))
        assert shown.columns == ["n", "square"]
        assert values(shown) == squares[:10]
    sheet = preview(spark, write_xlsx([["code", None, "word"], [7, None, "seven"], [None, "x", None]]))
    assert sheet.columns[0::2] == ["code", "word"] or sheet.columns == ["code", "word"]
    assert values(sheet.select("code", "word")) == [("7", "seven"), (None, None)]
    empty = preview(spark, write_csv("", "empty.csv"))
    assert (empty.columns, empty.count()) == ([], 0)
    with open(tmp_path / "large.xlsx", "wb") as file:
        file.truncate(LARGEST_WORKBOOK + 1)
    for path, code in (
        ("large.xlsx", "PREVIEW_UNAVAILABLE"),
        ("none.xlsx", "SOURCE_READ_ERROR"),
        ("none.csv", "SOURCE_READ_ERROR"),
        ("notes.txt", "UNSUPPORTED_FILE_TYPE"),
    ):
        with pytest.raises(RinseError) as caught:
            preview(spark, str(tmp_path / path))
        assert caught.value.code == code


def test_previews_of_a_folder(spark, tmp_path):
    for name, start in (("a.csv", 0), ("b.csv", 100)):
        rows = "".join(f"{start + i}\n" for i in range(20))
        (tmp_path / name).write_text("v\n" + rows)
    shown = preview_folder(spark, str(tmp_path), 3).orderBy("file", "row")
    assert [(row["row"], row["v"]) for row in shown.collect()] == [
        (1, "0"), (2, "1"), (3, "2"), (1, "100"), (2, "101"), (3, "102"),
    ]


# --- runs -------------------------------------------------------------------------------


def test_runs(spark, write_csv):
    source = write_csv("ID,Email\n1,a@example.com\n2,not an email\n3,\n")
    output = scratch(spark, "run")
    for _ in range(2):
        stats = run(spark, source, output, lambda df: find_replace(df, ["Email"], EMAIL, "R"))
        assert stats == Stats(3, 1)
    out = spark.read.parquet(output)
    assert out.columns == [ROW_ID, "ID", "Email", "__matched"]
    header_only = Replace(write_csv("ID,Email\n", "h.csv"), ("Email",), EMAIL, "R", scratch(spark, "h"))
    assert run_replace(spark, header_only) == Stats(0, 0)


def test_a_missing_column_fails_before_anything_is_written(spark, write_csv):
    output = scratch(spark, "absent")
    with pytest.raises(RinseError) as caught:
        run_replace(spark, Replace(write_csv(BRIEF), ("Phone",), "x", "", output))
    assert caught.value.code == "COLUMN_NOT_FOUND"
    assert not os.path.exists(output.removeprefix("file:"))


def test_round_trip(spark, write_csv, write_xlsx):
    tables = {
        "csv": read_source(spark, write_csv(BRIEF)),
        "xlsx": read_source(spark, write_xlsx(BRIEF_ROWS)),
        "none": spark.createDataFrame([], "v string"),
    }
    rows = {row["name"]: row for row in round_trip(spark, tables, scratch(spark, "trip")).collect()}
    for name in ("csv", "xlsx"):
        assert rows[name]["columns"] == ["ID", "Name", "Email"]
        assert rows[name]["source_rows"] == rows[name]["parquet_rows"] == 3
        assert rows[name]["partitions"] >= 1
    assert rows["none"]["parquet_rows"] == 0


def test_customers(spark):
    df = customers(spark.range(1, 1001))
    assert df.columns == ["ID", "Name", "Email", "Phone", "SignupDate", "Notes"]
    rows = values(df.orderBy(F.col("ID").cast("long")))
    assert [row[1:3] for row in rows[:3]] == [
        ("John Doe", "john.doe@example.com"),
        ("Jane Smith", "jane_smith@domain.com"),
        ("Alice Brown", "alice.brown@website.org"),
    ]
    assert len({row[2] for row in rows}) == 1000 and len({row[4] for row in rows}) > 500
    again = values(customers(spark.range(1, 1001).repartition(7)).orderBy(F.col("ID").cast("long")))
    assert again == rows
    assert values(customers(spark.range(1, 1001), seed=7)) != rows
    assert all("None" not in str(row[3]) for row in rows)
