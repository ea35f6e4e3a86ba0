import pytest

from regimeflow import sources
from regimeflow.sources.events import event_schema


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_missing_path_and_unknown_suffix(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sources.read_events(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(ValueError):
        sources.read_events(spark, write(tmp_path / "a.txt", ["x"]))


def test_headed_csv(spark, tmp_path):
    df = sources.read_events(spark, write(tmp_path / "a.csv", ["Day,x", "20000101,1.5", "20000102,2.5"]))
    assert df.columns == ["Day", "x"] and df.count() == 2
    assert dict(sources.column_types(df))["x"] == "double" and sources.shape(df) == (2, 2)


def test_headerless_tsv_takes_the_standard_schema(spark, tmp_path):
    cells = ["1", "20000101"] + [""] * 56
    cells[30], cells[26] = "-4.5", "012"
    df = sources.read_events(spark, write(tmp_path / "a.tsv", ["\t".join(cells)]))
    assert df.columns == sources.EVENT_COLUMNS and len(df.columns) == 58
    row = df.first()
    assert (row.GlobalEventID, row.Day, row.EventCode, row.GoldsteinScale) == (1, 20000101, "012", -4.5)


def test_wide_headed_csv_needs_header_set(spark, tmp_path):
    lines = [",".join(f"c{i}" for i in range(56)), ",".join(str(i) for i in range(56))]
    path = write(tmp_path / "wide.csv", lines)
    assert sources.detect_header(spark, path, ",") == (False, 56)
    assert sources.read_events(spark, path, header=True).columns[:2] == ["c0", "c1"]


def test_explicit_separator_and_schema(spark, tmp_path):
    path = write(tmp_path / "a.csv", ["1;x", "2;y"])
    df = sources.read_events(spark, path, schema="k int, v string", sep=";", header=False)
    assert [tuple(r) for r in df.orderBy("k").collect()] == [(1, "x"), (2, "y")]


def test_assign_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["0", "1", "2"])
    assert sources.assign_names(df).columns == sources.EVENT_COLUMNS[:3]
    named = spark.createDataFrame([(1,)], ["a"])
    assert sources.assign_names(named) is named


def test_event_schema_types():
    types = {f.name: f.dataType.simpleString() for f in event_schema()}
    assert types["GlobalEventID"] == "bigint" and types["ActionGeo_Lat"] == "double" and types["EventCode"] == "string"


def test_parquet_scan_prunes_and_pushes_down(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.range(10).selectExpr("id", "id * 2 AS v", "id * 3 AS w").write.parquet(path)
    plan = sources.read_events(spark, path).where("id > 5").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan and "w:bigint" not in plan


def test_wide_headerless_files_keep_every_column(spark, tmp_path):
    path = str(tmp_path / "wide.csv")
    with open(path, "w") as f:
        f.write(",".join(str(i) for i in range(61)) + "\n")
    row = sources.read_events(spark, path).first()
    assert len(row) == 61 and row["Column61"] == "60" and row["GlobalEventID"] == 0 and row["SOURCEURL"] == "57"


def test_quoted_cells_survive(spark, tmp_path):
    rows = [(1, 'a "b", c'), (2, "two\nlines"), (3, "ends with \\"), (4, ""), (5, None), (6, ",")]
    path = str(tmp_path / "quoted.csv")
    sources.write_delimited(spark.createDataFrame(rows, "id int, text string"), path)
    back = sources.read_events(spark, path, schema="id int, text string", header=True, multi_line=True).collect()
    want = [(i, t or None) for i, t in rows]  # an empty cell is null, quoted or not
    assert sorted((tuple(r) for r in back), key=lambda r: r[0]) == want


def test_names_like_numbers_only_are_positional(spark):
    assert sources.assign_names(spark.createDataFrame([(1, 2)], ["c1", "c2"])).columns == ["c1", "c2"]
    assert sources.assign_names(spark.createDataFrame([(1, 2)], ["_c0", "_c1"])).columns == ["GlobalEventID", "Day"]
