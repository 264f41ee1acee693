import csv
import datetime as dt
import glob
import os
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import DataFrameWriter
from fixtures import LINE, lines

from harborline import schema, session
from harborline.operators.quality import QualityError
from harborline.plans import pipeline
from harborline.sources import files

D = dt.date
RAW = {
    **{source: LINE[name] for source, name in schema.SOURCE_NAMES.items()},
    "Order Date": "1/3/2017",
    "Ship Date": "01/05/2017",
    "Sales": "10.0",
    "Discount": "0",
    "Profit": "2.0",
}


def write(folder, *changes, columns=tuple(schema.SOURCE_NAMES)):
    path = folder / f"{uuid.uuid4().hex}.csv"
    with open(path, "w", encoding="cp1252", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(columns)
        for i, change in enumerate(changes or [{}], start=1):
            row = {**RAW, "Row ID": i, **change}
            writer.writerow([row[c] for c in columns])
    return str(path)


def test_source_types_and_values(spark, tmp_path):
    df = files.read_source(spark, write(tmp_path))
    assert df.schema.simpleString() == schema.LINES.simpleString()
    row = df.first()
    assert (row.order_date, row.ship_date) == (D(2017, 1, 3), D(2017, 1, 5))
    assert row.postal_code == "01234" and row.sales == Decimal(10)


def test_cp1252_bytes_and_quotes(spark, tmp_path):
    name = 'Kid’s €9 "Deluxe", large œ'
    path = write(tmp_path, {"Product Name": name})
    assert b"\x92" in open(path, "rb").read()
    assert files.read_source(spark, path).first().product_name == name


def test_null_tokens(spark, tmp_path):
    path = write(tmp_path, {"City": "NA", "Region": "", "Sales": "NaN"}, {"City": "Na"})
    first, second = files.read_source(spark, path).orderBy("row_id").collect()
    assert (first.city, first.region, first.sales) == (None, None, None)
    assert second.city == "Na"
    only_empty = files.read_source(spark, path, null_tokens=["", "NaN"])
    assert only_empty.where("city = 'NA'").count() == 1


@pytest.mark.parametrize(
    "change", [{"Order Date": "2017-01-03"}, {"Ship Date": "13/40/2017"}, {"Sales": "ten"}, {"Quantity": "x"}]
)
def test_bad_values_fail(spark, tmp_path, change):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE|could not be parsed|DateTime"):
        files.read_source(spark, write(tmp_path, change)).collect()


def test_columns_are_found_by_name(spark, tmp_path):
    path = write(tmp_path, columns=tuple(reversed(schema.SOURCE_NAMES)))
    assert files.read_source(spark, path).first().customer_name == "Ann"


def test_missing_header_is_named(spark, tmp_path):
    columns = [c for c in schema.SOURCE_NAMES if c != "Segment"]
    with pytest.raises(QualityError, match="Missing columns: Segment"):
        files.read_source(spark, write(tmp_path, columns=columns))


def test_source_round_trip(spark, tmp_path):
    df = lines(spark, {"product_name": 'A "B", ’c'}, {"order_id": "B"})
    files.write_source(df, str(tmp_path / "out"))
    again = files.read_source(spark, str(tmp_path / "out"))
    assert sorted(again.collect()) == sorted(df.collect())


def test_delimited_table_round_trip(spark, tmp_path):
    df = lines(spark)
    files.write_delimited(df, str(tmp_path / "csv"))
    assert files.read_delimited_table(spark, str(tmp_path / "csv"), schema.LINES).collect() == df.collect()


def test_compressed_text_round_trips_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "COMPRESSED_ROWS", 2)
    df = lines(spark, *[{"row_id": str(i), "product_name": 'Kid’s "B", c', "city": None} for i in range(5)]).coalesce(1)
    files.write_source(df, str(tmp_path / "source"), compression="gzip")
    files.write_delimited(df, str(tmp_path / "table"), "gzip")
    for name in ("source", "table"):
        # Rows of one task, no more than two a file, since one task reads a file.
        assert len(glob.glob(f"{tmp_path}/{name}/*.csv.gz")) == 3
    assert sorted(files.read_source(spark, str(tmp_path / "source")).collect()) == sorted(df.collect())
    again = files.read_delimited_table(spark, str(tmp_path / "table"), schema.LINES)
    assert sorted(again.collect()) == sorted(df.collect())


ORDERS = [
    {"Sales": "10.5", "Profit": "1"},
    {"Sales": "4.5", "Profit": "2", "Product ID": "P2", "Product Name": "Two"},
    {"Order ID": "B", "Ship Mode": "First Class", "Order Date": "7/2/2015", "Ship Date": "7/8/2015",
     "Customer ID": "C2", "Customer Name": "Bob", "Region": "East"},
]


def test_transform(spark, tmp_path):
    source, orders = pipeline.transform(spark, write(tmp_path, *ORDERS), expected_rows=3)
    assert source.columns == schema.LINE_COLUMNS
    rows = {r.order_id: r for r in orders.collect()}
    assert set(rows) == {"A", "B"}
    # 3 July 2015 was the observed holiday.
    assert (rows["B"].calendar_days_to_ship, rows["B"].business_days_to_ship) == (6, 3)
    assert rows["B"].is_late and not rows["A"].is_late


def test_compressed_text_gets_the_partitions_of_wide_rows(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(pipeline, "size_for", lambda spark, path, spread: asked.append(spread))
    df = lines(spark)
    for compression in (None, "gzip"):
        files.write_source(df, str(tmp_path / "out"), compression=compression)
        source, _ = pipeline.transform(spark, str(tmp_path / "out"), expected_rows=None)
        assert sorted(source.collect()) == sorted(df.collect())
    assert asked == [1, session.SPREAD]
    assert all("zstd" in name for name in source.inputFiles())


def test_transform_rejects_before_computing(spark, tmp_path):
    with pytest.raises(QualityError, match="Expected 9994 rows, found 3"):
        pipeline.transform(spark, write(tmp_path, *ORDERS))


def test_run_writes_every_table(spark, tmp_path):
    output = str(tmp_path / "out")
    shared = session.shared_folder(spark)
    before = set(os.listdir(shared))
    written = pipeline.run(spark, write(tmp_path, *ORDERS), output, expected_rows=3, delimited=True)
    assert set(os.listdir(shared)) == before
    assert sorted(written) == sorted([
        "fact_order_lines", "fact_orders", "dim_date", "dim_customer", "dim_location",
        "dim_product", "dim_ship_mode", "fact_order_lines_star", "scenario_orders",
        "overall", "by_ship_mode", "by_region", "by_month",
    ])
    assert written["fact_order_lines"].count() == 3 and written["fact_orders"].count() == 2
    assert written["scenario_orders"].count() == 8
    assert written["dim_product"].count() == 2 and written["dim_customer"].count() == 2
    overall = {r.scenario: r for r in written["overall"].collect()}
    assert overall["base"].late_orders == 1 and overall["base"].total_sales == Decimal("25.0")
    months = {r.order_month_label for r in written["by_month"].collect()}
    assert months == {"2015-07", "2017-01"}
    # One folder per scenario, so one scenario reads one folder.
    assert len(glob.glob(f"{output}/run-*/scenario_orders/scenario=*")) == 4
    assert glob.glob(f"{output}/run-*/csv/dim_date/*.csv")
    kept = files.published(spark, output)["scenario_orders"].where("scenario = 'calibrated'")
    assert kept.count() == 2 and "01234" in {r.postal_code for r in kept.collect()}


def test_a_late_failure_leaves_the_published_set_whole(spark, tmp_path, monkeypatch):
    output = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError, match="no finished run"):
        files.published(spark, output)
    first = pipeline.run(spark, write(tmp_path, *ORDERS), output, expected_rows=3)
    more = [*ORDERS, {"Order ID": "C", "Sales": "100"}]
    real = pipeline.summaries.summarize_cells

    def failing(folded, table, dims=()):
        if dims == ["order_month_label"]:
            raise RuntimeError("the last stage failed")
        return real(folded, table, dims)

    monkeypatch.setattr(pipeline.summaries, "summarize_cells", failing)
    with pytest.raises(RuntimeError, match="last stage"):
        pipeline.run(spark, write(tmp_path, *more), output, expected_rows=4)
    assert len(glob.glob(f"{output}/run-*")) == 1
    current = files.published(spark, output)
    assert sorted(current) == sorted(first) and current["fact_orders"].count() == 2
    assert all(current[name].columns == table.columns for name, table in first.items())
    monkeypatch.setattr(pipeline.summaries, "summarize_cells", real)
    for _ in range(2):
        pipeline.run(spark, write(tmp_path, *more), output, expected_rows=4)
    assert files.published(spark, output)["fact_orders"].count() == 3
    # The current run and the one it replaced.
    assert len(glob.glob(f"{output}/run-*")) == 2


@pytest.mark.parametrize("encoding, text", [
    ("windows-1252", "Café “Ž” € …"), ("windows-1251", "Привет, №5"), ("windows-1253", "Ελλάδα"), ("UTF-8", "日本 €"),
])
def test_code_pages_leave_the_session_alone(spark, tmp_path, encoding, text):
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    df = lines(spark, {"product_name": text, "city": None})
    files.write_source(df, str(tmp_path / "out"), encoding=encoding)
    raw = b"".join(open(p, "rb").read() for p in glob.glob(f"{tmp_path}/out/*.csv"))
    assert text.encode(encoding.replace("windows-", "cp")) in raw
    assert files.read_source(spark, str(tmp_path / "out"), encoding=encoding).collect() == df.collect()
    assert spark.conf.get("spark.sql.legacy.javaCharsets", None) == before


def test_a_refused_source_leaves_nothing(spark, tmp_path):
    output, shared = tmp_path / "out", session.shared_folder(spark)
    before = set(os.listdir(shared))
    with pytest.raises(QualityError, match="Expected 9994 rows, found 3"):
        pipeline.run(spark, write(tmp_path, *ORDERS), str(output))
    assert not glob.glob(f"{output}/*") and set(os.listdir(shared)) == before


def test_a_source_without_rows_gives_empty_facts(spark, tmp_path):
    path = tmp_path / "empty.csv"
    path.write_text(",".join(schema.SOURCE_NAMES) + "\n")
    source, orders = pipeline.transform(spark, str(path), expected_rows=None)
    assert source.count() == orders.count() == 0


def test_folders_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    """The setting that spares the sort holds for the write alone."""
    real, seen = DataFrameWriter.parquet, []

    def noted(self, path, *args, **options):
        seen.append(spark.conf.get(files.OPEN_FILES))
        return real(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    before = spark.conf.get(files.OPEN_FILES, None)
    df = spark.range(1000).selectExpr("id", "CAST(id % 40 AS INT) AS part")
    files.write_table(df, str(tmp_path / "out"), ("part",))
    assert seen == [str(files.OPEN_FOLDERS)] and spark.conf.get(files.OPEN_FILES, None) == before
    again = files.read_table(spark, str(tmp_path / "out"), df.schema)
    assert sorted(again.collect()) == sorted(df.collect())
    assert len(glob.glob(f"{tmp_path}/out/part=*")) == 40
