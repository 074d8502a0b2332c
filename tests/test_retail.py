import glob
import json
from decimal import Decimal

import pytest

from fixtures import DIRTY_ORDERS, ORDER_FIELDS, SAMPLE_ORDERS, csv_text, orders_frame
from orderledger.operators.cleaning import clean_orders, rejected_orders
from orderledger.operators.reports import (
    clean_summary,
    clean_summary_of,
    dimension_rows,
    sales_breakdown,
    sales_by,
    sales_totals,
    summary_row,
    top_key,
)
from orderledger.operators.rules import order_issues
from orderledger.plans import retail_frames, run_retail, write_validation_report
from orderledger.sources import number_files, read_clean_orders


def document(path):
    [part] = glob.glob(path + "/document/part-*")
    with open(part, encoding="utf-8") as handle:
        return json.load(handle)


def listed(spark, folder, column):
    return sorted(r[column] for r in spark.read.json(folder).collect())


# The known results of the sample rows.
def test_sample_outputs_match_the_golden_files(spark, tmp_path):
    raw = tmp_path / "orders.csv"
    raw.write_text(csv_text(SAMPLE_ORDERS), encoding="utf-8")
    paths = run_retail(spark, str(raw), str(tmp_path / "out"))

    report = document(paths["report_path"])
    assert report == {
        "first_order_date": "2026-06-01",
        "issue_count": 0,
        "issues": {"folder": f"{paths['report_path']}/issues", "rows": 0},
        "last_order_date": "2026-06-04",
        "passed": True,
        "record_count": 6,
        "required_columns": ORDER_FIELDS,
        "source_path": str(raw),
        "unique_regions": {"folder": f"{paths['report_path']}/unique_regions", "rows": 4},
    }
    assert listed(spark, f"{paths['report_path']}/unique_regions", "region") == ["East", "North", "South", "West"]
    assert list(report) == sorted(report)

    clean = {r.order_id: r for r in read_clean_orders(spark, paths["clean_path"]).collect()}
    assert {k: float(r.order_value) for k, r in clean.items()} == {
        "1001": 7.0, "1002": 6.0, "1003": 3.5, "1004": 8.25, "1005": 4.8, "1006": 7.0,
    }
    assert (clean["1006"].region, clean["1006"].product) == ("North", "Notebook")

    summary = document(paths["summary_path"])
    maps = {
        "orders_by_region": {"East": 1, "North": 3, "South": 1, "West": 1},
        "revenue_by_product": {"Folder": 8.25, "Notebook": 17.5, "Pen": 10.8},
        "revenue_by_region": {"East": 4.8, "North": 17.5, "South": 6.0, "West": 8.25},
        "units_by_product": {"Folder": 3, "Notebook": 5, "Pen": 9},
    }
    for name, expected in maps.items():
        field = summary.pop(name)
        measure, key = name.split("_by_")
        rows = spark.read.json(field["folder"]).collect()
        assert {r[key]: r[measure] for r in rows} == expected and field["rows"] == len(expected)
    assert summary == {
        "first_order_date": "2026-06-01",
        "last_order_date": "2026-06-04",
        "top_product": "Notebook",
        "top_region": "North",
        "total_orders": 6,
        "total_revenue": 36.55,
    }
    assert document(paths["clean_summary_path"]) == {
        "average_order_value": 6.09,
        "clean_path": paths["clean_path"],
        "products": {"folder": f"{paths['clean_summary_path']}/products", "rows": 3},
        "regions": {"folder": f"{paths['clean_summary_path']}/regions", "rows": 4},
        "row_count": 6,
        "source_path": str(raw),
        "total_revenue": 36.55,
    }
    [part] = glob.glob(paths["region_breakdown_path"] + "/part-*.csv")
    lines = open(part, encoding="utf-8").read().splitlines()
    assert lines[0] == "region,orders,revenue"
    assert [(r, int(n), float(v)) for r, n, v in (line.split(",") for line in lines[1:])] == [
        ("East", 1, 4.8), ("North", 3, 17.5), ("South", 1, 6.0), ("West", 1, 8.25),
    ]


def test_dirty_rows_give_the_expected_issues(spark):
    issues = order_issues(orders_frame(spark, DIRTY_ORDERS)).orderBy("row_number", "rule_order")
    assert [r.message for r in issues.collect()] == [
        "row 2: missing customer_name",
        "row 3: missing quantity",
        "row 3: quantity must be positive",
        "row 4: unit_price must be positive",
        "row 5: missing region",
        "row 5: quantity must be positive",
    ]


def test_clean_and_rejects_split_the_rows(spark):
    orders = orders_frame(spark, [*DIRTY_ORDERS, *SAMPLE_ORDERS])
    clean = clean_orders(orders)
    rejects = {r.order_id: r.reason for r in rejected_orders(orders).collect()}
    assert {r.order_id for r in clean.collect()} == {"A4", *[r[0] for r in SAMPLE_ORDERS]}
    assert rejects == {
        "A1": "quantity is not a whole number",
        "A2": "quantity is not a whole number",
        "A3": "unit_price is not a decimal amount",
        "A5": "order_date is not an ISO date",
    }
    with pytest.raises(Exception, match="is not (a whole number|a decimal amount|an ISO date)"):
        clean_orders(orders, strict=True).collect()
    assert clean_orders(orders_frame(spark, SAMPLE_ORDERS), strict=True).count() == 6


def test_value_beyond_the_money_type_is_rejected(spark):
    huge = ("B1", "Ann", "North", "Pen", "9000000000000000", "99999.99", "2026-06-01")
    orders = orders_frame(spark, [huge])
    assert clean_orders(orders).count() == 0
    assert [r.reason for r in rejected_orders(orders).collect()] == [
        "order_value is not within decimal(18,2)"
    ]


def test_empty_input(spark):
    frames = retail_frames(orders_frame(spark, []))
    assert frames.report.collect() == [(0, 0, True, None, None)]
    assert frames.summary.collect() == [(0, Decimal("0.00"), Decimal("0.00"))]
    assert frames.sales.collect() == [(0, Decimal("0.00"), None, None, None, None)]
    assert sales_totals(frames.clean).collect() == [(0, 0, Decimal("0.00"), None, None)]
    assert frames.issues.count() == frames.rejects.count() == 0
    assert top_key(sales_by(frames.clean, "region"), "region").count() == 0


def test_revenue_ties_go_to_the_first_seen_in_date_order(spark):
    rows = [
        ("1", "A", "West", "Pen", "1", "5", "2026-06-02"),
        ("2", "A", "North", "Ink", "1", "5", "2026-06-01"),
        ("3", "A", "East", "Cap", "1", "5", "2026-06-01"),
    ]
    clean = clean_orders(orders_frame(spark, rows), keep=["row_number"])
    grouped = sales_by(clean, "region", "row_number")
    assert top_key(grouped, "region").collect()[0].region == "North"
    row = summary_row(sales_breakdown(clean, "row_number")).collect()[0]
    assert (row.top_region, row.top_product) == ("North", "Ink")


def test_ties_over_files_go_to_the_earlier_file(spark):
    """By date, then the path of the file, then the record, however large its number."""
    rows = [
        ("1", "A", "West", "Pen", "1", "5", "2026-06-01", "/b", 2),
        ("2", "A", "North", "Ink", "1", "5", "2026-06-01", "/a", 2**62),
        ("3", "A", "East", "Cap", "1", "5", "2026-06-01", "/a", 2**62 + 1),
        ("4", "A", "South", "Nib", "1", "5", "2026-06-02", "/0", 2),
    ]
    schema = ", ".join(f"{f} string" for f in ORDER_FIELDS) + ", source_file string, row_number bigint"
    raw = number_files(spark.createDataFrame(rows, schema))
    assert {r.source_file: r.file_number for r in raw.collect()} == {"/0": 0, "/a": 1, "/b": 2}
    frames = retail_frames(raw)
    [row] = frames.sales.collect()
    assert (row.top_region, row.top_product) == ("North", "Ink")
    regions = dimension_rows(frames.breakdown, "region").orderBy("first_seen").collect()
    assert [r.region for r in regions] == ["North", "East", "West", "South"]
    assert frames.rejects.columns == [c for c in raw.columns if c != "file_number"] + ["reason"]
    plan = frames.breakdown._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_breakdown_equals_the_single_reports(spark):
    clean = clean_orders(orders_frame(spark, SAMPLE_ORDERS))
    breakdown = sales_breakdown(clean)
    for key in ("region", "product"):
        fields = [key, "orders", "units", "revenue", "first_order_date", "last_order_date"]
        left = dimension_rows(breakdown, key).select(*fields).orderBy(key).collect()
        assert left == sales_by(clean, key).select(*fields).orderBy(key).collect()


def test_average_uses_the_rounded_total(spark):
    rows = [(str(i), "A", "N", "P", "1", "0.10", "2026-06-01") for i in range(3)]
    rows.append(("9", "A", "N", "P", "1", "0.11", "2026-06-01"))
    [row] = clean_summary(clean_orders(orders_frame(spark, rows))).collect()
    assert (row.total_revenue, row.average_order_value) == (Decimal("0.41"), Decimal("0.10"))


def test_a_long_issue_list_is_written_whole_beside_the_document(spark, tmp_path):
    rows = [("", "Ann", "North", "Pen", "1", "1.00", "2026-06-01")] * 25
    frames = retail_frames(orders_frame(spark, rows))
    path = write_validation_report(frames, "raw", str(tmp_path / "report"))
    report = document(path)
    assert report["issues"] == {"folder": path + "/issues", "rows": 25}
    assert report["issue_count"] == 25
    assert report["unique_regions"] == {"folder": path + "/unique_regions", "rows": 1}
    listed = spark.read.json(path + "/issues")
    assert listed.count() == 25
    assert {r.message for r in listed.collect()} == {
        f"row {n}: missing order_id" for n in range(2, 27)
    }


def test_documents_have_one_shape_and_can_be_written_again(spark, tmp_path):
    shapes = set()
    for n in (5000, 1, 0):
        rows = [("", "Ann", f"N{i}", "Pen", "1", "1.00", "2026-06-01") for i in range(n)]
        path = write_validation_report(retail_frames(orders_frame(spark, rows)), "raw", str(tmp_path / "report"))
        report = document(path)
        shapes.add(tuple((k, type(v).__name__) for k, v in sorted(report.items()) if not k.endswith("_date")))
        assert report["issues"]["rows"] == report["unique_regions"]["rows"] == n
        assert spark.read.schema("message string").json(path + "/issues").count() == n
    assert len(shapes) == 1


def test_numbers_that_could_stop_a_job(spark):
    rows = [
        ("1", "A", "N", "P", "9000000000000000000", "0.001", "2026-06-01"),
        ("2", "A", "N", "P", "9000000000000000000", "0.001", "2026-06-01"),
        ("3", "A", "N", "P", "1", "1e-99999999", "2026-06-01"),
        ("4", "A", "N", "P", "1", "1e99999999", "2026-06-01"),
        ("5", "A", "N", "P", "1", "1e-0003", "2026-06-01"),
        ("6", "A", "N", "P", "1", "12e0001", "2026-06-01"),
    ]
    clean = clean_orders(orders_frame(spark, rows))
    prices = {r.order_id: r.unit_price for r in clean.collect()}
    assert prices == {str(k): Decimal(v) for k, v in ((1, "0.00"), (2, "0.00"), (3, "0.00"), (5, "0.00"), (6, "120.00"))}
    total = sales_breakdown(clean).where("dimension = 'total'").collect()[0]
    assert total.units == 18000000000000000003


def test_average_is_rounded_once(spark):
    frame = spark.range(1).selectExpr("100000001L AS orders", "CAST(12500000 AS DECIMAL(38,2)) AS revenue", "'total' AS dimension")
    assert clean_summary_of(frame).collect()[0].average_order_value == Decimal("0.12")
    half = frame.selectExpr("2L AS orders", "CAST(-0.05 AS DECIMAL(38,2)) AS revenue", "dimension")
    assert clean_summary_of(half).collect()[0].average_order_value == Decimal("-0.03")


def test_row_steps_accept_a_streaming_frame(spark, tmp_path):
    orders_frame(spark, SAMPLE_ORDERS).write.parquet(str(tmp_path / "in"))
    schema = orders_frame(spark, []).schema
    stream = clean_orders(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
