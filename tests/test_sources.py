import csv

import pytest
from pyspark.sql import functions as F

from fixtures import DIRTY_ORDERS, ORDER_FIELDS, SAMPLE_ORDERS, csv_text
from orderledger.operators.cleaning import clean_orders
from orderledger.operators.rules import blank_counts
from orderledger.operators.run_history import recorded_paths
from orderledger.sources import (
    CLEAN_COLUMNS,
    has_multiline_records,
    number_file_records,
    position_in_group,
    read_numbered_orders,
    read_raw_orders,
    read_recorded,
    recorded_path,
    shared_dir,
    write_csv,
)


def rows_of(path):
    with open(path, newline="", encoding="utf-8") as handle:
        return list(csv.DictReader(handle))


def test_scan_agrees_with_the_csv_module(spark, tmp_path):
    path = tmp_path / "orders.csv"
    rows = [*SAMPLE_ORDERS, ("7", 'quo"te, "x"', "line\nbreak", "a,b", "", "1", "2026-06-01")]
    path.write_text(csv_text(rows) + "8,short\n\n9,a,b,c,1,2,2026-06-01,surplus\n", encoding="utf-8")
    scanned = number_file_records(read_raw_orders(spark, str(path), multi_line=True))
    got = [tuple(r) for r in scanned.orderBy("row_number").select("row_number", *ORDER_FIELDS).collect()]
    expected = [
        (n, *[row[f] or None for f in ORDER_FIELDS]) for n, row in enumerate(rows_of(path), start=2)
    ]
    assert got == expected


def test_columns_are_found_by_name_and_absent_ones_are_null(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text("unit_price,order_id\n1.5,A\n", encoding="utf-8")
    [row] = read_raw_orders(spark, str(path)).collect()
    assert (row.order_id, row.unit_price, row.region) == ("A", "1.5", None)
    [row] = read_numbered_orders(spark, str(path)).collect()
    assert (row.order_id, row.region, row.row_number) == ("A", None, 2)
    empty = tmp_path / "empty.csv"
    empty.write_text("", encoding="utf-8")
    scanned = read_raw_orders(spark, str(empty))
    assert scanned.count() == 0 and set(ORDER_FIELDS) <= set(scanned.columns)
    assert {r.blanks for r in blank_counts(scanned).collect()} == {0}


def test_columns_are_found_by_name_in_every_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text(csv_text(SAMPLE_ORDERS), encoding="utf-8")
    turned = csv_text([r[::-1] for r in SAMPLE_ORDERS], ORDER_FIELDS[::-1])
    (tmp_path / "b c.csv").write_text(turned, encoding="utf-8")
    (tmp_path / "d.csv").write_text("\ufefforder_id,note\r\nX,n\r\n", encoding="utf-8")
    got = read_numbered_orders(spark, str(tmp_path))
    rows = [tuple(r) for r in got.select(*ORDER_FIELDS, "row_number").collect()]
    expected = [(*map(lambda v: v or None, r), n) for n, r in enumerate(SAMPLE_ORDERS, start=2)] * 2
    assert sorted(rows, key=repr) == sorted([*expected, ("X", *[None] * 6, 2)], key=repr)
    assert read_raw_orders(spark, str(tmp_path)).where("note = 'n'").count() == 1


def test_records_with_line_breaks_are_read_in_splits(spark, tmp_path):
    rows = []
    for i in range(3000):
        name = [f"plain{i}", f'two\nlines "{i}"', f"a\n\nb,{i}", '"', "tail\n"][i % 5]
        rows.append((str(i), name, "r", "p" * (i % 40), "1", "1", "2026-06-01"))
    text = csv_text(rows[:1500]) + "\n \n" + "".join(csv_text(rows[1500:]).splitlines(True)[1:])
    (tmp_path / "broken.csv").write_text(text, encoding="utf-8", newline="")
    (tmp_path / "plain.csv").write_text(csv_text(SAMPLE_ORDERS), encoding="utf-8")
    expected = [(f, n, tuple(row[c] or None for c in ORDER_FIELDS)) for f in ("broken", "plain")
                for n, row in enumerate((r for r in rows_of(tmp_path / f"{f}.csv") if (r["order_id"] or "").strip()), start=2)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = read_numbered_orders(spark, str(tmp_path))
        found = [(r.source_file.rsplit("/", 1)[1][:-4], r.row_number, tuple(r[c] for c in ORDER_FIELDS)) for r in got.collect()]
        assert read_raw_orders(spark, str(tmp_path)).count() == len(expected)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(found) == sorted(expected)


def test_a_stray_quote_is_reported(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("orderledger.sources.records.MOST_LINES", 50)
    lines = ["order_id,region", "1,a", '2,"b', *(f"{i},c" for i in range(3, 200))]
    (tmp_path / "stray.csv").write_text("\n".join(lines), encoding="utf-8")
    with pytest.raises(ValueError, match="record 3 of .*stray.csv.*quote"):
        read_raw_orders(spark, str(tmp_path))


def test_quotes_decide_how_files_are_read(spark, tmp_path):
    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    plain.write_text(csv_text([('say "hi"', *SAMPLE_ORDERS[0][1:])]), encoding="utf-8")
    broken.write_text(csv_text([("two\nlines", *SAMPLE_ORDERS[0][1:])]), encoding="utf-8")
    assert not has_multiline_records(spark, str(plain))
    assert has_multiline_records(spark, str(broken))


def test_record_numbers_over_many_files_and_splits(spark, tmp_path):
    for name, count in {"a": 4000, "b": 1, "c": 700, "d": 0}.items():
        rows = [(f"{name}{i}", "c", "r", "p", "1", "1", "2026-06-01") for i in range(count)]
        (tmp_path / f"{name}.csv").write_text(csv_text(rows), encoding="utf-8")
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        raw = read_raw_orders(spark, str(tmp_path), multi_line=False)
        assert raw.rdd.getNumPartitions() > 10
        numbered = number_file_records(raw)
        wrong = numbered.where(
            F.col("row_number") != F.substring("order_id", 2, 10).cast("int") + 2
        )
        assert numbered.count() == 4701 and wrong.count() == 0
        files = numbered.select(F.regexp_extract("source_file", r"(\w)\.csv$", 1), F.left("order_id", F.lit(1)))
        assert {tuple(r) for r in files.distinct().collect()} == {(c, c) for c in "abc"}
    finally:
        for key, value in saved.items():
            spark.conf.set(key, value)


def test_positions_in_a_hot_group(spark):
    frame = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(99).alias("g"),
        ((F.col("id") * 7919) % 5003).alias("k"),
    )
    numbered = position_in_group(frame, ["g"], ["k"]).toPandas()
    expected = numbered.sort_values(["g", "k"]).groupby("g").cumcount()
    assert (numbered.loc[expected.index, "position"] == expected).all()
    assert len(numbered) == 5000


def test_written_csv_keeps_padding_and_order(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text(csv_text([*SAMPLE_ORDERS, *DIRTY_ORDERS]), encoding="utf-8")
    frame = read_raw_orders(spark, str(raw))
    out = write_csv(frame, str(tmp_path / "copy"), ORDER_FIELDS)
    back = read_raw_orders(spark, out)
    assert sorted(map(tuple, back.select(ORDER_FIELDS).collect()), key=str) == sorted(
        map(tuple, frame.select(ORDER_FIELDS).collect()), key=str
    )
    clean = write_csv(clean_orders(frame), str(tmp_path / "clean"), CLEAN_COLUMNS)
    [part] = (tmp_path / "clean").glob("part-*.csv")
    assert part.read_text().splitlines()[:2] == [
        "order_id,customer_name,region,product,order_date,quantity,unit_price,order_value",
        "1001,Alice Johnson,North,Notebook,2026-06-01,2,3.50,7.00",
    ]


def test_recorded_path_falls_back_to_the_default(spark):
    results = spark.createDataFrame(
        [("r", "check", 1, '{"raw_path": "/old"}'), ("r", "check", 2, '{"raw_path": "/new"}'), ("r", "empty", 3, "{}")],
        "run_id string, name string, seq int, outputs string",
    )
    assert recorded_path(results, "r", "check", "raw_path", "/default") == "/new"
    assert recorded_path(results, "r", "empty", "raw_path", "/default") == "/default"
    assert recorded_path(results, "r", "absent", "raw_path", "/default") == "/default"


def test_files_of_unlike_headers_below_an_odd_name(spark, tmp_path):
    folder = tmp_path / "a b%20+"
    folder.mkdir()
    (folder / "one.csv").write_text("order_id,region\n1,a\n", encoding="utf-8")
    (folder / "two.csv").write_text('region,order_id\n"b\nc",2\n', encoding="utf-8")
    got = read_numbered_orders(spark, str(folder)).select("order_id", "region", "row_number").collect()
    assert sorted(map(tuple, got)) == [("1", "a", 2), ("2", "b\nc", 2)]


def test_recorded_files_and_folders_are_read_once(spark, tmp_path):
    for name, rows in (("a b%20+", SAMPLE_ORDERS[:2]), ("c", SAMPLE_ORDERS[2:3]), ("other", SAMPLE_ORDERS)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_text(csv_text(rows), encoding="utf-8")
    folder, file = str(tmp_path / "a b%20+"), str(tmp_path / "c" / "part.csv")
    named = [("r1", folder), ("r2", folder), ("r3", folder + "/"), ("r4", file), ("r5", "file:" + file), ("r6", None)]
    paths = spark.createDataFrame(named, "run_id string, path string")
    rows = read_recorded(paths).select("path", "order_id", "row_number").collect()
    first, third = [o[0] for o in SAMPLE_ORDERS[:2]], SAMPLE_ORDERS[2][0]
    expected = [(p, i, n + 2) for p in (folder, folder + "/") for n, i in enumerate(first)]
    assert sorted(map(tuple, rows)) == sorted(expected + [(file, third, 2), ("file:" + file, third, 2)])
    with pytest.raises(ValueError):
        read_recorded(paths.where("path is null"))


def test_recorded_paths_of_every_run(spark):
    results = spark.createDataFrame(
        [("p", "r", 1, "s", 1, '{"raw_path": "/old"}'), ("p", "r", 1, "s", 2, '{"raw_path": "/new"}'),
         ("p", "r", 2, "s", 3, '{"raw_path": ""}'), ("p", "r", 3, "t", 4, '{"raw_path": "/t"}')],
        "pipeline string, run_id string, run_started_at int, name string, seq int, outputs string",
    )
    runs = spark.createDataFrame([("p", "r", n) for n in (1, 2, 3, 4)], "pipeline string, run_id string, run_started_at int")
    got = recorded_paths(results, runs, "s", "raw_path", "/default").collect()
    assert sorted((r.run_started_at, r.path) for r in got) == [(1, "/new"), (2, "/default"), (3, "/default"), (4, "/default")]


def test_the_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named
    else:
        assert shared_dir(spark) == shared_dir(spark)
