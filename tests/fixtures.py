"""Small tables typed in by hand."""

ORDER_FIELDS = ["order_id", "customer_name", "region", "product", "quantity", "unit_price", "order_date"]

# The sample rows whose results are known.
SAMPLE_ORDERS = [
    ("1001", "Alice Johnson", "North", "Notebook", "2", "3.50", "2026-06-01"),
    ("1002", "Ben Carter", "South", "Pen", "5", "1.20", "2026-06-01"),
    ("1003", "Chloe Nguyen", "North", "Notebook", "1", "3.50", "2026-06-02"),
    ("1004", "Daniel Patel", "West", "Folder", "3", "2.75", "2026-06-03"),
    ("1005", "Emma Stone", "East", "Pen", "4", "1.20", "2026-06-03"),
    ("1006", "Frank White", " north ", " notebook ", "2", "3.50", "2026-06-04"),
]

DIRTY_ORDERS = [
    ("A1", "", "North", "Pen", "2.5", "1.00", "2026-06-01"),
    ("A2", "Ann", "North", "Pen", "", "1.00", "2026-06-01"),
    ("A3", "Ann", "North", "Pen", "1", "nan", "2026-06-01"),
    ("A4", "Ann", "\t\xa0", "Pen", "-1", "1.00", "2026-06-01"),
    ("A5", "o'neil mary-jane", "North", "3rd pen", "1", "0.125", "2026-6-1"),
]


def csv_text(rows, fields=ORDER_FIELDS):
    def cell(value):
        quoted = '"' in value or "," in value or "\n" in value
        return '"' + value.replace('"', '""') + '"' if quoted else value

    return "\n".join(",".join(cell(v) for v in row) for row in [fields, *rows]) + "\n"


def orders_frame(spark, rows):
    schema = ", ".join(f"{f} string" for f in ORDER_FIELDS) + ", row_number bigint"
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows, start=2)], schema)
