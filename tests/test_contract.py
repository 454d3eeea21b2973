"""The ticket contract and the readers."""

import json

import pytest
from pyspark.sql import functions as F

from helpers import raw
from ticketlens.errors import DataContractError
from ticketlens.fixed_values import TICKET_COLUMNS
from ticketlens.operators import quality as qu
from ticketlens.plans import audit
from ticketlens.sources import companies as co
from ticketlens.sources import documents as do
from ticketlens.sources import tickets as ti
from ticketlens.sources.dimensions import factor_table


@pytest.fixture(scope="module")
def factors(spark):
    return factor_table(spark)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "company_id string")


def violations(frame, factors):
    return [r.violations for r in qu.with_violations(frame, factors).orderBy("ticket_id").collect()]


def test_good_rows_pass_in_every_notation(spark, factors):
    words = ["yes", "TRUE", "1", "on", "t", "No", "false", "0", "OFF", "f", "n", "Y"]
    frame = raw(spark, *({"escalated": w} for w in words))
    checked = qu.with_violations(frame, factors)
    assert checked.filter(F.size("violations") > 0).count() == 0
    rows = {r.ticket_id: r.escalated for r in qu.normalized(checked).collect()}
    assert [rows[f"T-{i}"] for i in range(1, 13)] == [True] * 5 + [False] * 6 + [True]


def test_each_broken_cell_is_found(spark, factors):
    cases = [
        ({"description": ""}, "description: missing"),
        ({"description": "NA"}, "description: missing"),
        ({"channel": None}, "channel: missing"),
        ({"created_at": "yesterday"}, "created_at: not a time"),
        ({"category": "lost badge"}, "category: outside domain"),
        ({"category": "Order Status"}, "category: outside domain"),
        ({"resolution_minutes": "ten"}, "resolution_minutes: not a number"),
        ({"resolution_minutes": "1d"}, "resolution_minutes: not a number"),
        ({"resolution_minutes": "-5"}, "resolution_minutes: negative"),
        ({"escalated": "maybe"}, "escalated: not a flag"),
    ]
    frame = raw(spark, *(change for change, _ in cases))
    rows = {r.ticket_id: r.violations for r in qu.with_violations(frame, factors).collect()}
    assert [rows[f"T-{n}"] for n in range(1, len(cases) + 1)] == [[text] for _, text in cases]


def test_white_space_and_infinity_pass(spark, factors):
    frame = raw(spark, {"description": " "}, {"resolution_minutes": "inf"}, {"resolution_minutes": " 7 "})
    assert violations(frame, factors) == [[], [], []]


def test_times(spark):
    utc = 1735725605
    cases = {
        "2025-01-01T10:00:05Z": utc,
        "2025-01-01 10:00:05": utc,
        "2025-01-01T12:00:05+02:00": utc,
        "2025-01-01T12:00:05 +0200": utc,
        "2025-01-01t10:00:05z": utc,
        "2025-01-01T10:00:05,5": utc + 0.5,
        "2025-01-01T10:00": utc - 5,
        "2025-01-01": utc - 36005,
        str(utc): utc,
        f"{utc}000": utc,
        "2025-02-30": None,
        "10:00": None,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "x string")
    rows = frame.select("x", qu.parse_time(F.col("x")).cast("double").alias("t")).collect()
    assert {r.x: r.t for r in rows} == cases


def test_duplicates_count_per_company(spark):
    frame = raw(spark, {}, {"ticket_id": "T-1"}, {"ticket_id": "T-1", "company_id": "two"}, {"ticket_id": None}, {"ticket_id": None})
    assert [tuple(r) for r in qu.duplicate_keys(frame).collect()] == [("one", "T-1", 2)]


def test_quarantine_and_normalized_split_the_rows(spark, factors):
    checked = qu.with_violations(raw(spark, {}, {"escalated": "?"}, {}), factors)
    assert qu.normalized(checked).count() == 2
    assert [r.escalated for r in qu.quarantine(checked).collect()] == ["?"]
    assert qu.normalized(checked).columns == ["company_id", *TICKET_COLUMNS]


def gate(spark, factors, frame, *companies):
    checked = qu.with_violations(frame, factors)
    qu.require_valid(qu.quality_report(checked, ids(spark, *(companies or ("one",)))))


def test_gate_names_the_first_failing_check(spark, factors):
    gate(spark, factors, raw(spark, {}, {}))
    with pytest.raises(DataContractError, match="must not be empty: two"):
        gate(spark, factors, raw(spark, {"channel": None}), "one", "two")
    with pytest.raises(DataContractError, match="null values"):
        gate(spark, factors, raw(spark, {"channel": None}, {"ticket_id": "T-1"}))
    with pytest.raises(DataContractError, match="unique"):
        gate(spark, factors, raw(spark, {"ticket_id": "T-2"}, {"escalated": "?"}))
    with pytest.raises(DataContractError, match="are invalid"):
        gate(spark, factors, raw(spark, {"resolution_minutes": "-1"}))
    # A column of nothing but numbers would be read as numbers, not as text.
    with pytest.raises(DataContractError, match="are invalid"):
        gate(spark, factors, raw(spark, {"ticket_id": "1"}, {"ticket_id": "2"}))
    gate(spark, factors, raw(spark, {"ticket_id": "1"}, {"ticket_id": "b"}))


def test_report_covers_companies_that_were_not_expected(spark, factors):
    checked = qu.with_violations(raw(spark, {"channel": None, "company_id": "two"}, {}), factors)
    rows = qu.quality_report(checked, ids(spark, "one")).filter("findings > 0").collect()
    assert [(r.company_id, r.check, r.findings) for r in rows] == [("two", "missing values", 1)]


def test_validated_tickets(spark, factors):
    assert audit.validated_tickets(raw(spark, {}), ids(spark, "one"), factors).count() == 1


CSV_ROWS = [
    {"ticket_id": "T-1", "description": 'Says "hello", twice'},
    {"ticket_id": "T-2", "description": "two\nlines"},
    {"ticket_id": "T-3", "description": "  padded  "},
]


def test_csv_round_trip_keeps_quotes_breaks_and_spaces(spark, factors, tmp_path):
    frame = raw(spark, *CSV_ROWS)
    path = str(tmp_path / "deep" / "tickets")
    ti.write_ticket_files(frame, path)
    ti.write_ticket_files(frame, path)  # overwrites
    back = ti.read_ticket_folder(spark, path, multi_line=True)
    assert sorted(map(tuple, back.drop(ti.CORRUPT).collect())) == sorted(map(tuple, frame.collect()))
    assert {r[ti.CORRUPT] for r in back.collect()} == {None}
    default = ti.read_ticket_folder(spark, path)
    assert sorted(map(str, default.collect())) == sorted(map(str, back.collect()))
    split = ti.read_ticket_folder(spark, path, multi_line=False).collect()
    assert any(r[ti.CORRUPT] for r in split)  # a break inside a cell needs multi_line
    single = ti.read_ticket_files(spark, {"one": f"{path}/company_id=one"}, multi_line=True)
    assert sorted(map(tuple, single.collect())) == sorted(map(tuple, back.collect()))


def test_files_are_read_by_column_name(spark, factors, tmp_path):
    first = tmp_path / "a.csv"
    order = [*reversed(TICKET_COLUMNS), "extra"]
    cells = dict(zip(TICKET_COLUMNS, ["T-1", "2025-01-01", "order status", "x", "5", "no", "email", "vip"]))
    first.write_text(",".join(order) + "\n" + ",".join(cells.get(c, "more") for c in order) + "\n")
    row = ti.read_ticket_files(spark, {"a": str(first)}, multi_line=True).head()
    assert row.company_id == "a" and {c: row[c] for c in TICKET_COLUMNS} == cells


def test_unfit_files_raise(spark, factors, tmp_path):
    lacking = tmp_path / "lacking.csv"
    lacking.write_text("ticket_id,created_at\n1,2\n")
    with pytest.raises(DataContractError, match="channel, customer_tier, description"):
        ti.read_ticket_files(spark, {"a": str(lacking)}, multi_line=True)
    with pytest.raises(DataContractError, match="channel, customer_tier, description"):
        ti.read_ticket_folder(spark, str(lacking), multi_line=True)
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    for path in (str(empty), str(tmp_path / "absent.csv")):
        with pytest.raises(DataContractError, match="Unable to load"):
            ti.read_ticket_files(spark, {"a": path}, multi_line=True)


def test_a_row_with_too_many_cells_is_unreadable(spark, factors, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text(",".join(TICKET_COLUMNS) + "\nT-1,2025-01-01,order status,x,5,no,email,vip,more\n")
    frame = ti.read_ticket_files(spark, {"a": str(path)}, multi_line=True)
    with pytest.raises(DataContractError, match="Unable to load"):
        gate(spark, factors, frame, "a")


COMPANY = {
    "id": "acme",
    "name": "Acme",
    "industry": "Parts",
    "description": "d",
    "headquarters": "Here",
    "support_team_size": 3,
    "support_hours": "9-5",
    "reporting_period_start": "2025-01-01",
    "reporting_period_end": "2025-06-30",
    "disclaimer": "none",
}


def test_companies(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(COMPANY, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({**COMPANY, "id": "bad", "support_team_size": 0, "name": None}, indent=2))
    checked = co.apply_company_contract(co.read_companies(spark, str(tmp_path)))
    rows = {r.id: r for r in checked.collect()}
    assert rows["acme"].ticket_count == 3000 and rows["acme"].violations == []
    assert rows["acme"].demo_status == "Preloaded fictional demo"
    assert rows["bad"].violations == ["name missing", "support_team_size not positive"]
    with pytest.raises(DataContractError, match="bad"):
        co.require_valid_companies(checked)


def test_registry(spark):
    registry = spark.createDataFrame([("a", "A"), ("b", "B")], "company_id string, display_name string")
    assert [r.display_name for r in co.resolve_companies(ids(spark, "b", "b"), registry).collect()] == ["B"]
    with pytest.raises(DataContractError, match="Unknown company: c"):
        co.resolve_companies(ids(spark, "a", "c"), registry)


MARKDOWN = """# Desk handbook

Opening remarks.

## Order status

- **Manual steps:** Look it up.
- **Systems used:** Inbox, carrier page.
plain line

## Billing question
- **Exceptions:** Tax: exempt **only**.
- no label
"""


def test_documents(spark, tmp_path):
    (tmp_path / "one.md").write_text("\n\n" + MARKDOWN + "\n\t\n", encoding="utf-8")
    read = do.require_documents(do.read_documents(spark, str(tmp_path)))
    assert read.head().text == MARKDOWN.strip()
    sections = do.process_sections(read, ["path"]).orderBy("section_no", "pos").collect()
    assert [(r.section, r.label, r.text) for r in sections] == [
        ("order status", "Manual steps", "Look it up."),
        ("order status", "Systems used", "Inbox, carrier page."),
        ("billing question", "Exceptions", "Tax: exempt **only**."),
    ]
    bullets = [r.line for r in do.process_bullets(read, ["path"]).orderBy("line_no").collect()]
    assert bullets == [
        "Process documentation — " + line[2:] for line in MARKDOWN.splitlines() if line.startswith("- **")
    ]
    (tmp_path / "two.md").write_text(" \n\t ")
    with pytest.raises(DataContractError, match="is empty"):
        do.require_documents(do.read_documents(spark, str(tmp_path)))


def test_only_files_with_line_breaks_are_read_whole(spark, tmp_path):
    path = str(tmp_path / "tickets")
    columns = [f"concat('{c}-', id) AS {c}" for c in TICKET_COLUMNS if c != "description"]
    frame = spark.range(6_000).selectExpr(
        "concat('c', id % 2) AS company_id",
        *columns,
        "CASE WHEN id % 1000 = 7 THEN concat('first', chr(10), 'second ', id) WHEN id % 1000 = 8 THEN concat('a', chr(13), id) "
        "ELSE concat('plain ', id) END AS description",
    ).coalesce(1)
    ti.write_ticket_files(frame, path)
    names = ["company_id", *TICKET_COLUMNS]
    back = ti.read_ticket_folder(spark, path)
    assert sorted(map(str, back.select(names).collect())) == sorted(map(str, frame.select(names).collect()))
    assert {r[ti.CORRUPT] for r in back.collect()} == {None}
    bytes_per_part = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        split = back.select("ticket_id").withColumn("part", F.spark_partition_id()).select("part").distinct().count()
        whole = ti.read_ticket_folder(spark, path, multi_line=True).select("ticket_id", F.spark_partition_id().alias("part"))
        assert split > 6 and whole.select("part").distinct().count() <= 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_per_part)
    # One company's rows still come from its files alone, and an explicit choice holds.
    plan = back.filter("company_id = 'c1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "company_id" in plan.split("PartitionFilters", 1)[1][:120]
    assert len(ti.read_ticket_folder(spark, path, multi_line=False).collect()) > 6_000
