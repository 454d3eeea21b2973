"""Files that differ or are broken, and the one pass over the cells of tickets taken in."""

import gzip
import shutil

import pytest
from pyspark.sql import functions as F

from helpers import raw
from ticketlens.fixed_values import TICKET_COLUMNS
from ticketlens.operators import quality as qu
from ticketlens.plans import intake
from ticketlens.sources import folders
from ticketlens.sources.dimensions import factor_table
from ticketlens.sources.tickets import CORRUPT

ROW = {
    "ticket_id": "T-1", "created_at": "2025-01-01", "category": "order status", "description": "Where, is\nit?",
    "resolution_minutes": "5", "escalated": "no", "channel": "email", "customer_tier": "standard",
}


def _text(columns, rows, end="\n"):
    lines = [",".join(columns)] + [",".join('"' + r.get(c, "more").replace('"', '""') + '"' for c in columns) for r in rows]
    return ("\n".join(lines) + end).encode()


@pytest.fixture
def folder(tmp_path):
    base = tmp_path / "tickets"
    good = _text(TICKET_COLUMNS, [ROW, {**ROW, "ticket_id": "T-2", "description": 'say "hi"'}])
    files = {
        "company_id=one/a.csv": good,
        "company_id=one/reordered.csv": _text(TICKET_COLUMNS[::-1], [{**ROW, "ticket_id": "T-3"}]),
        "company_id=one/more.csv": _text(("x", *TICKET_COLUMNS, "y"), [{**ROW, "ticket_id": "T-4"}], end=""),
        "company_id=middle east+/a.csv": b"\xef\xbb\xbf" + good.replace(b"\n", b"\r\n", 1),
        "company_id=middle east+/nothing.csv": b"",
        "company_id=two/blank.csv": b"\n  \n",
        "company_id=two/header only.csv": _text(TICKET_COLUMNS, []),
        "company_id=two/lacking.csv": _text([c for c in TICKET_COLUMNS if c not in ("channel", "category")], [ROW]),
        "company_id=two/twice.csv": _text((*TICKET_COLUMNS, "channel"), [ROW]),
        "company_id=two/cut in quote.csv": good[:-4],
        "company_id=two/cut in row.csv": _text(TICKET_COLUMNS, [ROW]) + b'"T-9","2025',
        "company_id=two/cut after cell.csv": _text(TICKET_COLUMNS, [ROW]) + b'"T-9","2025-01-01"',
        "company_id=two/binary.csv": gzip.compress(good),
        "company_id=two/latin.csv": good + '"T-é"'.encode("latin-1") + b",1,2,3,4,5,6,7\n",
    }
    for name, content in files.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(content)
    return str(base), len(files)


def test_every_file_has_a_verdict_and_good_ones_are_read(spark, folder):
    path, count = folder
    rows, findings = folders.read_folder_apart(spark, path)
    found = {r["path"].rsplit("/", 1)[1] if r["company_id"] == "two" else f"{r['company_id']}/" + r["path"].rsplit("/", 1)[1]: (r["verdict"], r["detail"]) for r in findings.collect()}
    assert found == {
        "one/a.csv": ("ok", ""),
        "one/reordered.csv": ("ok", ""),
        "one/more.csv": ("ok", ""),
        "middle east+/a.csv": ("ok", ""),
        "middle east+/nothing.csv": ("empty", "no content"),
        "blank.csv": ("empty", "no content"),
        "header only.csv": ("empty", "no rows"),
        "lacking.csv": ("wrong header", "missing category, channel"),
        "twice.csv": ("wrong header", "a column occurs twice"),
        "cut in quote.csv": ("cut", "a quote is not closed"),
        "cut in row.csv": ("cut", "a quote is not closed"),
        "cut after cell.csv": ("cut", "the last row lacks cells"),
        "binary.csv": ("unreadable", "not UTF-8 text"),
        "latin.csv": ("unreadable", "not UTF-8 text"),
    }
    assert len(found) == count
    got = sorted((r["company_id"], r["ticket_id"], r["description"], r["customer_tier"], r[CORRUPT]) for r in rows.collect())
    text, quoted = ROW["description"], 'say "hi"'
    assert got == sorted(
        [("one", "T-1", text, "standard", None), ("one", "T-2", quoted, "standard", None), ("one", "T-3", text, "standard", None),
         ("one", "T-4", text, "standard", None), ("middle east+", "T-1", text, "standard", None), ("middle east+", "T-2", quoted, "standard", None)]
    )


def test_files_are_scanned_once_for_findings(spark, folder):
    plan = folders.file_findings(spark, folder[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "ReadSchema: struct<path:string>" in plan


def test_a_folder_without_a_good_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    rows, findings = folders.read_folder_apart(spark, str(tmp_path))
    assert rows.collect() == [] and rows.columns == ["company_id", *TICKET_COLUMNS, CORRUPT]
    assert [(r["verdict"], r["company_id"]) for r in findings.collect()] == [("empty", None)]


def test_one_pass_over_the_cells(spark, tmp_path):
    changes = [{}, {"ticket_id": "T-1"}, {"created_at": "never"}, {"escalated": "maybe", "channel": ""}, {"category": "parking"}, {"company_id": "two"}]
    frame = raw(spark, *changes).withColumn(CORRUPT, F.when(F.col("category") == "parking", "parking,1"))
    source = str(tmp_path / "raw")
    frame.coalesce(1).write.parquet(source)
    cells = spark.read.parquet(source)
    companies = spark.createDataFrame([("one",), ("none",)], "company_id string")
    factors = factor_table(spark)
    checked = qu.with_violations(cells, factors)
    want = [sorted(map(repr, f.collect())) for f in (qu.normalized(checked), qu.quarantine(checked), qu.quality_report(checked, companies))]
    done = intake.take_in(cells, factors, companies, str(tmp_path / "out"))
    # All parts come from what was written: the source may go.
    shutil.move(source, str(tmp_path / "gone"))
    columns = qu.quarantine(checked).columns
    got = [sorted(map(repr, f.collect())) for f in (done.good, done.set_aside.select(columns), done.report)]
    assert got == want
    assert done.totals == {"rows": 6, "set_aside": 3, "unreadable": 1, "missing": 1, "invalid": 3}
    plan = done.report._jdf.queryExecution().executedPlan().toString()
    assert "description:string" not in plan and "rlike" not in plan.lower()


def test_nothing_taken_in(spark, tmp_path):
    cells = raw(spark, {}).limit(0)
    done = intake.take_in(cells, factor_table(spark), spark.createDataFrame([("one",)], "company_id string"), str(tmp_path / "out"))
    assert done.totals["rows"] == 0 and done.good.collect() == [] and done.set_aside.collect() == []
    assert {(r["check"], r["findings"]) for r in done.report.collect() if r["findings"]} == {("empty", 1)}
