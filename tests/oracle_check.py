"""Compare registered queries with their DuckDB statements.

``python tests/oracle_check.py SF_DIR [query …]``
"""

from __future__ import annotations

import datetime
import sys
import tempfile
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def compare(spark, con, sf_dir: str, name: str, frame=None) -> str | None:
    """None if both results hold the same rows, else what differs."""
    frame = queries()[name](spark, sf_dir) if frame is None else frame
    names = sorted(frame.columns)
    got = Counter(
        tuple(map(_plain, row)) for row in frame.select(*(f"`{n}`" for n in names)).collect()
    )
    cursor = con.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != names:
        return f"columns {names} against {sorted(columns)}"
    order = [columns.index(n) for n in names]
    expected = Counter(tuple(_plain(row[i]) for i in order) for row in cursor.fetchall())
    if got == expected:
        return None
    extra, lacking = got - expected, expected - got
    return (
        f"{sum(got.values())} rows against {sum(expected.values())}; "
        f"only here {str(list(extra)[:2])[:500]}; only there {str(list(lacking)[:2])[:500]}"
    )


def main() -> None:
    from ticketlens.session import build_session

    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="oracle-check-"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1]
    con = connect(sf_dir)
    for name in sys.argv[2:] or list(oracle_sql()):
        start = time.time()
        try:
            difference = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            difference = f"error {str(error)[:700]}"
        print("ok  " if difference is None else "DIFF", name, round(time.time() - start, 1), difference or "", flush=True)


if __name__ == "__main__":
    main()
