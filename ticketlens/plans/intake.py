"""Taking tickets in: one pass over the cells that checks, types, sets aside and counts.

The checked rows are written once, good ones apart from the others, with what the contract found as flags. Totals are
observed while they are written. The report by company, repeated ids included, reads the flags and ids of the written table; no cell is
parsed or looked at a second time, and the source may be gone by then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ticketlens.operators import quality as qu


@dataclass(frozen=True)
class Intake:
    """Good rows, typed; rows set aside, as read; the report by company; totals over all companies."""

    good: DataFrame
    set_aside: DataFrame
    report: DataFrame
    totals: dict[str, int]


def take_in(raw: DataFrame, categories: DataFrame, companies: DataFrame, path: str) -> Intake:
    """Check ``raw`` and write it below ``path``, in one job.

    ``totals`` holds ``rows``, ``set_aside`` and the rows ``unreadable``, with ``missing`` and with ``invalid`` cells. If none is
    set aside and the report finds no repeated id, the table meets the contract.
    """
    checked = qu.flagged(qu.with_violations(raw, categories))
    broken = F.size("violations") > 0
    seen = Observation("ticket intake")
    observed = checked.withColumn("kept", ~broken).observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(broken).alias("set_aside"),
        *(F.count_if(name).alias(name.removeprefix("_row_")) for name in qu.FLAGS),
    )
    observed.write.partitionBy("kept").parquet(path)
    schema = observed.schema
    stored = raw.sparkSession.read.schema(schema).parquet(path)
    raw_columns = [*raw.columns, "violations"]
    return Intake(
        good=qu.normalized(stored.filter("kept")),
        set_aside=stored.filter("NOT kept").select(*raw_columns),
        report=qu.report_of(stored, companies),
        totals=dict(seen.get),
    )
