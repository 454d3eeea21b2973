"""Small tables for the tests."""

import datetime

from ticketlens.fixed_values import TICKET_COLUMNS
from ticketlens.sources import schemas

DAY = datetime.datetime(2025, 1, 1)


def tickets(spark, rows):
    """rows: (company, id, category, minutes, escalated, channel, tier)."""
    return spark.createDataFrame(
        [(c, i, DAY, k, "A test case", float(m), e, ch, t) for c, i, k, m, e, ch, t in rows],
        schemas.TICKET,
    )


def golden(spark, company="one"):
    """Six tickets, three of each of two categories: 90 minutes and 216 minutes."""
    return tickets(
        spark,
        [
            (company, "a", "account access", 12, False, "chat", "basic"),
            (company, "b", "fraud review", 100, True, "phone", "gold"),
            (company, "c", "account access", 48, False, "chat", "gold"),
            (company, "d", "fraud review", 80, True, "letter", "basic"),
            (company, "e", "account access", 30, True, "phone", "basic"),
            (company, "f", "fraud review", 36, True, "chat", "basic"),
        ],
    )


def raw(spark, *changes, company="one"):
    """Text rows: one good row per dict of changed cells."""
    base = {
        "created_at": "2025-01-01T00:00:00Z",
        "category": "order status",
        "description": "Where is it?",
        "resolution_minutes": "12.5",
        "escalated": "no",
        "channel": "email",
        "customer_tier": "standard",
    }
    rows = []
    for number, change in enumerate(changes, start=1):
        cells = {"ticket_id": f"T-{number}", **base, **change}
        rows.append((change.get("company_id", company), *(cells[c] for c in TICKET_COLUMNS)))
    schema = "company_id string, " + ", ".join(f"{c} string" for c in TICKET_COLUMNS)
    return spark.createDataFrame(rows, schema)
