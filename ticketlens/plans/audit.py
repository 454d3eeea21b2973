"""The complete support audit of all companies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ticketlens.operators import evidence as ev
from ticketlens.operators import metrics as me
from ticketlens.operators import quality as qu
from ticketlens.operators import scoring as sc


@dataclass(frozen=True)
class SupportAudit:
    companies: DataFrame
    overall: DataFrame
    metrics: DataFrame
    channels: DataFrame
    tiers: DataFrame
    opportunities: DataFrame
    highest_volume: DataFrame
    highest_automation: DataFrame


def validated_tickets(raw: DataFrame, companies: DataFrame, factors: DataFrame) -> DataFrame:
    """Typed tickets of a table that passes every check; the first failing check raises."""
    checked = qu.with_violations(raw, factors)
    qu.require_valid(qu.quality_report(checked, companies))
    return qu.normalized(checked)


def scored_metrics(cube: DataFrame, factors: DataFrame) -> DataFrame:
    return sc.scored(me.category_metrics(cube), factors)


def opportunities(cube: DataFrame, factors: DataFrame) -> DataFrame:
    return sc.ranked(scored_metrics(cube, factors))


def support_audit(cube: DataFrame, companies: DataFrame, factors: DataFrame) -> SupportAudit:
    """All parts of the audit, lazily, from ``metrics.ticket_cube``.

    Stage the cube (``session.staged``) before using several parts: the tickets are
    then scanned and shuffled once for all of them.
    """
    metrics = scored_metrics(cube, factors)
    ranked = sc.ranked(metrics)
    return SupportAudit(
        companies=companies,
        overall=me.overall_metrics(cube),
        metrics=metrics,
        channels=me.dimension_counts(cube, "channel"),
        tiers=me.dimension_counts(cube, "customer_tier"),
        opportunities=ranked,
        highest_volume=sc.highest_volume(metrics),
        highest_automation=sc.highest_automation(ranked),
    )


def audit_evidence(audit: SupportAudit) -> DataFrame:
    """One row per company with the evidence that packages and contexts are made of."""
    return ev.company_evidence(
        ev.category_evidence(audit.opportunities), audit.overall, audit.companies
    )
