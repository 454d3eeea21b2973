"""Metrics, scores, ranking, explanations and presentation on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import golden
from ticketlens import fixed_values as fixed
from ticketlens.errors import DataContractError
from ticketlens.operators import evidence as ev
from ticketlens.operators import metrics as me
from ticketlens.operators import presentation as pr
from ticketlens.operators import scoring as sc
from ticketlens.plans import audit
from ticketlens.sources.dimensions import factor_table
from ticketlens.workloads import tables as tb


@pytest.fixture(scope="module")
def one(spark):
    cube = me.ticket_cube(golden(spark))
    companies = spark.createDataFrame([("one", "One")], "id string, name string")
    return audit.support_audit(cube, companies, factor_table(spark))


def by_category(frame):
    return {r["category"]: r for r in frame.collect()}


def test_golden_totals(one):
    row = one.overall.head()
    # (90 + 216) / 60 hours; four of six escalated.
    assert (row.total_ticket_count, row.total_handling_hours, row.overall_escalation_rate) == (6, 5.1, 0.666667)


def test_golden_categories_and_scores(one):
    rows = by_category(one.metrics)
    access, fraud = rows["account access"], rows["fraud review"]
    assert access.ticket_count == 3 and access.category_percentage == 50
    assert access.average_resolution_minutes == 30 and access.total_handling_hours == 1.5
    assert access.escalation_rate == pytest.approx(1 / 3)
    # 30 for volume, 25 * 0.95, 15 * 30 / 90, 15 * 2 / 3, 15 * 0.95
    assert access.automation_score == 83.0
    # 30, 25 * 0.18, 15 * 72 / 90, 0, 15 * 0.22
    assert fraud.automation_score == 49.8
    assert [r.position for r in (access, fraud)] == [1, 2]


def test_golden_dimensions(one):
    channels = [(r.value, r.ticket_count) for r in one.channels.orderBy("position").collect()]
    tiers = [(r.value, r.ticket_count) for r in one.tiers.orderBy("position").collect()]
    assert channels == [("chat", 3), ("phone", 2), ("letter", 1)]
    assert tiers == [("basic", 4), ("gold", 2)]


def test_three_tie_rules(one):
    """Equal volume: the audit takes the last name, the overview the first."""
    assert one.highest_volume.head().category == "fraud review"
    extremes = sc.overview_extremes(one.metrics).head()
    assert extremes.volume_category == "account access"
    assert extremes.score_category == "account access" and extremes.top_score == 83.0
    assert one.highest_automation.head().category == "account access"


def test_positions_of_a_million_values(spark):
    """One company with a million channels: places agree with a sort, and no window gathers them."""
    counted = spark.range(1_000_000).select(
        F.lit("one").alias("company_id"),
        F.concat(F.lit("c"), "id").alias("channel"),
        (F.col("id") % 3).alias("ticket_count"),
    )
    out = me.dimension_counts(counted, "channel")
    row = out.agg(F.count("*"), F.min("position"), F.max("position"), F.countDistinct("position")).head()
    assert tuple(row) == (1_000_000, 1, 1_000_000, 1_000_000)
    first = out.filter("position <= 3").orderBy("position").collect()
    assert [r.value for r in first] == ["c100001", "c100004", "c100007"]
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in text


def test_positions_of_missing_values(spark):
    cube = spark.createDataFrame([(None, "x", 1), (None, None, 2), ("one", None, 3)], "company_id string, channel string, ticket_count bigint")
    got = {(r.company_id, r.value): r.position for r in me.dimension_counts(cube, "channel").collect()}
    assert got == {(None, None): 1, (None, "x"): 2, ("one", None): 1}


def test_summary_levels_agree(spark):
    rows = me.support_summary(me.ticket_cube(golden(spark))).collect()
    totals = {}
    for r in rows:
        totals[r.level] = totals.get(r.level, 0) + r.ticket_count
    assert totals == {"company": 6, "category": 6, "channel": 6, "customer_tier": 6}


def test_missing_dimension_values_keep_their_level(spark):
    frame = golden(spark).withColumn("channel", F.lit(None).cast("string"))
    rows = me.support_summary(me.ticket_cube(frame)).filter("level = 'channel'").collect()
    assert [(r.value, r.ticket_count) for r in rows] == [(None, 6)]


def metrics_rows(spark, rows):
    """rows: (category, count, maximum, average, rate, score)."""
    return spark.createDataFrame(
        [("one", *r) for r in rows],
        "company_id string, category string, ticket_count bigint, maximum_category_count bigint,"
        "average_resolution_minutes double, escalation_rate double, automation_score double",
    )


def test_ranking_breaks_ties_by_name(spark):
    frame = metrics_rows(
        spark,
        [
            ("return request", 1, 1, 1.0, 0.1, 60.0),
            ("billing question", 1, 1, 1.0, 0.1, 60.0),
            ("order status", 1, 1, 1.0, 0.1, 90.0),
        ],
    )
    ranked = sc.ranked(sc.with_factors(frame, factor_table(spark))).orderBy("rank").collect()
    assert [(r.category, r["rank"]) for r in ranked] == [
        ("order status", 1),
        ("billing question", 2),
        ("return request", 3),
    ]


def test_explanations(spark):
    frame = metrics_rows(
        spark,
        [("order status", 100, 100, 12.0, 0.03, 90.0), ("damaged shipment", 20, 100, 120.0, 0.5, 30.0)],
    )
    rows = by_category(sc.ranked(sc.with_factors(frame, factor_table(spark))))
    assert rows["order status"].explanation == (
        "High volume increases the potential impact; the workflow is highly repetitive; "
        "a low escalation rate supports automation suitability; "
        "a consistent process supports repeatable automation."
    )
    assert rows["damaged shipment"].explanation == (
        "Lower volume limits the potential impact; limited repetition reduces suitability; "
        "long handling time increases potential savings but does not guarantee suitability; "
        "a high escalation rate reduces the score; an inconsistent process reduces the score."
    )


def test_scores_follow_the_weights(spark):
    """Against the weighted sum in plain Python, including the bounds."""
    rng = random.Random(11)
    factors = {name: (r, c) for name, r, c in fixed.PROCESS_FACTORS}
    rows = []
    for name in factors:
        rows.append((name, rng.randint(0, 50), rng.choice([0, 50]), rng.uniform(0, 200), rng.random(), 0.0))
    rows.append(("order status", 9, 9, float("inf"), 0.0, 0.0))
    frame = sc.scored(metrics_rows(spark, rows).drop("automation_score"), factor_table(spark))
    got = {(r.category, r.ticket_count): r.automation_score for r in frame.collect()}
    for name, count, top, minutes, rate, _ in rows:
        repetitiveness, consistency = factors[name]
        terms = (
            0.30 * (count / top if top else 0),
            0.25 * repetitiveness,
            0.15 * min(minutes / 90, 1),
            0.15 * (1 - rate),
            0.15 * consistency,
        )
        total = 0.0
        for term in terms:
            total += term
        assert got[name, count] == round(max(0, min(100, 100 * total)), 2)


def test_unknown_category_is_kept_and_can_stop_the_run(spark):
    frame = metrics_rows(spark, [("no such thing", 1, 1, 1.0, 0.1, 1.0)])
    joined = sc.with_factors(frame, factor_table(spark))
    assert joined.head().has_factors is False
    with pytest.raises(DataContractError, match="no such thing"):
        sc.require_factors(joined)
    with pytest.raises(Exception, match="No factors for category"):
        ranked = sc.ranked(joined).withColumns(
            {c: F.lit(0.0) for c in ("category_percentage", "total_handling_hours")}
        )
        ev.category_evidence(ranked).collect()


def test_factors_name_each_category_once(spark):
    with pytest.raises(DataContractError, match="more than one row"):
        factor_table(spark, [("a", 0.1, 0.2), ("a", 0.3, 0.4)])


def test_bands_top_and_rest(spark):
    rows = [(n, 1, 1, 1.0, 0.1, s) for n, s in zip(("a", "b", "c", "d", "e"), (75.0, 74.99, 55.0, 54.99, 3.0))]
    frame = metrics_rows(spark, rows).withColumns(
        {"repetitiveness": F.lit(0.5), "process_consistency": F.lit(0.6)}
    )
    ranked = sc.ranked(frame)
    bands = [r.band for r in pr.ranking_cards(ranked).orderBy("rank").collect()]
    assert bands == ["Strong opportunity", "Moderate opportunity", "Moderate opportunity"] + [
        "Limited opportunity"
    ] * 2
    assert sc.top_opportunities(ranked).count() == 3
    assert [r.category for r in sc.remaining_opportunities(ranked).orderBy("rank").collect()] == ["d", "e"]


def test_chart_series(spark):
    frame = spark.createDataFrame(
        [("one", "billing question", 20, 16.67, 60.0), ("one", "order status", 60, 10.0, 85.0)],
        "company_id string, category string, ticket_count bigint, total_handling_hours double, automation_score double",
    )
    rows = pr.chart_series(frame).orderBy("chart", "pos").collect()
    order = {}
    for r in rows:
        order.setdefault(r.chart, []).append(r)
    assert [r.label for r in order["volume"]] == ["Order Status", "Billing Question"]
    assert [r.label for r in order["hours"]] == ["Billing Question", "Order Status"]
    assert [r.value for r in order["score"]] == [85.0, 60.0]
    assert {r.axis_max for r in order["score"]} == {108.0}
    assert {r.axis_max for r in order["volume"]} == {60 * 1.22}
    assert [r.gradient_pos for r in order["hours"]] == [0.0, 1.0]
    with pytest.raises(DataContractError):
        pr.require_categories(frame.limit(0))


def test_headline_cards(one):
    cards = pr.headline_cards(one.overall, sc.overview_extremes(one.metrics)).orderBy("card_no")
    assert [(r.value, r.support) for r in cards.collect()] == [
        ("6", "All recorded tickets"),
        ("5.1", "Recorded resolution effort"),
        ("66.7%", "Share requiring escalation"),
        ("Account Access", "3 tickets"),
        ("Account Access", "83.0 out of 100"),
    ]


def test_fact_lines(one):
    lines = by_category(one.opportunities.withColumn("lines", ev.fact_lines()))["fraud review"].lines
    assert lines == [
        "Ticket count: 3",
        "Category percentage: 50.00%",
        "Average resolution minutes: 72.00",
        "Total handling hours: 3.60",
        "Escalation rate: 100.00%",
        "Automation score: 49.80/100",
    ]


def test_companies_do_not_mix(spark):
    both = golden(spark, "one").unionByName(golden(spark, "two").filter("ticket_id <> 'b'"))
    rows = {r.company_id: r for r in me.overall_metrics(me.ticket_cube(both)).collect()}
    assert rows["one"].total_ticket_count == 6 and rows["two"].total_ticket_count == 5
    assert rows["two"].total_handling_hours == 3.43


def test_invariants_per_company(spark, sf_dir):
    metrics = audit.opportunities(tb.cube(spark, sf_dir, "category"), tb.factors(spark))
    rows = metrics.groupBy("company_id").agg(
        F.sum("category_percentage").alias("share"),
        F.min("automation_score").alias("low"),
        F.max("automation_score").alias("high"),
        F.max("rank").alias("last"),
        F.count("*").alias("n"),
        F.countDistinct("rank").alias("ranks"),
    )
    for r in rows.collect():
        assert abs(r.share - 100) < 1e-9 and 0 <= r.low <= r.high <= 100
        assert r["last"] == r.n == r.ranks


def test_results_do_not_depend_on_partitioning(spark, sf_dir):
    base = tb.tickets(spark, sf_dir)
    factors = tb.factors(spark)
    results = []
    for frame in (base.repartition(1), base.repartition(9, "ticket_id"), base.orderBy(F.desc("ticket_id"))):
        rows = audit.opportunities(me.ticket_cube(frame, ["category"]), factors).collect()
        results.append(sorted(map(tuple, rows), key=str))
    assert results[0] == results[1] == results[2]
