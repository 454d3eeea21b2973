from cases import documents, labels
from pyspark.sql import functions as F

from ticketlens.llm import rule_ensemble
from ticketlens.llm.queries import op5_quality


def test_rules_are_columns_and_sparse(spark):
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(f"w{i}a{j}{'###' if bad else ''}" for j in range(5 + i % 50)), "en", "s", 0))
        marks.append((i, int(not bad), 0))
    docs = documents(spark, rows)
    ensemble = rule_ensemble.fit(docs, labels(spark, [*marks, (1, None, 0), (None, 1, 0)]))
    assert 0 < len(ensemble.rules) < 150
    found = {r["key"]: r["score"] for r in rule_ensemble.scores(docs, ensemble).collect()}
    assert all((found[i] >= 0.7) == (i % 4 != 0) for i in found)
    plan = rule_ensemble.scores(docs, ensemble)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    # The statistics are computed once a row, not once a rule.
    assert plan.split("== Physical Plan ==")[1].count("array_distinct") <= 4


def test_one_kind_of_labels_or_none(spark):
    docs = documents(spark)
    for marks in ([], [(1, 1, 0)], [(1, None, 0)]):
        ensemble = rule_ensemble.fit(docs, labels(spark, marks))
        assert ensemble.rules == ()
        assert len({r["score"] for r in rule_ensemble.scores(docs, ensemble).collect()}) == 1


def test_awkward_rows(awkward, nothing):
    ensemble = rule_ensemble.Ensemble(((((("symbols", ">", 0.5)),), 2.0),), -1.0)
    rows = rule_ensemble.scores(awkward, ensemble).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert rule_ensemble.scores(nothing, ensemble).collect() == []
    stats = awkward.select(rule_ensemble.statistics(F.col("text")).alias("s")).select("s.*").collect()
    assert all(v is not None and v == v for r in stats for v in r)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in op5_quality(spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in marks]
    right = sum(r["predicted"] == marks[r["doc_id"]] for r in rows)
    assert right >= 0.95 * len(rows) and len(rows) > 50
