import random
from fractions import Fraction

import pytest
from cases import documents
from pyspark.sql import functions as F

from ticketlens.llm import mixing
from ticketlens.llm.queries import domain_of, mix_weights


def _fill(given, nodes):
    """Exact shares by name: again and again, nodes that can't take their share are filled."""
    share, left, todo = {}, Fraction(given), {n: x for n, x in nodes.items() if x[0] > 0}
    while todo:
        total = sum(w for w, _ in todo.values())
        short = [n for n, (w, cap) in todo.items() if cap <= left * w / total]
        if not short:
            return share | {n: left * w / total for n, (w, _) in todo.items()}
        level = min(Fraction(todo[n][1], todo[n][0]) for n in short)
        for n in [n for n in short if Fraction(todo[n][1], todo[n][0]) == level]:
            share[n] = Fraction(todo[n][1])
            left -= todo.pop(n)[1]
    return share


def _leaves(spark, rows):
    names = "domain string, lang string, source string, weight_domain long, weight_lang long, weight_source long, tokens long"
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("seed", range(3))
def test_budgets_by_repeated_filling(spark, seed):
    rng = random.Random(seed)
    rows, weights = [], {}
    for d in "ABC":
        for l in (None, "x", "y"):
            for s in range(rng.randint(1, 4)):
                w = (weights.setdefault(d, rng.randint(1, 5)), weights.setdefault((d, l), rng.randint(0, 4)), rng.randint(0, 3))
                rows.append((d, l, f"s{s}", *w, rng.choice([1, 10, 100, 5000])))
    total = rng.choice([50, 3000, 10**6])
    got = {r["leaf"]: r for r in mixing.budgets(_leaves(spark, rows), total, 2).collect()}
    leaf = {r[:3]: f'{{"domain":"{r[0]}","lang":{chr(34) + r[1] + chr(34) if r[1] else "null"},"source":"{r[2]}"}}' for r in rows}
    cap = {r[:3]: 2 * r[6] if min(r[3:6]) > 0 else 0 for r in rows}
    assert {k: got[leaf[k]]["capacity"] for k in cap} == cap
    given = min(total, sum(cap.values()))
    assert sum(r["budget"] for r in got.values()) == given

    def under(prefix):
        return sum(c for k, c in cap.items() if k[: len(prefix)] == prefix)

    def budget(prefix):
        return sum(got[leaf[k]]["budget"] for k in cap if k[: len(prefix)] == prefix)

    # Each level shares what its parent was given, whole tokens apart.
    for d, share in _fill(given, {(d,): (weights[d], under((d,))) for d in "ABC"}).items():
        assert abs(budget(d) - share) < 1
    for d in "ABC":
        for l, share in _fill(budget((d,)), {(d, l): (weights[d, l], under((d, l))) for l in (None, "x", "y")}).items():
            assert abs(budget(l) - share) < 1
            nodes = {r[:3]: (r[5], cap[r[:3]]) for r in rows if r[:2] == l}
            for k, part in _fill(budget(l), nodes).items():
                assert abs(got[leaf[k]]["budget"] - part) < 1
                assert got[leaf[k]]["budget"] <= cap[k]


def test_shortage_stays_in_the_family(spark):
    rows = [("A", "x", "s1", 1, 1, 1, 10), ("A", "x", "s2", 1, 1, 1, 1000), ("B", "x", "s1", 1, 1, 1, 1000)]
    got = {r["leaf"][11:12] + r["leaf"][-4:-2]: r["budget"] for r in mixing.budgets(_leaves(spark, rows), 800, 1).collect()}
    assert got == {"As1": 10, "As2": 390, "Bs1": 400}


def test_prefixes(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "en", f"src{rng.choice([0, 0, 0, 1, 2, 7])}", 0) for i in range(400)]
    rows += [(9999, "a b c", "en", "src0", 5)] * 40  # one id forty times
    frame = documents(spark, rows)
    found = mixing.mixed(frame, domain_of(F.col("source")), mix_weights()).collect()
    assert len(found) == len(rows)
    by_leaf = {}
    for r in found:
        assert r["tokens"] == len(r["row"]["text"].split()) + 1
        by_leaf.setdefault(r["leaf"], []).append(r)
    for members in by_leaf.values():
        budget, total = members[0]["budget"], sum(r["tokens"] for r in members)
        whole, rest = divmod(budget, total)
        sizes = {}
        for r in members:
            sizes[r["row"]["doc_id"]] = sizes.get(r["row"]["doc_id"], 0) + r["tokens"]
        import hashlib

        order = sorted(sizes, key=lambda i: hashlib.md5(f"{mixing.SEED}:{whole}:{i}".encode()).hexdigest())
        taken, start = set(), 0
        for i in order:
            if start < rest:
                taken.add(i)
            start += sizes[i]
        assert {r["row"]["doc_id"]: r["copies"] for r in members} == {i: whole + (i in taken) for i in sizes}


def test_awkward_rows(awkward, nothing):
    rows = mixing.mixed(awkward, domain_of(F.col("source")), mix_weights()).collect()
    assert len(rows) == awkward.count() and all(r["row"]["key"] == 0 and r["copies"] >= 0 for r in rows)
    assert sum(r["copies"] * r["tokens"] for r in rows) >= sum(r["tokens"] for r in rows) * 0.5
    assert mixing.mixed(nothing, domain_of(F.col("source")), mix_weights()).collect() == []
