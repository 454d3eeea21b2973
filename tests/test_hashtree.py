"""Changes located by hash trees, against comparison of all parts."""

import random

from pyspark.sql import functions as F

from ticketlens.operators import hashtree as ht


def _tree(frame):
    found = ht.parts({"text": ht.lines(F.col("text")), "facts": F.transform("facts", lambda f: ht.leaf(f["name"], f["value"]))})
    return frame.withColumn("parts", found).withColumn("root", ht.root(F.col("parts"))).select("k", "root", "parts")


def _flat(rows):
    out = {}
    for k, text, facts in rows:
        for i, line in enumerate([] if text is None else text.split("\n")):
            out[k, "text", f"line {i}"] = line
        for name, value in facts:
            out[k, "facts", name] = value
    return out


def test_changes_equal_comparing_everything(spark):
    rng = random.Random(2)
    kind = "k int, text string, facts array<struct<name:string,value:string>>"
    before = [(k, "\n".join(rng.choice("abc") for _ in range(rng.randint(0, 9))), [(n, rng.choice([None, "1"])) for n in "xyz"]) for k in range(60)]
    after = []
    for k, text, facts in before[5:]:
        if k % 3 == 0:
            text = rng.choice([None, "", text + "\nz", "q" + text[1:], text[:3]])
        if k % 5 == 0:
            facts = rng.choice([[], facts[:2], [("x", "2"), *facts[1:]], [*facts, ("w", "null")]])
        after.append((k, text, facts))
    after.append((99, "new\nlines", []))
    old, new = _flat(before), _flat(after)
    want = {(*at, "added" if at not in old else "removed" if at not in new else "changed") for at in old.keys() | new.keys() if at not in old or at not in new or old[at] != new[at]}
    found = ht.changes(_tree(spark.createDataFrame(before, kind)), _tree(spark.createDataFrame(after, kind)), ["k"])
    got = found.collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 40


def test_equal_states_and_empty_ones(spark):
    frame = spark.createDataFrame([(1, "a\nb", [("x", None)]), (2, None, [])], "k int, text string, facts array<struct<name:string,value:string>>")
    assert ht.changes(_tree(frame), _tree(frame), ["k"]).collect() == []
    assert ht.changes(_tree(frame.limit(0)), _tree(frame.limit(0)), ["k"]).collect() == []
    assert ht.changes(_tree(frame), _tree(frame.limit(0)), ["k"]).count() == 3


def test_a_null_text_is_not_an_empty_one(spark):
    frame = spark.createDataFrame([(1, "a", [("x", None)])], "k int, text string, facts array<struct<name:string,value:string>>")
    other = spark.createDataFrame([(1, "a", [("x", "")])], "k int, text string, facts array<struct<name:string,value:string>>")
    assert [tuple(r) for r in ht.changes(_tree(frame), _tree(other), ["k"]).collect()] == [(1, "facts", "x", "changed")]
