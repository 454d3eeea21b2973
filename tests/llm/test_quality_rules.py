import re
from collections import Counter

from cases import documents
from pyspark.sql import functions as F

from ticketlens.llm import quality_rules
from ticketlens.llm.queries import op1_quality_rules


def _base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    eights = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(eights)
    covered = {j for i, e in enumerate(eights) if times[e] > 1 for j in range(i, i + 8)}
    n = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    return *n, n[0] < 20 or 100 * n[4] > 30 * n[0]


def test_counts_by_definition(spark):
    texts = [
        None, "", " ", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "a " * 30, "x\ny\nx\n \n \nx", "x\r\nx\nx\r\n",
        "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8", "é😀 #*|<>$%& ñ", "  a b", "q w e r t y u i o p " * 3 + "z",
    ]
    rows = documents(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]).select("doc_id", quality_rules.measures(F.col("text")).alias("m"))
    for r in rows.collect():
        assert tuple(r["m"][c] for c in quality_rules.BASE) == _base(texts[r["doc_id"]])[:5], texts[r["doc_id"]]


def test_buckets(spark):
    values = [0, 1, 127, 128, 129, 130, 255, 256, 12_345, 10**12, 2**62]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bucket(F.col("v")).alias("b")).collect()
    for r in rows:
        assert r["b"] <= r["v"] and (r["v"] - r["b"]) * 64 <= r["v"]
        assert r["v"] >= 128 or r["b"] == r["v"]


def test_sketches_merge(spark, awkward):
    docs = awkward.select("lang", "source", quality_rules.measures(F.col("text")).alias("m")).select("lang", "source", "m.*")
    whole = quality_rules.sketch(docs)
    halves = quality_rules.sketch(docs.filter("n_words % 2 = 0")).union(quality_rules.sketch(docs.filter("n_words % 2 = 1")))
    merged = halves.groupBy("lang", "source", "rule", "bucket").agg(F.sum("rows").alias("rows"))
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))


def _plain(i, words=40, end=""):
    return " ".join(f"w{i}x{j}" for j in range(words)) + end


def test_thresholds_follow_the_group(spark):
    def text(i, sign):
        return " ".join(f"w{i}x{j}{sign if j % 2 else ''}" for j in range(40))

    # Symbols are usual in one source, and a sign of junk in the other.
    rows = [(i, text(i, "#"), "en", "code", 0) for i in range(300)]
    rows += [(1000 + i, text(i, "#" if i < 5 else ""), "en", "web", 0) for i in range(300)]
    rows += [(5000, text(1, "#"), "en", "small", 0)]  # few rows: nearly judged by its language
    found = {r["key"]: r["kept"] for r in quality_rules.judged(documents(spark, rows)).collect()}
    assert all(found[i] for i in range(300))
    assert [found[1000 + i] for i in range(300)] == [False] * 5 + [True] * 295
    assert found[5000]


def test_every_rule_rejects_by_itself(spark):
    odd = {
        "symbols": _plain(600, end="#"),
        "capitals": _plain(601, 36) + " WAXBYCZ VBUCTDS",
        "marks": _plain(602, end="!"),
        "dup_lines": "\n".join(["same line", *(f"w603x{j} w604x{j}" for j in range(20)), "same line"]),
        "repeated": _plain(604, 90) + " " + _plain(604, 9),
        "word_length": " ".join(f"w{j}" + "x" * 20 for j in range(40)),
    }
    assert set(odd) == {r.name for r in quality_rules.RULES}
    rows = [(i, _plain(100 + i, 20 + i % 80), "en", "web", 0) for i in range(400)]
    rows += [(1000 + i, text, "en", "web", 0) for i, text in enumerate(odd.values())]
    found = {r["key"]: r for r in quality_rules.judged(documents(spark, rows)).collect()}
    assert all(found[i]["kept"] for i in range(400))
    for i, name in enumerate(odd):
        assert not found[1000 + i]["base_failed"]
        assert found[1000 + i]["broken"] == [name]


def test_no_step_with_the_size_of_a_group(spark):
    def fence(own):
        junk = _plain(1, end=" # # # # # # # # # #")
        rows = [(i, _plain(i), "en", "web", 0) for i in range(300)] + [(1000 + i, junk, "en", "small", 0) for i in range(own)]
        docs = documents(spark, rows).select("lang", "source", quality_rules.measures(F.col("text")).alias("m"))
        found = quality_rules.blended(quality_rules.sketch(docs.select("lang", "source", "m.*")))
        return {r["bucket"]: r["weight"] for r in found.filter("source = 'small' AND rule = 'symbols'").collect()}

    # Own rows come in one by one, and what the others weigh hardly moves.
    few, more = fence(4), fence(5)
    (zero,) = {k for k in few if k == 0}
    assert abs(few[zero] - more[zero]) < 300 and abs(max(more.items())[1] - max(few.items())[1] - quality_rules.UNIT) < 300


def test_fences_by_definition(spark, sf_dir):
    """Quantiles from whole value lists, row by row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    measured = docs.select("lang", "source", quality_rules.measures(F.col("text")).alias("m")).select("lang", "source", "m.*")
    values = measured.select("lang", "source", *(F.expr(r.value).alias(r.name) for r in quality_rules.RULES)).collect()
    found = {(r["lang"], r["source"]): r["limits"] for r in quality_rules.fences(quality_rules.sketch(measured)).collect()}
    assert len(found) == len({(v["lang"], v["source"]) for v in values})

    def bucket(v):
        extra = max(v.bit_length() - 7, 0)
        return v >> extra << extra

    for r in quality_rules.RULES:
        for lang, source in found:
            weights = Counter()
            levels = [[v for v in values if v["lang"] == lang and v["source"] == source], [v for v in values if v["lang"] == lang], values]
            for level, unit in zip(levels, (None, quality_rules.PRIOR, quality_rules.PRIOR), strict=True):
                for b, n in Counter(bucket(v[r.name]) for v in level).items():
                    weights[b] += n * quality_rules.UNIT if unit is None else unit * quality_rules.UNIT * n // len(level)

            def quantile(per_mille, weights=weights):
                upto = 0
                for b in sorted(weights):
                    upto += weights[b]
                    if upto * 1000 >= sum(weights.values()) * per_mille:
                        return b

            bottom, middle, top = map(quantile, (1000 - r.tail, 500, r.tail))
            limits = found[lang, source]
            assert limits[f"high_{r.name}"] == top + r.reach * (top - middle) + quality_rules.SLACK
            assert limits[f"low_{r.name}"] == (bottom - r.reach * (middle - bottom) - quality_rules.SLACK if r.low else 0)


def test_awkward_rows(awkward, nothing):
    rows = quality_rules.judged(awkward).collect()
    texts = sorted(map(_base, (r["text"] for r in awkward.collect())))
    assert sorted((*(r[c] for c in quality_rules.BASE), r["base_failed"]) for r in rows) == texts
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality_rules.judged(nothing).collect() == []


def test_query_keeps_good_and_rejects_bad(spark, sf_dir):
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in op1_quality_rules(spark, sf_dir).collect() if not r["base_failed"]]
    good = [r["kept"] for r in rows if marks.get(r["doc_id"]) == 1]
    bad = [r["kept"] for r in rows if marks.get(r["doc_id"]) == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.2 * len(bad)
