"""The language model against the formulas written out, and its verdicts on labelled documents."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest

from vertexloom.lineage import cut
from vertexloom.llm import quality

SF = "/root/testdata/sf0.01"


def reference(texts, order=quality.ORDER):
    """Log probabilities of an interpolated modified Kneser-Ney model, from dictionaries."""
    size = len({c for t in texts for c in t}) + 1
    counts = {order: Counter()}
    padded = lambda t: quality.BEGIN * (order - 1) + t
    for t in texts:
        s = padded(t)
        counts[order].update(s[i - order + 1 : i + 1] for i in range(order - 1, len(s)))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    tables = {}
    for n, table in counts.items():
        c = [max(sum(v == k for v in table.values()), 1) for k in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1])
        d = [min(max(k - (k + 1) * y * c[k] / c[k - 1], 0.1), k - 0.1) for k in (1, 2, 3)]
        total, freed = defaultdict(float), defaultdict(float)
        for g, v in table.items():
            total[g[:-1]] += v
            freed[g[:-1]] += d[min(v, 3) - 1]
        tables[n] = (table, d, total, freed)

    def p(g):
        if not g:
            return 1 / size
        table, d, total, freed = tables[len(g)]
        if g[:-1] not in total:
            return p(g[1:])
        v = table.get(g, 0)
        return ((v - d[min(v, 3) - 1]) if v else 0) / total[g[:-1]] + freed[g[:-1]] / total[g[:-1]] * p(g[1:])

    def logs(t):
        s = padded(t)
        return [math.log(p(s[i - order + 1 : i + 1])) for i in range(order - 1, len(s))]

    return logs


def test_perplexity_matches_the_formulas(spark, monkeypatch):
    monkeypatch.setattr(quality, "BUCKET_BYTES", 40)  # several buckets
    monkeypatch.setattr(quality, "TOGETHER", 2)
    texts = ["the cat sat on the mat. " * 3, "a cat and a hat, the end", "ünïcode là", "Zebra zoo", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    model = quality.fit(df)
    logs = reference(texts)
    asked = [*texts, "unseen words 漢字", "the mat", "", None]
    probe = spark.createDataFrame([(i, t) for i, t in enumerate(asked)] + [(0, texts[0])], "id long, text string")
    got = {r.id: (r.log_p, r.length) for r in quality.scores(probe, model).collect()}
    assert set(got) == set(range(len(texts) + 2))
    for i, t in enumerate(asked[: len(got)]):
        assert got[i] == (pytest.approx(sum(logs(t)), rel=1e-5), len(t))


def test_many_characters_and_long_texts_are_coded_whole(monkeypatch):
    text = "abcd " * 400 + "zz" + "".join(chr(0x4E00 + i) for i in range(5000))  # more characters than one integer can number

    def spelled():
        return [grams[k] for _, grams, number in quality.ngrams([text, "q"]) for k in number]

    padded = [quality.BEGIN * 4 + text, quality.BEGIN * 4 + "q"]
    expected = [s[i : i + 5] for s in padded for i in range(len(s) - 4)]
    assert spelled() == expected
    monkeypatch.setattr(quality, "CHUNK", 37)
    assert spelled() == expected


def test_without_trusted_text_nothing_is_known(spark):
    nothing = spark.createDataFrame([], "id long, text string")
    row = quality.scores(spark.createDataFrame([(1, "ab")], "id long, text string"), quality.fit(nothing)).first()
    assert (row.log_p, row.length) == (0.0, 2)


def test_clean_documents_are_kept_and_junk_goes(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality_verdicts(docs, labels).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.accepted for r in good) / len(good) >= 0.98
    assert sum(r.accepted for r in bad) / len(bad) <= 0.25


def test_defined_cases(spark):
    rows = [(1, "plain text", "en", 5), (2, None, "en", 5), (3, "", None, 5), (4, "plain text", None, 5), (4, "plain text", None, 5), (5, "t" * 100_000, "xx", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, threshold int")  # one column clashes
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (9, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_verdicts(df, labels)
    assert got.columns == ["doc_id", "text", "lang", "perplexity", "score", "threshold", "accepted"]
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].accepted and by[4].accepted and not by[2].accepted and by[3].perplexity is None
    assert quality.keep_accepted(df, labels).columns == df.columns
    untrusted = quality.quality_verdicts(df, labels.limit(0)).collect()
    assert {r.doc_id for r in untrusted if r.accepted} == {1, 4, 5}
    assert quality.quality_verdicts(df.limit(0), labels).collect() == []


def test_small_tables_do_not_shuffle_what_is_asked(spark, monkeypatch):
    texts = ["the cat sat on the mat. " * 3, "a cat and a hat, the end"]
    model = quality.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    grams = spark.createDataFrame([(g,) for t in texts + ["unseen words"] for _, some, _ in quality.ngrams([t]) for g in some], "gram string").distinct()
    dealt = cut(grams).repartition(4, "gram")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = quality.probabilities(dealt, model)
        rows = sorted(few.collect())
        plan = few._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastHashJoin") == 2 * quality.ORDER - 1
        monkeypatch.setattr(quality, "TABLE_ROWS", 0)
        many = quality.probabilities(dealt, model)
        assert sorted(many.collect()) == rows
        plan = many._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("REPARTITION_BY") == 1 and "hashpartitioning(tail" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
