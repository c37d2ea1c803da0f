"""The pipeline's stages on planted cases, and the registered queries."""

from __future__ import annotations

import random

import corpus_pipeline
from vertexloom.llm import registry

WORDS = ("river", "stone", "light", "carry", "over", "under", "their", "house", "green", "paper", "walks", "the", "of", "and", "to", "in", "that", "was", "for", "with")


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(("", "", "s", "ed", "ing")) for _ in range(n)).capitalize() + "."


def planted(spark, folder):
    rnd = random.Random(11)
    docs = [(i, prose(rnd, rnd.randint(60, 200)), "en", f"s{i % 4}", 0) for i in range(300)]
    base = {i: t for i, t, *_ in docs}
    docs += [(1000 + i, base[i].upper() if i % 2 else base[i], "en", "s1", 0) for i in range(0, 20, 2)]  # exact copies
    near = []
    for i in range(30, 50):
        w = base[i].split(" ")
        w[len(w) // 2] = "changed"
        near.append((2000 + i, " ".join(w), "en", "s2", 0))
    docs += near
    items = [(k, prose(rnd, 30)) for k in range(5)]
    docs += [(3000 + k, items[k][1] + " " + prose(rnd, 100), "en", "s3", 0) for k in range(5)]
    docs += [(4000 + k, "".join(rnd.choice("#$%&*|!~^") for _ in range(300)), "en", "s0", 0) for k in range(10)]
    docs += [(5000, None, "en", "s0", 0), (5001, "", None, None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return base


def test_stages_catch_what_is_planted(spark, tmp_path):
    base = planted(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "mixing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id for r in docs.collect()}
    assert not left["quality"] & {*range(4000, 4010), 5000, 5001}
    assert len(set(base) - left["quality"]) <= 6
    gone = set(range(0, 20, 2)) & left["quality"]
    assert not gone & left["exact_dedup"] and {1000 + i for i in gone} <= left["exact_dedup"]
    assert len(left["near_dedup"] & set(range(2030, 2050))) <= 1 and set(range(30, 50)) & left["exact_dedup"] <= left["near_dedup"]
    assert not left["decontamination"] & set(range(3000, 3005))
    assert left["near_dedup"] - left["decontamination"] <= set(range(3000, 3005))
    assert left["mixing"] <= left["decontamination"]
    total = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert total == docs.count() and {r["pass"] for r in docs.collect()} <= {1, 2}


def test_names():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES) == list(range(1, 11))
    assert set(registry.SQL) <= set(registry.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "mixing"]
