"""Personal data: base formats against plain regular expressions, the model's additions, defined cases."""

from __future__ import annotations

import hashlib
import random
import re

from vertexloom.llm import pii


def reference(text):
    out = []
    for kind, pattern in enumerate((
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and max(int(p) for p in m.group().split(".")) > 255:
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and sum((int(d) * (1 + i % 2) - 1) % 9 + 1 if d != "0" else 0 for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rnd = random.Random(5)
    pieces = ["a@b.c", "x.y+z@m-1.example.com", "@", ".", "..", "é", " ", "-", "+1 (620) 555-8424", "226.203.165.104", "1.2.3.4.5.6.7.8", "4225039295678253", "4111 1111 1111 1111"]
    pieces += ["+", "0", "12", "(", ")", "256", "999.1.1.1", "00255.0.0.1", "a@b@c.d", "\n", "word", "4111-1111-1111-1111", "+49", "'", "a@b.c.", "%@x.y"]
    for _ in range(4000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12)))
        assert pii.base_spans(text) == reference(text), text


def test_query_columns_and_added_spans(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        number = "".join(rnd.choice("0123456789") for _ in range(15))
        check = next(d for d in "0123456789" if pii.luhn(number + d))
        rows.append(rnd.choice([
            f"write to user{i}@mail.example.com now", f"card {number}{check} paid", f"token = \"{number}{(int(check) + 1) % 10}\" end", f"call +1 ({i + 100}) 555-{1000 + i} ok",
            f"host {i % 255}.2.3.{i % 250} up", f"version {i + 300}.2.3.4 of it", f"order {i}{i} 12 34 5", "nothing at all",
        ]))
    rows += ["mail to éva.ñandú@mail4.example.com please", None, "", "1" * 30000, "a@" * 10000, "9.9" * 9000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(rows)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find_personal_data(df, redact=True).collect()}
    for i, t in enumerate(rows):
        base = reference(t or "") if len(t or "") < 1000 else pii.base_spans(t)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.spelled(base).encode()).hexdigest()
        assert set(filter(None, pii.spelled(base).split(","))) <= set(r.spans.split(","))
        assert not base or pii.KINDS[base[0][1]] in r.redacted
    assert all(got[i].spans == "" for i, t in enumerate(rows) if t and ("token" in t or t == "nothing at all"))
    assert pii.find_personal_data(df.limit(0)).collect() == []


def test_trees_decide_on_notations_that_were_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").filter("doc_id % 2 = 0")
    model = pii.learn(docs, "doc_id", "text")
    assert max(model.thresholds) <= 1
    assert (8, 0, 35) in pii.all_spans("mail to éva.ñandú@mail4.example.com please", model)[1]  # whole name beyond ASCII
    found, wrong = [0] * 4, [0, 0]
    total = [0] * 4
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 2 = 1 and text is not null").select("text").collect():
        for a, k, b in pii.base_spans(r.text):
            left, right = r.text[max(0, a - 80) : a], r.text[b : b + 80]
            written = pii.variants(k, r.text[a:b])[-1]
            _, spans = pii.all_spans(left + written + right, model)
            total[k] += 1
            found[k] += any(s[1] == k and abs(s[0] - len(left)) <= 1 and abs(s[2] - len(left) - len(written)) <= 1 for s in spans)
            for other in pii.lookalikes(k, r.text[a:b]):
                base, spans = pii.all_spans(left + other + right, model)
                wrong[0] += any(s[0] < len(left) + len(other) and len(left) < s[2] for s in set(spans) - set(base))
                wrong[1] += 1
    assert sum(found) / sum(total) >= 0.9, (found, total)
    assert wrong[0] / wrong[1] <= 0.05


def test_every_document_is_learned_from(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE_DOCS", 50, raising=False)  # the bound that there was
    rows = [(i, f"write to user{i}@mail.example.com or user{i}@host, order {i}12 34 5" if i % 3 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [t for _, t in rows if t]
    counted = pii.gathered(df, "doc_id", "text").groupBy("label").sum("n").collect()
    assert {r[0]: r[1] for r in counted} == {x: sum(e[1] == x for t in texts for e in pii.examples(t)) for x in (0.0, 1.0)}
    # Examples stand only in documents that a sample of 50 by the hash of the ids would leave out.
    order = {r.doc_id: r.o for r in df.selectExpr("doc_id", "pmod(xxhash64(doc_id), 1L << 50) o").collect()}
    late = [(i, t if order[i] >= (1 << 50) / 8 else "nothing at all") for i, t in rows]
    model = pii.learn(spark.createDataFrame(late, "doc_id long, text string"), "doc_id", "text")
    assert model is not None and len(model.trees) == pii.TREES
