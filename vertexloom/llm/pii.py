"""Personal data: proposed spans, boosted trees over format and context, calibrated thresholds."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.lineage import cut
from vertexloom.llm.common import arrow_batches, shield

KINDS = ("email", "ip", "card", "phone")
#: One document in this many sets thresholds instead of being learned from.
HELD_OUT = 4
#: Share of proposals above a kind's threshold that must be right on the calibration fold.
PRECISION = 0.98
TREES, DEPTH = 30, 5
#: Characters of context on each side.
CONTEXT = 40
#: Steps of the score in which thresholds are sought.
STEPS = 1000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can only begin where a run of digits does
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

#: Wide generators of proposals beside the base formats.
_PROPOSE = (
    ("email", re.compile(r"[^\W_][\w.%+-]{0,63}(?:\s{0,2}@\s{0,2}|\s?[\[(]at[\])]\s?|\sat\s)[^\W_][\w-]{0,62}(?:(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s)[^\W_][\w-]{0,62}){1,5}")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}::?){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9.])[0-9]{1,4}(?:\s?(?:\.|\[\.\])\s?[0-9]{1,4}){3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{2,19}(?:[ ./_-]{1,2}[0-9]{2,7}){0,6}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,4}\)?){1,5}(?![0-9])")),
)
_CUES = tuple(
    re.compile(p, re.I)
    for p in (r"e-?mails?\b|mailto|contact|write to", r"\bip\b|address|server|host|\bv[46]\b", r"card|visa|account|iban|credit|debit|pay", r"phone|\btel\b|call|fax|mobile|\bcell\b|\+", r"token|key|hash|sha|md5|secret|version|isbn|license|order|\bv[0-9]")
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans ``start, kind number, end`` of the fixed formats, leftmost and non-overlapping for each kind, in order."""
    out = []
    free, at = 0, text.find("@")
    while at != -1:  # the part before an @ reaches back as far as it can, so its first valid @ gives the leftmost match
        domain = _DOMAIN.match(text, at + 1)
        begin = at
        if domain:
            while begin > free and text[begin - 1] in _LOCAL:
                begin -= 1
        if begin < at:
            out.append((begin, 0, domain.end()))
            free = domain.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group()) if m.end() - m.start() <= 40 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def kinds_possible(text: str) -> list[int]:
    """Kinds that a text can hold at all: an email needs an @ or a spelled sign, the others a digit."""
    return [0] * any(sign in text for sign in ("@", "dot", "at]", "at)")) + [1, 2, 3] * bool(_DIGITS.search(text))


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Spans of the wide generators, which may overlap each other and the base spans."""
    return sorted({(m.start(), k, m.end()) for k in kinds_possible(text) for m in _PROPOSE[k][1].finditer(text) if m.end() - m.start() <= 400})


def variants(kind: int, span: str) -> list[str]:
    """Other notations of a base span; the last one is never learned from."""
    if kind == 0:
        name, _, domain = span.partition("@")
        dots = domain.replace(".", " dot ")
        return [f"{name} @ {domain}", f"{name}[at]{domain}", f"{name} (at) {domain.replace('.', '(dot)')}", f"{name[:1]}é{re.sub('[0-9]', 'a', name[1:])}@{domain}", f"{name} at {dots}"]
    if kind == 1:
        parts = span.split(".")
        return [" . ".join(parts), "[.]".join(parts), ":".join(f"{int(x) + 4096:x}" for x in parts) + "::1", f"{parts[0]}.{parts[1]}[.]{parts[2]}.{parts[3]}"]
    digits = "".join(_DIGITS.findall(span))
    four = [digits[i : i + 4] for i in range(0, len(digits), 4)]
    three = [digits[:-10] or digits[:2], digits[-10:-7] or digits[2:4], digits[-7:-4], digits[-4:]]
    if kind == 2:
        return [".".join(four), "_".join(four), "  ".join(four), "/".join(four)]
    return [f"00{three[0]} " + " ".join(three[1:]), f"({three[1]}) {three[2]}-{three[3]}", ".".join(three), "/".join(three)]


def lookalikes(kind: int, span: str) -> list[str]:
    """What has the shape of a base span but is none."""
    digits = "".join(_DIGITS.findall(span))
    if kind == 0:
        return [span.split("@")[0] + "@host", span.split("@")[0] + "@10.30", span.split("@")[0] + " at 10.30"]
    if kind == 1:
        return [".".join(str(int(x) + 300) for x in span.split(".")), span.rsplit(".", 1)[0] + ".0-beta", span + ".12", ":".join(f"{int(x) % 60:02d}" for x in span.split(".")[:3])]
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + 5) % 10)
        return [".".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), wrong, "-".join(wrong[i : i + 4] for i in range(0, len(wrong), 4))]
    return [f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}", f"{digits[:2]}.{digits[2:4]}.{digits[4:8]} {digits[8:10]}", digits]


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context of a proposal; nothing tells which generator or base format found it."""
    span = text[start:end]
    around = text[max(0, start - CONTEXT) : start] + " \n " + text[end : end + CONTEXT]
    groups = _DIGITS.findall(span[:200])
    digits = "".join(groups)
    before, after = text[start - 1 : start], text[end : end + 1]
    sizes = [len(g) for g in groups] or [0]
    return [
        *[float(kind == k) for k in range(4)],
        float(len(digits)), float(len(groups)), float(max(sizes)), float(min(sizes)), float(sizes[0]), float(sizes[-1]), float(len(set(digits))),
        float(luhn(digits)), float(max((int(g[-6:]) for g in groups), default=0)), float(bool(re.search(r"[^\W\d_]{2,24}$", span))),
        float(len(span)), float(sum(c.isalpha() for c in span)), float(span.count(".")), float(span.count(":")), float(span.count(" ")), float(span.count("-")),
        float("@" in span), float("at" in span), float("dot" in span), float("[" in span), float("(" in span), float(span[:1] == "+"), float(span[:2] == "00"),
        float(before.isalnum()), float(after.isalnum()), float(before in "\"'=:/" and before != ""), float(after in "\"'" and after != ""),
        float(before in ".-_" and before != ""), float(after in ".-_" and after != ""),
        *[float(bool(c.search(around))) for c in _CUES],
    ]


def examples(text: str) -> Iterator[tuple[int, float, list[float]]]:
    """Labelled proposals ``kind, right, features`` of a text.

    Base spans are right; proposals that touch none, or only those of other kinds, are wrong. Each base span is also
    written in its other notations but the last, and as its lookalikes, in its place: proposals
    that cover a notation are right if they are of its kind, those of other kinds that touch it
    and all that touch a lookalike are wrong.
    """
    known = base_spans(text)
    for span in sorted({*known, *proposals(text)}):
        if span in known:
            yield span[1], 1.0, features(text, *span)
        elif not any(b[1] == span[1] and b[0] < span[2] and span[0] < b[2] for b in known):
            yield span[1], 0.0, features(text, *span)
    for start, kind, end in known:
        left, right = text[max(0, start - 2 * CONTEXT) : start], text[end : end + 2 * CONTEXT]
        forms = [(form, 1.0) for form in variants(kind, text[start:end])[:-1]]
        for written, fits in [*forms, *[(other, 0.0) for other in lookalikes(kind, text[start:end])]]:
            line, a, b = left + written + right, len(left), len(left) + len(written)
            for s in proposals(line):
                if s[0] < b and a < s[2]:
                    covers = abs(s[0] - a) <= 1 and abs(s[2] - b) <= 1
                    if covers or fits == 0.0 or s[1] != kind:
                        yield s[1], fits * float(s[1] == kind and covers), features(line, *s)


@dataclass(frozen=True)
class SpanModel:
    """Boosted trees as nested tuples (feature, threshold, left, right) or leaf values, and a threshold for each kind."""

    trees: list[tuple[float, tuple | float]]
    thresholds: tuple[float, ...]

    def probabilities(self, rows: list[list[float]]) -> np.ndarray:
        x = np.array(rows, np.float64)
        margin = np.zeros(len(x))
        for weight, tree in self.trees:
            margin += weight * self._leaf(tree, x)
        return 1 / (1 + np.exp(-2 * margin))

    def _leaf(self, tree: tuple | float, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        feature, threshold, left, right = tree
        return np.where(x[:, feature] <= threshold, self._leaf(left, x), self._leaf(right, x))


def _tree(node) -> tuple | float:  # noqa: ANN001
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def gathered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``apart, kind, label, x, n``: how often each of the :func:`examples` occurs in all texts; ``apart`` by a hash of the ids."""
    apart = F.pmod(F.xxhash64(F.col(id_col)), F.lit(HELD_OUT)) == 0

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            met = Counter((a, kind, label, tuple(x)) for text, a in zip(pdf["text"], pdf["apart"], strict=True) for kind, label, x in examples(text))
            yield pd.DataFrame([(*key, n) for key, n in met.items()], columns=["apart", "kind", "label", "x", "n"])

    texts = df.select(F.col(text_col).alias("text"), apart.alias("apart")).filter("text is not null")
    met = texts.mapInPandas(rows, "apart boolean, kind int, label double, x array<float>, n long")
    return met.groupBy("apart", "kind", "label", "x").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, id_col: str, text_col: str) -> SpanModel | None:
    """Fit trees and thresholds to the :func:`examples` of all documents.

    Equal examples are one row with a weight. The trees may have as many bins as make Spark ML
    look for cuts in all rows instead of drawn ones. One document in ``HELD_OUT`` sets the
    thresholds: a kind's is the least score above which ``PRECISION`` of its examples there are
    right, from counts by steps of the score. Without right and wrong examples there is no model.
    """
    found = cut(gathered(df, id_col, text_col))
    train = found.filter("not apart").select("label", "x", "n").orderBy("x", "label", "n")
    about = train.agg(F.count("*").alias("rows"), F.countDistinct("label").alias("labels")).first()
    if about.labels < 2:
        return None
    bins = max(32, math.isqrt(about.rows) + 1)
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=bins, stepSize=0.3, seed=7, featuresCol="f", weightCol="n").fit(
        train.select("label", "n", array_to_vector("x").alias("f"))
    )
    weights = list(fitted.treeWeights)
    trees = [(float(w), _tree(t._call_java("rootNode"))) for w, t in zip(weights, fitted.trees, strict=True)]
    model = SpanModel(trees, (2.0,) * len(KINDS))

    @F.pandas_udf("int")
    def step(x: pd.Series) -> pd.Series:
        return pd.Series(np.floor(model.probabilities(list(x)) * STEPS).astype(np.int32))

    counted = (
        found.filter("apart")
        .select("kind", "label", "n", step("x").alias("step"))
        .groupBy("kind", "step")
        .agg(F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("n"))
        .collect()
    )
    return SpanModel(trees, tuple(_threshold([(r.step, r.right, r.n) for r in counted if r.kind == k]) for k in range(len(KINDS))))


def _threshold(counted: list[tuple[int, float, int]]) -> float:
    """The least score, one half at least, from which on ``PRECISION`` of the examples are right; 2 (never reached) if there is none."""
    least, right, n = 2.0, 0.0, 0
    for step, r, m in sorted(counted, reverse=True):
        right, n = right + r, n + m
        if 2 * step >= STEPS and right >= PRECISION * n:
            least = step / STEPS
    return least


def all_spans(text: str, model: SpanModel | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those together with the proposals that the model selects."""
    if not kinds_possible(text):
        return [], []
    base = base_spans(text)
    if model is None:
        return base, base
    within = lambda s: any(b[1] == s[1] and b[0] <= s[0] and s[2] <= b[2] for b in base)
    new = [s for s in proposals(text) if not within(s)]
    if not new:
        return base, base
    scores = model.probabilities([features(text, *s) for s in new])
    chosen = [s for s, p in zip(new, scores.tolist(), strict=True) if p >= model.thresholds[s[1]]]
    return base, sorted({*base, *chosen})


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first one."""
    out, done = [], 0
    for a, k, b in spans:
        if a >= done:
            out.append(text[done:a] + f"[{KINDS[k]}]")
        done = max(done, b)
    return "".join(out) + text[done:]


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """Find personal data in every whole text.

    Emails, IPv4 addresses, card numbers and phone numbers of the fixed base formats always
    count. Wider generators propose further, overlapping spans (spaced or spelled-out
    addresses, names beyond ASCII, IPv6, numbers in other notations), which may overlap base
    spans; boosted trees score each by format and context, and calibrated thresholds select.

    Returns the columns of ``df`` (those that clash with the new names give way) and
    ``n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256`` (of ``kind:start:end``,
    comma-joined, in code points), ``spans`` (all spans, written likewise), ``n_spans`` (their
    number) and, with ``redact``, ``redacted`` text. Defined cases: a null text counts as empty; without
    examples to learn from only base spans are found; repeated rows are searched each; empty
    input gives no rows.
    """
    spark = df.sparkSession
    arrow_batches(spark)
    inner, col, restored = shield(df)
    names = [f"in_{df.columns.index(c)}" for c in (id_col, text_col)]
    sent = spark.sparkContext.broadcast(learn(inner.select(*names), *names))

    @F.pandas_udf("struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string,n_spans:long,redacted:string>")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for text in ("" if t is None else t for t in texts):
                base, every = all_spans(text, sent.value)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
                digest = hashlib.sha256(spelled(base).encode()).hexdigest()
                rows.append((*counts, digest, spelled(every), len(every), redacted(text, every) if redact else None))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "redacted"])

    new = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"] + ["redacted"] * redact
    found = inner.withColumn("found", find(col(text_col)))
    return found.select(*[c for c, n in zip(restored, df.columns, strict=True) if n not in new], *[f"found.{n}" for n in new])
