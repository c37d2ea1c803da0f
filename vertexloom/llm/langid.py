"""Language identification with string kernels, Nyström landmarks and ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.lineage import cut
from vertexloom.llm.common import arrow_batches, shield, small

#: Labelled texts that are learned from, about this many a language (fewer if there are fewer).
TEXTS = 300
#: Learned texts of all languages together, about; many languages share them, with ``LEAST`` each at least.
ALL_TEXTS = 20_000
LEAST = 5
#: Landmark texts a language, and of all languages together if there is one for each.
LANDMARKS = 40
ALL_LANDMARKS = 4000
#: Longest n-gram of the blended spectrum, in characters.
SPECTRUM = 3
#: N-grams that the kernel compares: an equal share for each language, the most widespread of it first, then those of all.
NGRAMS = 6000
#: Slots of the table that finds the compared n-grams.
SLOTS = 1 << 23
RIDGE = 0.1
#: Characters of texts that make one batch of the matrix products.
CHUNK = 400_000


def _grams(texts: list[str], letters: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and code of every n-gram, from one character to ``SPECTRUM``, of texts as :func:`_lowered`.

    Characters that are no known letters, and the texts' ends, count as one separator; n-grams
    of one character, and those of more that begin or end with it, take part once each kind.
    """
    table = np.zeros(0x110000, np.int32)
    for letter, number in letters.items():
        table[ord(letter)] = number
    lengths = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = table[points].astype(np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    base = len(letters) + 1
    owners, codes = [], []
    code = np.zeros(len(s), np.int64)
    for n in range(1, SPECTRUM + 1):
        code = code[: max(len(s) - n + 1, 0)] * base + s[n - 1 :]
        same = owner[: len(code)] == owner[n - 1 :]
        owners.append(owner[: len(code)][same])
        codes.append(code[same] + sum(base**k for k in range(1, n)))
    return np.concatenate(owners), np.concatenate(codes)


def _lowered(text: str) -> str:
    """In lower case, with a separator at the end."""
    return text.lower() + "\n"


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Owners and pieces of texts in lots of about ``CHUNK`` characters.

    Pieces of a long text overlap, so that each of its n-grams is whole in one of them.
    """
    owners, pieces, size = [], [], 0
    for i, text in enumerate(map(_lowered, texts)):
        for at in range(0, len(text), CHUNK):
            owners.append(i)
            pieces.append(text[at : at + CHUNK + SPECTRUM - 1])
            size += len(pieces[-1])
            if size >= CHUNK:
                yield owners, pieces
                owners, pieces, size = [], [], 0
    if pieces:
        yield owners, pieces


@dataclass(frozen=True)
class Finder:
    """Finds compared n-grams by their codes: a table without collisions among them."""

    codes: np.ndarray
    factor: int
    table: np.ndarray

    @staticmethod
    def of(codes: np.ndarray) -> Finder:
        for factor in range(0x9E3779B1, 0x9E3779B1 + (1 << 20), 2):
            slots = Finder._slots(codes, factor)
            if len(np.unique(slots)) == len(codes):
                table = np.zeros(SLOTS, np.uint16)
                table[slots] = np.arange(1, len(codes) + 1)
                return Finder(codes, factor, table)
        raise ValueError("too many n-grams for the table")

    @staticmethod
    def _slots(codes: np.ndarray, factor: int) -> np.ndarray:
        mixed = codes.astype(np.uint64) * np.uint64(factor)
        return (mixed ^ (mixed >> np.uint64(29))) & np.uint64(SLOTS - 1)

    def columns(self, codes: np.ndarray) -> np.ndarray:
        """Column of each code, from 1; 0 if it is not compared."""
        found = self.table[self._slots(codes, self.factor)].astype(np.int32)
        found[(found > 0) & (self.codes[found - 1] != codes)] = 0
        return found


@dataclass(frozen=True)
class KernelClassifier:
    """What prediction needs; its size depends on the parameters, not on the texts."""

    languages: list[str]
    letters: dict[str, int]
    finder: Finder
    landmarks: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Normalised kernel between texts and landmarks: shared n-grams over the root of both their numbers."""
        present = self.presence(texts, self.letters, self.finder)
        sizes = np.sqrt(np.maximum(present.sum(axis=1, keepdims=True), 1))
        return (present @ self.landmarks) / sizes

    @staticmethod
    def presence(texts: list[str], letters: dict[str, int], finder: Finder) -> np.ndarray:
        """Which of the compared n-grams each text has."""
        out = np.zeros((len(texts), len(finder.codes)), np.float32)
        for owners, pieces in _pieces(texts):
            owner, code = _grams(pieces, letters)
            column = finder.columns(code)
            hit = column > 0
            out[np.array(owners)[owner[hit]], column[hit] - 1] = 1
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """One-versus-rest scores, a column a language."""
        return self.kernel(texts) @ self.weights + self.offset

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; the score is the softmax of the scores, sharpened to spread over 0 to 1."""
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        worth = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        held: list[int] = []
        size = 0
        for k, i in enumerate(worth):
            held.append(i)
            size += len(texts[i])
            if size >= CHUNK or k + 1 == len(worth):
                raw = self.scores([texts[i] for i in held])
                odds = np.exp(8 * (raw - raw.max(axis=1, keepdims=True)))
                best = raw.argmax(axis=1)
                share = odds.max(axis=1) / odds.sum(axis=1)
                for i, b, p in zip(held, best.tolist(), share.tolist(), strict=True):
                    langs[i], scores[i] = self.languages[b], min(max(p, 0.0), 1.0)
                held, size = [], 0
        return langs, scores


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _compared(texts: list[str], langs: list[str], letters: dict[str, int]) -> np.ndarray:
    """Codes of the n-grams that the kernel compares, in order."""
    by_lang: dict[str, dict[int, int]] = {}
    for t, lang in zip(texts, langs, strict=True):
        spread = by_lang.setdefault(lang, {})
        for code in np.unique(_grams([_lowered(t)], letters)[1]).tolist():
            spread[code] = spread.get(code, 0) + 1
    every: dict[int, int] = {}
    for spread in by_lang.values():
        for code, n in spread.items():
            every[code] = every.get(code, 0) + n
    first = lambda spread, n: sorted(spread, key=lambda c: (-spread[c], c))[:n]
    chosen = {c for spread in by_lang.values() for c in first(spread, max(1, NGRAMS // len(by_lang)))}
    for c in first(every, NGRAMS):
        if len(chosen) >= NGRAMS:
            break
        chosen.add(c)
    return np.array(sorted(chosen), np.int64)


def learn(texts: list[str], langs: list[str]) -> KernelClassifier:
    """Fit landmarks and ridge weights to labelled texts, given in an order that reruns repeat."""
    languages = sorted(set(langs))
    counts: dict[str, int] = {}
    for t in texts:
        for c in set(t.lower()):
            if c.isalpha():
                counts[c] = counts.get(c, 0) + 1
    letters = {c: i + 1 for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)))}
    finder = Finder.of(_compared(texts, langs, letters))
    present = np.concatenate([KernelClassifier.presence([t], letters, finder) for t in texts])
    sizes = np.sqrt(np.maximum(present.sum(axis=1, keepdims=True), 1))
    unit = present / sizes
    of = {lang: [] for lang in languages}
    for i, lang in enumerate(langs):
        of[lang].append(i)
    marks = [i for lang in languages for i in of[lang][: max(1, min(LANDMARKS, ALL_LANDMARKS // len(languages)))]]
    landmarks = np.ascontiguousarray(unit[marks].T)
    among = unit[marks] @ landmarks
    values, vectors = np.linalg.eigh(among.astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nyström features are kernel values times this
    features = (unit @ landmarks) @ root
    targets = np.array([[1.0 if x == lang else -1.0 for lang in languages] for x in langs])
    weight_of = {lang: len(langs) / (len(languages) * len(of[lang])) for lang in languages}
    w = np.array([weight_of[x] for x in langs])[:, None]
    mean_f, mean_t = (w * features).sum(0) / w.sum(), (w * targets).sum(0) / w.sum()
    centred = features - mean_f
    solution = np.linalg.solve(centred.T @ (w * centred) + RIDGE * np.eye(features.shape[1]), centred.T @ (w * (targets - mean_t)))
    return KernelClassifier(
        languages, letters, finder, landmarks.astype(np.float32), (root @ solution).astype(np.float32), (mean_t - mean_f @ solution).astype(np.float32)
    )


def held_out(id_col: Column) -> Column:
    """Documents that are never learned from; a null id counts as the empty string."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predict the language of every whole text.

    About ``TEXTS`` labelled texts a language (``ALL_TEXTS`` together, if languages are many),
    chosen by a hash of ids and texts among those not held out, are learned from, repeats once: presence of n-grams of one to ``SPECTRUM`` characters,
    normalised kernels with ``LANDMARKS`` texts a language, and one-versus-rest ridge
    regression on the Nyström features. Every text is then scored by its n-grams alone, a
    batch at a time, as products of matrices; the language column takes no part.

    Returns the columns of ``df`` (those that clash with the new names give way) and
    ``held_out`` boolean, ``lang_pred`` (``und`` for null texts and those without a letter),
    ``score`` (0 to 1; 0 for ``und``). Defined cases: without labelled texts all are ``und``;
    texts without a known n-gram get the language that the offsets favour; repeated rows are
    scored each; empty input gives no rows.
    """
    spark = df.sparkSession
    arrow_batches(spark, rows=1000, megabytes=4)
    inner, col, restored = shield(df)
    apart = held_out(col(id_col))
    labelled = inner.filter(~apart & col(lang_col).isNotNull() & col(text_col).rlike(r"\p{L}"))
    sizes = cut(labelled.groupBy(col(lang_col).alias("counted")).agg(F.count("*").alias("n_texts")))
    share = min(TEXTS, max(LEAST, ALL_TEXTS // max(sizes.count(), 1)))
    order = F.pmod(F.xxhash64(col(id_col), col(text_col)), F.lit(1 << 50))
    chosen = labelled.join(small(sizes), col(lang_col) == F.col("counted")).filter(order < (F.lit(float(1 << 50)) * F.least(F.lit(1.0), F.lit(float(share)) / F.col("n_texts"))))
    rows = chosen.select(col(lang_col).alias("lang"), col(text_col).alias("text"), order.alias("o")).dropDuplicates(["lang", "o"]).collect()
    rows.sort(key=lambda r: (r.o, r.lang, r.text))
    model = learn([r.text for r in rows], [r.lang for r in rows]) if rows else None
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            known = [t if isinstance(t, str) else None for t in texts]
            langs, scores = sent.value.predict(known) if sent.value else (["und"] * len(known), [0.0] * len(known))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    new = ["held_out", "lang_pred", "score"]
    told = inner.withColumn("told", predict(col(text_col)))
    return told.select(*[c for c, n in zip(restored, df.columns, strict=True) if n not in new], apart.alias("held_out"), "told.*")
