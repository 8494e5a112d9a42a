"""Language identification by error-correcting output codes.

Each language has a codeword; for every bit a binary classifier over byte n-grams tells the languages with
a 1 from those with a 0. A text is given the language whose codeword costs least when every bit's margin is
weighed by an exponential loss; a text whose two best languages cost nearly the same is flagged ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadentia.llm.common import in_fold, small_or_plain, text_slices

#: Lengths of the byte n-grams, and buckets that they are hashed to.
LENGTHS, BUCKETS = (2, 3, 4), 1 << 16
#: Training texts of each language at most (about: a share of all is drawn by a hash of the id).
TRAINING_ROWS = 600
#: Ambiguous: the second language costs less than so much more than the first, as a share.
AMBIGUOUS = 0.05
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
#: Letters stay, A-Z lower-cased, bytes beyond ASCII stay, all else is a blank.
_NORMAL = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def gram_buckets(texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each n-gram length the buckets of all n-grams in order, 0 for one of blanks only or across texts, and where each text's begin."""
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    sizes = np.array([len(p) + 1 for p in parts])
    begins = np.concatenate(([0], np.cumsum(sizes)))
    codes = _NORMAL[np.frombuffer(b" ".join(parts) + b" ", np.uint8)]
    out = []
    for n in LENGTHS:
        value = np.zeros(max(len(codes) - n + 1, 0), np.uint32)
        letters = np.zeros(len(value), bool)
        for k in range(n):
            c = codes[k : k + len(value)]
            value = value * np.uint32(257) + c
            letters |= c != 32
        value *= np.uint32(0x9E3779B1)
        bucket = (value >> np.uint32(16)).astype(np.int64)
        bucket[bucket == 0] = 1
        bucket[~letters] = 0
        bucket = np.concatenate((bucket, np.zeros(len(codes) - len(value), np.int64)))
        for k in range(1, n):
            bucket[np.maximum(begins[1:] - k, 0)] = 0
        out.append(bucket)
    return out, [begins] * len(LENGTHS)


def code_matrix(classes: int) -> np.ndarray:
    """Codewords of -1 and 1, one row a class: all ways to split up to 5 classes in two, else random ones far apart."""
    if classes <= 5:
        return np.array([[1 if c == 0 or (word >> (c - 1)) & 1 else -1 for word in range(2 ** (classes - 1) - 1)] for c in range(classes)], np.int8).reshape(classes, -1)
    rng = np.random.default_rng(7)
    bits = int(np.ceil(15 * np.log2(classes)))
    best, best_apart = None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (classes, bits))
        m = m[:, np.abs(m.sum(0)) < classes]
        apart = min(int((m[i] != m[j]).sum()) for i in range(classes) for j in range(i))
        if apart > best_apart:
            best, best_apart = m, apart
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray

    @staticmethod
    def trained(counts: dict[str, np.ndarray]) -> LanguageModel:
        """From the n-gram counts of each language."""
        languages = sorted(counts)
        if not languages:
            return LanguageModel([], np.zeros((0, 0), np.int8), np.zeros((BUCKETS, 0), np.float32))
        c = np.array([counts[x] for x in languages], float) + 0.1
        c[:, 0] = 0
        share = c / c.sum(1, keepdims=True)
        codes = code_matrix(len(languages))
        weights = np.zeros((BUCKETS, codes.shape[1]))
        for b in range(codes.shape[1]):
            one, zero = share[codes[:, b] > 0].mean(0)[1:], share[codes[:, b] < 0].mean(0)[1:]
            w = np.log(one / zero)
            # Margins of about 1 on a text like those of training.
            weights[1:, b] = w / max(np.abs(share[:, 1:] @ w).mean(), 1e-9)
        return LanguageModel(languages, codes, weights.astype(np.float32))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (the share of the best language among all) and whether it is ambiguous, for each text."""
        n = len(texts)
        labels, score, ambiguous = [UNDETERMINED] * n, np.zeros(n), np.zeros(n, bool)
        if not self.languages or not n:
            return labels, score, ambiguous
        buckets, begins = gram_buckets(texts)
        sums, grams = np.zeros((n, self.weights.shape[1]), np.float32), np.zeros(n)
        for bucket, begin in zip(buckets, begins, strict=True):
            grams += np.add.reduceat(bucket > 0, begin[:-1], dtype=np.int64)
            if self.weights.shape[1]:
                sums += np.add.reduceat(self.weights[bucket], begin[:-1], axis=0)
        margins = sums / np.maximum(grams, 1)[:, None]
        cost = np.exp(-np.clip(margins, -20, 20)[:, None, :] * self.codes[None]).sum(2)
        ranked = np.sort(cost, 1)
        best = cost.argmin(1)
        share = np.exp(-3 * (cost - ranked[:, :1]))
        share = 1 / share.sum(1)
        for i, text in enumerate(texts):
            if text and _LETTER.search(text):
                labels[i], score[i] = self.languages[best[i]], share[i]
                ambiguous[i] = len(self.languages) > 1 and ranked[i, 1] - ranked[i, 0] < AMBIGUOUS * ranked[i, 1]
        return labels, score, ambiguous


def train(docs: DataFrame, folds: int = 4, held_out: int = 2, rows: int = TRAINING_ROWS) -> LanguageModel:
    """Learn from text and lang of rows outside the held-out fold, at most about ``rows`` of each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~in_fold(F.col("doc_id"), folds, held_out))
    totals = known.groupBy("lang").agg(F.count("*").alias("n"))
    drawn = known.join(small_or_plain(totals, totals.count()), "lang")
    # By id and text, of which one of a kind is learned from: repeated rows meet in one task and don't add to the bound.
    key = F.xxhash64("doc_id", "text", F.lit(9))
    drawn = drawn.where(F.pmod(key, F.lit(1 << 30)) < rows / F.col("n") * float(1 << 30)).select("lang", "text", key.alias("key")).repartition("key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            for lang, text, key in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "key")), strict=True):
                if (lang, key) in seen:
                    continue
                seen.add((lang, key))
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for bucket in gram_buckets([text])[0]:
                    own += np.bincount(bucket, minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([own[at].astype("<i8").tobytes()], pa.binary())], names=["lang", "at", "n"])

    counts: dict[str, np.ndarray] = {}
    for r in drawn.mapInArrow(count, "lang string, at binary, n binary").collect():
        own = counts.setdefault(r["lang"], np.zeros(BUCKETS, np.int64))
        own[np.frombuffer(r["at"], "<i4")] += np.frombuffer(r["n"], "<i8")
    return LanguageModel.trained(counts)


def _predictions(spark: SparkSession, rows: DataFrame, model: LanguageModel) -> DataFrame:
    """``rows`` (with a text) with lang_pred, score and ambiguous in front of its other columns."""
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in rows.columns if c != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "__text"):
            labels, score, ambiguous = shared.value.predict(texts)
            columns = [pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*columns, *[part.column(c) for c in kept]], names=["lang_pred", "score", "ambiguous", *kept])

    schema = "lang_pred string, score double, ambiguous boolean" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(run, schema)


def identify(spark: SparkSession, docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row.

    A null text or one without a letter is 'und' with score 0. If no row can be learned from, all are.
    Null and repeated ids are rows like others (a null id is not held out); an empty table gives no rows;
    columns other than doc_id, text and lang are ignored, and lang is only learned from. Texts of any length are judged whole.
    """
    model = train(docs, folds, held_out)
    rows = docs.select("doc_id", in_fold(F.col("doc_id"), folds, held_out).alias("held_out"), F.col("text").alias("__text"))
    return _predictions(spark, rows, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def known_language_documents(spark: SparkSession, docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """The rows of ``docs`` whose language is determined, with the same columns: those of no letter, or ambiguous, go.

    Null and empty texts have no letter and go; very long texts are judged whole; repeated rows and null ids are rows
    like others. An empty table gives no rows. Columns may have any names.
    """
    model = train(docs, folds, held_out)
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text").alias("__text"))
    return _predictions(spark, rows, model).where((F.col("lang_pred") != UNDETERMINED) & ~F.col("ambiguous")).select("row.*")
