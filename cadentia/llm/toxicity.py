"""Toxicity by a convolutional text classifier trained in numpy.

Words (runs of ASCII letters and digits and of bytes beyond ASCII, A-Z lower-cased) and their first bytes
are hashed to a table of embeddings if training saw them often enough; all others share one. A word's
vector is the sum of its own and those of its beginnings. Filters over one, two and three words are
max-pooled over the whole text and weighed by a logistic layer. All labelled rows of the training folds are
learned from: words and their evidence are counted in tasks; parts of the rows then train copies of the model, which are averaged after each round.
For each language a threshold is calibrated on held-back training rows and moved to 0.5. The language is guessed from the text's own common words, so a
score depends on nothing but the text.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadentia.llm.common import in_fold, small_or_plain, text_slices, written_by
from cadentia.llm.words import NOT_ALNUM, prefix_hashes

#: Rows and characters of a part of the training rows, about, and rounds after which parts are averaged if there are several.
PART_ROWS, PART_CHARS, ROUNDS = 3_000, 24_000_000, 3
#: Parts share a bucket of the table beyond so many.
MOST_BUCKETS = 10_000
#: Slots of the word table, buckets and length of embeddings, widths of filters and filters of each width.
SLOTS, BUCKETS, LENGTH, WIDTHS, FILTERS = 1 << 20, 1 << 15, 12, (1, 2, 3), 6
#: Bytes of the beginnings of a word that have vectors of their own.
PREFIXES = (4, 5)
#: A word or beginning is known if at least three training texts have it, and this share of the number of toxic ones.
LEAST_SHARE = 0.015
#: Steps of training, and texts in each.
STEPS, BATCH = 300, 64
#: Filters of each width that begin with the evidence of single words.
INFORMED = 2
#: Steps of a logit in which thresholds are looked for, and steps of a parameter in which parts are added up, so that sums have no order.
CUTS, UNITS = 256, 1 << 30
_GAP = max(WIDTHS) - 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class ToxicityModel:
    known: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, np.uint64))
    language_of: np.ndarray = field(default_factory=lambda: np.full(BUCKETS, -1, np.int8))
    embedding: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, LENGTH), np.float32))
    filters: dict[int, np.ndarray] = field(default_factory=dict)
    bias: dict[int, np.ndarray] = field(default_factory=dict)
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    offset: float = -10.0
    #: Logit of the threshold for each guessed language; the last is for texts without a guess.
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def buckets(self, hashes: np.ndarray) -> np.ndarray:
        hit = self.known[hashes & np.uint64(SLOTS - 1)] == hashes
        return np.where(hit, 1 + (hashes >> np.uint64(32)) % np.uint64(BUCKETS - 1), 0).astype(np.int64)

    def learn_words(self, words: np.ndarray, texts: np.ndarray, by_language: np.ndarray, sizes: np.ndarray) -> None:
        """Keep these words, which so many texts have; where two share a slot, the more frequent one. by_language: texts of each language (rows) that have the word whole."""
        order = np.lexsort((words, texts))
        self.known[words[order] & np.uint64(SLOTS - 1)] = words[order]
        kept = self.known[words & np.uint64(SLOTS - 1)] == words
        words, share = words[kept], by_language[:, kept] / np.maximum(sizes, 1)[:, None]
        if len(sizes) and len(words):
            second = np.sort(share, 0)[-2] if len(sizes) > 1 else np.zeros(len(words))
            clear = (share.max(0) > 0.2) & (second < 0.25 * share.max(0))
            self.language_of[self.buckets(words[clear])] = share.argmax(0)[clear]

    def pooled(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Largest response of every filter in every text, of the windows that start from its begin to before its end; ``ids`` ends with a gap."""
        tables = {(w, k): self.embedding @ self.filters[w][k] for w in WIDTHS for k in range(w)}
        n = ids.shape[1] - _GAP
        spans = np.stack((begins, ends), 1).ravel()
        found = []
        for w in WIDTHS:
            response = np.zeros((n, FILTERS), np.float32)
            for k in range(w):
                for row in ids:
                    response += tables[w, k][row[k : k + n]]
            found.append(np.maximum.reduceat(response, spans, axis=0)[::2] + self.bias[w])
        return np.maximum(np.concatenate(found, 1), 0)

    def logits(self, hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit and guessed language of each text, -1 for none. A text without words is one unknown word.

        As in training, an unknown word and a gap follow each text, and no window reaches beyond them.
        """
        n = len(begins) - 1
        counts = np.diff(begins)
        apart = _GAP + 1
        starts = np.arange(n) * apart + begins[:-1]
        ids = np.zeros((len(hashes), hashes.shape[1] + n * apart + _GAP), np.int64)
        place = np.arange(hashes.shape[1]) + np.repeat(np.arange(n) * apart, counts)
        ids[:, place] = self.buckets(hashes)
        # Added up filter by filter: a product of matrices rounds differently with the number of texts.
        logit = sum(self.pooled(ids, starts, starts + counts + 1).T * self.out[:, None]) + self.offset
        languages = len(self.thresholds) - 1
        guess = np.full(n, -1)
        if languages:
            lang = self.language_of[ids[0, :-_GAP]]
            votes = np.stack([np.add.reduceat(lang == x, starts, dtype=np.int64) for x in range(languages)], 1)
            guess = np.where(votes.max(1) > 0, votes.argmax(1), -1)
        return logit, guess

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if not self.filters:
            return _sigmoid(np.full(len(texts), self.offset))
        logit, guess = self.logits(*prefix_hashes(texts, NOT_ALNUM, PREFIXES))
        return _sigmoid(logit - self.thresholds[guess])


def _hashed(texts: list[str]) -> list[np.ndarray]:
    found = []
    for i in range(0, len(texts), 200):
        h, b = prefix_hashes(texts[i : i + 200], NOT_ALNUM, PREFIXES)
        found += [h[:, lo:hi] for lo, hi in zip(b[:-1], b[1:], strict=True)]
    return found


def _word_counts(hashes: list[np.ndarray], langs: list[int]) -> pd.DataFrame:
    """word, lang and n: in how many of these texts a word is, by language; beginnings of words have -1 for it."""
    found = []
    for lang in sorted({-1, *langs}):
        rows = [np.unique(h[1:]) for h in hashes] if lang < 0 else [np.unique(h[0]) for h, x in zip(hashes, langs, strict=True) if x == lang]
        words, n = np.unique(np.concatenate(rows), return_counts=True)
        found.append(pd.DataFrame({"word": words.view(np.int64), "lang": lang, "n": n}))
    return pd.concat(found)


def _seen(model: ToxicityModel, hashes: list[np.ndarray], labels: list[int]) -> np.ndarray:
    """How many texts of either label have each bucket."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for h, label in zip(hashes, labels, strict=True):
        seen[label, np.unique(np.append(model.buckets(h), 0))] += 1
    return seen


def _prepare(model: ToxicityModel, seen: np.ndarray, toxic: int, other: int, seed: int = 3) -> None:
    """Parameters to begin with. One dimension begins as what the fitted rows say of a word by itself, and some filters of each width begin by reading it.

    That is the log-odds of toxic texts to have a bucket, less their standard error; 0 where it speaks against or not clearly.
    """
    rng = np.random.default_rng(seed)
    model.embedding = rng.normal(0, 0.3, (BUCKETS, LENGTH)).astype(np.float32)
    model.filters = {w: rng.normal(0, 0.4 / np.sqrt(w), (w, LENGTH, FILTERS)).astype(np.float32) for w in WIDTHS}
    model.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
    model.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
    model.offset = 0.0
    more = np.log((seen[1] + 0.5) / (toxic + 1)) - np.log((seen[0] + 0.5) / (other + 1))
    lower = np.maximum(more - np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5)), 0)
    lower[0] = 0  # words never seen, and gaps
    model.embedding[:, 0] = lower
    for w in WIDTHS:
        model.filters[w][:, :, :INFORMED] = 0
        model.filters[w][:, 0, :INFORMED] = 1
        model.out[(w - 1) * FILTERS : (w - 1) * FILTERS + INFORMED] = 0.5


def _fit(model: ToxicityModel, hashes: list[np.ndarray], y: np.ndarray, share: float, passes: int, seed: object) -> None:
    """Go over these texts so many times; both labels weigh the same if ``share`` of all rows is toxic."""
    ids = [np.concatenate((model.buckets(h), np.zeros((len(h), _GAP + 1), np.int64)), axis=1).astype(np.int32) for h in hashes]
    weight = np.where(y > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    rng = np.random.default_rng(seed)
    state: dict[object, list[np.ndarray]] = {}
    squares = np.full(BUCKETS, 1e-6, np.float32)

    def adam(key: object, value: np.ndarray, grad: np.ndarray, rate: float = 0.01) -> None:
        m, v, t = state.setdefault(key, [np.zeros_like(value), np.zeros_like(value), np.zeros(1)])
        t += 1
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        value -= rate * (m / (1 - 0.9 ** t[0])) / (np.sqrt(v / (1 - 0.999 ** t[0])) + 1e-8)

    offset = np.array([model.offset], np.float32)
    for _ in range(passes):
        for chunk in np.array_split(rng.permutation(len(ids)), max(1, len(ids) // BATCH)):
            all_ids = np.concatenate([ids[i] for i in chunk], axis=1)
            begins = np.concatenate(([0], np.cumsum([ids[i].shape[1] for i in chunk])))
            x = sum(model.embedding[row] for row in all_ids)
            peaks, best = [], []
            for w in WIDTHS:
                n = len(x) - w + 1
                response = sum(x[k : k + n] @ model.filters[w][k] for k in range(w)) + model.bias[w]
                at = np.stack([lo + response[lo : hi - _GAP].argmax(0) for lo, hi in zip(begins[:-1], begins[1:], strict=True)])
                peaks.append(at)
                best.append(np.take_along_axis(response, at, 0))
            hidden = np.maximum(np.concatenate(best, 1), 0)
            p = _sigmoid(hidden @ model.out + offset[0])
            d = ((p - y[chunk]) * weight[chunk] / len(chunk)).astype(np.float32)
            d_hidden = d[:, None] * model.out * (hidden > 0)
            adam("out", model.out, hidden.T @ d + 1e-4 * model.out)
            adam("offset", offset, np.array([d.sum()], np.float32))
            d_embedding = np.zeros_like(x)
            touched = np.unique(np.concatenate([(peak + k).ravel() for w, peak in zip(WIDTHS, peaks, strict=True) for k in range(w)]))
            for j, w in enumerate(WIDTHS):
                g = d_hidden[:, j * FILTERS : (j + 1) * FILTERS]
                d_filter = np.zeros_like(model.filters[w])
                for k in range(w):
                    rows = x[peaks[j] + k]
                    d_filter[k] = np.einsum("bf,bfl->lf", g, rows)
                    np.add.at(d_embedding, peaks[j] + k, g[:, :, None] * model.filters[w][k].T[None])
                adam(("filter", w), model.filters[w], d_filter + 1e-4 * model.filters[w])
                adam(("bias", w), model.bias[w], g.sum(0))
            used, inverse = np.unique(all_ids[:, touched], return_inverse=True)
            grad = np.zeros((len(used), LENGTH), np.float32)
            np.add.at(grad, inverse.reshape(len(all_ids), -1), np.broadcast_to(d_embedding[touched], (len(all_ids), len(touched), LENGTH)))
            squares[used] += (grad * grad).mean(1)
            model.embedding[used] -= 0.05 * grad / np.sqrt(squares[used])[:, None]
    model.offset = float(offset[0])


def _cut_counts(model: ToxicityModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Guessed language and step of the logit of each text."""
    logit, guess = model.logits(*prefix_hashes(texts, NOT_ALNUM, PREFIXES))
    return guess, np.floor(np.clip(logit, -1e6, 1e6) * CUTS).astype(np.int64)


def _calibrate(model: ToxicityModel, counts: pd.DataFrame, n_languages: int) -> None:
    """For each language the logit of least error on rows held back from training, where both labels have some; the one for all rows elsewhere. counts: guess, step, yes and no, numbers of rows."""
    thresholds = np.zeros(n_languages + 1)

    def best(rows: pd.DataFrame) -> float | None:
        steps = rows.groupby("step")[["yes", "no"]].sum().sort_index()
        yes, no, at = steps["yes"].to_numpy(), steps["no"].to_numpy(), steps.index.to_numpy()
        if yes.sum() < 10 or no.sum() < 10:
            return None
        cuts = (at[1:] + at[:-1] + 1) / 2 / CUTS if len(at) > 1 else (at + 0.5) / CUTS
        missed = np.cumsum(yes)[: len(cuts)] if len(at) > 1 else np.zeros(1)
        passed = no.sum() - np.cumsum(no)[: len(cuts)] if len(at) > 1 else no
        errors = missed / yes.sum() + passed / no.sum()
        good = cuts[errors <= errors.min() + 1e-9]
        # Nearer to the toxic ones, since most texts are not.
        return float(good[0] + 2 * good[-1]) / 3

    common = best(counts)
    common = 0.0 if common is None else common
    for x in range(-1, n_languages):
        own = best(counts[counts["guess"] == x]) if x >= 0 else None
        thresholds[x] = common if own is None else own
    model.thresholds = thresholds


def _learned_words(model: ToxicityModel, counts: pd.DataFrame, sizes: np.ndarray) -> None:
    """counts: word, texts, and l0, l1, ... by language."""
    words = counts["word"].to_numpy(np.int64).view(np.uint64)
    by_language = np.array([counts[f"l{i}"].to_numpy(float) for i in range(len(sizes))]).reshape(len(sizes), len(words))
    model.learn_words(words, counts["texts"].to_numpy(np.int64), by_language, sizes)


def _least(toxic: int) -> float:
    return max(3.0, LEAST_SHARE * toxic)


def _one_label(label: int | None) -> ToxicityModel:
    """Gives every text a score near the label there is, or 0."""
    return ToxicityModel(offset=10.0 if label else -10.0)


def trained(texts: list[str], labels: list[int], langs: list[str | None], seed: int = 3) -> ToxicityModel:
    """A model of a few texts in memory, fitted as one part."""
    if len(set(labels)) < 2:
        return _one_label(labels[0] if labels else None)
    model, y = ToxicityModel(), np.array(labels)
    names = sorted({x for x in langs if x})
    lang = [names.index(x) if x else 0 for x in langs]
    hashes = _hashed(texts)
    counts = _word_counts(hashes, lang)
    wide = pd.DataFrame({"texts": counts.groupby("word")["n"].sum(), **{f"l{i}": counts[counts["lang"] == i].set_index("word")["n"] for i in range(len(names))}}).fillna(0).reset_index(names="word")
    _learned_words(model, wide[wide["texts"] >= _least(sum(labels))], np.bincount(lang, minlength=len(names))[: len(names)])
    back = np.arange(len(texts)) % 5 == 0
    fit = [h for h, b in zip(hashes, back, strict=True) if not b]
    _prepare(model, _seen(model, fit, y[~back]), int(y[~back].sum()), int((1 - y[~back]).sum()), seed)
    _fit(model, fit, y[~back], y[~back].mean(), -(-STEPS // max(1, len(fit) // BATCH)), seed)
    guess, step = _cut_counts(model, [t for t, b in zip(texts, back, strict=True) if b])
    _calibrate(model, pd.DataFrame({"guess": guess, "step": step, "yes": y[back], "no": 1 - y[back]}), len(names))
    return model


def _parameters(model: ToxicityModel) -> np.ndarray:
    """Parameters other than embeddings in one row."""
    return np.concatenate([*[model.filters[w].ravel() for w in WIDTHS], *[model.bias[w] for w in WIDTHS], model.out, [model.offset]])


def _set_parameters(model: ToxicityModel, values: np.ndarray) -> None:
    shapes = [*[model.filters[w].shape for w in WIDTHS], *[model.bias[w].shape for w in WIDTHS], model.out.shape]
    ends = np.cumsum([np.prod(s) for s in shapes])
    found = [values[e - np.prod(s) : e].reshape(s).astype(np.float32) for s, e in zip(shapes, ends, strict=True)]
    model.filters, model.bias, model.out = dict(zip(WIDTHS, found, strict=False)), dict(zip(WIDTHS, found[len(WIDTHS) :], strict=False)), found[-1]
    model.offset = float(values[ends[-1]])


def _labelled_texts(docs: DataFrame, labels: DataFrame, folds: int, held_out: int) -> DataFrame:
    """doc_id, toxic, text and lang of all rows with a text whose id has a label outside the held-out fold, and whether the id is held back."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), folds, held_out))
    usable = usable.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1))
    back = (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)) == 0).alias("back")
    # Texts without a label need not move.
    texts = docs.select("doc_id", "text", "lang", back).where(F.col("text").isNotNull())
    return texts.join(small_or_plain(usable, usable.count()), F.col("doc_id") == F.col("label_id")).drop("label_id")


def _one_of_an_id(texts: DataFrame) -> DataFrame:
    """One text of an id, however often it is repeated."""
    one = F.min(F.struct(F.xxhash64("text"), "text", "lang")).alias("one")
    return texts.groupBy("doc_id", "toxic", "back").agg(one).select("doc_id", "toxic", "one.text", "one.lang", "back")


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, held_out: int) -> DataFrame:
    """doc_id, toxic, text and lang of every labelled id outside the held-out fold that has a text, and whether it is held back: one text of an id."""
    return _one_of_an_id(_labelled_texts(docs, labels, folds, held_out))


def _parts(texts: DataFrame) -> int:
    """How many parts of about ``PART_ROWS`` and ``PART_CHARS`` the rows that are not held back make; hashes stand for the texts, so that none moves for this."""
    one = F.min(F.struct(F.xxhash64("text"), F.length("text").alias("chars"))).alias("one")
    n, chars = texts.where("not back").groupBy("doc_id").agg(one).agg(F.count("*"), F.coalesce(F.sum("one.chars"), F.lit(0))).first()
    return max(1, -(-n // PART_ROWS), -(-chars // PART_CHARS))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> ToxicityModel:
    """Learn from all labelled ids outside the held-out fold, and one whole text of each. What the driver gets grows with the words that a share of the texts have, not with the texts."""
    spark = docs.sparkSession
    texts = _labelled_texts(docs, labels, folds, held_out)
    parts = _parts(texts)
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(parts)).alias("part")
    with written_by(spark, _one_of_an_id(texts).select("*", part), "toxicity_texts", "part", min(parts, MOST_BUCKETS)) as rows:
        return _learned(spark, rows, parts)


def _learned(spark: SparkSession, rows: DataFrame, parts: int) -> ToxicityModel:
    """A model of training rows, which lie in buckets by part."""
    totals = rows.groupBy("lang", "toxic", "back").agg(F.count("*").alias("n")).toPandas()
    if totals["toxic"].nunique() < 2:
        return _one_label(int(totals["toxic"].iloc[0]) if len(totals) else None)
    names = sorted({x for x in totals["lang"] if x})
    number = {x: i for i, x in enumerate(names)}
    totals["lang"] = [number.get(x, 0) for x in totals["lang"]]
    fitted = totals[~totals["back"]]
    toxic, other = (int(fitted.loc[fitted["toxic"] == v, "n"].sum()) for v in (1, 0))
    model = ToxicityModel()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []

        def summed() -> pd.DataFrame:
            return pd.concat(held).groupby(["word", "lang"], as_index=False)["n"].sum()

        for part, texts in text_slices(batches, "text", 1 << 20):
            held.append(_word_counts(_hashed(texts), [number.get(x, 0) for x in part.column("lang").to_pylist()]))
            if len(held) > 16:
                held = [summed()]
                if len(held[0]) > 1 << 20:
                    yield pa.RecordBatch.from_pandas(held.pop(), preserve_index=False)
        if held:
            yield pa.RecordBatch.from_pandas(summed(), preserve_index=False)

    words = rows.select("text", "lang").mapInArrow(counted, "word long, lang long, n long").groupBy("word")
    words = words.agg(F.sum("n").alias("texts"), *[F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).alias(f"l{i}") for i in range(len(names))])
    _learned_words(model, words.where(F.col("texts") >= _least(int(totals.loc[totals["toxic"] == 1, "n"].sum()))).toPandas(), totals.groupby("lang")["n"].sum().reindex(range(len(names)), fill_value=0).to_numpy())

    shared = spark.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int64)
        for part, texts in text_slices(batches, "text"):
            seen += _seen(shared.value, _hashed(texts), part.column("toxic").to_pylist())
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["bucket", "n0", "n1"])

    found = rows.where("not back").select("text", "toxic").mapInArrow(evidence, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    seen = np.zeros((2, BUCKETS), np.int64)
    seen[:, found["bucket"]] = found[["n0", "n1"]].to_numpy().T
    _prepare(model, seen, toxic, other)
    if toxic and other:
        _fit_in_parts(spark, model, rows.where("not back"), toxic, toxic + other, parts)
    model.thresholds = np.zeros(len(names) + 1)
    final = spark.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            guess, step = _cut_counts(final.value, texts)
            yield pa.RecordBatch.from_arrays([pa.array(guess), pa.array(step), part.column("toxic")], names=["guess", "step", "toxic"])

    steps = rows.where("back").select("text", "toxic").mapInArrow(judged, "guess long, step long, toxic int").groupBy("guess", "step").agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no"))
    _calibrate(model, steps.toPandas(), len(names))
    return model


def _fit_in_parts(spark: SparkSession, model: ToxicityModel, rows: DataFrame, toxic: int, n: int, parts: int) -> None:
    """Train ``model`` on all rows: parts of them, drawn by id, each go on from the same parameters, whose mean over the parts that changed them begins the next round.

    Rows lie in buckets by part, so no text moves in any round.
    """
    rounds = 1 if parts == 1 else ROUNDS
    passes = max(1, -(-STEPS // (rounds * parts * max(1, n // parts // BATCH))))
    columns = [f"e{i}" for i in range(LENGTH)]
    dealt = rows.select("doc_id", "text", "toxic", "part")
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def fit(part: pa.Table) -> pa.Table:
            part = part.sort_by("doc_id")
            own = copy.deepcopy(shared.value)
            _fit(own, _hashed(part.column("text").to_pylist()), part.column("toxic").to_numpy(), toxic / n, passes, (3, r))
            at = np.flatnonzero((own.embedding != shared.value.embedding).any(1))
            rest = _parameters(own)
            rest = np.append(rest, np.zeros(-len(rest) % LENGTH)).reshape(-1, LENGTH)
            values = np.rint(np.concatenate((own.embedding[at].astype(float), rest)) * UNITS).astype(np.int64)
            return pa.table({"at": np.concatenate((at, -1 - np.arange(len(rest)))), **dict(zip(columns, values.T, strict=True))})

        sums = dealt.groupBy("part").applyInArrow(fit, "at long, " + ", ".join(f"{c} long" for c in columns)).groupBy("at").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns]).toPandas()
        means = sums[columns].to_numpy() / sums[["n"]].to_numpy() / UNITS
        at = sums["at"].to_numpy()
        model.embedding[at[at >= 0]] = means[at >= 0]
        _set_parameters(model, means[at < 0][np.argsort(-at[at < 0])].ravel())


def _scored(spark: SparkSession, rows: DataFrame, model: ToxicityModel) -> DataFrame:
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in rows.columns if c != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.scores(texts), pa.float64()), *[part.column(c) for c in kept]], names=["score", *kept])

    return rows.mapInArrow(run, "score double" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"))


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.5) of every row.

    A null text counts as empty; empty texts get the score of a text of one unknown word. Labels that are
    null, or repeated for an id, count as none, or as the largest. Without labelled rows of both kinds all
    scores are near the one label there is, or 0. Null and repeated ids are rows like others; an empty table
    gives no rows; columns other than doc_id, text and lang are ignored. Texts of any length are scored whole.
    """
    model = train(docs, labels, folds, held_out)
    rows = docs.select("doc_id", in_fold(F.col("doc_id"), folds, held_out).alias("held_out"), F.col("text").alias("__text"))
    return _scored(spark, rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def harmless_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with the same columns.

    Null, empty and repeated texts and ids are treated as in ``score_toxicity``; very long texts are scored whole.
    An empty table gives no rows. Columns may have any names.
    """
    model = train(docs, labels, folds, held_out)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("__text"))
    return _scored(spark, rows, model).where(F.col("score") < 0.5).select("row.*")
