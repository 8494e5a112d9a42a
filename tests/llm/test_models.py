"""BPE, toxicity and language identification."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from cadentia.llm import bpe, language, toxicity
from tokenizers import Tokenizer as Reference

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Reference.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_library(reference):
    t = bpe.tokenizer(PATH)
    rng = random.Random(2)
    alphabet = [chr(c) for c in range(0x250)] + [" "] * 90 + ["\n"] * 20 + [chr(c) for c in (0x4E00, 0x1F600, 0x3000, 0x2028, 0x85, 0xA0, 0x300, 0x1C89, *(a for a, _ in bpe.SINCE_UNICODE_16))] + ["'s", "'ll", "<|endoftext|>", "   ", "hello", " the"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["a" * 20_000, " " * 999 + "x", "\n" * 99 + " \n x", "ab" * 5000, "é" * 999, "-" * 3000, ""]
    for text in texts:
        want = reference.encode(text, add_special_tokens=False).ids
        assert t.encode(text).tolist() == want, text[:50]
        assert t.decode(want) == reference.decode(want, skip_special_tokens=False)


def test_bpe_pieces_by_code_point(reference):
    t = bpe.tokenizer(PATH)
    rng = random.Random(3)
    for c in rng.sample([c for c in range(0x30000) if not 0xD800 <= c < 0xE000], 3000):
        text = f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}a"
        assert t.encode(text).tolist() == reference.encode(text, add_special_tokens=False).ids, hex(c)


def test_bpe_queries(spark, odd_docs, odd_rows, no_docs, reference):
    rows = bpe.round_trip_digests(odd_docs, PATH).collect()
    assert len(rows) == len(odd_rows) and bpe.round_trip_digests(no_docs, PATH).count() == 0
    want = []
    for r in odd_rows:
        ids = reference.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows)
    back = bpe.decode(bpe.encode(odd_docs, PATH), PATH)
    assert sorted(str(r.text) for r in back.collect()) == sorted(str(r[1] or "") for r in odd_rows)


def labelled(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = ["en", "de"][i % 2]
        syllables = {"en": ["the", "ing", "and", "ou", "er"], "de": ["sch", "ung", "ü", "ein", "ich"]}[lang]
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 80))]
        toxic = int(i % 7 < 2)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["grr", "bahh", "ughly" + str(rng.randint(0, 9))])
        out.append((i, " ".join(words), lang, toxic))
    return out


def test_toxicity_learns(spark):
    rows = labelled(1500, 1)
    docs = spark.createDataFrame([(*r[:3], 9.0, "x") for r in rows], "doc_id long, text string, lang string, score double, predicted string")
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int")
    found = toxicity.score_toxicity(spark, docs, labels).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    assert np.mean([r.predicted == rows[r.doc_id][3] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    kept = toxicity.harmless_documents(spark, docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in found)


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """Texts of any length, and any number of parts; reruns agree."""
    monkeypatch.setattr(toxicity, "PART_ROWS", 100, raising=False)
    rows = labelled(500, 5)
    ids = [i for i in range(500, 600) if zlib.crc32(str(i).encode()) % 5][:6]
    rows += [(i, "the inger " * 4_200 + "farbeyond", "en", 1) for i in ids]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(7)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    models = [toxicity.train(docs, labels) for _ in range(2)]
    hashes, _ = toxicity.prefix_hashes(["farbeyond"], toxicity.NOT_ALNUM, toxicity.PREFIXES)
    assert (models[0].buckets(hashes) > 0).all() and models[0].scores(["the ing farbeyond and ou"])[0] > 0.5
    assert np.array_equal(models[0].embedding, models[1].embedding) and np.array_equal(models[0].thresholds, models[1].thresholds)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == r[3] for s, r in zip(models[0].scores([r[1] for r in held]), held, strict=True)]) > 0.9
    assert toxicity.training_rows(docs, labels, 5, 0).count() == len(rows) - len(held)


def test_toxicity_parts_move_once(spark, monkeypatch):
    """In the rounds parts are read as they lie, and no table stays in the catalog."""
    rows = labelled(400, 6)
    docs = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    found, fit = [], toxicity._fit_in_parts

    def watched(spark, model, rows, toxic, n, parts):
        grouped = rows.groupBy("part").applyInPandas(lambda f: f[["part"]].head(1), "part long")
        found.append((parts, sorted(r.part for r in grouped.collect()), grouped._jdf.queryExecution().executedPlan().toString()))
        fit(spark, model, rows, toxic, n, parts)

    monkeypatch.setattr(toxicity, "PART_ROWS", 100)
    monkeypatch.setattr(toxicity, "_fit_in_parts", watched)
    before = {t.name for t in spark.catalog.listTables()}
    toxicity.train(docs, labels)
    [(parts, seen, plan)] = found
    assert parts == 3 and seen == [0, 1, 2] and "Exchange" not in plan
    assert {t.name for t in spark.catalog.listTables()} == before


def test_toxicity_odd(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 0), (3, 1, 1), (3, 1, 0), (4, 1, 0), (5, 1, 1), (9, 0, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        rows = toxicity.score_toxicity(spark, odd_docs, labels).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(spark, no_docs, some).count() == 0


def test_toxicity_of_a_text_is_its_own():
    rows = labelled(900, 6)
    model = toxicity.trained([r[1] for r in rows], [r[3] for r in rows], [r[2] for r in rows])
    texts = ["the and", None, "", "grr", "the", "grr bahh", "!!", "ing", "bahh the and", *[r[1] for r in rows[:60]]]
    alone = [model.scores([t])[0] for t in texts]
    assert model.scores(texts).tolist() == alone and model.scores(texts[::-1]).tolist() == alone[::-1]


def test_toxicity_pools_where_training_does():
    rng = np.random.default_rng(4)
    model = toxicity.ToxicityModel(embedding=rng.normal(size=(toxicity.BUCKETS, toxicity.LENGTH)).astype(np.float32), out=rng.normal(size=len(toxicity.WIDTHS) * toxicity.FILTERS).astype(np.float32), offset=0.0)
    model.filters = {w: rng.normal(size=(w, toxicity.LENGTH, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS}
    model.bias = {w: np.zeros(toxicity.FILTERS, np.float32) for w in toxicity.WIDTHS}
    texts = ["a", "b c", "", "d e f g"]
    hashes, begins = toxicity.prefix_hashes(texts, toxicity.NOT_ALNUM, toxicity.PREFIXES)
    model.known[hashes & np.uint64(toxicity.SLOTS - 1)] = hashes
    want = []
    for lo, hi in zip(begins[:-1], begins[1:], strict=True):
        x = model.embedding[np.concatenate((model.buckets(hashes[:, lo:hi]), np.zeros((len(hashes), 3), np.int64)), 1)].sum(0)
        peaks = [max(sum(x[i + k] @ model.filters[w][k][:, f] for k in range(w)) for i in range(hi - lo + 1)) for w in toxicity.WIDTHS for f in range(toxicity.FILTERS)]
        want.append(np.maximum(peaks, 0) @ model.out)
    assert np.allclose(model.logits(hashes, begins)[0], want, atol=1e-3)


def test_language_learns(spark):
    rows = labelled(600, 4)
    docs = spark.createDataFrame([(r[0], r[1] if i % 50 else "12 !", r[2] if i % 9 else None, "s") for i, r in enumerate(rows)], "doc_id long, text string, lang string, lang_pred string")
    found = language.identify(spark, docs).collect()
    assert all((r.lang_pred == "und") == (r.doc_id % 50 == 0) for r in found)
    good = [r.lang_pred == rows[r.doc_id][2] for r in found if r.doc_id % 50]
    assert np.mean(good) > 0.98 and all(0 <= r.score <= 1 for r in found)
    kept = language.known_language_documents(spark, docs)
    assert kept.columns == docs.columns and kept.where("doc_id % 50 = 0").count() == 0 and kept.count() > 550


def test_language_odd(spark, odd_docs, no_docs):
    rows = language.identify(spark, odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.lang_pred in ("en", "de", "und") for r in rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (0, 1, 2, 11))
    assert language.identify(spark, no_docs).count() == 0
    assert all(r.lang_pred == "und" for r in language.identify(spark, odd_docs.withColumn("lang", odd_docs.lang.substr(9, 0)).where("1 = 0").unionByName(odd_docs.selectExpr(*[c if c != "lang" else "cast(null as string) as lang" for c in [f"`{c}`" if c == "row" else c for c in odd_docs.columns]]))).collect())


@pytest.mark.parametrize("langs", [["de", "en"], ["de", "en", "fr", "nl"]])
def test_language_of_a_text_is_its_own(langs):
    texts = ["schön", None, "", "a", "the", "ü", "12 !", "ich ein", "and", " ", "ab", "", "", "x y", *[r[1] for r in labelled(60, 7)]]
    alone = [np.concatenate([b[b > 0] for b in language.gram_buckets([t])[0]]) for t in texts]
    together = language.gram_buckets(texts)
    for j, own in enumerate(alone):
        cut = [b[at[j] : at[j + 1]] for b, at in zip(*together, strict=True)]
        assert np.concatenate([c[c > 0] for c in cut]).tolist() == own.tolist()
    rng = np.random.default_rng(5)
    model = language.LanguageModel.trained({x: rng.integers(0, 50, language.BUCKETS) for x in langs})
    want = [[v[0] for v in model.predict([t])] for t in texts]
    assert [list(v) for v in zip(*model.predict(texts), strict=True)] == want


@pytest.mark.parametrize("classes", [1, 2, 3, 5, 8])
def test_codewords_differ(classes):
    m = language.code_matrix(classes)
    assert m.shape[0] == classes and len({tuple(r) for r in m.tolist()}) == classes
