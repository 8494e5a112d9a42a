"""Queries of trained models against literal versions of the same definitions, loop by loop."""

import hashlib
import re
import zlib
from collections import Counter
from functools import cache
from math import exp, log

import corpus_pipeline
import public_tokenizers
import pytest
from cadentia.llm import language, toxicity, urls
from cadentia.llm.common import table
from cadentia.llm.queries import op5_url_filter, op7_toxicity
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_url_verdicts(spark):
    rows = op5_url_filter(spark, SF).collect()
    long = "http://a.example.com/" + "x/" * 3000
    known = {}
    for verdict in ("allow", "block"):
        of_rule = {r.host + r.path for r in rows if r.rule and r.verdict == verdict}
        known[verdict] = sorted(of_rule, key=lambda a: hashlib.md5(a.encode()).hexdigest())[: urls.TRAINING_ROWS]
    assert all(known.values())

    def probability_of(addresses):
        seen = Counter()
        for a in addresses:
            padded = "\n" * urls.ORDER + a + "\t"
            seen.update((padded[i - k : i], padded[i]) for i in range(urls.ORDER, len(padded)) for k in range(urls.ORDER + 1))
        total, kinds = Counter(), Counter()
        for (context, _), n in seen.items():
            total[context] += n
            kinds[context] += 1

        @cache
        def often(context):
            return not context or total[context] >= urls.LEAST_SEEN and often(context[1:])

        @cache
        def p(context, c):
            shorter = p(context[1:], c) if context else 1 / urls.ALPHABET
            if not often(context) or not total[context]:
                return shorter
            return (seen[context, c] + kinds[context] * shorter) / (total[context] + kinds[context])

        def mean(a):
            padded = "\n" * urls.ORDER + a + "\t"
            return sum(log(p(padded[i - urls.ORDER : i], padded[i])) for i in range(urls.ORDER, len(padded))) / (len(a) + 1)

        return mean

    yes, no = (probability_of([a for i, a in enumerate(known[v]) if i % 4]) for v in ("allow", "block"))
    score = {a: yes(a) - no(a) for a in {r.host + r.path for r in rows}}
    held = [[score[a] for a in known[v][::4]] for v in ("allow", "block")]
    cuts = sorted(held[0] + held[1])
    cuts = [cuts[0] - 1e-9] + [(a + b) / 2 for a, b in zip(cuts, cuts[1:], strict=False)]
    errors = [sum(s < c for s in held[0]) / len(held[0]) + sum(s >= c for s in held[1]) / len(held[1]) for c in cuts]
    threshold = cuts[errors.index(min(errors))]
    for r in rows:
        s = score[r.host + r.path]
        assert r.llr == pytest.approx(s, abs=1e-9)
        if abs(s - threshold) > 1e-9:
            assert r.model_verdict == ("allow" if s >= threshold else "block")
            assert r.rule or r.verdict == r.model_verdict
    assert urls.filter_urls(spark.createDataFrame([(1, long), (1, long)], "page_id long, url string")).count() == 2


def test_language_by_loops(spark):
    docs = table(spark, SF, "documents").where("length(text) < 4000 or text is null")
    model = language.train(docs)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    found = language.identify(spark, docs).collect()
    assert len(found) == docs.count() and len(model.languages) > 1
    for r in found:
        text = texts[r.doc_id] or ""
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        data = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()] + [32]
        margins, grams = [0.0] * model.codes.shape[1], 0
        for n in language.LENGTHS:
            for i in range(len(data) - n + 1):
                gram = data[i : i + n]
                if set(gram) == {32}:
                    continue
                value = 0
                for b in gram:
                    value = (value * 257 + b) % 2**32
                bucket = (value * 0x9E3779B1 % 2**32 >> 16) or 1
                grams += 1
                for k, w in enumerate(model.weights[bucket].tolist()):
                    margins[k] += w
        costs = [sum(exp(-code * m / grams) for code, m in zip(codes, margins, strict=True)) for codes in model.codes.tolist()]
        ranked = sorted(costs)
        share = 1 / sum(exp(-3 * (c - ranked[0])) for c in costs)
        assert r.score == pytest.approx(share, abs=1e-3)
        if ranked[1] - ranked[0] > 1e-3:
            assert r.lang_pred == model.languages[costs.index(ranked[0])]
    assert re.fullmatch(r"\w+", found[0].lang_pred)


def test_toxicity_by_loops(spark):
    """The query's scores from the definitions, word by word: evidence and thresholds are the model's, all else is worked out here."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train(docs, labels)
    assert model.filters and len(model.thresholds) > 1
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = op7_toxicity(spark, SF).collect()
    assert len(rows) == len(texts)

    @cache
    def vector(word):
        """Bucket of the word itself, and the sum of the vectors of the word and its beginnings."""
        hashes, _ = toxicity.prefix_hashes([word], toxicity.NOT_ALNUM, toxicity.PREFIXES)
        slots = [int(h) % toxicity.SLOTS for h in hashes[:, 0]]
        known = [1 + (int(h) >> 32) % (toxicity.BUCKETS - 1) if int(model.known[slot]) == int(h) else 0 for h, slot in zip(hashes[:, 0], slots, strict=True)]
        return known[0], [sum(float(model.embedding[b, d]) for b in known) for d in range(toxicity.LENGTH)]

    nothing = [len(toxicity.PREFIXES) * float(x) + float(x) for x in model.embedding[0]]
    checked = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5)
        words = re.findall(rb"[a-z0-9\x80-\xff]+", texts[r.doc_id].encode().lower())
        if len(words) > 150:
            continue
        checked += 1
        found = [vector(w.decode()) for w in words]
        x = [v for _, v in found] + [nothing] * max(toxicity.WIDTHS)
        logit = model.offset
        for w in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                peak = max(sum(x[i + k][d] * float(model.filters[w][k, d, f]) for k in range(w) for d in range(toxicity.LENGTH)) for i in range(len(words) + 1))
                logit += max(0.0, peak + float(model.bias[w][f])) * float(model.out[(w - 1) * toxicity.FILTERS + f])
        votes = Counter(int(model.language_of[b]) for b, _ in found if model.language_of[b] >= 0)
        top = max(votes.values(), default=0)
        guess = min(x for x in votes if votes[x] == top) if votes else -1
        assert r.score == pytest.approx(1 / (1 + exp(-(logit - float(model.thresholds[guess])))), abs=1e-3), (r.doc_id, guess)
    assert checked > 30


def mixed(rows):
    """doc_id and how often the mix takes it whole, of rows (doc_id, source, size)."""
    size = Counter()
    for _, source, n in rows:
        size[source] += n
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float((5, 2, 1)[k % 3]) for k, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(size.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(2.0 * size[s] for s in full)
        free -= full
    out = []
    for s in names:
        epochs = int(target[s] // size[s]) if size[s] else 0
        rest, before = round(target[s] - epochs * size[s]), 0
        for doc_id, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: hashlib.md5(f"{r[0]}:mix-1".encode()).hexdigest()):
            out += [doc_id] * (epochs + (before < rest))
            before += n
    return Counter(out)


def test_pipeline_by_loops(spark):
    """What every stage of the pipeline keeps, from the decisions of its models and the definitions of the other stages."""
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    judged = {r.doc_id for r in language.identify(spark, docs).collect() if r.lang_pred != "und" and not r.ambiguous}
    left = docs.where(F.col("doc_id").isin(*judged))
    harmless = {r.doc_id for r in toxicity.score_toxicity(spark, left, table(spark, SF, "labels")).collect() if r.score < 0.5}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in rows[i].text or "")) for i in harmless}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    group = {i: i for i in harmless}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in sorted(sets):
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    kept = [i for i in sorted(harmless) if top(i) == i]
    copies = mixed([(i, rows[i].source, len(re.findall(r"[^\x20\x09-\x0D]+", rows[i].text or ""))) for i in kept])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    want = Counter()
    for i, n in copies.items():
        ids = library.encode(rows[i].text or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(b"".join(t.to_bytes(4, "little") for t in ids)).hexdigest()] = n
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want and len(kept) < len(harmless) < len(rows)


def test_pipeline_runs_on_odd_rows_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        at = f"{tmp_path}/{name}"
        docs.write.parquet(f"{at}/documents.parquet")
        table(spark, SF, "labels").write.parquet(f"{at}/labels.parquet")
        rows = corpus_pipeline.run(spark, at).collect()
        assert all(len(r.ids) == r.n_tokens for r in rows) and (name == "odd" or not rows)
