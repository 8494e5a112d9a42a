"""Divergence of sources against the definitions on dictionaries, and tries against sorted ones."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from cadentia.llm import divergence


def plain_terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [t.encode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)]


def expected(rows, least, top):
    docs = [(plain_terms(text), lang or "", source or "") for text, lang, source in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for words, lang, source in docs:
        df[lang].update(set(words))
        counts[lang, source].update(words)
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in df.items()}
    out = []

    def share(lang, often):
        total = sum(often[t] for t in kept[lang])
        return {t: 1 + 10**9 * (often[t] + 5) // (total + 5 * len(kept[lang])) for t in kept[lang]}

    p = {k: share(k[0], c) for k, c in counts.items()}
    for (lang, source), mine in p.items():
        whole = sum((c for (x, _), c in counts.items() if x == lang), Counter())
        q = share(lang, whole)
        pairs = [(sum(abs(mine[t] - theirs[t]) for t in mine), s) for (x, s), theirs in p.items() if x == lang and s != source]
        terms = [(mine[t] - q[t], t.decode()) for t in mine if counts[lang, source][t] and mine[t] > q[t]]
        for part, items in (("pair", pairs), ("term", terms)):
            ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def test_random_rows_in_small_pieces(spark):
    rng = random.Random(8)
    pieces = ["a", "ab", "abc", "ABC", "é", "éa", "漢", "漢字", "b", "x", "xy", "xyz", "zz"]
    rows = []
    for _ in range(300):
        text = " ".join("".join(rng.choice(pieces) for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice([text, text + " 12!" + text.upper(), None, ""]), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", "é", None, "s10"])))
    rows += [("only here", "fr", "one"), ("", "it", "one"), ("", "it", "two")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, term int, `count` string").repartition(4)
    want = expected(rows, 30, 7)
    assert sorted(map(tuple, divergence.source_divergence(spark, docs, 30, 7).collect())) == want
    small = divergence.source_divergence(spark, docs, 30, 7, most_leaves=20, chunk=5, tile=2)
    assert sorted(map(tuple, small.collect())) == want and {r[2] for r in want} == {"pair", "term"}
    assert [r for r in want if r[0] == "it"] == [("it", "one", "pair", "two", 0, 1), ("it", "two", "pair", "one", 0, 1)]


def test_tries_walk_in_order_and_add_up():
    rng = random.Random(2)
    terms = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 7))).encode() for _ in range(3000)] + [b"a" * 5000, b"a" * 4999, b"a" * 4999 + b"b"]
    rng.shuffle(terms)
    trie = divergence.Trie()
    for k in range(3):
        mine = sorted(Counter(terms[k::3]).items())
        trie.merge([t for t, _ in mine], [n for _, n in mine], [[(f"s{k}", n), ("all", n)] for _, n in mine])
    walked = [(t, n.documents, sum(n.counts.values())) for t, n in trie.walk()]
    assert walked == [(t, n, 2 * n) for t, n in sorted(Counter(terms).items())] and trie.leaves == len(walked)


def test_shares_are_exact():
    for total, kept in ((10**14 + 8, 4), (8, 1), (3 * 10**14, 10**12)):
        counts = [c for c in (0, 1, 7, 10**14) if c <= total]
        assert divergence.shares(np.array(counts, np.int64), total, kept).tolist() == [1 + 10**9 * (c + 5) // (total + 5 * kept) for c in counts]


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    found = sorted(map(tuple, divergence.source_divergence(spark, odd_docs, 2).collect()))
    assert found == expected([(r[1], r[2], r[3]) for r in odd_rows], 2, divergence.TOP)
    assert divergence.source_divergence(spark, no_docs).count() == 0
