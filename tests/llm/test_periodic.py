"""Periodic runs against a search of all starts and periods, and the query against the same on whole documents."""

import hashlib
import random
import re
import zlib

from cadentia.llm import periodic
from cadentia.llm.common import table
from cadentia.llm.queries import op11_periodic_runs

SF = "/root/testdata/sf0.001"


def slow_runs(words):
    """All maximal stretches of every period, of each of which a run of a smaller one that covers it is not there."""
    found = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q) and not any(all(words[k] == words[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                found.append((i, j - i + q, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = top[1] * 1000 // top[2] if runs else None
    return (doc_id, len(runs), *top, milli, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in dropped)))


def test_random_words_against_all_starts():
    rng = random.Random(3)
    texts = []
    for k in range(400):
        letters = "ab" if k % 3 == 0 else "abc" if k % 3 == 1 else "abcdefghij"
        text = []
        for _ in range(rng.randint(0, 6)):
            piece = [rng.choice(letters) for _ in range(rng.randint(1, 30))]
            text += piece * rng.randint(1, 4) + piece[: rng.randint(0, len(piece))]
        texts.append(" ".join(text))
    ids, words = periodic.word_ids(texts)
    assert len(words) == 10
    for text, runs in zip(texts, periodic.runs_of(ids), strict=True):
        assert runs == slow_runs(text.split()), text
    assert sum(map(len, periodic.runs_of(ids))) > 300


def test_long_texts_and_all_lags():
    """Texts alone and together, with one word throughout and with periods next to powers of two."""
    rng = random.Random(4)
    texts = ["a " * 50_000, "a b " * 30_000]
    for q in (11, 12, 13, 23, 24, 25, 95, 96, 97, 191, 193):
        piece = [str(rng.random()) for _ in range(q)]
        for extra in (-1, 0, 1):
            text = [str(rng.random()) for _ in range(rng.randint(0, 40))] + piece * 2
            texts.append(" ".join((text[:extra] if extra < 0 else text + piece[:extra]) + ["end"]))
    ids, _ = periodic.word_ids(texts)
    together = periodic.runs_of(ids)
    assert together[0] == [(0, 50_000, 1)] and together[1] == [(0, 60_000, 2)]
    assert together == [periodic.runs_of([x])[0] for x in ids]
    assert together[2:] == [slow_runs(t.split()) for t in texts[2:]]


def test_query_on_all_documents(spark):
    rows = [tuple(r) for r in op11_periodic_runs(spark, SF).collect()]
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect() if len((r.text or "").split()) < 2500]
    assert len(rows) == table(spark, SF, "documents").count() and len(docs) > 150
    by_id = {r[0]: r for r in rows}
    for doc_id, text in docs:
        assert by_id[doc_id] == expected(doc_id, text)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    found = periodic.find_runs(odd_docs)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = [tuple(r) for r in periodic.run_digests(found).collect()]
    assert len(got) == len(odd_rows)
    # No planting here: ids whose checksum ends in 0 are judged as others are. The two long texts repeat words, but nothing in a row.
    wanted = [(r[0], *expected(None, r[1])[1:]) for r in odd_rows if len(r[1] or "") < 100_000]
    long_ids = {r[0] for r in odd_rows} - {w[0] for w in wanted}
    assert sorted(str(r) for r in got if r[0] not in long_ids) == sorted(map(str, wanted)) and len(long_ids) == 2
    assert all(r[1:6] == (0, None, None, None, None) for r in got if r[0] in long_ids)
    nulls = periodic.find_runs(odd_docs).where("doc_id is null").collect()
    assert sorted(r.collapsed for r in nulls) == ["", "one"] and all(not r.runs for r in nulls)
    assert periodic.run_digests(periodic.find_runs(no_docs)).count() == 0
