"""Personal data: patterns against plain regular expressions, the field on held-out rows, Viterbi against all paths."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from cadentia.llm import pii
from cadentia.llm.common import table
from cadentia.llm.queries import op12_pii

SF = "/root/testdata/sf0.001"


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    """The definitions, word for word."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(kind, *m.span()) for kind, pattern, ok in kinds for m in re.finditer(pattern, text) if ok(m.group())]


def test_patterns_on_random_text():
    rng = random.Random(6)
    pieces = ["a", "@", ".", "-", "+", "1", "23", "456", " ", "(", ")", "4111 1111 1111 1111", "1.2.3.4", "a@b.c", "é", "\n", "0", "+49 30 123456", "256", "%", "_"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert pii.pattern_spans(text) == plain(text), text
    assert sum(len(pii.pattern_spans(" ".join(rng.choice(pieces) for _ in range(20)))) for _ in range(100)) > 100


def test_patterns_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "1 " * 200_000, "+1(" * 130_000, "a@" * 200_000, "a@b." * 100_000):
        pii.pattern_spans(text)
        list(pii.contexts(text, []))


def test_field_finds_held_out_forms_and_nothing_else():
    learned = {t for t, _ in pii.labelled_table()}
    rows = [r for r in pii.labelled_table(5, seed=123) if r[0] not in learned]
    assert len(rows) > 200
    base = [pii.pattern_spans(t) for t, _ in rows]
    added = pii.field_spans(pii.default_field(), [t for t, _ in rows], base)
    wanted = {(k, s) for k, (_, spans) in enumerate(rows) for s in spans}
    found = {(k, s) for k, spans in enumerate(added) for s in spans}
    assert len(wanted & found) >= 0.95 * len(wanted)
    assert not [rows[k] for k, s in found - wanted if not rows[k][1]]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    sequences = [s for text in ("call (030) 1 now", "a", "x @ y . z") for s in pii._sequences(text, 0, len(text))]
    f = pii.default_field()
    f = f._replace(by_shape=rng.normal(size=f.by_shape.shape), by_pair=rng.normal(size=f.by_pair.shape), by_gap=rng.normal(size=f.by_gap.shape), steps=rng.normal(size=f.steps.shape))
    steps = f.steps + pii._forbidden()
    for s, tags in zip(sequences, pii.decode(f, sequences), strict=True):
        scores = pii._scores(f, pii._batch(f.shapes, [s]))[0]
        n = min(len(s.shapes), 5)
        if n < len(s.shapes):
            s = pii.Sequence(s.shapes[:n], s.gaps[:n], s.places[:n])
            scores, tags = pii._scores(f, pii._batch(f.shapes, [s]))[0], pii.decode(f, [s])[0]
        paths = [p for p in itertools.product(range(pii.TAGS), repeat=n) if p[0] % 2 or p[0] == 0]
        best = max(paths, key=lambda p: sum(scores[k, t] for k, t in enumerate(p)) + sum(steps[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert tuple(tags) == best


def test_query_on_all_documents(spark):
    rows = {r.doc_id: r for r in op12_pii(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r, base = rows[d.doc_id], plain(d.text or "")
        shown = [f"{k}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        # Nothing but the patterns' forms is in these texts.
        assert r.spans == ",".join(shown)
    assert sum(r.n_email + r.n_phone for r in rows.values()) > 0


def test_added_spans_and_odd_rows(spark, odd_docs, odd_rows, no_docs):
    assert pii.find_personal_data(odd_docs).count() == len(odd_rows) and pii.find_personal_data(no_docs).count() == 0
    texts = ["écrivez à jo (at) mail (dot) org ou appelez le 06 12 34 56 78 vite 😀", "x 10.0.0.1 and +1 (017) 555-7713, tel. (017) 555-7713", None, "", "Visa 3782 822463 10005", "Visa 3782 822463 10006"]
    docs = spark.createDataFrame([(k, t, "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, spans string, base int")
    got = {r.doc_id: r for r in pii.span_digests(pii.find_personal_data(docs)).collect()}
    assert got[0].spans == "email:10:32,phone:47:61" and got[0].n_email == 0
    assert got[1].spans == "ip:2:10,phone:15:32,phone:39:53" and (got[1].n_ip, got[1].n_phone) == (1, 1)
    assert got[2].spans == got[3].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[4].spans == "card:5:22" and got[5].spans == ""


@pytest.mark.parametrize("digits", ["4111111111111111", "378282246310005", "1234567890123456"])
def test_checksum(digits):
    assert pii.luhn(digits) == luhn(digits)
