"""Licence scan, sharding, mixing and URL filter."""

import hashlib
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import pytest
from cadentia.llm import licenses, mixing, sharding, urls


def test_license_forms(spark):
    mit = licenses.KNOWN[0][1]
    rows = [
        (1, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace(",", " ;")), (2, mit.replace("sublicense", "sublicence")), (3, mit + " and more"), (4, None), (5, "..."), (6, ""),
        (7, "// © 1999 X. All rights reserved.\nLicenced under the Apache License, Version 2.0"),
    ]
    found = {r.doc_id: r.license_id for r in licenses.scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None, 7: "Apache-2.0"}


def test_license_odd(spark, odd_docs, no_docs):
    rows = licenses.scan_licenses(spark, odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.license_id is None for r in rows)
    assert licenses.scan_licenses(spark, no_docs).count() == 0


def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, load = (low + high) // 2, 1, 0
        for s in sizes:
            if load + s > mid:
                used, load = used + 1, 0
            load += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_sharding_is_minimax(spark, odd_docs, odd_rows, shards):
    rows = sharding.shard(spark, odd_docs, shards).collect()
    assert len(rows) == len(odd_rows)
    groups, where = defaultdict(int), defaultdict(set)
    for t in (r[1] for r in odd_rows):
        groups[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    loads, slots = Counter(), defaultdict(list)
    for r in rows:
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[r.text_crc32].add(r.shard)
    assert max(loads.values()) <= smallest_capacity([groups[k] for k in sorted(groups)], shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    assert all(0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None for r in rows)
    assert Counter(r.text_crc32 for r in rows) == Counter(zlib.crc32((r[1] or "").encode()) for r in odd_rows)


def test_sharding_of_many_and_of_none(spark, no_docs):
    assert sharding.shard(spark, no_docs).count() == 0
    docs = spark.range(5000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same text' else repeat(cast(id as string), cast(id % 50 as int)) end as text")
    rows = sharding.shard(spark, docs).collect()
    groups = defaultdict(int)
    for r in docs.collect():
        groups[hashlib.md5(r.text.encode()).hexdigest()] += len(r.text) + 1
    loads = Counter()
    for r in rows:
        loads[r.shard] += r["size"]
    assert max(loads.values()) == smallest_capacity([groups[k] for k in sorted(groups)], 16) or max(loads.values()) <= sum(groups.values()) / 16 + max(groups.values())


@pytest.mark.parametrize("at_once", [2, 256])
def test_sharding_opens_blocks(spark, monkeypatch, at_once):
    """With few first blocks, cuts fall inside of blocks that are opened level by level, down to single groups."""
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    monkeypatch.setattr(sharding, "OPEN_AT_ONCE", at_once)
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat(cast(id as string), cast(1 + id * id % 37 as int)) as text")
    groups = {hashlib.md5(r.text.encode()).hexdigest(): len(r.text) + 1 for r in docs.collect()}
    loads = Counter()
    for r in sharding.shard(spark, docs).collect():
        loads[r.shard] += r["size"]
    assert max(loads.values()) == smallest_capacity([groups[k] for k in sorted(groups)], 16) and len(loads) == 16


def targets(sizes, share=1.5, most=2.0):
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, out, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = left / sum(weight[k] for k in open_)
        over = {k for k in open_ if level * weight[k] > most * sizes[k]}
        if not over:
            return out | {k: level * weight[k] for k in open_}
        for k in over:
            out[k] = most * sizes[k]
            left -= out[k]
        open_ -= over
    return out


def test_mixing(spark, odd_docs, odd_rows, no_docs):
    assert mixing.mix(spark, no_docs).count() == 0 and mixing.mixed_documents(spark, no_docs).count() == 0
    rows = mixing.mix(spark, odd_docs).collect()
    assert len(rows) == len(odd_rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    for r in odd_rows:
        sizes[r[3]] += count(r[1])
    want = targets(sizes)
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
    for k in sizes:
        assert abs(taken[k] - want[k]) <= 3  # repeated ids share a cut, and lose less than a word each
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(spark, odd_docs.repartition(5)).collect()))
    mixed = mixing.mixed_documents(spark, odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == sum(r.copies for r in rows)


def test_urls(spark):
    rows = [
        (1, "http://A.Example.NET/x?y"), (2, "http://example.net/en/1"), (3, "http://m.example.net/en/"), (4, "https://example.com/de/1#t"), (5, "http://x.org/fr/"), (6, "http://notexample.com/de/1"),
        (7, None), (8, "no scheme"), (9, "http://net"), (10, "x://h?q/en/"), (11, "http://planet/"), (11, "http://planet/"), (None, "a://b://c/d"),
    ]
    found = {(r.page_id, r.host): r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' as host", "1 as rule")).collect()}
    rules = {k[0]: r.rule for k, r in found.items()}
    assert rules == {1: "net/", 2: "example.net/en/", 3: "example.net/en/", 4: "example.com/de/", 5: "org/fr/", 6: None, 7: None, 8: None, 9: None, 10: None, 11: None, None: None}
    assert found[1, "a.example.net"].verdict == "block" and found[3, "m.example.net"].verdict == "allow"
    assert (found[10, "h"].path, found[None, "b:"].path, found[1, "a.example.net"].path) == ("", "//c/d", "/x")
    assert all(r.verdict in ("allow", "block") for r in found.values())
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_markov_model_sums_to_one_and_separates():
    good, bad = [f"www.good{i}.org/en/{i}" for i in range(200)], [f"ads.bad{i}.net/track/{i}?id={i}" for i in range(200)]
    model = urls.MarkovModel(good)
    for context in ("", "w", "ww", "www.g", "zzz"):
        while context not in model.contexts:
            context = context[1:]
        assert abs(sum(model._probability(context, chr(c)) for c in range(urls.ALPHABET)) - 1) < 1e-9
    c = urls.UrlClassifier(good, bad)
    assert c.score("www.good999.org/en/7") > c.threshold > c.score("ads.bad999.net/track/7?id=7")


def test_all_decided_addresses_train_the_models(spark):
    """More than 6,000 of a verdict: every one counts, and the threshold is that of all that are held back."""
    rows = [(i, f"http://a{i}.org/fr/{i}") for i in range(7_000)] + [(7_000 + i, f"http://b{i}.net/x/{i}") for i in range(6_500)] + [(20_000, "http://c.com/fr/1")]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    ordered = lambda verdict: sorted({r.host + r.path for r in got.values() if r.rule and r.verdict == verdict}, key=lambda a: hashlib.md5(a.encode()).hexdigest())
    want = urls.UrlClassifier(ordered("allow"), ordered("block"))
    for k in (0, 6_999, 7_000, 20_000):
        assert abs(got[k].llr - want.score(got[k].host + got[k].path)) < 1e-9
    assert all(r.model_verdict == ("allow" if r.llr >= want.threshold else "block") for r in got.values() if abs(r.llr - want.threshold) > 1e-9)


def wrapped(text, width):
    """The text with the lines of each paragraph filled anew; notices and short lines stay on their own."""
    out = []
    for block in re.split(r"\n[ \t]*\n", text):
        out.append(block if re.search(r"(?im)^\W*copyright [\[(]", block) else textwrap.fill(" ".join(block.split()), width, break_long_words=False, break_on_hyphens=False))
    return "\n\n".join(out)


def test_license_wrapped_at_any_width(spark):
    known = licenses.known_licenses(spark).collect()
    rows = [(n, w, wrapped("Copyright (c) 2020 Some One\n\n" + t, w)) for n, (_, t) in enumerate(known) for w in (range(40, 121) if len(t) < 9000 else (40, 72, 80, 101))]
    found = licenses.scan_licenses(spark, spark.createDataFrame([(1000 * n + w, t) for n, w, t in rows], "doc_id long, text string")).collect()
    assert len(found) == len(rows) and {r.doc_id for r in found if r.license_id != known[r.doc_id // 1000][0]} == set()


@pytest.mark.parametrize("line_end", ["\r", "\r\n", "\n"])
def test_license_with_line_ends_of_any_system(spark, line_end):
    known = licenses.known_licenses(spark).collect()
    rows = [(n, ("Copyright (c) 2020 Some One\n\n" + t).replace("\n", line_end)) for n, (_, t) in enumerate(known)]
    found = licenses.scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows) and {r.doc_id for r in found if r.license_id != known[r.doc_id][0]} == set()


def test_license_notices(spark):
    mit = licenses.KNOWN[0][1]
    notices = [
        "Copyright 2020 X", "(c) 1999, 2001 Y Z", "© Z", "(c) Some One", "Copyright Some One", "// Copyright (C) A\n// Copyright: B", "Copyright The X Authors\nAll rights reserved", "Copyright <YEAR> <NAME>",
        "Copyright (c) X. All rights\nreserved.", "(C) Foo 2011", "* (c) Copyright X", "Copyright [yyyy] [name of copyright owner]",
    ]
    kept = ["copyright holders and others", "copyright notice", "(c) you must retain this", "copyrighted by someone", "copyright law"]
    rows = [(i, f"{n}\n\n{mit}") for i, n in enumerate(notices + kept)]
    found = {r.doc_id: r.license_id for r in licenses.scan_licenses(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(rows))] == ["MIT"] * len(notices) + [None] * len(kept)


def test_license_headings_and_whole_texts(spark):
    notice = "Copyright (c) 2021, Some One\nAll rights reserved.\n\n"
    texts = {i: t for i, t in reversed(licenses.KNOWN)}
    want = [
        ("MIT", "The MIT License (MIT)\n\n" + notice + texts["MIT"]), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + notice + texts["BSD-3-Clause"]), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + notice + texts["BSD-2-Clause"]),
        ("BSD-2-Clause", re.sub(r"(?m)^[0-9]\.", "*", texts["BSD-2-Clause"])), ("ISC", "ISC License\n\n" + notice + texts["ISC"]),
    ]
    for name in ("Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "Unlicense"):
        text = (licenses.TEXTS / f"{name}.txt").read_text("utf-8")
        want += [(name, text), (name, re.sub(r"(?m)^", "# ", text))]
    apache = (licenses.TEXTS / "Apache-2.0.txt").read_text("utf-8")
    want += [("Apache-2.0", apache.split("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS\n"), (None, apache.replace("Grant of Patent License", "Grant"))]
    found = licenses.scan_licenses(spark, spark.createDataFrame([(i, t) for i, (_, t) in enumerate(want)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.license_id for r in found} == {i: name for i, (name, _) in enumerate(want)}
