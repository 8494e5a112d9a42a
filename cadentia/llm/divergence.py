"""How far the sources of each language are from each other, and by which terms each stands out.

Every task counts the terms of its texts in a byte trie for each language, whose edges hold as many bytes as
no branch parts (a radix trie) and whose leaves count each source and the documents. The tries travel as their leaves
and are merged again in tasks that hold one range of prefixes each, in the order of UTF-8, a few thousand leaves at a time. Walking a
merged trie gives the kept terms in that order: sums of differences for all pairs of sources and, for each source, its candidates, ties in place.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadentia.llm.common import small_or_plain, text_slices, written

LEAST_DOCUMENTS, TOP = 30, 50
#: Bytes of texts that are counted together, leaves of a task's tries before they are given out, leaves of a merged trie that are walked together, sources that are compared with as many at once.
MOST_BYTES, MOST_LEAVES, CHUNK, TILE = 1 << 24, 300_000, 4096, 256
#: Added to each count; steps of a thousand in the billion that shares are parts of.
PRIOR, STEPS = 5, 3

_LEAVES = "lang string, term binary, documents long, sources array<string>, counts array<long>"
_KEPT = "lang string, terms array<binary>, sources array<array<string>>, counts array<array<long>>"
_FOUND = "lang string, source string, part string, item string, value long"

# Term bytes are ASCII letters, which are lower-cased, and all beyond ASCII.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def terms_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in a row, and the number of each one's text."""
    parts = [t.encode("utf-8", "surrogatepass").lower().translate(_LETTERS) for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    letter = data != 0x20
    edges = np.flatnonzero(np.diff(letter, prepend=False))
    starts, stops = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(stops - starts)))
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[letter])])
    return terms, np.searchsorted(ends, starts, "right")


class Node:
    """A node of a radix trie with the bytes on the edge that leads to it."""

    __slots__ = ("counts", "documents", "kids", "label")

    def __init__(self, label: bytes):
        self.label, self.kids = label, None
        self.documents, self.counts = 0, None  # of the term that ends here


class Trie:
    """Terms with their number of documents and how often each source has them."""

    def __init__(self):
        self.root = Node(b"")
        self.ends: dict[bytes, Node] = {}  # where each term ends, so that only new ones walk

    @property
    def leaves(self) -> int:
        return len(self.ends)

    def put(self, terms: Iterable[bytes]) -> None:
        """Make the nodes at which terms end, given in their order: a term goes on from where it leaves the path of the one before. An edge that it leaves halfway is parted."""
        path = [(b"", self.root)]
        for term in terms:
            if term in self.ends:
                continue
            while not term.startswith(path[-1][0]):
                path.pop()
            before, node = path[-1]
            i, n = len(before), len(term)
            while i < n:
                kids = node.kids
                if kids is None:
                    kids = node.kids = {}
                first = term[i]
                kid = kids.get(first)
                if kid is None:
                    node = kids[first] = Node(term[i:])
                    i = n
                else:
                    label = kid.label
                    if term.startswith(label, i):
                        node = kid
                        i += len(label)
                    else:
                        k = 1
                        while i + k < n and label[k] == term[i + k]:
                            k += 1
                        node = kids[first] = Node(label[:k])
                        kid.label = label[k:]
                        node.kids = {label[k]: kid}
                        i += k
                path.append((term[:i], node))
            node.counts = {}
            self.ends[term] = node

    def merge(self, terms: list[bytes], documents: Iterable[int], counts: Iterable[Iterable[tuple[str, int]]]) -> None:
        """Add leaves, in order of their terms: documents, and how often each of some sources has the term."""
        self.put(terms)
        ends = self.ends
        for term, n, of_sources in zip(terms, documents, counts, strict=True):
            end = ends[term]
            end.documents += n
            held = end.counts
            for source, c in of_sources:
                held[source] = held.get(source, 0) + c

    def walk(self) -> Iterator[tuple[bytes, Node]]:
        """Terms and their leaves in the order of their bytes."""
        stack = [(b"", self.root)]
        while stack:
            term, node = stack.pop()
            if node.counts is not None:
                yield term, node
            if node.kids:
                for _, kid in sorted(node.kids.items(), reverse=True):
                    stack.append((term + kid.label, kid))


def _leaf_batch(lang: str, terms: pa.Array, documents: pa.Array, sizes: np.ndarray, sources: pa.Array, counts: pa.Array) -> pa.RecordBatch:
    """Leaves, of which each has its number of sources; sources and counts are those of all of them."""
    ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, x) for x in (sources, counts)]
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(terms)), terms.cast(pa.binary()), documents, *lists], schema=_LEAVES_SCHEMA)


def _walked(lang: str, trie: Trie) -> Iterator[pa.RecordBatch]:
    for part in batched(trie.walk(), 20_000):
        nodes = [n for _, n in part]
        sources, counts = (pa.array([x for n in nodes for x in of(n.counts)], t) for of, t in ((dict.keys, pa.string()), (dict.values, pa.int64())))
        yield _leaf_batch(lang, pa.array([t for t, _ in part], pa.binary()), pa.array([n.documents for n in nodes], pa.int64()), np.array([len(n.counts) for n in nodes]), sources, counts)


def _into_trie(trie: Trie, lang: str, texts: list[str], sources: list[str]) -> Iterator[pa.RecordBatch]:
    """Count the terms of texts of one language. A term that one of them has is given out as a leaf by itself, the others go into the trie."""
    terms, owner = terms_of(texts)
    if not len(terms):
        return
    coded = terms.dictionary_encode()
    ids, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    names = sorted(set(sources))
    number = {s: k for k, s in enumerate(names)}
    place = np.array([number[s] for s in sources])
    counts = np.bincount(ids * len(names) + place[owner], minlength=len(words) * len(names)).reshape(len(words), len(names))
    pairs = np.sort(owner * len(words) + ids)
    documents = np.bincount(pairs[np.diff(pairs, prepend=-1) != 0] % len(words), minlength=len(words))
    one = np.flatnonzero(documents == 1)
    where = counts[one].argmax(1)
    of_one = pa.array(counts[one, where], pa.int64())
    yield _leaf_batch(lang, words.take(pa.array(one)), pa.array(np.ones(len(one), np.int64)), np.ones(len(one), np.int64), pa.array(names, pa.string()).take(pa.array(where)), of_one)
    more = words.take(pa.array(np.flatnonzero(documents > 1)))
    order = np.flatnonzero(documents > 1)[pc.sort_indices(more).to_numpy()]
    rows, columns = np.nonzero(counts[order])
    pairs = list(zip([names[c] for c in columns.tolist()], counts[order][rows, columns].tolist(), strict=True))
    ends = np.searchsorted(rows, np.arange(len(order) + 1)).tolist()
    trie.merge(words.take(pa.array(order)).to_pylist(), documents[order].tolist(), (pairs[a:b] for a, b in pairwise(ends)))


def _counted(most_leaves: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves of the tries of a task's texts."""
        tries: dict[str, Trie] = defaultdict(Trie)
        for part, texts in text_slices(batches, "text", most_bytes):
            by_lang = defaultdict(lambda: ([], []))
            for text, lang, source in zip(texts, part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True):
                by_lang[lang][0].append(text)
                by_lang[lang][1].append(source)
            for lang, (mine, sources) in by_lang.items():
                yield from _into_trie(tries[lang], lang, mine, sources)
            if sum(t.leaves for t in tries.values()) > most_leaves:
                for lang, trie in tries.items():
                    yield from _walked(lang, trie)
                tries.clear()
        for lang, trie in tries.items():
            yield from _walked(lang, trie)

    return run


def _merged(least_documents: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kept terms of each chunk of leaves, which come in order."""
        trie, lang, last = Trie(), None, None

        def kept() -> list[tuple]:
            rows = [(term, list(n.counts), list(n.counts.values())) for term, n in trie.walk() if n.documents >= least_documents]
            return [(lang, *map(list, zip(*rows, strict=True)))] if rows else []

        for batch in batches:
            out = []
            for in_lang, term, documents, sources, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if in_lang != lang or trie.leaves >= chunk and term != last:
                    out += kept()
                    trie, lang = Trie(), in_lang
                last = term
                trie.merge([term], [documents], [zip(sources, counts, strict=True)])
            yield _batch(out, _KEPT_SCHEMA)
        yield _batch(kept(), _KEPT_SCHEMA)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_LEAVES_SCHEMA = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("documents", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_KEPT_SCHEMA = pa.schema([("lang", pa.string()), ("terms", pa.list_(pa.binary())), ("sources", pa.list_(pa.list_(pa.string()))), ("counts", pa.list_(pa.list_(pa.int64())))])
_FOUND_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def shares(counts: np.ndarray, totals: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), by long division, which stays within 64 bits up to totals of 10^15."""
    left, whole, by = counts + PRIOR, np.zeros_like(counts), totals + PRIOR * kept
    for _ in range(STEPS):
        digit, left = np.divmod(left * 1000, by)
        whole = whole * 1000 + digit
    return whole + 1


def _compared(top: int, tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], tuple[list[str], list[str], np.ndarray]] = {}

        def pairs() -> Iterator[pa.RecordBatch]:
            for (lang, i, j), (left, right, total) in sums.items():
                rows = [(lang, a, "pair", b, v) for a, line in zip(left, total.tolist(), strict=True) for b, v in zip(right, line, strict=True) if a != b]
                if i != j:
                    rows += [(lang, b, "pair", a, v) for lang, a, _, b, v in rows]
                yield _batch(rows, _FOUND_SCHEMA)
            sums.clear()

        for batch in batches:
            for row in batch.to_pylist():
                lang, i, j, kept, n_lang = (row[c] for c in ("lang", "i", "j", "kept", "n_lang"))
                names, totals = [s["source"] for s in row["groups"]], np.array([s["n"] for s in row["groups"]], np.int64)
                sides = []
                for k in {i, j}:
                    mine = slice(k * tile, (k + 1) * tile)
                    place = {s: c for c, s in enumerate(names[mine])}
                    counts = np.zeros((len(row["terms"]), len(place)), np.int64)
                    for r, (sources, ns) in enumerate(zip(row["sources"], row["counts"], strict=True)):
                        for s, n in zip(sources, ns, strict=True):
                            if s in place:
                                counts[r, place[s]] = n
                    sides.append((k, names[mine], counts, shares(counts, totals[mine], kept) if kept else counts))
                by = dict((k, x) for k, *x in sides)
                left, right = by[i], by[j]
                if (lang, i, j) not in sums:
                    if len(sums) == 32:
                        yield from pairs()
                    sums[lang, i, j] = left[0], right[0], np.zeros((len(left[0]), len(right[0])), np.int64)
                total = sums[lang, i, j][2]
                for g in range(len(left[0])):
                    total[g] += np.abs(right[2] - left[2][:, g, None]).sum(axis=0)
                if i == j and row["terms"]:
                    q = shares(np.array([sum(ns) for ns in row["counts"]], np.int64), n_lang, kept)
                    more = np.where(left[1] > 0, left[2] - q[:, None], 0)
                    rows = []
                    for g, name in enumerate(left[0]):
                        best = np.argsort(-more[:, g], kind="stable")[:top]  # terms come in order, so ties stay in it
                        rows += [(lang, name, "term", row["terms"][t].decode("utf-8", "surrogatepass"), int(more[t, g])) for t in best.tolist() if more[t, g] > 0]
                    yield _batch(rows, _FOUND_SCHEMA)
        yield from pairs()

    return run


def source_divergence(spark: SparkSession, docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, most_leaves: int = MOST_LEAVES, chunk: int = CHUNK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value and rank, for every pair of lang and source that occurs.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language keeps those in at least
    ``least_documents`` of its rows. The share of a kept term is 1 + floor(10^9 (count + 5) / (N + 5 V)), N being the counts of all V kept
    terms there. Part ``pair``: each other source of the language and the sum of differences of the shares of all kept
    terms. Part ``term``: the ``top`` terms of the source whose shares exceed the language's most. Ranks from 1 by falling value, then
    by the bytes of the item.

    A null text, lang or source is an empty one. Rows without terms count as groups; where a language keeps none, its pairs have
    value 0. Rows that repeat an id or a text are rows like others. A text of any length is split as a whole in one task. An empty
    table gives no rows. Other columns are ignored. ``most_leaves``, ``chunk`` and ``tile`` change what is held at once, not the result. Lists of the sources of one language are held in one row, as the result has a row for each two of them.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    leaves = written(spark, rows.mapInArrow(_counted(most_leaves, MOST_BYTES if most_leaves >= MOST_LEAVES else 200), _LEAVES), "divergence-leaves")
    # Most terms are rare; rows of these go before the tries of a range are merged. The window has the partitioning and order of the ranges.
    ranges = leaves.repartitionByRange("lang", "term").withColumn("in_all", F.sum("documents").over(Window.partitionBy("lang", "term")))
    ranges = ranges.where(F.col("in_all") >= least_documents).drop("in_all").sortWithinPartitions("lang", "term")
    kept = written(spark, ranges.mapInArrow(_merged(least_documents, chunk), _KEPT), "divergence-kept")

    counts = kept.select("lang", F.explode(F.arrays_zip(F.flatten("sources").alias("source"), F.flatten("counts").alias("n"))).alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    groups = rows.select("lang", "source").distinct().join(counts, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0)).alias("n")).alias("g"))
    terms = kept.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"))
    langs = groups.groupBy("lang").agg(F.array_sort(F.collect_list("g")).alias("groups"), F.sum("g.n").alias("n_lang"))
    langs = written(spark, langs.join(terms, "lang", "left").na.fill(0, ["kept"]), "divergence-langs")

    # A chunk without terms stands for each language, so that all have pairs.
    chunks = kept.unionByName(langs.select("lang", *[F.array().cast(kept.schema[c].dataType).alias(c) for c in ("terms", "sources", "counts")]))
    tiles = F.sequence(F.lit(0), F.floor((F.size("groups") - 1) / tile))
    work = chunks.join(small_or_plain(langs, langs.count()), "lang").withColumn("i", F.explode(tiles)).withColumn("j", F.explode(tiles)).where("i <= j")
    found = work.mapInArrow(_compared(top, tile), _FOUND)
    found = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", place).where((F.col("part") == "pair") | (F.col("rank") <= top))


_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE = f"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), '{_ASCII}', '{_ASCII.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ws
  from documents),
w as (select r, lang, source, unnest(ws) as term from d),
kept as (select lang, term from w group by lang, term having count(distinct r) >= {LEAST_DOCUMENTS}),
counts as (select lang, source, term, count(*) as c from w semi join kept using (lang, term) group by lang, source, term),
groups as (select distinct lang, source from d),
v as (select lang, count(*) as v from kept group by lang),
ns as (select g.lang, g.source, coalesce(sum(c), 0) as n from groups g left join counts using (lang, source) group by g.lang, g.source),
p as (
  select g.lang, g.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 5)) // (g.n::hugeint + 5 * v.v) as p
  from ns g join kept k using (lang) join v using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (
  select lang, term, 1 + (1000000000::hugeint * (sum(c) + 5)) // ((select sum(n) from ns where ns.lang = counts.lang)::hugeint + 5 * (select v from v where v.lang = counts.lang)) as q
  from counts group by lang, term),
pairs as (
  select a.lang, a.source, b.source as item, coalesce((select sum(abs(x.p - y.p)) from p x join p y using (lang, term) where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source),
terms as (select p.lang, p.source, p.term as item, p.p - q.q as value from p join q using (lang, term) where p.c > 0 and p.p > q.q),
ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from terms)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= {TOP}
"""
