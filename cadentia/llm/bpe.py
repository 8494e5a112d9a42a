"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that its encoding ends with. An automaton over the
vocabulary gives all tokens that are suffixes of each prefix; the right one is the one that is compatible
with the last token of the prefix before it, meaning that no merge would cross their border. The last
tokens, followed back from the end of the piece, are the exact ids.

Why pairs are enough: merges run in the order of their rank, and a merge always has a higher rank than
those that made its parts. While two neighbouring tokens are built up, what touches the border goes up the
right edge of the one's merge tree and the left edge of the other's. A merge crosses the border if and only
if its two parts touch the border at one time and it comes before either is used up.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cadentia.llm.common import text_slices

# Code points that the regex module counts as letters or numbers and Unicode 16 does not.
SINCE_UNICODE_16 = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
_NEW = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SINCE_UNICODE_16)
_L, _N = rf"[\p{{L}}--[{_NEW}]]", rf"[\p{{N}}--[{_NEW}]]"
#: Pieces of a text that tokens never cross.
PIECE = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{_L}+| ?{_N}+| ?[[^\s\p{{L}}\p{{N}}]||[{_NEW}]]+|\s+(?!\S)|\s+")
#: A blank where a text can be cut without changing its pieces.
_CUT = regex.compile(r"(?<=\S) (?=\S)")
_SPACES = [chr(c) for c in (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_ASCII_RUNS = [p for s in _SPACES if ord(s) < 128 for p in (s + " ", " " + s)]
_ALL_RUNS = [p for s in _SPACES for p in (s + " ", " " + s)]
_NEVER = 1 << 60
#: Words, and other pieces and chunks, remembered in each of two generations, the longest of them, and pairs of tokens remembered.
WORDS, OTHERS, LONGEST, PAIRS = 150_000, 20_000, 48, 150_000
#: A word that is one piece with the blank before it, and characters that are a piece of their own after such a word.
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_MARKS = frozenset(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Memory(dict):
    """Values used lately: when the newer generation is full, the older one is dropped."""

    def __init__(self, find, most: int):
        self.find, self.most, self.older = find, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class _Chunks(_Memory):
    """Ids of what stands after a blank, that blank included. Words are remembered here, other chunks with the tokenizer."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__(lambda word: tokenizer.encode_piece(" " + word), WORDS)
        self.tokenizer = tokenizer

    def __missing__(self, chunk: str) -> bytes:
        word = chunk[:-1]
        if chunk[-1:] in _MARKS and _WORD(word) and len(word) <= LONGEST:
            return self[word] + self.tokenizer.others[chunk[-1]]
        if _WORD(chunk) and len(chunk) <= LONGEST:
            return super().__missing__(chunk)
        return self.tokenizer.encode_chunk(" " + chunk)


class Tokenizer:
    """A byte-level BPE tokenizer read from a tokenizers JSON file without a normalizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        pre = data["pre_tokenizer"]
        if data.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only plain byte-level tokenizers can be read")
        model = data["model"]
        byte_of = _byte_of_char()
        vocab = {token: i for token, i in model["vocab"].items() if all(c in byte_of for c in token)}
        self.added = {a["content"]: a["id"] for a in data["added_tokens"]}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in data["added_tokens"]):
            raise ValueError("added tokens that take blanks or word borders into account can't be read")
        self.tokens: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.tokens[i] = bytes(byte_of[c] for c in token)
        for content, i in self.added.items():
            self.tokens[i] = content.encode()
        self._added_split = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        #: Rank of the merge of a pair, by left id * 2**20 + right id; parts of each merged token; rank of the merge that made it.
        self.rank: dict[int, int] = {}
        parts: dict[int, tuple[int, int]] = {}
        made: dict[int, int] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.rank[a << 20 | b] = r
            if c not in parts:
                parts[c], made[c] = (a, b), r
        self._parts, self._made = parts, made
        #: Edges of merge trees, of tokens that have been tested: at most two for each token.
        self._edges: tuple[dict[int, list[tuple[int, int]]], ...] = {}, {}
        sound: dict[int, bool] = {}
        for i in sorted(vocab.values(), key=lambda i: made.get(i, -1)):
            if i in parts:
                a, b = parts[i]
                sound[i] = sound[a] and sound[b] and self._first_crossing(a, b) == (a, b)
            else:
                sound[i] = len(self.tokens[i]) == 1
        for edges in self._edges:
            edges.clear()
        self._compatible = _Memory(self._fit, PAIRS)
        self.automaton = ahocorasick.Automaton()
        for i, whole in sound.items():
            if whole:
                self.automaton.add_word(self.tokens[i].decode("latin-1"), (len(self.tokens[i]), i))
        self.automaton.make_automaton()
        #: Ids of short pieces other than words after a blank, and of words after one.
        self.others = _Memory(self.encode_piece, OTHERS)
        self._later = _Chunks(self)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The left (0) or right (1) edge of a token's merge tree from the byte up: tokens, and the rank at which each is used up."""
        known = self._edges[side].get(token)
        if known is None:
            out, at = [(token, _NEVER)], token
            while at in self._parts:
                used, at = self._made[at], self._parts[at][side]
                out.append((at, used))
            known = self._edges[side][token] = out[::-1]
        return known

    def _fit(self, pair: int) -> bool:
        """Whether no merge crosses the border of two tokens, given as left id * 2**20 + right id."""
        return self._first_crossing(pair >> 20, pair & 0xFFFFF) is None

    def _first_crossing(self, a: int, b: int) -> tuple[int, int] | None:
        """The first pair merged across the border of a and b when both are spelt out in bytes, or None."""
        lefts, rights, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        while True:
            (x, x_used), (y, y_used) = lefts[i], rights[j]
            r = self.rank.get(x << 20 | y)
            # Equal ranks are one merge at two places, done from left to right.
            if r is not None and r < x_used and r <= y_used:
                return x, y
            if x_used == y_used == _NEVER:
                return None
            if x_used <= y_used:
                i += 1
            else:
                j += 1

    def encode_piece(self, text: str) -> bytes:
        """Ids of one piece: the last token of every prefix, and the way back through them."""
        piece = text.encode("utf-8", "surrogatepass")
        last, back = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        fits, open_ = self._compatible, 1
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if end < open_:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0 or not fits[before << 20 | token]:
                    continue
            last[end], back[end], open_ = token, start, end + 1
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        return np.array(ids, "<u4").tobytes()

    def encode_chunk(self, chunk: str) -> bytes:
        out = []
        for piece in PIECE.findall(chunk):
            if len(piece) > LONGEST:
                out.append(self.encode_piece(piece))
            elif piece[0] == " " and _WORD(piece[1:]):
                out.append(self._later[piece[1:]])
            else:
                out.append(self.others[piece])
        return b"".join(out)

    def _encode_plain(self, text: str) -> bytes:
        runs = any(run in text for run in (_ASCII_RUNS if text.isascii() else _ALL_RUNS))
        first, *later = _CUT.split(text) if runs else text.split(" ")
        return self.encode_chunk(first) + b"".join(map(self._later.__getitem__, later))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        if self._added_split and any(a in text for a in self.added):
            parts = (np.array([self.added[p]], "<u4").tobytes() if p in self.added else self._encode_plain(p) for p in self._added_split.split(text) if p)
            return np.frombuffer(b"".join(parts), "<u4")
        return np.frombuffer(self._encode_plain(text), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, read once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """The rows of ``docs`` with ``ids array<int>`` in place of ``text``. A null text is encoded as an empty one: no ids."""
    kept = [c for c in docs.columns if c not in ("text", "ids")]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            ids = pa.array([t.encode(x.as_py() or "").astype(np.int32) for x in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], ids], names=[*kept, "ids"])

    return docs.select(*kept, "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with ``text`` in place of ``ids``; null ids give a null text, and bytes that are no UTF-8 the replacement character."""
    kept = [c for c in encoded.columns if c not in ("text", "ids")]
    schema = T.StructType([*[encoded.schema[c] for c in kept], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            texts = pa.array([None if x is None else t.decode(x) for x in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], texts], names=[*kept, "text"])

    return encoded.select(*kept, "ids").mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode every text and decode its ids again: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids array<int> if asked for.

    A null text counts as empty: no ids, and the digests of nothing. Very long texts are encoded whole. Doc_ids and repeated
    rows are passed through, of which those that follow each other are encoded once; other columns are ignored.
    An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, last, found = tokenizer(path), None, ()
        for part, texts in text_slices(batches, "text", 1 << 20):
            rows = []
            for text in texts:
                if text is None or text != last:
                    ids = t.encode(text or "")
                    decoded = t.decode(ids.tolist()).encode("utf-8", "surrogatepass")
                    last, found = text, (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids)
                rows.append(found)
            counts, ids_digests, text_digests, ids = zip(*rows, strict=True)
            out = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
