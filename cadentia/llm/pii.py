"""Personal data: fixed patterns, and what a linear-chain conditional random field finds beyond them.

Patterns give e-mail addresses, network addresses, card and telephone numbers in their usual form. Other forms (numbers as they are
written inside a country, addresses spelled to avoid patterns) are left to the field: it labels the words around every
chain of digits, at sign or spelled dot by their shapes, neighbours and gaps. It is trained in numpy from a small
labelled table and decoded by Viterbi over many contexts at once. What it labels counts only if it could be of its kind (digits, checksum, parts).
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.llm.common import text_slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# Patterns of the fixed part. Chains are matched whole and judged afterwards, which takes time linear in the text.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def _is_byte(part: str) -> bool:
    kept = part.lstrip("0")
    return len(kept) <= 3 and int(kept or "0") <= 255


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def _addresses(text: str) -> Iterator[Span]:
    """Numbers in a chain of dots are taken by four; what is left over is none."""
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(map(_is_byte, four)):
                yield "ip", at, at + size
            at += size + 1


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            yield "card", *m.span()


def _phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                yield "phone", *m.span()


def pattern_spans(text: str) -> list[Span]:
    """Kind, start and end (in code points, end exclusive) of what the patterns find, by kind, then start."""
    return [s for find in (_emails, _addresses, _cards, _phones) for s in find(text)]


# Contexts and shapes.

#: Characters on either side of an anchor that the field sees, and words of one sequence.
REACH, LONGEST = 64, 128
_ANCHOR = re.compile(r"[0-9](?:[^\w\n]{0,3}[0-9]){6,}|[0-9](?:\s?[\[(]\s?(?:\.|[Dd][Oo][Tt])\s?[\])]\s?[0-9]){1,}|@|[\[(]\s?(?:[Aa][Tt]|arroba)\s?[\])]|\b[Dd][Oo][Tt]\b")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
# Words that matter as such; all others count by their case and length.
_KNOWN_WORDS = frozenset(
    "at dot arroba punkt punto point com org net edu de fr es uk tel telephone phone call fax mobile cell ring dial reach text mail email contact write card visa mastercard amex credit paid ip address host server ping gateway"
    " isbn order version invoice date id ref no nr number page pages section figure on from to in since of build serial total price sku account telefon rufnummer handy anrufen karte rechnung am telefono teléfono movil móvil llame"
    " tarjeta pedido fecha téléphone portable appelez carte commande facture le und and et y or oder ou".split()
)


@cache
def shape(token: str) -> str:
    first = token[0]
    if first.isascii() and first.isdigit():
        return f"d{min(len(token), 20)}"
    if first.isalpha():
        if (low := token.lower()) in _KNOWN_WORDS:
            return "w" + low
        case = "x" if token.islower() else "X" if token.isupper() else "Xx" if token.istitle() else "xX"
        return case + str(min(len(token), 4))
    return first if first.isascii() else "?"


class Sequence(NamedTuple):
    """Words of a context: shapes, what stands before each (0 nothing, 1 blanks, 2 a line end), and where they are in the text."""

    shapes: list[str]
    gaps: list[int]
    places: list[tuple[int, int]]


def _sequences(text: str, start: int, end: int) -> Iterator[Sequence]:
    shapes, gaps, places, last = [], [], [], start
    for m in _TOKEN.finditer(text, start, end):
        if len(shapes) == LONGEST:
            yield Sequence(shapes, gaps, places)
            shapes, gaps, places = [], [], []
        shapes.append(shape(m.group()) if m.end() - m.start() < 40 else "x4")
        between = text[last : m.start()]
        gaps.append(0 if not between else 2 if "\n" in between else 1)
        places.append(m.span())
        last = m.end()
    if shapes:
        yield Sequence(shapes, gaps, places)


def contexts(text: str, known: list[Span]) -> Iterator[Sequence]:
    """Sequences of words around all anchors that are not inside spans known already; contexts that touch are one."""
    taken = sorted((s, e) for _, s, e in known)
    k, start, end = 0, 0, -1
    for m in _ANCHOR.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] <= m.start() and m.end() <= taken[k][1]:
            continue
        if m.start() - REACH > end:
            if end > 0:
                yield from _sequences(text, start, end)
            start = max(0, m.start() - REACH)
        end = min(len(text), m.end() + REACH)
    if end > 0:
        yield from _sequences(text, start, end)


# The field. Tag 0 is outside; each kind has one tag for its first word and one for the others.

TAGS = 1 + 2 * len(KINDS)
OFFSETS = (-2, -1, 0, 1, 2)
_NEVER = -1e4


def _forbidden() -> np.ndarray:
    """What is added to transitions: a kind's later words come only after words of the kind."""
    out = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = _NEVER
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return out


class Field(NamedTuple):
    shapes: dict[str, int]  # from 1; 0 is none or never seen
    pairs: np.ndarray  # index of a pair of shapes in ``by_pair``; 0 is never seen
    by_shape: np.ndarray  # offset, shape, tag
    by_pair: np.ndarray  # with the word before or the next, pair, tag
    by_gap: np.ndarray  # gaps before and after, tag
    steps: np.ndarray  # tag, next tag


class Batch(NamedTuple):
    shapes: np.ndarray  # sequence, word; 0 beyond the end
    gaps: np.ndarray
    sizes: np.ndarray


def _batch(shapes: dict[str, int], sequences: list[Sequence]) -> Batch:
    longest = max(len(s.shapes) for s in sequences)
    ids, gaps = np.zeros((2, len(sequences), longest), np.int32)
    for k, s in enumerate(sequences):
        ids[k, : len(s.shapes)] = [shapes.get(x, 0) for x in s.shapes]
        gaps[k, : len(s.gaps)] = s.gaps
    return Batch(ids, gaps, np.array([len(s.shapes) for s in sequences]))


def _features(pairs: np.ndarray, b: Batch) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Rows of the weight tables that each word adds up: by offset, by neighbour, and by gaps."""
    around = np.pad(b.shapes, ((0, 0), (2, 2)))
    at = [around[:, 2 + o : around.shape[1] - 2 + o] for o in OFFSETS]
    after = np.pad(b.gaps, ((0, 0), (0, 1)))[:, 1:]
    return at, [pairs[at[1], at[2]], pairs[at[2], at[3]]], b.gaps * 3 + after


def _scores(f: Field, b: Batch) -> np.ndarray:
    at, near, gaps = _features(f.pairs, b)
    return sum(f.by_shape[k][x] for k, x in enumerate(at)) + sum(f.by_pair[k][x] for k, x in enumerate(near)) + f.by_gap[gaps]


def decode(f: Field, sequences: list[Sequence]) -> list[np.ndarray]:
    """The best tags of each sequence by Viterbi, all sequences of a batch word by word."""
    b = _batch(f.shapes, sequences)
    scores, steps = _scores(f, b), f.steps + _forbidden()
    first = scores[:, 0] + np.where(np.arange(TAGS) % 2 == 0, _NEVER, 0) * (np.arange(TAGS) > 0)
    best, came = first, []
    for t in range(1, scores.shape[1]):
        through = best[:, :, None] + steps
        came.append(through.argmax(1))
        inside = (t < b.sizes)[:, None]
        best = np.where(inside, through.max(1) + scores[:, t], best)
    tags = np.zeros(b.shapes.shape, np.int64)
    now = best.argmax(1)
    for t in range(scores.shape[1] - 1, -1, -1):
        tags[:, t] = now
        if t:
            now = np.where(t < b.sizes, np.take_along_axis(came[t - 1], now[:, None], 1)[:, 0], now)
    return [tags[k, :n] for k, n in enumerate(b.sizes.tolist())]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(table: Iterable[tuple[str, list[Span]]], rounds: int = 80, rate: float = 0.15, decay: float = 2e-3) -> Field:
    """Weights of largest penalised likelihood over labelled texts, by forward and backward sums and adaptive steps."""
    sequences, gold = [], []
    for text, spans in table:
        for s in _sequences(text, 0, len(text)):
            tags = np.zeros(len(s.places), np.int64)
            for kind, start, end in spans:
                inside = [i for i, (a, b) in enumerate(s.places) if start <= a and b <= end]
                tags[inside] = 2 + 2 * KINDS.index(kind)
                tags[inside[:1]] -= 1
            sequences.append(s)
            gold.append(tags)
    shapes = {x: k for k, x in enumerate(sorted({x for s in sequences for x in s.shapes}), 1)}
    b = _batch(shapes, sequences)
    seen = {(x, y) for row in b.shapes.tolist() for x, y in zip([0, *row], [*row, 0], strict=True)}
    pairs = np.zeros((len(shapes) + 1,) * 2, np.int32)
    for k, (x, y) in enumerate(sorted(seen), 1):
        pairs[x, y] = k
    truth = np.zeros(b.shapes.shape, np.int64)
    for k, tags in enumerate(gold):
        truth[k, : len(tags)] = tags
    n, longest = b.shapes.shape
    weights = [np.zeros((len(OFFSETS), len(shapes) + 1, TAGS)), np.zeros((2, len(seen) + 1, TAGS)), np.zeros((9, TAGS)), np.zeros((TAGS, TAGS))]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    inside = np.arange(longest) < b.sizes[:, None]
    at, near, gaps = _features(pairs, b)
    forbidden, no_start = _forbidden(), np.where((np.arange(TAGS) > 0) & (np.arange(TAGS) % 2 == 0), _NEVER, 0.0)
    onehot = np.eye(TAGS)[truth] * inside[:, :, None]
    both = inside[:, 1:]
    true_steps = np.zeros((TAGS, TAGS))
    np.add.at(true_steps, (truth[:, :-1][both], truth[:, 1:][both]), 1)
    for step in range(1, rounds + 1):
        f = Field(shapes, pairs, *weights)
        scores, steps = _scores(f, b), weights[3] + forbidden
        ahead = np.zeros((longest, n, TAGS))
        ahead[0] = scores[:, 0] + no_start
        for t in range(1, longest):
            ahead[t] = np.where(inside[:, t, None], _logsum(ahead[t - 1][:, :, None] + steps, 1) + scores[:, t], ahead[t - 1])
        total = _logsum(ahead[-1], 1)
        back = np.zeros((longest, n, TAGS))
        expected_steps = np.zeros((TAGS, TAGS))
        for t in range(longest - 1, 0, -1):
            coming = back[t] + scores[:, t]
            joint = ahead[t - 1][:, :, None] + steps + coming[:, None, :] - total[:, None, None]
            expected_steps += (np.exp(np.minimum(joint, 0)) * inside[:, t, None, None]).sum(0)
            back[t - 1] = np.where(inside[:, t, None], _logsum(steps + coming[:, None, :], 2), back[t])
        shares = np.exp(np.minimum(ahead + back - total[:, None], 0)).transpose(1, 0, 2) * inside[:, :, None]
        wrong = shares - onehot
        slopes = [np.zeros_like(w) for w in weights]
        for k, x in enumerate(at):
            np.add.at(slopes[0][k], x, wrong)
        for k, x in enumerate(near):
            np.add.at(slopes[1][k], x, wrong)
        np.add.at(slopes[2], gaps, wrong)
        slopes[3] = expected_steps - true_steps
        for w, slope, (mean, square) in zip(weights, slopes, moments, strict=True):
            slope = slope / n + decay * w
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope * slope - square)
            w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights[0][:, 0] = 0  # none and never seen say nothing
        weights[1][:, 0] = 0
    return Field(shapes, pairs, *weights)


# What a labelled span must look like to count.

_NUMBER_CHAIN = re.compile(r"[0-9+(][\x20().0-9/-]*[0-9]\Z")
_BEFORE, _AFTER = re.compile(r"[\w+@#/][.,-]?\Z|[0-9][\x20.-]?\Z"), re.compile(r"[\w@#]|[.,:/-]\w|[\x20][0-9]")
_SPELLED = re.compile(r"[\w.%+-]+\s?(?:@|[\[({<]\s?(?:at|@|arroba)\s?[\])}>]|\s(?:at|arroba)\s)\s?[\w-]+(?:\s?(?:\.|[\[({<]\s?(?:dot|\.|punkt|punto|point)\s?[\])}>]|\s(?:dot|punkt|punto|point)\s)\s?[\w-]+)+\Z", re.IGNORECASE)


def plausible(text: str, kind: str, start: int, end: int) -> bool:
    """Whether a labelled span could be of its kind: enough digits, the checksum, four bytes, or an at and a dot; and whether it ends where it does."""
    shown = text[start:end]
    if "\n" in shown or end - start > 200 or _AFTER.match(text, end, end + 2) or _BEFORE.search(text[max(0, start - 2) : start]):
        return False
    digits = _NOT_DIGIT.sub("", shown) if kind != "email" else ""
    if kind == "phone":
        return 7 <= len(digits) <= 15 and bool(_NUMBER_CHAIN.match(shown))
    if kind == "card":
        return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", shown)
        return len(parts) == 4 and all(map(_is_byte, parts))
    return bool(_SPELLED.match(shown))


def field_spans(f: Field, texts: list[str], known: list[list[Span]], at_once: int = 4096) -> list[list[Span]]:
    """What the field adds to the spans known of each text; nothing that touches these."""
    jobs = [(k, s) for k, text in enumerate(texts) for s in contexts(text, known[k])]
    jobs.sort(key=lambda job: len(job[1].shapes))  # sequences of about one length together
    found: list[list[Span]] = [[] for _ in texts]
    for first in range(0, len(jobs), at_once):
        part = jobs[first : first + at_once]
        for (k, s), tags in zip(part, decode(f, [s for _, s in part]), strict=True):
            for i in np.flatnonzero(tags % 2).tolist():  # first words
                j = i + 1
                while j < len(tags) and tags[j] == tags[i] + 1:
                    j += 1
                kind, start, end = KINDS[tags[i] // 2], s.places[i][0], s.places[j - 1][1]
                if not any(a < end and start < b for _, a, b in known[k]) and plausible(texts[k], kind, start, end):
                    found[k].append((kind, start, end))
    return [sorted(set(x), key=lambda s: (KINDS.index(s[0]), s[1])) for x in found]


# The labelled table: contexts and forms, combined by a rule. '#' is a digit, '{}' the data.

_LEADS = {
    "phone": ["Call {} today", "tel. {}", "phone: {}", "my number is {} now", "Rufen Sie {} an", "Telefon {}", "téléphone {} .", "appelez le {} vite", "llame al {} hoy", "teléfono: {}", "Fax {}", "or text {}, please", "the office ( {} ) is open", "mobile {}"],
    "card": ["card {} expires", "paid with {} today", "Visa {}", "Karte {} gültig", "tarjeta {} .", "carte {} ,", "amex: {}", "my credit card number {} please"],
    "ip": ["host {} is down", "ping {} now", "from {} to", "Server {} antwortet", "the address {} was seen", "IP: {}"],
    "email": ["write to {} please", "mail: {}", "contact {} for help", "E-Mail {}", "escriba a {} hoy", "écrivez à {} .", "or {}"],
    "": ["on {} we met", "version {} is out", "order {} was sent", "ISBN {}", "Rechnung {} vom", "page {} of", "since {} the", "pedido {} .", "commande {} du", "id {}", "total: {} paid", "section {} says", "= {} ;", "the {} things", "the values are {} here"],
}
_FORMS = {
    "phone": ["(###) ###-####", "###-###-####", "### ### ####", "###.###.####", "###-####", "0### #######", "0##/#######", "0## ## ## ## ##", "(0##) ########", "0#### ######", "0###-#######", "## ## ## ## ##", "1-800-###-####", "(###) #######", "0##########"],
    "card": ["#### ###### #####", "####.####.####.####", "####/####/####/####", "###############"],
    "ip": ["##[.]##[.]#[.]##", "1##(.)##(.)#(.)#", "##[dot]#[dot]#[dot]1##", "1## . 1## . # . ##"],
    "email": ["anna (at) shop (dot) org", "jo.berg [at] mail [dot] com", "kim at firm dot com", "max.m@ site . de", "ana [at] correo (punto) es", "luc(at)poste(dot)fr", "eva AT uni DOT edu", "tom @ host.org", "b##[at]web[dot]net", "info (arroba) casa.es"],
    "": ["####-##-##", "##.##.####", "##/##/####", "##:##:##", "####-##-## ##:##", "#.##.#", "978-#-##-######-#", "978##########", "########", "#########", "#,###,###", "#.###.###,##", "1990-1995 and 2001-2004", "3.14159265", "17########", "17###########", "A#######", "## 23 45 12 9 8 10", "#########-##########-###", "dot by dot", "polka dot dress", "user@host", "look @ this . now", "####,####,####,####", "####################", "12 (##) 34 (##) 567"],
}


def labelled_table(each: int = 6, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Texts and their spans: every form in ``each`` contexts of its kind, with random digits; cards have a checksum that fits."""
    rng = random.Random(seed)
    rows = []
    for kind, forms in _FORMS.items():
        for form in forms:
            for _ in range(each):
                data = re.sub("#", lambda _: rng.choice("0123456789"), form)
                while kind == "card" and not luhn(_NOT_DIGIT.sub("", data)):
                    data = re.sub("#", lambda _: rng.choice("0123456789"), form)
                before, after = rng.choice(_LEADS[kind]).split("{}")
                # Half of the rows have no cue, as data often stand in running text.
                if kind and rng.random() < 0.5:
                    before, after = rng.choice([("of the and ", " in the rest."), ("La maison est ", " et la"), ("Das ist ", ". Und so"), ("que los ", " de la casa"), ("", "")])
                rows.append((before + data + after, [(kind, len(before), len(before) + len(data))] if kind else []))
    return rows


@cache
def default_field() -> Field:
    return train(labelled_table())


SPANS = "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end, base) of every row, by kind (email, ip, card, phone), then start; places in code points, end exclusive.

    Base spans are those of the patterns, of which some of different kinds may overlap; the others are added by the field and touch none of
    these. A null text is an empty one, which has no spans. Texts of any length are taken whole, each in one
    task; the field cuts contexts of more than ``LONGEST`` words. A row that repeats an id or a text is a row like others; a null id stays null.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    model = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text", 1 << 21):
            texts = [t or "" for t in texts]
            base = [pattern_spans(t) for t in texts]
            added = field_spans(model, texts, base)
            rows = [sorted([(*s, True) for s in b] + [(*s, False) for s in a], key=lambda s: (KINDS.index(s[0]), s[1])) for b, a in zip(base, added, strict=True)]
            spans = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in r] for r in rows]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPANS)


def span_digests(found: DataFrame) -> DataFrame:
    """doc_id, how many base spans there are of each kind, a digest of them, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", "spans", base.alias("base")).select("doc_id", *map(of, KINDS), F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))
