"""Personal data by weak supervision.

1. Every whole text is read once. Base spans (email, ip, card, phone by fixed rules) and further candidates by looser rules get
   the votes of six labelers (1 yes, -1 no, 0 no opinion): format, check and range rules by regular expressions; gazetteers
   of top-level domains, issuer prefixes, calling codes and reserved networks; words in the context for and against; boundary.
2. Expectation-maximisation over the counts of the vote patterns (all candidates of all documents; at most 3**6 patterns a kind)
   estimates the reliability of each labeler for each kind, without labels, and so a probability for each pattern.
3. A span classifier (logistic regression over votes, kind, length, shape and hashed context) learns these probabilities from
   at most ``SAMPLE`` candidates of either sort, those of the least hash; it sees what no labeler says. It decides on the further candidates;
   base spans always stay.

A null text counts as empty. Offsets are code points, ends exclusive. Rows that repeat are each judged; rows may have any other
columns, which aren't read; an empty table gives an empty one. All patterns run in time proportional to the text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 20_000  # the most candidates, of base and of further ones each, that the classifier is fitted on
LABELERS = 6
CONTEXT = 48

#: Pseudo-counts of the votes -1, 0, 1 of any labeler, given no and given yes; and the most that a labeler's no may be wrong:
#: the arithmetic checks hardly ever are. Without such an anchor the classes could swap or merge where most candidates agree.
PRIOR = np.array([[6.0, 6.0, 6.0], [1.0, 6.0, 13.0]])
WRONG_NO = np.array([0.3, 0.01, 0.3, 1.0, 0.3, 0.3])

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: Further candidates, each of bounded length.
_FURTHER = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]{2,63}){1,4}")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    ("card", re.compile(r"(?<![0-9A-Za-z.])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([ -]?)[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+])(?:\+?[0-9]{1,3}[ .-])?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[.-])[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9A-Za-z-])")),
)

# Gazetteers and context words.
TLDS = frozenset("com org net edu gov mil int io info biz dev app ai co me uk de fr es it nl at ch be pt se no dk fi pl cz ru ua us ca mx br ar cl au nz jp cn kr in eu".split())
RESERVED = frozenset("0 10 127 224 225 239 240 255".split())
CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "380", "420", "971", "972")
FOR = {
    "email": re.compile(r"\b(?:e-?mail|mail|correo|courriel|contact|contacto|kontakt|write|reply|address)", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|servidor|serveur|client|login|logged|address|connect|from)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte|payment|paid|pay)", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telefon|téléphone|teléfono|call|fax|mobile|cell|dial|sms|whatsapp|contact)", re.I),
}
AGAINST = re.compile(r"\b(?:version|v|ver|isbn|issn|section|chapter|fig|figure|token|sha|hash|commit|uuid|serial|order|invoice|page|doi|build|release|port|date)\b[^A-Za-z]{0,4}$", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As a leftmost search would, but from each @ outwards, so no start is tried twice."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Of each kind, the spans that the fixed rules find."""
    out = [list(_emails(text)), [], [], []]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
                out[1].append(m.span())
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
                out[2].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_digits(m.group())) <= 15:
                    out[3].append(m.span())
    return out


def further_spans(text: str, base: list[list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of candidates by the looser rules that touch no base span and none before them."""
    taken = sorted(x for spans in base for x in spans)
    out: list[tuple[int, int, int]] = []
    low = None
    for k, (_, pattern) in enumerate(_FURTHER):
        if k == 0:
            low = low or text.lower()
            if "at" not in low or not any(x in text for x in ("(at)", "[at]", "{at}")):
                continue
        elif not _DIGIT.search(text) or (k == 1 and ":" not in text):
            continue
        for m in pattern.finditer(text):
            out.append((k, *m.span()))
    if not out:
        return out
    kept, at, end = [], 0, 0
    for k, a, b in sorted(out, key=lambda s: (s[1], -s[2], s[0])):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= end and all(x >= b or y <= a for x, y in taken[max(0, at - 4) : at + 4]):
            kept.append((k, a, b))
            end = b
    return sorted(kept)


def votes(kind: int, text: str, a: int, b: int) -> list[int]:
    s = text[a:b]
    before, after = text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    digits = _digits(s)
    if kind == 0:
        parts = re.split(r"@|\(at\)|\[at\]|\{at\}", s)
        last = re.split(r"[^A-Za-z0-9-]+", s)[-1].lower()
        form = 1 if len(parts) == 2 and last.isalpha() and len(last) >= 2 and "--" not in s and ".." not in s else -1
        check = 1 if "@" in s else 0
        known = 1 if last in TLDS else -1
    elif kind == 1:
        quad = s.split(".")
        form = 1 if s.count(":") == 7 or (len(quad) == 4 and all(x == str(int(x[-4:])) for x in quad)) else -1
        check = -1 if re.match(r"[.\w]", after[:1]) and after[1:2].isdigit() or before[-1:] == "." else 1
        known = -1 if quad[0] in RESERVED else 1
    elif kind == 2:
        form = 1 if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}", s) else -1
        check = 1 if _luhn(digits) and len(set(digits)) > 1 else -1
        known = 1 if re.match(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35", digits) else -1
    else:
        form = 1 if re.fullmatch(r"(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}", s) else -1
        check = 1 if 10 <= len(digits) <= 13 else -1
        known = (1 if digits.startswith(CODES) else -1) if s[0] == "+" else 0
    context = 1 if FOR[KINDS[kind]].search(before) or FOR[KINDS[kind]].search(after[:16]) else 0
    against = -1 if AGAINST.search(before) else 0
    edge = 1 if not re.match(r"\w", after) and not re.search(r"[\w]$", before) else -1
    return [form, check, known, context, against, edge]


_VOTE, _LENGTH, _SHAPE = 4 + 4 * LABELERS * 3, 4 * 8, 64
SIZE = 1 + _VOTE + _LENGTH + 3 * _SHAPE


def features(kind: int, given: list[int], text: str, a: int, b: int) -> list[int]:
    """The places of the ones in a span's feature vector."""
    near = lambda words: zlib.crc32(words[0].lower().encode()) % _SHAPE if words else 0
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", text[a:b][:40])))
    at = 1 + _VOTE + _LENGTH
    return [
        0,
        1 + kind,
        *[5 + (kind * LABELERS + j) * 3 + v + 1 for j, v in enumerate(given)],
        1 + _VOTE + kind * 8 + min(7, (b - a) // 4),
        at + zlib.crc32(f"{kind}{shape}".encode()) % _SHAPE,
        at + _SHAPE + near(re.findall(r"\w+", text[max(0, a - CONTEXT) : a])[-1:]),
        at + 2 * _SHAPE + near(re.findall(r"\w+", text[b : b + CONTEXT])[:1]),
    ]


def _key(kind: int, given: list[int]) -> int:
    for v in given:
        kind = kind * 3 + v + 1
    return kind


def _votes_of(key: int) -> tuple[int, list[int]]:
    out = []
    for _ in range(LABELERS):
        key, v = divmod(key, 3)
        out.append(v)
    return key, out[::-1]


_SPAN = "struct<kind:int,start:int,stop:int,pattern:int,ones:array<int>>"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, more): arrays of the spans of each document, with the pattern of votes and the features."""
    rows = docs.select("doc_id", docs["text"].cast("string").alias("_text"))

    def described(text: str, kind: int, a: int, b: int) -> dict:
        v = votes(kind, text, a, b)
        return {"kind": kind, "start": a, "stop": b, "pattern": _key(kind, v), "ones": features(kind, v, text, a, b)}

    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("pattern", pa.int32()), ("ones", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                base, more = [], []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    found = base_spans(text)
                    base.append([described(text, k, a, b) for k in range(4) for a, b in found[k]])
                    more.append([described(text, *s) for s in further_spans(text, found)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, kind), pa.array(more, kind)], names=["doc_id", "base", "more"])

    of = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {of}, base array<{_SPAN}>, more array<{_SPAN}>")


def reliabilities(counts: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """By EM: the probability that a candidate with a pattern of votes is personal data. Two hidden classes a kind; labelers
    are independent given the class; priors keep rare patterns from settling anything."""
    out: dict[int, float] = {}
    for kind in range(len(KINDS)):
        keys = sorted(k for k in counts if _votes_of(k)[0] == kind)
        if not keys:
            continue
        given = np.array([_votes_of(k)[1] for k in keys])
        n = np.array([counts[k] for k in keys], float)
        one = np.eye(3)[given]  # pattern, labeler, vote
        p = 1 / (1 + np.exp(-(given - 1).sum(axis=1)))  # majority
        for _ in range(rounds):
            weight = np.stack([n * (1 - p), n * p])
            prior = (weight.sum(axis=1) + 1) / (n.sum() + 2)
            table = np.einsum("cp,plv->clv", weight, one) + PRIOR[:, None, :]
            table /= table.sum(axis=2, keepdims=True)
            table[1, :, 0] = np.minimum(table[1, :, 0], WRONG_NO)
            table /= table.sum(axis=2, keepdims=True)
            score = np.log(prior)[:, None] + np.einsum("plv,clv->cp", one, np.log(table))
            p = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        out |= dict(zip(keys, p.tolist(), strict=True))
    return out


def fit(rows: list[tuple[list[int], float]], rounds: int = 300, rate: float = 1.0, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression over sparse ones, to soft labels, by gradient steps scaled by each feature's share."""
    w = np.zeros(SIZE)
    if not rows:
        return w
    ones = np.array([o for o, _ in rows])
    goal = np.array([p for _, p in rows])
    share = np.maximum(np.bincount(ones.ravel(), minlength=SIZE) / len(rows), 0.01)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-w[ones].sum(axis=1)))
        slope = np.bincount(ones.ravel(), weights=np.repeat(p - goal, ones.shape[1]), minlength=SIZE) / len(rows)
        w -= rate * (slope / share / ones.shape[1] * 4 + decay * w)
    return w


def train(found: DataFrame) -> tuple[dict[int, float], np.ndarray]:
    """The probabilities of the patterns and the classifier's weights, from ``candidates`` rows."""
    sides = F.concat(*[F.transform(c, lambda s, i=i: F.struct(F.lit(i).alias("side"), s["pattern"].alias("pattern"))) for i, c in enumerate(("base", "more"))])
    each = found.select(F.explode(sides).alias("s")).groupBy("s.side", "s.pattern").agg(F.count("*").alias("n")).collect()  # at most 8 * 3**6
    counts: dict[int, int] = {}
    for r in each:
        counts[r["pattern"]] = counts.get(r["pattern"], 0) + r["n"]
    truth = reliabilities(counts)
    rows = []
    for i, side in enumerate(("base", "more")):
        share = 1.25 * SAMPLE / max(1, sum(r["n"] for r in each if r["side"] == i))
        picked = found.select("doc_id", F.explode(side).alias("s")).select(F.xxhash64("doc_id", "s.start", "s.kind").alias("h"), F.struct("doc_id", "s.start", "s.pattern", "s.ones").alias("s"))
        if share < 1:  # so few that no more than these are ranked, wherever they are
            picked = picked.where(F.col("h") < int((share * 2 - 1) * (1 << 63)))
        picked = picked.groupBy("h").agg(F.min("s").alias("s")).orderBy("h").limit(SAMPLE)
        rows += [(r["ones"], truth[r["pattern"]]) for r in picked.select("s.ones", "s.pattern").collect()]
    return truth, fit(rows)


def spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, base, found): lists of kind:start:end, by kind and start; ``found`` also has what the classifier adds."""
    rows = cut(candidates(docs))
    _, weights = train(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for b, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                first = [(s["kind"], s["start"], s["stop"]) for s in b]
                added = [(s["kind"], s["start"], s["stop"]) for s in m if 1 / (1 + np.exp(-weights[s["ones"]].sum())) >= threshold]
                base.append([f"{KINDS[k]}:{x}:{y}" for k, x, y in first])
                found.append([f"{KINDS[k]}:{x}:{y}" for k, x, y in sorted(first + added)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(pa.string())), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "base", "found"])

    of = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {of}, base array<string>, found array<string>")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans of each document."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return spans(docs).select("doc_id", *counts, F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"), F.array_join("found", ",").alias("spans"))


def masked(text: str, found: list[str]) -> str:
    """A text with its spans replaced by the kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in found)), key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])


def digest(base: list[str]) -> str:
    return hashlib.sha256(",".join(base).encode()).hexdigest()
