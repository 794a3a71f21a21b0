"""Plain versions of the corpus operators, over lists of rows (doc_id, text, lang, source, n_chars)."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

from .conftest import words_of


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# near duplicates


def shingle_set(text: str | None, k: int) -> frozenset:
    w = words_of(text, lower=True)
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_classes(rows: list[tuple], k: int, percent: int) -> list[tuple]:
    """(doc_id, set size, component) of each row; ids tie their texts."""
    sets = [shingle_set(r[1], k) for r in rows]
    up = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(rows[i][0]), root(rows[j][0])))
                up[y] = x
    return [(r[0], len(s), None if r[0] is None else root(r[0])) for r, s in zip(rows, sets, strict=True)]


def keep_one(rows: list[tuple], k: int = 5, percent: int = 80) -> list[tuple]:
    out, seen = [], set()
    for r, (_, _, c) in zip(rows, near_classes(rows, k, percent), strict=True):
        if r[0] is None:
            out.append(r)
        elif c == r[0] and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


# lines


def line_dedup(rows: list[tuple]) -> list[tuple]:
    """Rows without later windows, and how many lines went. Ids and texts are unique together, or alike."""
    seen, gone = {}, defaultdict(set)
    order = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    for key in order:
        lines = [(i, " ".join(x.split("\n")).strip(" \t\x0b\x0c\r")) for i, x in enumerate(key[1].split("\n")) if words_of(x)]
        for j in range(len(lines) - 2):
            window = tuple(x for _, x in lines[j : j + 3])
            if window in seen:
                gone[key].update(i for i, _ in lines[j : j + 3])
            seen[window] = True
    out = []
    for r in rows:
        g = gone[r[0], r[1]]
        text = r[1] if not g else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in g)
        out.append((r[0], text, r[2], r[3], len(text) if g else r[4], len(g)))
    return out


# quality


def counts(text: str | None) -> tuple:
    text = text or ""
    w = words_of(text)
    where = defaultdict(list)
    for i in range(len(w) - 7):
        where[tuple(w[i : i + 8])].append(i)
    covered = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def measures(c: tuple) -> list[int]:
    """In bins of a 32nd of a doubling."""
    n, chars, symbols, dup, _, lines = c
    return [math.floor(math.log2(x) * 32 + 1e-6) for x in (max(chars, 1) / max(n, 1), (symbols + 1) / (n + 1), (dup + 1) / (lines + 1))]


def fences(rows: list[list[int]]) -> list[tuple[float, float]]:
    out = []
    for column, reach, least in zip(zip(*rows, strict=True), (5, 2, 1.5), (2, 32, 32), strict=True):
        order = sorted(column)
        low, high = (order[max(0, math.ceil(q * len(order)) - 1)] for q in (0.25, 0.75))
        way = reach * max(least, high - low)
        out.append((low - way if reach == 5 else -math.inf, high + way))
    return out


def verdicts(rows: list[tuple], least: int) -> list[tuple]:
    """(doc_id, counts but lines, base_failed, kept)."""
    made = [(r, counts(r[1])) for r in rows]
    failed = [c[0] < 20 or 100 * c[4] > 30 * c[0] for _, c in made]
    groups = defaultdict(list)
    for (r, c), f in zip(made, failed, strict=True):
        if not f:
            for key in (("fine", r[2], r[3]), ("lang", r[2]), ("all",)):
                groups[key].append(measures(c))

    out = []
    for (r, c), f in zip(made, failed, strict=True):
        key = next((k for k in (("fine", r[2], r[3]), ("lang", r[2])) if len(groups[k]) >= least), ("all",))
        fine = f or all(a <= m <= b for m, (a, b) in zip(measures(c), fences(groups[key]), strict=True))
        out.append((r[0], *c[:5], f, not f and fine))
    return out


# mixing


def mix(rows: list[tuple], seed: str, weights=(5, 2, 1), cap: int = 3) -> list[tuple]:
    """(doc_id, size, source_size, target, copies)."""
    size = [len(words_of(r[1])) for r in rows]
    held = Counter()
    for r, n in zip(rows, size, strict=True):
        held[r[3]] += n
    order = sorted(held, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set = set()
    while True:
        left = sum(held.values()) - sum(cap * held[s] for s in full)
        free = [s for s in order if s not in full]
        target = {s: cap * held[s] for s in full} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > cap * held[s]}
        if not over:
            break
        full |= over
    copies = [0] * len(rows)
    for s in order:
        own = [i for i, r in enumerate(rows) if r[3] == s]
        of = {i: 1 if size[i] < 64 else 2 if size[i] < 256 else 3 for i in own}
        stuck: set = set()  # weights whose documents are all taken cap times
        while True:
            free = sum(of[i] * size[i] for i in own if of[i] not in stuck)
            level = (target[s] - sum(cap * size[i] for i in own if of[i] in stuck)) / free if free else 0.0
            over = {w for w in set(of.values()) - stuck if level * w >= cap}
            if not over:
                break
            stuck.add(max(over))
        ranked, past = [], target[s]
        for i in own:
            c = cap if of[i] in stuck else of[i] * level
            copies[i] = math.floor(c)
            past -= copies[i] * size[i]
            part = c - copies[i]
            if part > 0:
                key = "" if rows[i][0] is None else str(rows[i][0])
                u = (int(hashlib.md5(f"{seed}:{key}:{rows[i][1] or ''}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranked.append(((u / (1 - u)) / (part / (1 - part)), key, size[i], i))
        for *_, n, i in sorted(ranked):
            if past < n / 2:
                break
            copies[i] += 1
            past -= n
    return [(r[0], n, held[r[3]], target[r[3]], c) for r, n, c in zip(rows, size, copies, strict=True)]


# personal data


def base_spans(text: str) -> list[str]:
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d: str) -> bool:
        total = 0
        for i, c in enumerate(d[::-1]):
            v = int(c) * (1 + i % 2)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, text) if ok(m.group())]
