"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax.

Symbols are the head words, in classes of ``WIDTH``, then the tail classes. The probability of a head word is that of its class,
given the state, times that of the word, given class and state; a tail class has no words of its own here. The input
weights are a table of gate values for each symbol. A document's state starts at zero, after a start symbol, and is carried
over all of its windows, in training (where gradients stop at a window's start) as in scoring. Within a step texts are columns, so
the gates, halves of rows otherwise, are whole blocks of memory.
"""

from __future__ import annotations

import numpy as np

WIDTH = 64
HIDDEN = 24
WINDOW = 16
LANES = 128  # texts side by side in a step of training
RATE = 0.2
TOGETHER = 1024  # texts side by side in scoring
PENDING = 1 << 12  # states that are turned into probabilities at once: what they take stays with the process from one time to the next
_f = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    x *= _f(0.5)
    np.tanh(x, out=x)
    x += _f(1)
    x *= _f(0.5)
    return x


def _powers(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """The exponentials of each column, their sums, and what the logits were lessened by first: only where 32 bits need it, by the largest."""
    ones = np.ones(len(logit), _f)
    with np.errstate(over="ignore"):
        e = np.exp(logit)
    total = ones @ e
    if len(total) and not (total.min() > 1e-25 and total.max() < 1e25):
        top = logit.max(axis=0)
        e = np.exp(logit - top)
        return e, ones @ e, top
    return e, total, 0.0


def _over_ones(states: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Some columns of states, with a one below each for the bias."""
    out = np.ones((len(states) + 1, len(columns)), _f)
    np.take(states, columns, axis=1, out=out[:-1], mode="clip")
    return out


def _sums(rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The sums of the rows from each edge to the next. numpy adds up column by column: as complex numbers, two at a time."""
    if rows.shape[1] % 2:
        return np.add.reduceat(rows, edges)
    pairs = rows.view(np.result_type(rows.dtype, np.complex64))
    return np.add.reduceat(pairs, edges).view(rows.dtype)


def _order(x: np.ndarray, limit: int) -> np.ndarray:
    """A stable order of integers from 0 to under ``limit``; those of 16 bits are sorted by their digits."""
    return np.argsort(x.astype(np.uint16) if limit <= 1 << 16 else x, kind="stable")


class Model:
    """Parameters by name; ``classes`` head classes of WIDTH words (some may be missing), then ``tails`` tail classes."""

    def __init__(self, head: np.ndarray, tail: np.ndarray, hidden: int = HIDDEN, seed: int = 7):
        """``head``: counts of the head words; ``tail``: of the tail classes. The model starts as their unigram model."""
        self.words, self.tails, self.hidden = len(head), len(tail), hidden
        self.classes = -(-self.words // WIDTH)
        random = np.random.default_rng(seed)
        padded = np.zeros(self.classes * WIDTH)
        padded[: self.words] = head + 0.5
        each = padded.reshape(self.classes, WIDTH)
        total = np.concatenate([each.sum(axis=1), tail + 0.5])
        with np.errstate(divide="ignore"):
            words = np.maximum(np.log(each / np.maximum(each.sum(axis=1, keepdims=True), 1e-30)), -1e9)
        small = lambda *shape: (random.standard_normal(shape) * 0.1).astype(_f)
        with_bias = lambda x, bias: np.concatenate([x * _f(0.1), bias[..., None].astype(_f)], axis=-1)
        self.p = {
            "gates": small(self.words + self.tails + 1, 3 * hidden),
            "bias": np.zeros(3 * hidden, _f),
            "state": (random.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(_f),
            "to_class": with_bias(small(hidden, self.classes + self.tails).T.copy(), np.log(total / total.sum())),
            "to_word": with_bias(small(self.classes, WIDTH, hidden), words),
        }

    @property
    def start(self) -> int:
        return self.words + self.tails

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def take(self, flat: np.ndarray) -> None:
        at = 0
        for name, x in self.p.items():
            self.p[name] = flat[at : at + x.size].reshape(x.shape).astype(_f)
            at += x.size

    def _step(self, symbols: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        n = self.hidden
        a = self.p["gates"][symbols] + self.p["bias"]
        g = h @ self.p["state"]
        rz = _sigmoid(a[:, : 2 * n] + g[:, : 2 * n])
        r, z = rz[:, :n], rz[:, n:]
        gn = g[:, 2 * n :]
        new = np.tanh(a[:, 2 * n :] + r * gn)
        return new + z * (h - new), r, z, new, gn

    def _class_of(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.words, symbols // WIDTH, symbols - self.words + self.classes)

    def _by_class(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """An order of some symbols by class, so that head words come first; their classes in it; (class, from, to) of the head's that have some."""
        c = self._class_of(symbols)
        order = _order(c, self.classes + self.tails)
        ends = np.cumsum(np.bincount(c, minlength=self.classes)[: self.classes]).tolist()
        return order, c[order], [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if a < b]

    def _logits(self, states: np.ndarray, classes: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Of classes, and of words in their class, given states (as columns, over a row of ones) in the order of their words' classes."""
        words = np.empty((WIDTH, classes[-1][2] if classes else 0), _f)
        for c, a, b in classes:
            np.matmul(self.p["to_word"][c], states[:, a:b], out=words[:, a:b])
        return self.p["to_class"] @ states, words

    def log_probability(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural log of each symbol's probability, given the states before them."""
        order, c, classes = self._by_class(symbols)
        logit, words = self._logits(_over_ones(states.T, order), classes)
        found = logit[c, np.arange(len(c))].astype(np.float64)
        _, total, top = _powers(logit)
        found -= np.log(total) + top
        if head := words.shape[1]:
            found[:head] += words[symbols[order[:head]] % WIDTH, np.arange(head)]
            _, total, top = _powers(words)
            found[:head] -= np.log(total) + top
        out = np.empty(len(found))
        out[order] = found
        return out

    def score(self, symbols: np.ndarray, first: np.ndarray, together: int = TOGETHER, pending: int = PENDING) -> np.ndarray:
        """The log-likelihood of each text, of symbols first[i] : first[i + 1], whole. Texts run side by side, longest first; the
        states of about ``pending`` symbols are turned into probabilities at once."""
        n = self.hidden
        gates, weights = self.p["gates"] + self.p["bias"], self.p["state"].T.copy()
        lengths = np.diff(first)
        order = np.argsort(-lengths, kind="stable")
        out = np.zeros(len(lengths))
        for at in range(0, len(order), together):
            docs = order[at : at + together]
            size, begin = lengths[docs], first[docs]
            longest = int(size[0])
            live = np.searchsorted(-size, -np.arange(longest), "left").tolist()  # texts longer than each place
            h = np.zeros((n, len(docs)), _f)
            before = np.full(len(docs), self.start)
            states, targets, owners, held = [], [], [], 0
            for u in range(longest):
                k = live[u]
                h = h[:, :k]
                a = np.ascontiguousarray(gates[before[:k]].T)
                g = weights @ h
                rz = a[: 2 * n]
                rz += g[: 2 * n]
                _sigmoid(rz)
                new = g[2 * n :]
                new *= rz[:n]
                new += a[2 * n :]
                np.tanh(new, out=new)
                h = h - new
                h *= rz[n:]
                h += new
                before = symbols[begin[:k] + u]
                states.append(h)
                targets.append(before)
                owners.append(docs[:k])
                held += k
                if held >= pending or u + 1 == longest:
                    found = self.log_probability(np.concatenate(states, axis=1).T, np.concatenate(targets))
                    np.add.at(out, np.concatenate(owners), found)
                    states, targets, owners, held = [], [], [], 0
        return out

    def gradients(self, before: np.ndarray, targets: np.ndarray, alive: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray, float]:
        """Of a window (steps x lanes): gradients of the mean loss, those of the gates of the symbols that it holds (all others are 0), the
        state after it, and the loss. A start symbol begins a text anew, from a state of zero."""
        p, n = self.p, self.hidden
        steps, texts = targets.shape
        fresh, whole = before == self.start, alive.all(axis=1)
        begins = fresh.any(axis=1)
        given = (p["gates"] + p["bias"])[before].transpose(0, 2, 1).copy()
        h, weights = h.T, p["state"].T.copy()
        old, states, dn = [], np.empty((steps, n, texts), _f), np.empty((steps, n, texts), _f)
        slopes, g = np.empty((steps, 3, n, texts), _f), np.empty((3 * n, texts), _f)  # of the gates' inputs, by the state's
        for t in range(steps):
            if begins[t]:
                h = np.where(fresh[t], _f(0), h)
            old.append(h)
            np.matmul(weights, h, out=g)
            rz, new, gn = given[t, : 2 * n], given[t, 2 * n :], g[2 * n :]
            rz += g[: 2 * n]
            _sigmoid(rz)
            r, z = rz[:n], rz[n:]
            new += r * gn
            np.tanh(new, out=new)
            after = np.subtract(h, new, out=states[t])
            after *= z
            rest = 1 - rz
            np.multiply(after, rest[n:], out=slopes[t, 1])
            after += new
            new *= new
            np.subtract(1, new, out=new)
            x = np.multiply(new, rest[n:], out=dn[t])
            x = np.multiply(x, r, out=slopes[t, 2])
            gn *= rest[:n]
            np.multiply(x, gn, out=slopes[t, 0])
            if not whole[t]:
                np.copyto(after, h, where=~alive[t])
            h = after
        rows = np.flatnonzero(alive.ravel())
        y = targets.ravel()[rows]
        order, c, classes = self._by_class(y)
        rows, y = rows[order], y[order]
        held = _over_ones(states.transpose(1, 0, 2).reshape(n, -1), rows)
        share, each = _f(1 / max(1, len(rows))), np.arange(len(y))
        logit, words = self._logits(held, classes)
        e, total, top = _powers(logit)
        loss = float((np.log(total) + top - logit[c, each]).sum())
        e *= share / total
        e[c, each] -= share
        slope = {"to_class": e @ held.T, "to_word": np.zeros_like(p["to_word"])}
        dheld = p["to_class"][:, :n].T @ e
        if head := words.shape[1]:
            c, each = y[:head] % WIDTH, each[:head]
            e, total, top = _powers(words)
            loss += float((np.log(total) + top - words[c, each]).sum())
            e *= share / total
            e[c, each] -= share
            for c, a, b in classes:
                own = e[:, a:b]
                np.matmul(own, held[:, a:b].T, out=slope["to_word"][c])
                dheld[:, a:b] += p["to_word"][c, :, :n].T @ own
        place = np.zeros(steps * texts, np.int64)
        place[rows] = np.arange(len(rows))
        d = dheld.take(place, axis=1) if len(rows) else np.zeros((n, len(place)), _f)
        if len(rows) < len(place):
            d *= alive.ravel()
        d = d.reshape(n, steps, texts)
        dh, dg, part = np.zeros((n, texts), _f), np.empty((3, n, texts), _f), np.empty((n, 3 * n), _f)
        by_gate, given_z = dg.reshape(3 * n, texts), given[:, n : 2 * n]
        given, slope["state"] = np.empty((steps, texts, 3 * n), _f), np.zeros((n, 3 * n), _f)
        for t in reversed(range(steps)):
            dh += d[:, t]
            now = dh if whole[t] else dh * alive[t]
            np.multiply(now, slopes[t], out=dg)
            slope["state"] += np.matmul(old[t], by_gate.T, out=part)
            through = p["state"] @ by_gate
            np.multiply(now, dn[t], out=dg[2])
            given[t] = by_gate.T
            through += now * given_z[t]
            dh = through if whole[t] else np.where(alive[t], through, dh)
            if begins[t]:
                dh *= ~fresh[t]
        order = _order(before.ravel(), self.start + 1)
        used = before.ravel()[order]
        edges = np.concatenate([[0], np.flatnonzero(used[1:] != used[:-1]) + 1])
        gates = _sums(given.reshape(-1, 3 * n)[order], edges)
        slope["bias"] = np.ones(len(gates), _f) @ gates
        return slope, (used[edges], gates), h.T, loss

    def train(self, symbols: np.ndarray, first: np.ndarray, lanes: int = LANES, rate: float = RATE, past: dict[str, np.ndarray] | None = None) -> tuple[int, float]:
        """Learn from some texts in one pass, however many they are; (symbols, loss). The texts stand in ``lanes`` side by side, one after
        the other, each from a state of zero; a lane's state is carried over its windows. ``past``: the sums of squared gradients
        that divide the rate, kept from one call to the next."""
        past = {} if past is None else past
        for name, x in self.p.items():
            past.setdefault(name, np.full(x.shape, 1e-4, _f))
        before = np.concatenate([np.array([self.start], symbols.dtype), symbols[:-1]]) if len(symbols) else symbols
        before[first[:-1][np.diff(first) > 0]] = self.start
        steps = -(-len(symbols) // lanes)
        lane = np.arange(lanes) * steps
        h, loss = np.zeros((lanes, self.hidden), _f), 0.0
        for t in range(0, steps, WINDOW):
            u = np.arange(t, min(t + WINDOW, steps))[:, None]
            alive = (lane + u) < len(symbols)
            at = np.where(alive, lane + u, 0)
            g, (used, gates), h, cost = self.gradients(before[at], symbols[at], alive, h)
            loss += cost
            for name, rows, x in [("gates", used, gates), *((name, slice(None), x) for name, x in g.items())]:
                seen = past[name][rows] + x * x
                past[name][rows] = seen
                x *= _f(rate)
                x /= np.sqrt(seen, out=seen)
                self.p[name][rows] -= x
        return len(symbols), loss
