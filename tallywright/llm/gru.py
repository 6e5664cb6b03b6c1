"""A gated recurrent language model with a class-factored output, in numpy.

Symbols are the commonest words and, for all other words, one symbol per tail class. The output
first picks a class (a block of common words, or a tail class) and then a word inside a block; the
word inside a tail class is left to the caller. Texts are laid end to end in lanes that step
together; a window of steps is worked out at a time and the state goes on into the next window, so
a text's likelihood has its whole past, however long it is. In training the gradient stops at the
window's start (truncated backpropagation through time).

The three gates lie apart, each with its lanes one after the other, so that every operation runs
over memory in one piece.
"""

from __future__ import annotations

import numpy as np

WINDOW = 32
#: Values of a parameter updated at a time: what a pass touches stays in the processor's cache.
PIECE = 1 << 14
#: Multiplications of one product of tall matrices: the library has a faster way for small ones.
PRODUCT = 900_000
#: Logits that are surely within this go into the exponential as they are.
FAR = 60


def lanes(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Lane and first step of each text, longest first into the shortest lane, fullest lanes
    first; steps in all."""
    import heapq

    heap = [(0, i) for i in range(max(1, min(most, len(sizes))))]
    lane, first = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        used, at = heapq.heappop(heap)
        lane[i], first[i] = at, used
        heapq.heappush(heap, (used + int(sizes[i]), at))
    used = np.zeros(len(heap), np.int64)
    for n, i in heap:
        used[i] = n
    rank = np.empty(len(heap), np.int64)
    rank[np.argsort(-used, kind="stable")] = np.arange(len(heap))
    return rank[lane], first, int(used.max(initial=0))


class _Laid:
    """Runs of symbols in lanes, handed out a window of steps at a time: what is held grows with
    the texts and a window, not with the longest text times the lanes."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, start: int, most_lanes: int):
        self.symbols, self.bounds, self.start = symbols, bounds, start
        sizes = np.diff(bounds)
        lane, first, self.steps = lanes(sizes, most_lanes)
        self.count = int(lane.max(initial=-1)) + 1
        place = lane * self.steps + first
        some = np.flatnonzero(sizes > 0)
        self.texts = some[np.argsort(place[some])]
        self.first, self.places = first[self.texts], place[self.texts]
        self.used = np.bincount(lane, sizes, self.count).astype(np.int64)

    def window(self, a: int, b: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Steps a..b-1 of the first `count` lanes: text (-1: none), symbol, the symbol before it,
        and whether a text begins."""
        t, lane = np.arange(a, b), np.arange(count)[:, None]
        live = t < self.used[:count, None]
        k = np.searchsorted(self.places, lane * self.steps + t, "right") - 1
        text, since = self.texts[k], t - self.first[k]
        at = np.where(live, self.bounds[text] + since, 0)
        fresh = ~live | (since == 0)
        past = np.where(fresh, self.start, self.symbols[at - 1]).astype(np.intp)
        return tuple(np.ascontiguousarray(x.T) for x in (np.where(live, text, -1), np.where(live, self.symbols[at], 0), past, fresh))


def _order(symbols: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(symbols.astype(np.int16) if n < 1 << 15 else symbols, kind="stable")


def _symbol_sums(rows: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows (the last axis but one) of each of n symbols; `of`: the rows' symbols, in order."""
    out = np.zeros((*rows.shape[:-2], n, rows.shape[-1]), rows.dtype)
    edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])[:len(of)])
    out[..., of[edge], :] = np.add.reduceat(rows, edge, -2)
    return out


def _tall(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of matrices with many rows."""
    rows = max(1, PRODUCT // (a.shape[1] * b.shape[1]))
    even = len(a) - len(a) % rows
    out = a[even:].T @ b[even:]
    return out + np.matmul(a[:even].reshape(-1, rows, a.shape[1]).transpose(0, 2, 1), b[:even].reshape(-1, rows, b.shape[1])).sum(0)


def _logits(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, near: bool) -> np.ndarray:
    """Without the bias if `near`, which goes into the sums of the exponentials instead; else with
    it, shifted so that no exponential overflows."""
    logits = h @ weights
    if not near:
        logits += bias
        logits -= logits.max(1, keepdims=True)
    return logits


def _pieces(x: np.ndarray) -> list[np.ndarray]:
    flat = x.reshape(-1)  # of one piece of memory, so no copy
    return [flat[i:i + PIECE] for i in range(0, len(flat), PIECE)]


class Gru:
    """Symbols 0..words-1 are words, in blocks of `block`; then come the tail classes."""

    def __init__(self, counts: np.ndarray, words: int, block: int, hidden: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        n, self.words, self.block, self.hidden = len(counts), words, block, hidden
        self.blocks = -(-words // block)
        share = (counts + 1.0) / (counts + 1.0).sum()
        member = np.arange(n)
        self.class_of = np.where(member < words, member // block, self.blocks + member - words)
        of_class = np.bincount(self.class_of, share)
        f = np.float32

        def by_gate(x):
            return np.ascontiguousarray(x.reshape(len(x), 3, hidden).transpose(1, 0, 2), f)

        self.p = {
            "into": by_gate(rng.normal(0, 0.1, (n, 3 * hidden))), "over": by_gate(rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))),
            "bias": np.zeros((3, hidden), f), "pick": np.zeros((hidden, len(of_class)), f), "pick_bias": np.log(of_class).astype(f),
            "word": np.zeros((words, hidden), f), "word_bias": np.log(share[:words] / of_class[self.class_of[:words]]).astype(f)}

    def weights(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)]).astype(np.float64)

    def take(self, weights: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            to = at + self.p[k].size
            self.p[k] = weights[at:to].reshape(self.p[k].shape).astype(self.p[k].dtype)
            at = to

    def step(self, x, fresh, h):
        """One step of all lanes; what backward needs is returned too."""
        h = np.where(fresh[:, None], np.float32(0), h)
        a, u = self.p["into"][:, x] + self.p["bias"][:, None], h @ self.p["over"]
        z, r = 1 / (1 + np.exp(-np.clip(a[:2] + u[:2], -30, 30)))
        c = np.tanh(a[2] + r * u[2])
        return c + z * (h - c), (x, fresh, h, u, z, r, c)

    def _halved(self) -> tuple[np.ndarray, np.ndarray]:
        """Input and state weights of the gates for half a hyperbolic tangent of half the input,
        which a logistic gate is; what a reset gate multiplies is halved too."""
        into = self.p["into"] + self.p["bias"][:, None]
        into[:2] *= 0.5
        return into, self.p["over"] * self.p["over"].dtype.type(0.5)

    def stepper(self, count: int):
        """`step` without what backward needs, in place: f(x, h) changes h."""
        into, over = self._halved()
        a, u = np.empty((3, count, self.hidden), into.dtype), np.empty((3, count, self.hidden), into.dtype)
        gates, (z, r, c), past = a[:2], a, u[2]

        def advance(x, h):
            np.take(into, x, 1, out=a, mode="clip")
            np.matmul(h, over, out=u)
            np.add(gates, u[:2], out=gates)
            np.tanh(gates, out=gates)
            np.add(gates, 1, out=gates)  # twice the gates
            np.multiply(past, r, out=past)
            np.add(c, past, out=c)
            np.tanh(c, out=c)
            h -= c
            h *= z
            h *= 0.5
            h += c

        return advance

    def outputs(self, h, y, rows=None, logs=True):
        """log P(class of y | h) + log P(y | class, h) for words; and what backward needs. `rows`: the rows
        of h that y is of. The logarithms may be left out."""
        order = _order(y, len(self.class_of))
        # In the order of symbols the rows of a word, a block and a class lie together.
        h, y = np.take(h, order if rows is None else rows[order], 0), y[order]
        kind = self.class_of[y]
        reach = np.abs(h).max(initial=0)
        word, pick = self.p["word"], self.p["pick"]
        near = (np.abs(pick).sum(0) * reach + np.abs(self.p["pick_bias"])).max() < FAR
        near = near and (np.abs(word) @ np.ones(self.hidden, word.dtype) * reach + np.abs(self.p["word_bias"])).max(initial=0) < FAR
        # The exponentials of the biases, as factors.
        pick_factor, word_factor = ((np.exp(self.p[k]) if near else np.ones_like(self.p[k])) for k in ("pick_bias", "word_bias"))
        e = _logits(h, pick, self.p["pick_bias"], near)
        row = np.arange(len(y))
        got = e[row, kind] if logs else None
        np.exp(e, out=e)
        total = e @ pick_factor
        edge = np.searchsorted(kind, np.arange(self.blocks + 1)).tolist()
        words = slice(0, edge[-1])
        sums = np.empty(edge[-1], e.dtype)
        inner = []
        for b in range(self.blocks):
            rows = slice(edge[b], edge[b + 1])
            if rows.start < rows.stop:
                some = slice(b * self.block, min((b + 1) * self.block, self.words))
                f = _logits(h[rows], word[some].T, self.p["word_bias"][some], near)
                if logs:
                    got[rows] += f[row[:len(f)], y[rows] - some.start]
                np.exp(f, out=f)
                np.matmul(f, word_factor[some], out=sums[rows])
                inner.append((rows, some, f))
        out = None
        if logs:
            if near:
                got += self.p["pick_bias"][kind]
                got[words] += self.p["word_bias"][y[words]]
            got -= np.log(total)
            got[words] -= np.log(sums)
            out = np.empty(len(y))
            out[order] = got
        return out, (order, h, y, kind, e, total, inner, sums, pick_factor, word_factor)

    def score(self, symbols: np.ndarray, bounds: np.ndarray, start: int, most_lanes: int = 256) -> np.ndarray:
        """Natural log-likelihood of each text, a run of symbols; `start` is every text's past."""
        laid = _Laid(symbols, bounds, start, most_lanes)
        out = np.zeros(len(bounds) - 1)
        h, advance = np.zeros((laid.count, self.hidden), np.float32), self.stepper(laid.count)
        states = np.empty((WINDOW, laid.count, self.hidden), np.float32)
        for a in range(0, laid.steps, WINDOW):
            alive = int((laid.used > a).sum())  # the first lanes; the others have ended
            if alive < len(h):
                h, advance = h[:alive].copy(), self.stepper(alive)
                states = np.empty((WINDOW, alive, self.hidden), np.float32)
            text, y, x, fresh = laid.window(a, min(a + WINDOW, laid.steps), alive)
            begins = fresh.any(1).tolist()
            for i in range(len(text)):
                if begins[i]:
                    h[fresh[i]] = 0
                advance(x[i], h)
                states[i] = h
            rows = np.flatnonzero(text.ravel() >= 0)
            got, _ = self.outputs(states.reshape(-1, self.hidden), y.ravel()[rows], rows)
            np.add.at(out, text.ravel()[rows], got)
        return out

    def train(self, symbols: np.ndarray, bounds: np.ndarray, start: int, epochs: int = 2, rate: float = 0.01, most_lanes: int = 64,
              since: float = 0.0, until: float = 1.0) -> None:
        """`since` and `until`: the shares of the whole training that lie before and up to the end of this call."""
        laid = _Laid(symbols, bounds, start, most_lanes)
        steps = laid.steps
        if not steps:
            return
        first_moment = {k: np.zeros_like(v) for k, v in self.p.items()}
        second_moment = {k: np.zeros_like(v) for k, v in self.p.items()}
        n, total = 0, epochs * -(-steps // WINDOW)
        for _ in range(epochs):
            h = np.zeros((laid.count, self.hidden), np.float32)
            for a in range(0, steps, WINDOW):
                h = h[:int((laid.used > a).sum())]  # the first lanes; the others have ended
                text, y, x, fresh = laid.window(a, min(a + WINDOW, steps), len(h))
                grads, h = self.gradients(x, y, fresh, text >= 0, h)
                n += 1
                pace = rate * min(1.0, 2.0 * (1 - since - (until - since) * n / (total + 1)))
                norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
                shrink = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
                # m / (1 - 0.9^n) over sqrt(v / (1 - 0.99^n)) + 1e-8, times the pace; m and v are held
                # as 10 and 100 times themselves.
                pace *= 0.1 / (1 - 0.9**n)
                of_root, least = np.float32(0.1 / np.sqrt(1 - 0.99**n) / pace), np.float32(1e-8 / pace)
                for k, g in grads.items():
                    for p, g, m, v in zip(*(_pieces(x) for x in (self.p[k], g, first_moment[k], second_moment[k])), strict=True):
                        g = g * shrink
                        m *= np.float32(0.9)
                        m += g
                        g *= g
                        v *= np.float32(0.99)
                        v += g
                        np.sqrt(v, out=g)
                        g *= of_root
                        g += least
                        np.divide(m, g, out=g)
                        p -= g

    def gradients(self, x, y, fresh, live, h):
        """Of the mean negative log-likelihood of a window, the state before it being given."""
        steps, count, k = *x.shape, self.hidden
        into, over = self._halved()
        kind = np.result_type(over, h)
        before, states, keep = (np.empty((steps, count, k), kind) for _ in range(3))
        # What a step's gradient is multiplied by, for the candidate, the gates, and what the reset gate
        # multiplies, does not depend on later steps.
        d = np.empty((steps, 4, count, k), kind)
        a, u, twice = (np.empty((j, count, k), kind) for j in (3, 3, 2))
        gates, c, past = a[:2], a[2], u[2]
        begins = fresh.any(1).tolist()
        for i in range(steps):
            was, now, z = before[i], states[i], keep[i]
            was[...] = h
            if begins[i]:
                was[fresh[i]] = 0
            np.take(into, x[i], 1, out=a, mode="clip")
            np.matmul(was, over, out=u)
            np.add(gates, u[:2], out=gates)
            np.tanh(gates, out=gates)
            np.add(gates, 1, out=twice)
            past *= twice[1]
            c += past
            np.tanh(c, out=c)
            to_c, to_z, to_r, to_past = d[i]
            np.multiply(twice[0], 0.5, out=z)
            np.subtract(1, z, out=to_c)
            np.subtract(was, c, out=now)
            now *= z
            np.multiply(now, to_c, out=to_z)
            now += c
            c *= c
            np.subtract(1, c, out=c)
            to_c *= c
            r = twice[1]
            r *= 0.5
            np.multiply(to_c, r, out=to_past)
            np.subtract(to_c, to_past, out=to_r)
            to_r *= past
            h = now
        live = np.flatnonzero(live.ravel())
        n = max(1, len(live))
        _, (order, flat, of, of_class, share, total, inner, sums, pick_factor, word_factor) = self.outputs(states.reshape(-1, k), y.ravel()[live], live, logs=False)
        g = {}
        # Rows over their totals, columns times their factors: the exponentials themselves are only
        # multiplied with narrow matrices. Less what each row's own symbol takes away.
        pick, word, part = self.p["pick"], self.p["word"], 1 / (total * n)
        own, times = _symbol_sums(flat, of, len(self.class_of)), np.bincount(of, minlength=len(self.class_of))
        edge = np.searchsorted(self.class_of, np.arange(len(pick_factor)))
        g["pick"] = _tall(flat * part[:, None], share) * pick_factor - np.add.reduceat(own, edge, 0).T / n
        g["pick_bias"] = (part @ share) * pick_factor - np.add.reduceat(times, edge) / kind.type(n)
        d_sorted = share @ (pick * pick_factor).T
        d_sorted *= part[:, None]
        d_sorted -= np.take(np.ascontiguousarray(pick.T) / n, of_class, 0)
        g["word"], g["word_bias"] = own[:self.words] / -n, times[:self.words] / kind.type(-n)
        part = 1 / (sums * n)
        inside, scaled, weighted = np.empty((len(sums), k), kind), flat[:len(sums)] * part[:, None], word * word_factor[:, None]
        for rows, some, f in inner:
            g["word"][some] += (f.T @ scaled[rows]) * word_factor[some, None]
            g["word_bias"][some] += (part[rows] @ f) * word_factor[some]
            np.matmul(f, weighted[some], out=inside[rows])
        inside *= part[:, None]
        inside -= np.take(word / n, of[:len(sums)], 0)
        d_sorted[:len(sums)] += inside
        d_states = np.zeros((steps, count, k), kind)
        d_states.reshape(-1, k)[live[order]] = d_sorted
        back = np.ascontiguousarray(self.p["over"].transpose(0, 2, 1))
        d_h = np.zeros((count, k), kind)
        for i in range(steps - 1, -1, -1):
            now = d_states[i]
            now += d_h
            d[i] *= now
            np.matmul(d[i, 1:], back, out=u)
            np.add(u[0], u[1], out=d_h)
            d_h += past
            now *= keep[i]
            d_h += now
            if begins[i]:
                d_h[fresh[i]] = 0
        g["over"] = np.matmul(before.transpose(0, 2, 1)[:, None], d[:, 1:]).sum(0)
        met = x.ravel()
        order = _order(met, len(self.class_of))
        place = order + order // count * (3 * count)  # of the candidate's rows; the gates' follow
        rows = np.take(d.reshape(-1, k), np.stack([place + count, place + 2 * count, place]), 0)
        g["into"] = _symbol_sums(rows, met[order], len(self.class_of))
        g["bias"] = g["into"].sum(1)
        return g, h
