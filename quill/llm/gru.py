"""The numpy kernel of the gated recurrent language model.

Documents lie in lanes: a lane that is through with a document takes the next
one, all lanes take a step together, and a lane's state starts at zero with
every document. A window of steps is computed at once; the state is carried
into the next window, gradients are not (truncated backpropagation).

Before a token is read it is predicted from the state: a softmax over classes,
then for frequent words a softmax over the words of the class. The words of
other classes have fixed shares of their class, which the caller adds.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

F32 = np.float32
ROWS = 512  # tokens whose class logits are worked on at once
PIECE = 1 << 15  # weights that a step changes at once


@dataclass(frozen=True)
class Shape:
    inputs: int  # input ids
    hidden: int
    classes: int  # all classes; the first ``heads`` have ``words`` words each
    heads: int
    words: int

    def parts(self) -> list[tuple[str, tuple[int, ...]]]:
        h = self.hidden
        return [("wx", (3 * h, self.inputs)), ("u", (h, 3 * h)), ("class", (self.classes, h + 1)),
                ("word", (self.heads, h + 1, self.words))]

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for _, s in self.parts())

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, s in self.parts():
            n = int(np.prod(s))
            out[name] = flat[at:at + n].reshape(s)
            at += n
        h = self.hidden  # the last ones are biases
        return out | {"wx": out["wx"].T, "wc": out["class"][:, :h].T, "bc": out["class"][:, h],
                      "wh": out["word"][:, :h], "bh": out["word"][:, h]}

    def initial(self, class_mass: np.ndarray, word_mass: np.ndarray, seed: int = 42) -> np.ndarray:
        """Small random weights; biases that make the untrained model the
        unigram model of the given masses (absent words: no probability)."""
        rng = np.random.default_rng(seed)
        flat = np.zeros(self.size, F32)
        v = self.views(flat)
        v["wx"][:] = rng.normal(0, 0.3, v["wx"].shape)
        v["u"][:] = rng.normal(0, self.hidden ** -0.5, v["u"].shape)
        v["wx"][:, :self.hidden] += 1  # gates start by keeping the state
        v["wc"][:] = rng.normal(0, 0.05, v["wc"].shape)
        with np.errstate(divide="ignore"):
            v["bc"][:] = np.maximum(np.log(class_mass / class_mass.sum()), -30)
            share = np.log(word_mass / np.maximum(word_mass.sum(1, keepdims=True), 1e-30))
            v["bh"][:] = np.where(word_mass > 0, share, -1e9)
        return flat


#: columns of a token: input id, class, place in the class (-1: none), document, first of it, last of it
X, C, W, DOC, FIRST, LAST = range(6)


def windows(documents, lanes: int, steps: int):
    """Windows over documents, each an int32 array (tokens, 6), in the order in
    which lanes get free: (lane numbers, tokens [steps, lanes, 6], live mask)."""
    documents = iter(documents)
    held = [np.empty((0, 6), np.int32)] * lanes
    at, open_ = [0] * lanes, True
    while True:
        active, parts = [], []
        for lane in range(lanes):
            tokens, i = held[lane], at[lane]
            if len(tokens) - i < steps and open_:
                more, n = [tokens[i:]], len(tokens) - i
                while n < steps:
                    d = next(documents, None)
                    if d is None:
                        open_ = False
                        break
                    more.append(d)
                    n += len(d)
                tokens, i = np.concatenate(more) if len(more) > 1 else more[0], 0
                held[lane] = tokens
            if i < len(tokens):
                active.append(lane)
                parts.append(tokens[i:i + steps])
                at[lane] = i + steps
        if not active:
            return
        size = np.array([len(p) for p in parts])
        out = np.zeros((len(parts), steps, 6), np.int32)
        for row, p in zip(out, parts, strict=True):
            row[:len(p)] = p
        out = np.ascontiguousarray(out.transpose(2, 1, 0))  # each column of a token by itself
        yield np.array(active), out.transpose(1, 2, 0), np.arange(steps)[:, None] < size


class Net:
    """The network over windows, with its lanes' states. Arrays lie feature by
    feature, [features, steps, lanes], so that every operation runs along lanes."""

    def __init__(self, shape: Shape, flat: np.ndarray, lanes: int):
        self.shape, self.flat, self.v = shape, flat, shape.views(flat)
        self.state = np.zeros((shape.hidden, lanes), F32)
        self.kept: dict[str, np.ndarray] = {}

    def forward(self, lane: np.ndarray, token: np.ndarray, live: np.ndarray, keep: bool):
        """States before each token, a row of ones below them; the lanes' states
        move on."""
        h, v = self.shape.hidden, self.v
        steps, n = live.shape
        a = self._buffer("gates", steps if keep else 1, 3 * h * n).reshape(-1, 3 * h, n)
        gn = self._buffer("products", steps if keep else 1, h * n).reshape(-1, h, n)
        s = self._buffer("states", h + 1, steps * n, True).reshape(h + 1, steps, n)
        s[h] = 1
        ids, fresh = token[:, :, X], (live & (token[:, :, FIRST] == 0)).astype(F32)  # fresh: states that go on
        wx, ut = v["wx"].T, np.ascontiguousarray(v["u"].T)
        np.negative(ut[:2 * h], out=ut[:2 * h])  # the gates' sigmoid as 1 / (1 + exp(-x))
        g, now = np.empty((3 * h, n), F32), self.state.take(lane, axis=1)
        with np.errstate(over="ignore"):
            for t in range(steps):
                at = a[t if keep else 0]
                wx.take(ids[t], axis=1, mode="clip", out=at)
                before = np.multiply(now, fresh[t], out=s[:h, t])
                np.matmul(ut, before, out=g)
                zr, new, product = at[:2 * h], at[2 * h:], gn[t if keep else 0]
                np.subtract(g[:2 * h], zr, out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.divide(1, zr, out=zr)
                product[:] = g[2 * h:]
                new += np.multiply(zr[h:], product, out=g[2 * h:])
                np.tanh(new, out=new)
                np.subtract(before, new, out=now)
                now *= zr[:h]
                now += new
        self.state[:, lane] = now
        return s, (a, gn, fresh)  # of every step: both gates and the new value; the new value's products with the state

    @staticmethod
    def _exponentials(logits, out, pick, axis):
        """In ``out`` the exponentials of what ``logits`` writes there; the log
        probability of the picked entries along the axis, and the sums."""
        logits(out)
        p, ones = out[pick], np.ones(out.shape[axis], F32)
        with np.errstate(over="ignore"):
            np.exp(out, out=out)
            total = out @ ones if axis else ones @ out
        if not 0 < total.min() <= total.max() < np.inf:  # hardly ever: states and weights are small
            logits(out)
            out -= out.max(axis, keepdims=True)
            p = out[pick]
            np.exp(out, out=out)
            total = out @ ones if axis else ones @ out
        return p - np.log(total), total

    def _buffer(self, name: str, rows: int, columns: int, apart: bool = False) -> np.ndarray:
        """An array that is used again and again; with ``apart`` its rows do not
        begin at the same places of the cache."""
        wide = columns + 16 * apart
        if name not in self.kept or self.kept[name].size < rows * wide:
            self.kept[name] = np.empty(rows * wide, F32)
        return self.kept[name][:rows * wide].reshape(rows, wide)[:, :columns]

    def outputs(self, s: np.ndarray, c: np.ndarray, w: np.ndarray, grad: dict | None):
        """Natural log probabilities of class and word, for states by columns with
        a row of ones; with ``grad`` also the gradient of their negative mean on
        the states, the weights' set in ``grad`` (zero before). Probabilities less the truth
        stay undivided by their sums: the sums divide the short vectors that they
        meet. ``ROWS`` tokens at a time stay in the cache."""
        v, shape, h, n = self.v, self.shape, self.shape.hidden, s.shape[1]
        logp, every, share = np.empty(n, F32), np.arange(max(ROWS, n)), F32(1 / max(1, n))
        ds = self._buffer("of states", h, n, True) if grad is not None else None
        wc = np.ascontiguousarray(v["wc"].T)
        for i in range(0, n, ROWS):
            part = slice(i, min(i + ROWS, n))
            sk, ck = s[:, part], c[part]
            e = self._buffer("classes", shape.classes, len(ck))
            pick = ck, every[:len(ck)]
            logp[part], total = self._exponentials(lambda out, sk=sk: np.matmul(v["class"], sk, out=out), e, pick, 0)
            if grad is not None:
                e[pick] -= total
                of = share / total
                grad["class"] += e @ (sk * of).T
                np.multiply((e.T @ wc).T, of, out=ds[:, part])
        head = np.flatnonzero(w >= 0)
        order = head[np.argsort(c[head].astype(np.int16), kind="stable")]
        if not len(order):
            return logp, ds
        # tokens sorted by class: a product per class, all else over many classes at once
        of, sk, wk = c[order], s.take(order, axis=1), w[order]
        edge = np.searchsorted(of, np.arange(shape.heads + 1)).tolist()
        back, k = None, 0
        if grad is not None:
            back, word_t = np.empty((h, len(order) + 1), F32), np.ascontiguousarray(v["wh"].transpose(0, 2, 1))
        while k < shape.heads:
            a, first = edge[k], k
            k += 1
            while k < shape.heads and edge[k + 1] - a <= 2 * ROWS:
                k += 1
            z = edge[k]
            if a == z:
                continue
            spans = [(i, edge[i] - a, edge[i + 1] - a) for i in range(first, k) if edge[i] < edge[i + 1]]
            e, at = self._buffer("words", z - a, shape.words), sk[:, a:z]

            def logits(out, spans=spans, at=at.T):
                for i, x, y in spans:
                    np.matmul(at[x:y], v["word"][i], out=out[x:y])
            pick = every[:z - a], wk[a:z]
            p, total = self._exponentials(logits, e, pick, 1)
            logp[order[a:z]] += p
            if grad is not None:
                e[pick] -= total
                scale = share / total
                scaled, rows = at * scale, self._buffer("back", z - a, h)
                for i, x, y in spans:
                    np.matmul(scaled[:, x:y], e[x:y], out=grad["word"][i])
                    np.matmul(e[x:y], word_t[i], out=rows[x:y])
                np.multiply(rows.T, scale, out=back[:, a:z])
        if grad is not None:
            back[:, -1] = 0
            place = np.full(n, len(order))
            place[order] = every[:len(order)]
            ds += back.take(place, axis=1, mode="clip")
        return logp, ds

    def score(self, lane, token, live) -> tuple[np.ndarray, np.ndarray]:
        """Of a window its live tokens, and their natural log probabilities."""
        s, _ = self.forward(lane, token, live, False)
        s, t, _ = self._live(s, token, live)
        return t.T, self.outputs(s, t[C], t[W], None)[0]

    @staticmethod
    def _live(s, token, live):
        """States and tokens of a window by columns, live ones only, and where they
        are (None: everywhere)."""
        s, t = s.reshape(len(s), -1), token.transpose(2, 0, 1).reshape(6, -1)
        if live.all():
            return s, t, None
        at = np.flatnonzero(live)
        return s.take(at, axis=1), t.take(at, axis=1), at

    def gradient(self, lane, token, live) -> tuple[np.ndarray, float]:
        """Mean gradient of a window (until the next call) and its summed log
        probability."""
        shape, h, v = self.shape, self.shape.hidden, self.v
        g = self._buffer("gradient", 1, shape.size)[0]
        grad = shape.views(g)
        g[:] = 0
        s, (a, gates, fresh) = self.forward(lane, token, live, True)
        steps, n = live.shape
        of_live, t, at = self._live(s, token, live)
        logp, ds = self.outputs(of_live, t[C], t[W], grad)
        if at is not None:
            ds_live, ds = ds, np.zeros((h, steps * n), F32)
            ds[:, at] = ds_live
        ds = ds.reshape(h, steps, n)
        dg = self._buffer("of products", 3 * h, steps * n, True)
        of_news = self._buffer("of new values", h, steps * n, True)
        back, bz, x, u = np.zeros((h, n), F32), np.empty((h, n), F32), np.empty((h, n), F32), v["u"].copy()
        for t in range(steps - 1, -1, -1):  # back: gradient on the state after the step
            z, r, new, now = a[t, :h], a[t, h:2 * h], a[t, 2 * h:], slice(t * n, (t + 1) * n)
            of_z, of_r, of_gn, of_new = dg[:h, now], dg[h:2 * h, now], dg[2 * h:, now], of_news[:, now]
            np.multiply(back, z, out=bz)
            back -= bz
            np.multiply(new, new, out=x)
            np.subtract(1, x, out=x)
            np.multiply(back, x, out=of_new)
            np.subtract(s[:h, t], new, out=of_z)
            of_z *= bz
            of_z *= np.subtract(1, z, out=x)
            np.multiply(of_new, r, out=of_gn)
            np.multiply(of_gn, gates[t], out=of_r)
            of_r *= np.subtract(1, r, out=x)
            np.matmul(u, dg[:, now], out=back)
            back += bz
            back += ds[:, t]
            back *= fresh[t]
        grad["u"] += s[:h].reshape(h, -1) @ dg.T
        ids, of_wx = token[:, :, X].ravel().astype(np.intp), grad["wx"].T
        for k, row in enumerate((*dg[:2 * h], *of_news)):
            of_wx[k] = np.bincount(ids, row, shape.inputs)
        return g, float(logp.sum())


class Adam:
    """Moments are kept as plain decaying sums, 10 and 200 times the usual means."""

    def __init__(self, size: int, rate: float):
        self.m, self.s, self.t, self.rate = np.zeros(size, F32), np.zeros(size, F32), 0, rate
        self.work = np.empty(min(size, PIECE), F32)

    def step(self, flat: np.ndarray, g: np.ndarray) -> None:
        """One step, a piece of the weights after the other."""
        self.t += 1
        root = (0.005 / (1 - 0.995 ** self.t)) ** 0.5
        size = F32(self.rate * min(1.0, self.t / 20) / (1 - 0.9 ** self.t) * 0.1 / root)
        for i in range(0, len(flat), PIECE):
            at = slice(i, i + PIECE)
            self._piece(flat[at], g[at], self.m[at], self.s[at], size, F32(1e-6 / root))

    def _piece(self, flat, g, m, s, size, least) -> None:
        work = np.multiply(g, g, out=self.work[:len(g)])
        s *= F32(0.995)
        s += work
        m *= F32(0.9)
        m += g
        np.sqrt(s, out=work)
        work += least
        np.divide(m, work, out=work)
        work *= size
        flat -= work


def cut(documents, most: int):
    """The documents, those of more than ``most`` tokens in parts that start anew."""
    for d in documents:
        if len(d) > most:
            d[::most, FIRST] = 1
            yield from (d[i:i + most] for i in range(0, len(d), most))
        else:
            yield d


def fit(flat: np.ndarray, shape: Shape, documents, adam: Adam, lanes: int = 1024, steps: int = 8,
        most: int = 2048) -> tuple[float, int]:
    """One run over the documents, weights changed in place; the summed log
    probability on the way and the number of tokens. While learning, a document
    starts anew every ``most`` tokens, so that all lanes are in use."""
    net, total, n = Net(shape, flat, lanes), 0.0, 0
    for lane, token, live in windows(cut(documents, most), lanes, 8 * steps):
        for part in (slice(i, i + steps) for i in range(0, 8 * steps, steps)):
            on = live[part].any(0)
            if not on.any():
                break
            g, logp = net.gradient(lane[on], token[part, on], live[part, on])
            adam.step(flat, g)
            total, n = total + logp, n + int(live[part].sum())
    return total, n
