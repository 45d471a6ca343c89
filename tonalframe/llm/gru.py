"""A gated recurrent language model with a class-factored softmax, in numpy.

The unit has one gate for both of its uses: f = sigmoid(xf + h Uf), c = tanh(xc + f * (h Uc)), h' = h + f * (c - h).
"""

from __future__ import annotations

import heapq

import numpy as np


class Vocabulary:
    """`words` frequent entries in the order of their classes, and `groups` that stand for all rarer words.

    Entry i < words is a word; entry words + g stands for group g and is a class of its own.
    """

    def __init__(self, counts: np.ndarray, groups: np.ndarray, classes: int):
        """counts of the frequent entries, descending; groups: total counts of the groups. Classes have like shares of sqrt(count)."""
        share = np.cumsum(np.sqrt(counts + 1.0))
        of = np.minimum((share / share[-1] * classes).astype(np.int64), classes - 1)
        _, of = np.unique(of, return_inverse=True)
        self.words, self.groups = len(counts), len(groups)
        n = int(of[-1]) + 1
        self.low = np.searchsorted(of, np.arange(n))
        self.high = np.append(self.low[1:], self.words)
        self.classes = n + len(groups)
        self.class_of = np.concatenate([of, n + np.arange(len(groups))]).astype(np.uint16)
        mass = np.concatenate([np.add.reduceat(counts.astype(float), self.low), groups]) + 1
        self.class_bias = np.log(mass / mass.sum())
        self.word_bias = np.log((counts + 1.0) / (np.add.reduceat(counts + 1.0, self.low))[of])


class Gru:
    """Parameters X (input rows), U (recurrent), Wc (classes) and Wk (words within classes), all float32; the last row of Wc and Wk is the bias."""

    NAMES = ("X", "U", "Wc", "Wk")

    def __init__(self, vocabulary: Vocabulary, hidden: int = 16, seed: int = 1):
        v, rng = vocabulary, np.random.default_rng(seed)
        self.v, self.hidden = v, hidden
        r = lambda *s, scale=0.1: rng.normal(0, scale, s).astype(np.float32)
        self.p = {
            "X": r(v.words + v.groups, 2 * hidden), "U": r(hidden, 2 * hidden, scale=hidden**-0.5),
            "Wc": np.vstack([r(hidden, v.classes), v.class_bias.astype(np.float32)]), "Wk": np.vstack([r(hidden, v.words), v.word_bias.astype(np.float32)]),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def load(self, values: np.ndarray) -> Gru:
        at = 0
        for k in self.NAMES:
            n = self.p[k].size
            self.p[k] = values[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return self

    def forward(self, block: Block, h: np.ndarray, kept: bool = False) -> tuple:
        """States (steps, lanes, hidden + 1; the last is 1) of a block; h is brought up to date in place. With kept, what the way back needs."""
        n, u = self.hidden, self.p["U"]
        steps, width = block.inp.shape
        x = self.p["X"][block.inp]
        states = np.ones((steps, width, n + 1), np.float32)
        shape = (steps, width, n) if kept else (1, width, n)
        before, gate, cand, gc = (np.zeros(shape, np.float32) for _ in range(4))
        for t in range(steps):
            k, s = block.active[t], t if kept else 0
            if len(block.fresh[t]):
                h[block.fresh[t]] = 0
            now, f, c = h[:k], gate[s, :k], cand[s, :k]
            g = now @ u
            before[s, :k], gc[s, :k] = now, g[:, n:]
            np.add(x[t, :k, :n], g[:, :n], out=f)
            np.multiply(f, 0.5, out=f)
            np.tanh(f, out=f)
            f += 1
            f *= 0.5
            np.multiply(f, g[:, n:], out=c)
            c += x[t, :k, n:]
            np.tanh(c, out=c)
            g = c - now
            g *= f
            now += g
            states[t, :k, :n] = now
        return states, (before, gate, cand, gc)

    def log_probs(self, s: np.ndarray, target: np.ndarray, grads: dict | None = None):
        """Natural log probability of each target after state row s; with grads, gradients of their sum are added and that by s is returned too."""
        v, p = self.v, self.p
        cls, out = v.class_of[target], np.empty(len(target), np.float32)
        ds = None if grads is None else np.empty((len(s), self.hidden), np.float32)
        wc, wk, n = p["Wc"], p["Wk"], self.hidden
        ones = np.ones(max(v.classes, int((v.high - v.low).max(initial=1))), np.float32)
        for a in range(0, len(target), 2048):  # blocks that stay in cache
            sb, cb = s[a : a + 2048], cls[a : a + 2048]
            rows = np.arange(len(cb))
            e = sb @ wc
            own = e[rows, cb]
            np.exp(e, out=e)
            total = e @ ones[: v.classes]
            out[a : a + 2048] = own - np.log(total)
            if grads is not None:
                e[rows, cb] -= total
                scale = (-1 / total)[:, None]
                grads["Wc"] += (sb * scale).T @ e
                np.multiply(e @ wc[:n].T, scale, out=ds[a : a + 2048])
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(len(v.low) + 1, dtype=np.uint16))
        for c in range(len(v.low)):
            mine = order[edges[c] : edges[c + 1]]
            lo, hi = v.low[c], v.high[c]
            if not len(mine) or hi - lo == 1:
                continue
            block = max(512, 131072 // (hi - lo))
            for a in range(0, len(mine), block):
                some = mine[a : a + block]
                sc, t = s[some], target[some] - lo
                e = sc @ wk[:, lo:hi]
                at = np.arange(len(some))
                own = e[at, t]
                np.exp(e, out=e)
                total = e @ ones[: hi - lo]
                out[some] += own - np.log(total)
                if grads is not None:
                    e[at, t] -= total
                    scale = (-1 / total)[:, None]
                    grads["Wk"][:, lo:hi] += (sc * scale).T @ e
                    ds[some] += e @ wk[:n, lo:hi].T * scale
        return out, ds

    def score(self, docs: list[np.ndarray], start: int, window: int = 32, lanes: int = 512) -> np.ndarray:
        """Sum of the natural log probabilities of each document's entries; the state runs on from window to window through the whole document."""
        total = np.zeros(len(docs))
        plan = Lanes(docs, start, lanes)
        h = np.zeros((plan.width, self.hidden), np.float32)
        for block in plan.blocks(window):
            states = self.forward(block, h)[0]
            got, _ = self.log_probs(states[block.real], block.target[block.real])
            total += np.bincount(block.doc[block.real], got, len(docs))
        return total

    def back(self, block: Block, dstates: np.ndarray, kept: tuple, grads: dict) -> None:
        """Adds the gradients of the recurrent parameters, from those by the states of a block; nothing flows back beyond it."""
        n, u = self.hidden, self.p["U"]
        before, f, c, gc = kept
        steps, width = block.inp.shape
        dg, dx = np.zeros((steps, width, 2 * n), np.float32), np.zeros((steps, width, 2 * n), np.float32)
        to_c, to_f, through, keep = f * (1 - c * c), c - before, f * (1 - f), 1 - f
        carry = np.zeros((width, n), np.float32)
        for t in reversed(range(steps)):
            k = block.active[t]
            d = dstates[t, :k]
            d += carry[:k]
            dc = np.multiply(d, to_c[t, :k], out=dx[t, :k, n:])
            df = d * to_f[t, :k]
            df += dc * gc[t, :k]
            df *= through[t, :k]
            dg[t, :k, :n] = df
            np.multiply(dc, f[t, :k], out=dg[t, :k, n:])
            d *= keep[t, :k]
            d += dg[t, :k] @ u.T
            carry[:k] = d
            if len(block.fresh[t]):
                carry[block.fresh[t]] = 0
        dx[:, :, :n] = dg[:, :, :n]
        grads["U"] += before.reshape(-1, n).T @ dg.reshape(-1, 2 * n)
        real = block.real
        ids = block.inp[real]
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        grads["X"][ids[first]] += np.add.reduceat(dx[real][order], first, axis=0)

    def train(self, docs: list[np.ndarray], start: int, window: int = 32, lanes: int = 512, rate: float = 0.01, held: dict | None = None) -> Gru:
        """One pass of Adam over the documents by backpropagation truncated at windows; the state is carried across them. `held` keeps
        the moments from call to call. Few documents go in fewer lanes, so that there are some dozens of steps."""
        held = {} if held is None else held
        plan = Lanes(docs, start, max(8, min(lanes, sum(map(len, docs)) // (64 * window))))
        h = np.zeros((plan.width, self.hidden), np.float32)
        for block in plan.blocks(window):
            states, kept = self.forward(block, h, True)
            grads = {k: np.zeros_like(x) for k, x in self.p.items()}
            dstates = np.zeros((*block.inp.shape, self.hidden), np.float32)
            dstates[block.real] = self.log_probs(states[block.real], block.target[block.real], grads)[1]
            self.back(block, dstates, kept, grads)
            held["steps"] = held.get("steps", 0) + 1
            fix = rate * (1 - 0.99 ** held["steps"]) ** 0.5 / (1 - 0.9 ** held["steps"])
            size = np.float32(1 / max(1, int(block.real.sum())))
            for key, g in grads.items():
                g *= size
                if key not in held:
                    held[key] = np.zeros_like(g), np.zeros_like(g)
                m, s = held[key]
                m *= 0.9
                m += 0.1 * g
                s *= 0.99
                g *= g
                g *= 0.01
                s += g
                np.sqrt(s, out=g)
                g += 1e-8
                self.p[key] += np.float32(fix) * (m / g)
        return self


class Block:
    """Some steps of all lanes: inputs, targets, documents, `real` (a target is there), lanes active and lanes that begin a document, by step."""

    def __init__(self, inp, target, doc, real, active, fresh):
        self.inp, self.target, self.doc, self.real, self.active, self.fresh = inp, target, doc, real, active, fresh


class Lanes:
    """Documents dealt out to lanes, longest first, each lane one document after the other; the longest lanes come first, so the active ones
    always do. Beside the entries themselves only one block is laid out at a time, however long a document is."""

    def __init__(self, docs: list[np.ndarray], start: int, lanes: int):
        order = sorted((i for i in range(len(docs)) if len(docs[i])), key=lambda i: -len(docs[i]))
        heap = [(0, k) for k in range(min(lanes, len(order)))]
        lane: list[list[int]] = [[] for _ in heap]
        for i in order:
            length, k = heapq.heappop(heap)
            lane[k].append(i)
            heapq.heappush(heap, (length + len(docs[i]), k))
        lane.sort(key=lambda x: -sum(len(docs[i]) for i in x))
        each = [i for x in lane for i in x]
        self.start, self.width, self.of = start, len(lane), np.array(each, np.int32)
        self.flat = np.concatenate([docs[i] for i in each]) if each else np.empty(0, np.uint16)
        size = np.array([len(docs[i]) for i in each], np.int64)
        self.first = np.concatenate([[0], np.cumsum(size)])  # of each document in `flat`
        self.lengths = np.array([sum(len(docs[i]) for i in x) for x in lane], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]

    def blocks(self, window: int):
        begins = np.zeros(len(self.flat) + 1, bool)
        begins[self.first[:-1]] = True
        for a in range(0, int(self.lengths.max(initial=0)), window):
            width = int(np.searchsorted(-self.lengths, -a, "left"))
            left = self.lengths[:width] - a
            steps = int(min(window, left[0]))
            real = np.arange(steps)[:, None] < left
            at = np.where(real, self.at[:width] + a + np.arange(steps)[:, None], 0)
            fresh = begins[at] & real
            inp = np.where(fresh | ~real, self.start, self.flat[at - 1])
            active = real.sum(1)
            begun = [np.flatnonzero(x) for x in fresh]
            doc = self.of[np.searchsorted(self.first, at, "right") - 1]
            yield Block(inp, self.flat[at], doc, real, active, begun)
