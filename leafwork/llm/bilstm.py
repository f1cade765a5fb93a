"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by Adam, Viterbi decoding in batches.

The cell couples its input gate to its forget gate and uses x / (1 + |x|) for all squashing, which numpy does several times
faster than a tangent: c' = g + f (c - g), h' = o c'. A step reads two characters and scores the tags of both, so a text takes
half as many steps. Arrays are (rows, batch), so that every gate is one contiguous block.
"""

from __future__ import annotations

import ctypes
import glob
import os

import numpy as np

LANES = 1024


def one_thread() -> None:
    """Keep numpy's matrix products in a task on the task's own core: Spark runs a task per core already."""
    for path in glob.glob(os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                return


def _logsumexp(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class BiLstmCrf:
    def __init__(self, symbols: int, tags: int, size: int = 16, embed: int = 8, seed: int = 5):
        r = np.random.default_rng(seed)
        f = np.float32
        self.size, self.embed, self.tags = size, embed, tags
        self.p = {"E": r.normal(0, 0.5, (embed, symbols)).astype(f), "o": np.zeros(tags, f), "T": np.zeros((tags, tags), f), "S": np.zeros(tags, f)}
        for d in "fb":
            w = r.normal(0, (size + 2 * embed) ** -0.5, (3 * size, size + 2 * embed + 1)).astype(f)
            w[:, -1] = 0
            w[:size, -1] = 1  # forget gates open
            self.p["W" + d] = w
            self.p["O" + d] = r.normal(0, 0.3, (2 * tags, size)).astype(f)

    def save(self, path: str) -> None:
        np.savez_compressed(path, size=self.size, **self.p)

    @classmethod
    def load(cls, path: str) -> "BiLstmCrf":
        with np.load(path) as z:
            m = cls(z["E"].shape[1], len(z["S"]), int(z["size"]), z["E"].shape[0])
            m.p = {k: z[k] for k in m.p}
        return m

    def _emit(self, x: np.ndarray, size: np.ndarray, d: str) -> np.ndarray:
        """One direction's share of the emissions, (steps, 2 x tags, batch), of (time, batch) symbols read from the first row on.

        Lanes are sorted by ``size``; those that have ended are left out of the further steps. Read backwards, the second row of
        a step is the first character of its pair."""
        n, m, b, p = self.size, self.embed, x.shape[1], self.p
        w, out_w, table = (np.ascontiguousarray(p[k]) for k in ("W" + d, "O" + d, "E"))
        state = np.zeros((n + 2 * m + 1, b), np.float32)
        state[-1] = 1
        z, a, c = np.empty((3 * n, b), np.float32), np.empty((3 * n, b), np.float32), np.zeros((n, b), np.float32)
        out = np.zeros((len(x) // 2, len(out_w), b), np.float32)
        k, l = (0, 1) if d == "f" else (1, 0)
        was = -1
        for i in range(len(out)):
            if i % 8 == 0 and (lo := int(np.searchsorted(size, 2 * i, side="right"))) != was:
                was = lo
                st, zz, aa, cc = state[:, lo:], z[:, lo:], a[:, lo:], c[:, lo:]
                h, e, e2 = st[:n], st[n : n + m], st[n + m : -1]
                f, g, o = zz[:n], zz[n : 2 * n], zz[2 * n :]
            e[:] = table[:, x[2 * i + k, was:]]
            e2[:] = table[:, x[2 * i + l, was:]]
            np.matmul(w, st, out=zz)
            np.abs(zz, out=aa)
            aa += 1
            zz /= aa
            cc -= g
            f += 1
            f *= 0.5
            cc *= f
            cc += g
            o += 1
            o *= 0.5
            np.multiply(o, cc, out=h)
            np.matmul(out_w, h, out=out[i, :, was:])
        return out

    def decode(self, windows: list[np.ndarray]) -> list[np.ndarray]:
        """The best tag sequence of each window of symbols. Windows are run side by side; one of odd length gets a 0 at its end."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(windows)
        order = sorted((i for i, w in enumerate(windows) if len(w)), key=lambda i: len(windows[i]))
        for k in range(0, len(order), LANES):
            part = order[k : k + LANES]
            size = np.array([len(windows[i]) + len(windows[i]) % 2 for i in part])
            ahead = np.zeros((size.max(), len(part)), np.intp)
            back = np.zeros_like(ahead)
            for j, i in enumerate(part):
                ahead[: len(windows[i]), j] = windows[i]
                back[: size[j], j] = ahead[: size[j], j][::-1]
            e = self._emit(ahead, size, "f")
            r = self._emit(back, size, "b")
            whole = int(np.searchsorted(size, len(ahead)))  # from here on lanes are full
            e[:, :, whole:] += r[::-1, :, whole:]
            for j in range(whole):
                e[: size[j] // 2, :, j] += r[: size[j] // 2, :, j][::-1]
            del r
            path = self._viterbi(e.reshape(len(ahead), self.tags, len(part)), size)
            for j, i in enumerate(part):
                out[i] = path[: len(windows[i]), j]
        return out

    def _viterbi(self, e: np.ndarray, size: np.ndarray) -> np.ndarray:
        """e: (time, tags, batch), overwritten; lanes, sorted by ``size``, end there.

        Scores are taken against the path of tag 0 alone, which has 0: a lane whose best score is 0 holds nothing else."""
        T = self.p["T"] - self.p["T"][0, 0]
        e += self.p["o"][:, None]
        e -= e[:, :1].copy()
        move = np.ascontiguousarray(T[:, :, None])
        e[0] += (self.p["S"] - self.p["S"][0])[:, None]
        for i in range(1, len(e)):
            lo = int(np.searchsorted(size, i, side="right")) if i % 8 == 0 or i == 1 else lo
            e[i, :, lo:] += (e[i - 1, :, None, lo:] + move).max(axis=0)
        path = np.zeros((len(e), e.shape[2]), np.int8)
        lanes = np.arange(e.shape[2])
        end = e[size - 1, :, lanes]
        on = np.flatnonzero(end.max(axis=1) > 0)
        if not len(on):
            return path
        y, size = end[on].argmax(axis=1), size[on]
        path[size - 1, on] = y
        for i in range(len(e) - 1, 0, -1):
            first = int(np.searchsorted(size, i, side="right"))  # lanes that reach so far
            if first < len(on):
                y[first:] = (e[i - 1][:, on[first:]] + T[:, y[first:]]).argmax(axis=0)
                path[i - 1, on[first:]] = y[first:]
        return path

    def _run(self, x: np.ndarray, d: str):
        n, p = self.size, self.p
        b = x.shape[1]
        kind = p["E"].dtype
        h, c, one = np.zeros((n, b), kind), np.zeros((n, b), kind), np.ones((1, b), kind)
        steps = len(x) // 2
        hs, memo = [None] * steps, []
        for i in range(steps) if d == "f" else range(steps - 1, -1, -1):
            into = np.concatenate([h, p["E"][:, x[2 * i]], p["E"][:, x[2 * i + 1]], one])
            z = p["W" + d] @ into
            t = z / (1 + np.abs(z))
            f, g, o = 0.5 * (t[:n] + 1), t[n : 2 * n], 0.5 * (t[2 * n :] + 1)
            before = c
            c = g + f * (c - g)
            h = o * c
            memo.append((i, into, t, f, g, o, before, c))
            hs[i] = h
        return np.stack(hs), memo

    def _step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients for (time, batch) symbols and tags; an even number of rows."""
        p, n, m = self.p, self.size, self.embed
        t, b = x.shape
        runs = {d: self._run(x, d) for d in "fb"}
        e = sum(np.matmul(p["O" + d], runs[d][0]) for d in "fb").reshape(t, self.tags, b).transpose(0, 2, 1) + p["o"]  # (time, batch, tags)
        T = p["T"]
        a = np.empty_like(e)
        a[0] = e[0] + p["S"]
        for i in range(1, t):
            a[i] = _logsumexp(a[i - 1][:, :, None] + T, 1) + e[i]
        z = _logsumexp(a[-1], 1)
        q = np.zeros_like(e)
        dT = np.zeros_like(T)
        rows = np.arange(b)
        for i in range(t - 1, 0, -1):
            pair = a[i - 1][:, :, None] + T + (e[i] + q[i])[:, None, :]
            dT += np.exp(pair - z[:, None, None]).sum(axis=0)
            q[i - 1] = _logsumexp(T + (e[i] + q[i])[:, None, :], 2)
        de = np.exp(a + q - z[:, None])
        gold = p["S"][y[0]] + e[0][rows, y[0]]
        for i in range(t):
            de[i][rows, y[i]] -= 1
            if i:
                gold = gold + T[y[i - 1], y[i]] + e[i][rows, y[i]]
                np.add.at(dT, (y[i - 1], y[i]), -1)
        de /= b
        g = {"T": dT / b, "S": de[0].sum(axis=0), "o": de.sum(axis=(0, 1)), "E": np.zeros_like(p["E"])}
        de = de.transpose(0, 2, 1).reshape(t // 2, 2 * self.tags, b)
        for d in "fb":
            hs, memo = runs[d]
            w = p["W" + d]
            g["O" + d] = np.einsum("tkb,tnb->kn", de, hs)
            dhs = np.matmul(p["O" + d].T, de)
            dW = np.zeros_like(w)
            dh, dc = np.zeros((n, b), w.dtype), np.zeros((n, b), w.dtype)
            symbols, parts = [], []
            for i, into, s, f, gg, o, before, c in reversed(memo):
                dh = dh + dhs[i]
                dc = dc + dh * o
                slope = (1 - np.abs(s)) ** 2
                dz = np.concatenate([0.5 * dc * (before - gg), dc * (1 - f), 0.5 * dh * c]) * slope
                dW += dz @ into.T
                dinto = w.T @ dz
                symbols += [x[2 * i], x[2 * i + 1]]
                parts += [dinto[n : n + m], dinto[n + m : -1]]
                dh, dc = dinto[:n], dc * f
            g["W" + d] = dW
            at, part = np.concatenate(symbols), np.concatenate(parts, axis=1)
            order = np.argsort(at, kind="stable")
            seen, first = np.unique(at[order], return_index=True)
            g["E"][:, seen] += np.add.reduceat(part[:, order], first, axis=1)
        return float((z - gold).mean()), g

    def fit(self, gradients, steps: int, rate: float = 0.01) -> "BiLstmCrf":
        """Adam with a falling rate; ``gradients(self)`` gives a loss and gradients of the next examples. The weights kept are the
        mean of those after each step of the second half."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        mean = {k: np.zeros(w.shape, np.float64) for k, w in self.p.items()}
        self.losses = []
        for step in range(1, steps + 1):
            loss, g = gradients(self)
            self.losses.append(loss)
            lr = rate * min(1.0, step / 50) * max(0.02, 1 - step / steps)
            norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
            for k, w in g.items():
                w = w * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * w
                v[k] = 0.99 * v[k] + 0.01 * w * w
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(self.p[k].dtype)
                if 2 * step > steps:
                    mean[k] += self.p[k]
        self.p = {k: (w / (steps - steps // 2)).astype(self.p[k].dtype) for k, w in mean.items()}
        return self
