"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding. Scores come from graph.py where its
library is installed."""

from __future__ import annotations

import ctypes
from functools import lru_cache
from pathlib import Path

import numpy as np

from casewright.llm import graph

KINDS = ("email", "phone", "identity", "address", "name")
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]

#: Texts are tagged in groups of about this many characters, so memory does not grow with the batch.
GROUP_CHARS = 400_000
#: What a further batch of windows costs, in windows: the calls of its steps.
BATCH_COST = 32

#: Characters with a row of their own; others share the row of their class.
_RANGES = ((0x20, 0x7F), (0xA0, 0x180), (0x400, 0x4A0), (0x5B0, 0x5F5), (0xFF01, 0xFF5F), (0x391, 0x3CA))
_OWN = {chr(c): i for i, c in enumerate(c for a, b in _RANGES for c in range(a, b))}
_CLASSES = len(_OWN)
N_CHARS = _CLASSES + 6


def char_id(c: str) -> int:
    if c in _OWN:
        return _OWN[c]
    if c == "\n":
        return _CLASSES
    return _CLASSES + (1 if c.isdigit() else 2 if c.isupper() else 3 if c.isalpha() else 4 if c.isspace() else 5)


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """char_id of every character of the first plane."""
    return np.array([char_id(chr(c)) for c in range(0x10000)], np.int32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts in one array, each text followed by a gap (a line end), and where each begins and ends."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1) - 1
    return code_points("\n".join([*texts, ""])), ends - sizes, ends


def ids(text: str) -> np.ndarray:
    return ids_of(code_points(text))


def ids_of(c: np.ndarray) -> np.ndarray:
    table = _table()
    if not len(c) or c.max() < len(table):
        return table[c]
    out = table[np.minimum(c, len(table) - 1)]
    far = np.flatnonzero(c >= len(table))
    out[far] = [char_id(chr(x)) for x in c[far].tolist()]
    return out


def batches_of(sizes: np.ndarray, most: int) -> list[slice]:
    """Cuts the windows of ascending sizes into batches of at most `most`. One is closed as soon as the padding of its windows to
    the longest costs more than a further batch would."""
    out, stop = [], len(sizes)
    while stop:
        start = max(0, stop - most)
        padding = np.cumsum(sizes[stop - 1] - sizes[start:stop][::-1])
        n = max(1, int(np.searchsorted(padding, BATCH_COST * sizes[stop - 1], "right")))
        out.append(slice(stop - n, stop))
        stop -= n
    return out


def one_thread() -> None:
    """Limits the linear algebra of this process to one thread: Spark runs a task on every core already, and the small
    products here only make further threads spin. Without a known library nothing changes."""
    for lib in sorted((Path(np.__file__).parent.parent / "numpy.libs").glob("libscipy_openblas*")):
        try:
            ctypes.CDLL(str(lib)).scipy_openblas_set_num_threads64_(1)
        except (OSError, AttributeError):
            pass


# tanh(x) as x * (C + A / (x*x + P) + B / (x*x + Q)), the fourth convergent of its continued fraction in partial
# fractions; from 3.7 on it is 1. The error is under 0.002.
TANH_P, TANH_Q = 14 - 133**0.5, 14 + 133**0.5
TANH_A = (TANH_P * TANH_P - 105 * TANH_P + 945) / (15 * (TANH_Q - TANH_P))
TANH_B = (TANH_Q * TANH_Q - 105 * TANH_Q + 945) / (15 * (TANH_P - TANH_Q))
TANH_C = 1 / 15


def squash(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> None:
    """tanh in place by a few passes over arrays that fit the cache; y and z are room of the same shape."""
    np.multiply(x, x, out=y)
    np.add(y, np.float32(TANH_P), out=z)
    np.divide(np.float32(TANH_A), z, out=z)
    np.add(y, np.float32(TANH_Q), out=y)
    np.divide(np.float32(TANH_B), y, out=y)
    np.add(z, y, out=z)
    np.add(z, np.float32(TANH_C), out=z)
    np.multiply(x, z, out=x)
    np.clip(x, np.float32(-1), np.float32(1), out=x)


class Tagger:
    """Parameters: E (characters x 4H per direction: embedding and input weights in one table), U (H x 4H), b, W (2H x tags),
    c, T (tags x tags), s (start)."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params
        self.h = params["U0"].shape[0]
        self.session = None

    @classmethod
    def fresh(cls, hidden: int = 32, seed: int = 3) -> "Tagger":
        r = np.random.default_rng(seed)
        p = {}
        for d in "01":
            p["E" + d] = (r.standard_normal((N_CHARS, 4 * hidden)) * 0.3).astype(np.float32)
            p["U" + d] = (r.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden) * 0.7).astype(np.float32)
            b = np.zeros(4 * hidden, np.float32)
            b[hidden : 2 * hidden] = 1.0
            p["b" + d] = b
        n = len(TAGS)
        p["W"] = (r.standard_normal((2 * hidden, n)) * 0.1).astype(np.float32)
        p["c"], p["T"], p["s"] = np.zeros(n, np.float32), np.zeros((n, n), np.float32), np.zeros(n, np.float32)
        return cls(p)

    # gates are kept in the order input, forget, output, candidate
    def _run(self, x: np.ndarray, d: str, keep: bool):
        """x: T x B. Hidden states T x B x H of one direction (already in the order of x)."""
        h, (steps, batch) = self.h, x.shape
        table = self.p["E" + d] + self.p["b" + d]
        table = table * np.repeat(np.float32([0.5, 0.5, 0.5, 1]), h)
        u = self.p["U" + d] * np.repeat(np.float32([0.5, 0.5, 0.5, 1]), h)
        state, cell = np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
        out = np.empty((steps, batch, h), np.float32)
        saved = []
        for t in range(steps):
            g = table[x[t]]
            g += state @ u
            np.tanh(g, out=g)
            s = g[:, : 3 * h]
            s *= 0.5
            s += 0.5
            before = cell
            cell = s[:, h : 2 * h] * cell + s[:, :h] * g[:, 3 * h :]
            tc = np.tanh(cell)
            prev = state
            state = s[:, 2 * h :] * tc
            out[t] = state
            if keep:
                saved.append((g, before, tc, prev))
        return out, saved

    def _scores(self, x: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x, back: T x B, the text and what the backward direction reads. Tag scores T x B x tags of the two directions, as
        _run and the output weights give them; both go side by side, with tanh by squash, and all room is taken once."""
        h, (steps, batch) = self.h, x.shape
        half = np.repeat(np.float32([0.5, 0.5, 0.5, 1]), h)
        t0, t1 = (np.ascontiguousarray((self.p["E" + d] + self.p["b" + d]) * half) for d in "01")
        u = np.stack([self.p["U0"] * half, self.p["U1"] * half])
        out = np.empty((steps, 2, batch, h), np.float32)
        g, z, y, q = (np.empty((2, batch, 4 * h), np.float32) for _ in range(4))
        cell, a, b, c = (np.zeros((2, batch, h), np.float32) for _ in range(4))
        state, g0, g1 = np.zeros((2, batch, h), np.float32), g[0], g[1]
        s, i, f, o, new = g[..., : 3 * h], g[..., :h], g[..., h : 2 * h], g[..., 2 * h : 3 * h], g[..., 3 * h :]
        point = np.float32(0.5)
        for t in range(steps):
            np.take(t0, x[t], axis=0, out=g0, mode="clip")
            np.take(t1, back[t], axis=0, out=g1, mode="clip")
            np.matmul(state, u, out=z)
            np.add(g, z, out=g)
            squash(g, y, q)
            np.multiply(s, point, out=s)
            np.add(s, point, out=s)
            np.multiply(cell, f, out=cell)
            np.multiply(i, new, out=a)
            np.add(cell, a, out=cell)
            np.copyto(a, cell)
            squash(a, b, c)
            state = out[t]
            np.multiply(o, a, out=state)
        w = self.p["W"]
        return out[:, 0] @ w[:h], out[:, 1] @ w[h:]

    def _back(self, x: np.ndarray, d: str, saved, dout: np.ndarray, grads: dict) -> None:
        h, u = self.h, self.p["U" + d]
        dstate, dcell = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        de, du = np.zeros_like(self.p["E" + d]), np.zeros_like(u)
        for t in range(len(x) - 1, -1, -1):
            g, before, tc, prev = saved[t]
            i, f, o, c = g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h], g[:, 3 * h :]
            ds = dout[t] + dstate
            dc = dcell + ds * o * (1 - tc * tc)
            dz = np.concatenate([dc * c * i * (1 - i), dc * before * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - c * c)], 1)
            np.add.at(de, x[t], dz)
            du += prev.T @ dz
            dstate = dz @ u.T
            dcell = dc * f
        grads["E" + d], grads["U" + d], grads["b" + d] = de, du, de.sum(0)

    def loss(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood per character of a padded batch (T x B) and its gradients."""
        f, sf = self._run(x, "0", True)
        b, sb = self._run(x[::-1], "1", True)
        b = b[::-1]
        w, trans = self.p["W"], self.p["T"]
        e = f @ w[: self.h] + b @ w[self.h :] + self.p["c"]
        steps, batch, n = e.shape
        rows = np.arange(batch)
        alpha = np.empty_like(e)
        alpha[0] = self.p["s"] + e[0]
        for t in range(1, steps):
            z = alpha[t - 1][:, :, None] + trans
            m = z.max(1)
            a = m + np.log(np.exp(z - m[:, None, :]).sum(1)) + e[t]
            alpha[t] = np.where(mask[t][:, None], a, alpha[t - 1])
        m = alpha[-1].max(1)
        log_z = m + np.log(np.exp(alpha[-1] - m[:, None]).sum(1))
        beta = np.zeros((batch, n), np.float32)
        de, dt = np.zeros_like(e), np.zeros_like(trans)
        for t in range(steps - 1, -1, -1):
            de[t] = np.exp(alpha[t] + beta - log_z[:, None]) * mask[t][:, None]
            if t:
                z = alpha[t - 1][:, :, None] + trans + (e[t] + beta)[:, None, :] - log_z[:, None, None]
                p = np.exp(z) * mask[t][:, None, None]
                dt += p.sum(0)
                q = trans + (e[t] + beta)[:, None, :]
                mq = q.max(2)
                beta = np.where(mask[t][:, None], mq + np.log(np.exp(q - mq[:, :, None]).sum(2)), beta)
        gold = self.p["s"][y[0]] + e[0, rows, y[0]]
        ds = np.exp(alpha[0] + 0) * 0
        for t in range(steps):
            de[t, rows, y[t]] -= mask[t]
            if t:
                gold = gold + mask[t] * (trans[y[t - 1], y[t]] + e[t, rows, y[t]])
                np.add.at(dt, (y[t - 1], y[t]), -mask[t].astype(np.float32))
        total = float(mask.sum())
        de /= total
        grads = {"T": dt / total, "c": de.sum((0, 1)), "s": de[0].sum(0) + ds.sum(0) * 0}
        both = np.concatenate([f, b], 2)
        grads["W"] = both.reshape(-1, 2 * self.h).T @ de.reshape(-1, n)
        dh = de @ w.T
        self._back(x, "0", sf, dh[:, :, : self.h], grads)
        self._back(x[::-1], "1", sb, dh[::-1, :, self.h :], grads)
        return float((log_z - gold).sum() / total), grads

    def train(self, texts: list[str], tags: list[np.ndarray], window: int = 128, batch: int = 96, epochs: int = 6, rate: float = 6e-3, seed: int = 5, seconds: float = 1e9, say=lambda *_: None) -> None:
        """Adam over windows of the labelled texts."""
        import time

        began = time.time()
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            items = []
            for t, y in zip(texts, tags):
                at = -int(rng.integers(0, window)) if len(t) > window else 0
                while at < len(t):
                    lo, hi = max(at, 0), min(at + window, len(t))
                    if hi - lo > 8 or len(t) <= 8:
                        items.append((ids(t[lo:hi]), y[lo:hi]))
                    at += window
            rng.shuffle(items)
            items = [b for i in range(0, len(items), batch * 20) for b in sorted(items[i : i + batch * 20], key=lambda z: len(z[0]))]
            groups = [items[i : i + batch] for i in range(0, len(items), batch)]
            rng.shuffle(groups)
            total = 0.0
            for k, g in enumerate(groups):
                done = max((time.time() - began) / seconds, (epoch + k / len(groups)) / epochs)
                if done >= 1:
                    return
                n = max(len(a) for a, _ in g)
                x, y, mask = np.zeros((n, len(g)), np.int32), np.zeros((n, len(g)), np.int64), np.zeros((n, len(g)), bool)
                for j, (a, b) in enumerate(g):
                    x[: len(a), j], y[: len(a), j], mask[: len(a), j] = a, b, True
                loss, grads = self.loss(x, y, mask)
                total += loss
                size = np.sqrt(sum(float((z * z).sum()) for z in grads.values()))
                step += 1
                for key, z in grads.items():
                    z = z * min(1.0, 1.0 / max(size, 1e-9))
                    m[key] += 0.1 * (z - m[key])
                    v2[key] += 0.003 * (z * z - v2[key])
                    self.p[key] -= (rate * (1 - done) + 2e-4) * (m[key] / (1 - 0.9**step)) / (np.sqrt(v2[key] / (1 - 0.997**step)) + 1e-8)
            say(epoch, total / len(groups), time.time() - began)

    def viterbi(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tag paths (T x B) of B stretches at once; e: T x tags x B, with the scores of what stands before and after. No
        back pointers are kept: on the way back the best predecessor is found anew for the one tag of the path."""
        steps, n, batch = e.shape
        trans = np.ascontiguousarray(self.p["T"][:, :, None])
        scores = np.empty_like(e)
        scores[0] = e[0]
        for t in range(1, steps):
            np.add((scores[t - 1][:, None, :] + trans).max(0), e[t], out=scores[t])
        into = np.ascontiguousarray(self.p["T"].T)
        paths = np.empty((steps, batch), np.uint8)
        rows = np.arange(batch)
        tag = scores[lengths - 1, :, rows].argmax(1)
        paths[steps - 1] = tag
        for t in range(steps - 2, -1, -1):
            before = (scores[t].T + into[tag]).argmax(1)
            tag = np.where(t < lengths - 1, before, tag)
            paths[t] = tag
        return paths

    def _open(self, e: np.ndarray, first: np.ndarray, last: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """Whether the best path can be inside a piece at each place of e (places x tags; texts, each followed by a gap).

        A run of inner tags between outer ones scores at most the sum of `gain` over its places, plus `edge`, more than outer
        tags in its stead. A place that is in no run for which this is above zero is outside on the best path."""
        trans, s = self.p["T"].astype(float), self.p["s"].astype(float)
        most = trans[1:, 1:].max() - trans[0, 0]
        enter, leave = trans[0, 1:].max() - trans[0, 0], trans[1:, 0].max() - trans[0, 0]
        inner = np.empty(len(e), e.dtype)
        for lo in range(0, len(e), 8192):  # parts that fit the cache
            part, top = e[lo : lo + 8192], inner[lo : lo + 8192]
            np.copyto(top, part[:, 1])
            for k in range(2, e.shape[1]):
                np.maximum(top, part[:, k], out=top)
        gain = (inner - e[:, 0]).astype(float) + most
        gain[first] += max(0.0, (s[1:] - s[0]).max() - enter)
        gain[last] += max(0.0, -leave)
        gain[gaps] = 0
        gain[gaps] = -1 - np.maximum(gain, 0).sum()  # no run over a gap is ever the best
        total = np.concatenate([[0.0], np.cumsum(gain)])
        best = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
        out = best + enter + leave - most > -1e-3  # for rounding
        out[gaps] = False
        return out

    def decode(self, e: np.ndarray, first: np.ndarray, last: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """Best tag of each place of e, laid out as for _open: the stretches that are open are decoded by viterbi, what lies
        between them is outside."""
        out = np.zeros(len(e), np.uint8)
        is_open = np.concatenate([[False], self._open(e, first, last, gaps), [False]])
        starts, stops = np.flatnonzero(~is_open[:-1] & is_open[1:]), np.flatnonzero(is_open[:-1] & ~is_open[1:])
        at_first, at_last = np.isin(starts, first), np.isin(stops - 1, last)
        order = np.argsort(stops - starts, kind="stable")
        while len(order):
            # The longest stretch of a part sets its padded length: at most GROUP_CHARS / 8 places, or one stretch.
            n = min(512, max(1, GROUP_CHARS // 8 // int(stops[order[-1]] - starts[order[-1]])))
            part, order = order[-n:], order[:-n]
            lengths, rows = stops[part] - starts[part], np.arange(len(part))
            steps = np.arange(lengths.max())[:, None]
            places = np.minimum(starts[part] + steps, stops[part] - 1)
            x = e[places]
            x[0] += np.where(at_first[part, None], self.p["s"], self.p["T"][0])
            x[lengths - 1, rows] += np.where(at_last[part, None], np.float32(0), self.p["T"][:, 0])
            paths = self.viterbi(np.ascontiguousarray(x.transpose(0, 2, 1)), lengths)
            inside = steps < lengths
            out[places[inside]] = paths[inside]
        return out

    def tag(self, texts: list[str], window: int = 256, overlap: int = 32, batch: int = 384) -> list[np.ndarray]:
        """Tags of whole texts: overlapping windows are scored, the scores of the overlaps are blended by distance to
        the window's edge, and one best path is decoded over each whole text."""
        return [t[a:b] for starts, ends, t in self.groups(texts, window, overlap, batch) for a, b in zip(starts.tolist(), ends.tolist())]

    def groups(self, texts: list[str], window: int = 256, overlap: int = 32, batch: int = 384):
        """Yields the tags of the texts, in order, as joined lays them out (starts, ends, tags; a gap is outside). Texts go in
        groups of GROUP_CHARS characters or of one text, and only windows of like length are padded to one another."""
        group, chars = [], 0
        for t in texts:
            if group and chars + len(t) > GROUP_CHARS:
                yield self._tag(group, window, overlap, batch)
                group, chars = [], 0
            group.append(t)
            chars += len(t)
        yield self._tag(group, window, overlap, batch)

    def _tag(self, texts: list[str], window: int, overlap: int, batch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, starts, ends = joined(texts)
        coded, sizes = ids_of(codes), ends - starts
        merged = np.zeros((len(coded), len(TAGS)), np.float32)
        weight = np.ones((len(coded), 1), np.float32)
        # Windows: their first places, and the ends of their texts.
        many = np.maximum(-(-(sizes - overlap) // (window - overlap)), 1)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        first, stop = np.repeat(starts, many) + nth * (window - overlap), np.repeat(ends, many)
        size, whole = np.minimum(stop - first, window), np.repeat(many == 1, many) & (np.repeat(sizes, many) <= window)
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        first, size, whole = first[order], size[order], whole[order]
        ramps: dict[int, np.ndarray] = {}
        for part in batches_of(size, batch):
            at, n, alone = first[part], size[part], whole[part]
            steps = np.arange(n[-1])[:, None]
            x = np.where(steps < n, coded[np.minimum(at + steps, len(coded) - 1)], np.int32(0))
            e = np.ascontiguousarray(self._masked(x, n).transpose(1, 0, 2))
            if alone.any():
                inside = steps.T < n[alone, None]
                merged[(at[alone, None] + steps.T)[inside]] = e[alone][inside]
            for j in np.flatnonzero(~alone).tolist():
                k = int(n[j])
                to = slice(int(at[j]), int(at[j]) + k)
                w = ramps.get(k)
                if w is None:
                    w = ramps[k] = np.minimum(np.arange(k) + 1, np.arange(k, 0, -1)).clip(max=overlap).astype(np.float32)[:, None]
                merged[to] += e[j, :k] * w
                weight[to] += w
        for i in np.flatnonzero(sizes > window):
            merged[starts[i] : ends[i]] /= weight[starts[i] : ends[i]] - 1
        some = sizes > 0
        return starts, ends, self.decode(merged, starts[some], ends[some] - 1, ends)

    def _both(self, x: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What _scores gives, by the inference library where there is one."""
        if self.session is None:
            self.session = graph.session(self.p) or False
        if not self.session:
            return self._scores(x, back)
        return self.session.run(None, {"x0": x, "x1": np.ascontiguousarray(back), "start": np.zeros((x.shape[1], self.h), np.float32)})

    def _masked(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tag scores of a padded batch; the backward direction reads each text reversed from its own end."""
        if (sizes == len(x)).all():
            f, b = self._both(x, x[::-1])
            f += b[::-1]
        else:
            steps = np.arange(len(x))[:, None]
            turn = np.where(steps < sizes, sizes - 1 - steps, steps)
            f, b = self._both(x, np.take_along_axis(x, turn, 0))
            f += np.take_along_axis(b, turn[:, :, None], 0)
        f += self.p["c"]
        return f

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})

    @classmethod
    def load(cls, path: str) -> "Tagger":
        with np.load(path) as z:
            return cls({k: z[k].astype(np.float32) for k in z.files})
