"""A bidirectional gated recurrent network with attention pooling, in numpy, with its training."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from voxtab.llm.common import words_of

#: Words in a window, and words from the start of one window to that of the next.
WINDOW, STRIDE = 40, 20
WORD_ROWS, CHAR_ROWS, WORD_DIM, CHAR_DIM = 1 << 14, 1 << 14, 8, 16
HIDDEN, ATTENTION = 10, 8
#: Parameters of which a step uses few rows.
TABLES = ("word", "char")
FLOOR = 0.005
#: Weights shrink by this times the rate at every step.
DECAY = 0.02
#: Windows run at once.
AT_ONCE = 4096


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return (np.tanh(x * 0.5) + 1) * 0.5


class Words:
    """Distinct words of some texts: a row of the word table, and rows of the character table.

    The characters of a word come in as the 3 and the 5 bytes from each of its places on;
    a blank stands before the word and blanks after it.
    """

    def __init__(self, texts: list[bytes]):
        lists = [words_of(t) for t in texts]
        self.counts = np.array([len(x) for x in lists], np.int64)
        flat = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
        self.codes = flat.indices.to_numpy().astype(np.int64)
        distinct = flat.dictionary.to_pylist()
        self.word = np.array([zlib.crc32(w) for w in distinct], np.int64) % WORD_ROWS
        raw = np.frombuffer(b"".join(b" %b    " % w for w in distinct), np.uint8).astype(np.int64)
        sizes = np.array([len(w) for w in distinct], np.int64)
        begins = np.cumsum(sizes + 5) - sizes - 5
        at = np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
        three = raw[at] * 961 + raw[at + 1] * 31 + raw[at + 2] if len(at) else at
        five = (three * 31 + raw[at + 3]) * 31 + raw[at + 4] + 7 if len(at) else at
        self.char = (np.stack([three, five], 1).ravel() * 2654435761 >> 16) % CHAR_ROWS
        self.pieces = 2 * sizes
        self.char_of = np.repeat(np.arange(len(distinct)), self.pieces)
        self.char_at = np.cumsum(self.pieces) - self.pieces

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Text of each window, and its words as numbers into the distinct ones, -1 after the end.

        The windows of a text overlap and cover it; one that adds no word is left out.
        """
        n = np.maximum(0, -(-(self.counts - WINDOW) // STRIDE)) + (self.counts > 0)
        text = np.repeat(np.arange(len(n)), n)
        start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
        place = start[:, None] + np.arange(WINDOW)
        begins = np.cumsum(self.counts) - self.counts
        inside = place < self.counts[text][:, None]
        if not len(text):
            return text, np.zeros((0, WINDOW), np.int64)
        found = self.codes[np.minimum(begins[text][:, None] + place, len(self.codes) - 1)]
        return text, np.where(inside, found, -1)


class Gru:
    """Word and character tables, two recurrences, attention, and one output."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        dim = WORD_DIM + CHAR_DIM

        def some(*shape: int, scale: float = 0.0) -> np.ndarray:
            return (r.standard_normal(shape) * (scale or shape[0] ** -0.5)).astype(np.float32)

        self.p = {"word": np.zeros((WORD_ROWS, WORD_DIM), np.float32), "char": some(CHAR_ROWS, CHAR_DIM, scale=0.1),
                  "va": some(ATTENTION), "wa": some(2 * HIDDEN, ATTENTION), "ba": np.zeros(ATTENTION, np.float32),
                  "wo": some(2 * HIDDEN), "bo": np.full(1, -1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": some(dim, 3 * HIDDEN), f"u{d}": some(HIDDEN, 3 * HIDDEN),
                       f"c{d}": np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, words: Words) -> np.ndarray:
        """Of each distinct word, its own row beside the mean of its characters' rows."""
        chars = np.add.reduceat(self.p["char"][words.char], words.char_at) / words.pieces[:, None] \
            if len(words.pieces) else np.zeros((0, CHAR_DIM))
        return np.concatenate([self.p["word"][words.word], chars], 1).astype(np.float32)

    def _recur(self, d: str, proj: np.ndarray, ids: np.ndarray, kept: list | None) -> np.ndarray:
        u, steps = self.p[f"u{d}"], range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1)
        h = np.zeros((len(ids), HIDDEN), np.float32)
        out = np.empty((WINDOW, len(ids), HIDDEN), np.float32)
        for t in steps:
            g, x = h @ u, proj[ids[:, t]]
            zr = _sigmoid(x[:, :2 * HIDDEN] + g[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN:] + r * g[:, 2 * HIDDEN:])
            new = n + z * (h - n)
            if (ended := ids[:, t] < 0).any():
                new[ended] = h[ended]
            if kept is not None:
                kept.append((t, h, z, r, n, g[:, 2 * HIDDEN:]))
            h = new
            out[t] = h
        return out

    def forward(self, x: np.ndarray, ids: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Logit of every window; x: inputs of the distinct words."""
        states = []
        for d in "fb":
            own = None if kept is None else kept.setdefault(d, [])
            states.append(self._recur(d, x @ self.p[f"w{d}"] + self.p[f"c{d}"], ids, own))
        h = np.concatenate(states, 2)
        a = np.tanh(h @ self.p["wa"] + self.p["ba"])
        s = np.where(ids.T >= 0, a @ self.p["va"], -1e9)
        e = np.exp(s - s.max(0))
        e /= e.sum(0)
        pooled = np.einsum("tb,tbh->bh", e, h)
        if kept is not None:
            kept |= {"h": h, "a": a, "e": e, "pooled": pooled}
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def gradient(self, words: Words, ids: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
        """Gradient of the weighted log loss over some windows."""
        used, local = np.unique(ids, return_inverse=True)
        local = local.reshape(ids.shape) - (used[0] < 0)
        used = used[used >= 0]
        x_all = self._x[used]
        kept: dict = {}
        p = self.p
        dlog = ((_sigmoid(self.forward(x_all, local, kept)) - label) * weight / weight.sum()).astype(np.float32)
        h, a, e = kept["h"], kept["a"], kept["e"]
        grad = {"wo": kept["pooled"].T @ dlog, "bo": np.array([dlog.sum()])}
        dpool = dlog[:, None] * p["wo"]
        dh = e[:, :, None] * dpool
        de = np.einsum("tbh,bh->tb", h, dpool)
        ds = e * (de - (e * de).sum(0))
        grad["va"] = np.einsum("tb,tba->a", ds, a)
        da = ds[:, :, None] * p["va"] * (1 - a * a)
        grad["wa"], grad["ba"] = np.einsum("tbh,tba->ha", h, da), da.sum((0, 1))
        dh += da @ p["wa"].T
        dx = np.zeros_like(x_all)
        order = np.argsort(local.T, axis=None, kind="stable")
        flat = local.T.reshape(-1)[order]
        order, flat = order[flat >= 0], flat[flat >= 0]
        starts = np.searchsorted(flat, np.arange(len(x_all)))
        for k, d in enumerate("fb"):
            u, du = p[f"u{d}"], np.zeros_like(p[f"u{d}"])
            each = np.empty((WINDOW, len(ids), 3 * HIDDEN), np.float32)
            back = np.zeros((len(ids), HIDDEN), np.float32)
            for t, h0, z, r, n, gn in reversed(kept[d]):
                full = back + dh[t, :, k * HIDDEN:(k + 1) * HIDDEN]
                live = (local[:, t] >= 0)[:, None]
                dn = full * (1 - z) * (1 - n * n) * live
                dz = full * (h0 - n) * z * (1 - z) * live
                dr = dn * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], 1)
                du += h0.T @ dg
                back = np.where(live, full * z, full) + dg @ u.T
                each[t] = np.concatenate([dz, dr, dn], 1)
            dproj = np.add.reduceat(each.reshape(-1, 3 * HIDDEN)[order], starts)
            grad[f"u{d}"], grad[f"c{d}"] = du, dproj.sum(0)
            grad[f"w{d}"] = x_all.T @ dproj
            dx += dproj @ p[f"w{d}"].T
        grad["word"] = np.zeros_like(p["word"])
        np.add.at(grad["word"], words.word[used], dx[:, :WORD_DIM])
        share = np.zeros((len(words.pieces), CHAR_DIM), np.float32)
        share[used] = dx[:, WORD_DIM:] / words.pieces[used][:, None]
        own = np.isin(words.char_of, used)
        grad["char"] = np.zeros_like(p["char"])
        np.add.at(grad["char"], words.char[own], share[words.char_of[own]])
        return grad

    def _update(self, grad: dict, rate: float) -> None:
        """One step of Adam.

        In a table the second moment of a number is at least ``FLOOR`` of the largest.
        Otherwise a word of a single text would move as far as one that all texts with a
        label share, and the network would learn its texts by heart.
        """
        if not hasattr(self, "_m"):
            self._m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
            self._n = 0
        self._n += 1
        for k, g in grad.items():
            m, v = self._m[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            spread = np.maximum(v, FLOOR * v.max()) if k in TABLES else v
            self.p[k] = (self.p[k] * (1 - rate * DECAY) - rate * (m / (1 - 0.9 ** self._n)) / (
                np.sqrt(spread / (1 - 0.999 ** self._n)) + 1e-8)).astype(np.float32)

    def train(self, texts: list[bytes], label: np.ndarray, seed: int = 0, first: int = 3, more: int = 8,
              batch: int = 512, least_steps: int = 8, rate: float = 0.01) -> None:
        """Learn from labelled texts.

        First every window takes its text's label. Then a text is judged by its
        highest window: that window of a text labelled 1 is taught as 1; of a text
        labelled 0 the highest window, all others that score too high and some more
        are taught as 0. A step takes ``batch`` windows, fewer if an epoch had less than
        ``least_steps`` of them.
        """
        words, r = Words(texts), np.random.default_rng(seed)
        text, ids = words.windows()
        if not len(text) or not 0 < label.sum() < len(label):
            self.p["wo"][:] = 0
            self.p["bo"][:] = 8 if len(label) and label.all() else -8
            return
        for epoch in range(first + more):
            if epoch < first:
                own = np.concatenate([np.flatnonzero(label[text] == 1), r.permutation(np.flatnonzero(
                    label[text] == 0))[:int((label[text] == 1).sum()) + 1]])
            else:
                score = self.logits(words, ids)
                order = np.lexsort([-score, text])
                top = order[np.r_[True, text[order][1:] != text[order][:-1]]]
                clean = label[text] == 0
                other = r.permutation(np.flatnonzero(clean))[:int((label == 0).sum())]
                own = np.unique(np.concatenate([top, other, np.flatnonzero(clean & (score > -1.5))]))
            own = r.permutation(own)
            y = label[text[own]]
            weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
            size = min(batch, max(32, len(own) // least_steps))
            for k in range(0, len(own), size):
                part = slice(k, k + size)
                self._x = self.inputs(words)
                self._update(self.gradient(words, ids[own[part]], y[part], weight[part]),
                             rate * (1 if epoch < first + more // 2 else 0.3))
        del self._x, self._m

    def logits(self, words: Words, ids: np.ndarray) -> np.ndarray:
        x = self.inputs(words)
        return np.concatenate([np.zeros(0, np.float32), *[
            self.forward(x, ids[k:k + AT_ONCE]) for k in range(0, len(ids), AT_ONCE)]])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Of each text, the highest score of its windows; 0 for a text without words."""
        words = Words(texts)
        text, ids = words.windows()
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, self.logits(words, ids))
        return np.where(np.isfinite(best), _sigmoid(np.where(np.isfinite(best), best, 0)), 0.0)
