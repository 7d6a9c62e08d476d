"""Recurrent block labeller: a bidirectional LSTM in numpy over a page's leaf blocks.

A block's vector is the mean of learned vectors of its hashed path tokens, the mean of those of its hashed words, and a
few counts. The network reads the whole sequence in both directions, so each block is judged in the page's context.
Sizes are fixed, so the weights are a few hundred kB whatever the corpus.
"""

from __future__ import annotations

import zlib
from math import log

import numpy as np

from .html_blocks import Block
from .shingles import word_hashes

TAGS, WORDS, WIDTH, COUNTS, HIDDEN = 1024, 512, 12, 8, 16
INPUT = 2 * WIDTH + COUNTS
_tag_slot: dict[str, int] = {}


def tag_slot(token: str) -> int:
    if token not in _tag_slot:
        if len(_tag_slot) > 100_000:
            _tag_slot.clear()
        _tag_slot[token] = zlib.crc32(token.encode()) % TAGS
    return _tag_slot[token]


class Features:
    """Hashed tokens and counts of all blocks of some pages, as flat arrays."""

    def __init__(self, pages: list[list[Block]]):
        blocks = [b for p in pages for b in p]
        self.lengths = np.array([len(p) for p in pages], dtype=np.int64)
        tags = [[tag_slot(t) for t in b.path] or [0] for b in blocks]
        self.tags, self.tag_at = self._flat(tags)
        hashes, before, _, _ = word_hashes([b.text.lower().encode() for b in blocks])
        self.words = (hashes % np.uint64(WORDS)).astype(np.int64)
        self.word_at = before
        counts = np.zeros((len(blocks), COUNTS), dtype=np.float32)
        i = 0
        for page in pages:
            for k, b in enumerate(page):
                n = len(b.text)
                counts[i] = (
                    log(1 + n) / 8, min(1.0, b.link_chars / n), min(1.0, 20 * (b.text.count(". ") + b.text.endswith(".")) / n), min(1.0, 10 * b.text.count(",") / n),
                    k / len(page), len(b.path) / 24, n < 40, 1,
                )
                i += 1
        self.counts = counts

    @staticmethod
    def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return np.array([y for x in lists for y in x], dtype=np.int64), at


def _means(table: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros((len(at) - 1, table.shape[1]), dtype=np.float32)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = np.add.reduceat(table[ids], at[some], axis=0) / np.diff(at)[some, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Labeller:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "tags": (r.normal(0, 0.3, (TAGS, WIDTH))).astype(f), "words": (r.normal(0, 0.1, (WORDS, WIDTH))).astype(f),
            "out": (r.normal(0, 0.3, 2 * HIDDEN)).astype(f), "bias": np.zeros(1, f), "skip": (r.normal(0, 0.1, INPUT)).astype(f),
        }
        for d in ("f", "b"):
            self.p[f"w{d}"] = r.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * HIDDEN)).astype(f)
            self.p[f"u{d}"] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(f)
            self.p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(f)

    def inputs(self, x: Features) -> np.ndarray:
        return np.concatenate([_means(self.p["tags"], x.tags, x.tag_at), _means(self.p["words"], x.words, x.word_at), x.counts], axis=1)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states (T, B, H); the backward direction gets reversed time from the caller."""
        steps, size = x.shape[:2]
        h, c = np.zeros((size, HIDDEN), np.float32), np.zeros((size, HIDDEN), np.float32)
        pre = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
        out = np.zeros((steps, size, HIDDEN), np.float32)
        for t in range(steps):
            z = pre[t] + h @ self.p[f"u{d}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            m = mask[t][:, None]
            if keep is not None:
                keep.append((h, c, i, f, o, g, new, m))
            c = np.where(m, new, c)
            h = np.where(m, o * np.tanh(new), h)
            out[t] = h
        return out

    def _pad(self, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(T, B, INPUT), mask, and the flat places as t * B + b."""
        steps, size = int(lengths.max()), len(lengths)
        owner = np.repeat(np.arange(size), lengths)
        t = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        padded = np.zeros((steps, size, x.shape[1]), np.float32)
        padded[t, owner] = x
        mask = np.zeros((steps, size), bool)
        mask[t, owner] = True
        return padded, mask, t * size + owner

    def scores(self, x: Features) -> np.ndarray:
        """Log-odds of every block to be article text. Pages without blocks take no part."""
        out = np.zeros(int(x.lengths.sum()), np.float32)
        flat = self.inputs(x)
        starts = np.cumsum(x.lengths) - x.lengths
        pages = np.flatnonzero(x.lengths)
        pages = pages[np.argsort(x.lengths[pages], kind="stable")]  # pages of like length together
        lo = 0
        while lo < len(pages):
            hi = lo + 1
            while hi < len(pages) and (hi - lo) < 1024 and (hi - lo + 1) * int(x.lengths[pages[hi]]) <= 40_000:
                hi += 1
            own = pages[lo:hi]
            at = np.concatenate([np.arange(starts[p], starts[p] + x.lengths[p]) for p in own])
            padded, mask, where = self._pad(flat[at], x.lengths[own])
            f = self._run("f", padded, mask, None)
            b = self._run("b", padded[::-1], mask[::-1], None)[::-1]
            z = np.concatenate([f, b], axis=2) @ self.p["out"] + padded @ self.p["skip"] + self.p["bias"]
            out[at] = z.reshape(-1)[where]
            lo = hi
        return out

    def _back(self, d: str, x: np.ndarray, kept: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        dz_all = np.zeros((len(x), x.shape[1], 4 * HIDDEN), np.float32)
        du = np.zeros_like(self.p[f"u{d}"])
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, new, m = kept[t]
            total = dh + dout[t]
            th = np.tanh(new)
            live, still = np.where(m, total, 0), np.where(m, 0, total)
            dnew = np.where(m, dc, 0) + live * o * (1 - th * th)
            dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), live * th * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            du += h.T @ dz
            dh = dz @ self.p[f"u{d}"].T + still
            dc = dnew * f + np.where(m, 0, dc)
        grad[f"u{d}"] = du
        grad[f"c{d}"] = dz_all.sum(axis=(0, 1))
        grad[f"w{d}"] = np.tensordot(x, dz_all, axes=([0, 1], [0, 1]))
        return dz_all @ self.p[f"w{d}"].T

    def gradients(self, x: Features, labels: np.ndarray) -> tuple[float, dict]:
        """Mean log-loss over the blocks of ``x`` and its gradient."""
        flat = self.inputs(x)
        padded, mask, where = self._pad(flat, x.lengths)
        kf, kb = [], []
        f = self._run("f", padded, mask, kf)
        b = self._run("b", padded[::-1], mask[::-1], kb)[::-1]
        both = np.concatenate([f, b], axis=2)
        z = (both @ self.p["out"] + padded @ self.p["skip"] + self.p["bias"]).reshape(-1)[where]
        p = _sigmoid(z)
        loss = float(-np.mean(np.where(labels, np.log(p + 1e-9), np.log(1 - p + 1e-9))))
        dz = np.zeros(mask.size, np.float32)
        dz[where] = (p - labels) / len(labels)
        dz = dz.reshape(mask.shape)
        grad = {"out": np.tensordot(dz, both, axes=([0, 1], [0, 1])), "bias": np.array([dz.sum()], np.float32), "skip": np.tensordot(dz, padded, axes=([0, 1], [0, 1]))}
        dboth = dz[:, :, None] * self.p["out"]
        dx = dz[:, :, None] * self.p["skip"]
        dx = dx + self._back("f", padded, kf, dboth[:, :, :HIDDEN], grad)
        dx = dx + self._back("b", padded[::-1], kb, dboth[::-1, :, HIDDEN:], grad)[::-1]
        dflat = dx.reshape(-1, INPUT)[where]
        for name, ids, at, lo in (("tags", x.tags, x.tag_at, 0), ("words", x.words, x.word_at, WIDTH)):
            n = np.diff(at)
            share = np.repeat(dflat[:, lo : lo + WIDTH] / np.maximum(n, 1)[:, None], n, axis=0)
            grad[name] = np.zeros_like(self.p[name])
            np.add.at(grad[name], ids, share)
        return loss, grad

    def fit(self, pages: list[list[Block]], labels: list[np.ndarray], epochs: int, batch: int = 48, rate: float = 0.01, seed: int = 2) -> float:
        """Adam over seeded batches; returns the mean loss of the last epoch."""
        some = [k for k, p in enumerate(pages) if p]
        r, step, loss = np.random.default_rng(seed), 0, [0.0]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        some.sort(key=lambda k: len(pages[k]))
        parts = [some[i : i + batch] for i in range(0, len(some), batch)]
        ready = [(Features([pages[k] for k in part]), np.concatenate([labels[k] for k in part]).astype(np.float32)) for part in parts]
        for _ in range(epochs):
            loss = []
            for i in r.permutation(len(ready)):
                value, grad = self.gradients(*ready[i])
                loss.append(value)
                step += 1
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return float(np.mean(loss))
