"""A small byte-level convolutional network in numpy.

Bytes are embedded, filters of several widths slide over a window of fixed
length, each filter keeps its maximum over the window, the windows of a
document are averaged and a softmax layer gives the class probabilities.
Training is minibatch Adam with exact gradients; the gradient of a maximum
flows only to the position that attained it, so the backward pass costs
little beside the forward pass.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np

#: Windows convolved at once: the product stays inside a core's cache.
BLOCK = 16
#: Windows whose gradients are added up at once.
SLICE = 2048
#: Threads that training's convolutions are dealt to.
THREADS = 4


@dataclass
class Shape:
    classes: int
    window: int = 256
    dims: int = 8
    widths: tuple[int, ...] = (2, 3, 4, 5)
    filters: int = 12  # for each width

    @property
    def reach(self) -> int:
        return max(self.widths)

    @property
    def stride(self) -> int:
        """Neighbouring windows overlap so that no n-gram of the text falls between them."""
        return self.window - self.reach + 1

    @property
    def features(self) -> int:
        return self.filters * len(self.widths)


def cut(texts: list[bytes], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A padded buffer, the start of every window in it and each text's first window.

    The windows cover every byte of every text; an empty text has one blank window.
    """
    blank = bytes(shape.window)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    counts = np.maximum(1, -(-(sizes - shape.reach + 1) // shape.stride))
    buffer = np.frombuffer(b"".join(part for t in texts for part in (t, blank)), np.uint8)
    base = np.concatenate([[0], np.cumsum(sizes + shape.window)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    starts = np.repeat(base, counts) + (np.arange(first[-1]) - np.repeat(first[:-1], counts)) * shape.stride
    return buffer, starts, first


def windows(buffer: np.ndarray, starts: np.ndarray, shape: Shape) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(buffer, shape.window)[starts]


@dataclass
class Network:
    shape: Shape
    embed: np.ndarray = field(repr=False)
    kernel: np.ndarray = field(repr=False)  # (reach * dims, features), zero beyond a filter's width
    bias: np.ndarray = field(repr=False)
    dense: np.ndarray = field(repr=False)
    offset: np.ndarray = field(repr=False)

    @classmethod
    def fresh(cls, shape: Shape, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.5, (256, shape.dims)).astype(np.float32)
        embed[0] = 0
        kernel = rng.normal(0, 1, (shape.reach * shape.dims, shape.features)).astype(np.float32)
        kernel *= shape_mask(shape)
        kernel /= np.sqrt((kernel**2).sum(0, keepdims=True)) * 0.7
        return cls(shape, embed, kernel, np.zeros(shape.features, np.float32), np.zeros((shape.features, shape.classes), np.float32), np.zeros(shape.classes, np.float32))

    def pooled(self, x: np.ndarray, places: bool = False, pool: ThreadPoolExecutor | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's maximum over each window of x (count, window), and where it was attained."""
        s = self.shape
        span = s.window - s.reach + 1
        out = np.empty((len(x), s.features), self.kernel.dtype)
        at = np.empty((len(x), s.features), np.int32) if places else None

        def convolve(low: int, high: int) -> None:
            for lo in range(low, high, BLOCK):
                part = x[lo : min(high, lo + BLOCK)]
                hi = lo + len(part)
                flat = self.embed[part].reshape(len(part), s.window * s.dims)
                rows = np.lib.stride_tricks.as_strided(flat, (len(part), span, s.reach * s.dims), (flat.strides[0], s.dims * flat.itemsize, flat.itemsize))
                seen = (rows.reshape(-1, s.reach * s.dims) @ self.kernel).reshape(len(part), span, s.features)
                if places:
                    at[lo:hi] = seen.argmax(1)
                    out[lo:hi] = np.take_along_axis(seen, at[lo:hi][:, None], 1)[:, 0]
                else:
                    out[lo:hi] = seen.max(1)

        if pool:
            edges = np.linspace(0, len(x), THREADS + 1).astype(int)
            for _ in pool.map(convolve, edges[:-1], edges[1:]):
                pass
        else:
            convolve(0, len(x))
        out += self.bias
        np.maximum(out, 0, out=out)
        return out, at

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(texts, classes): over the whole of every text, in blocks of bounded size."""
        out = np.empty((len(texts), self.shape.classes))
        lo = 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held + len(texts[hi]) < 4_000_000):
                held += len(texts[hi])
                hi += 1
            buffer, starts, first = cut(texts[lo:hi], self.shape)
            sums = np.zeros((hi - lo, self.shape.features))
            owner = np.repeat(np.arange(hi - lo), np.diff(first))
            for a in range(0, len(starts), 4096):
                seen, _ = self.pooled(windows(buffer, starts[a : a + 4096], self.shape))
                own = owner[a : a + 4096]
                edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                sums[own[edges]] += np.add.reduceat(seen, edges, axis=0, dtype=np.float64)
            out[lo:hi] = softmax(sums / np.diff(first)[:, None] @ self.dense + self.offset)
            lo = hi
        return out

    def gradients(self, x: np.ndarray, counts: np.ndarray, target: np.ndarray, weight: np.ndarray, decay: float, pool: ThreadPoolExecutor | None = None) -> list[np.ndarray]:
        """Of the weighted mean loss (and decay * |dense|^2 / 2) in embed, kernel, bias, dense and offset.

        x: the windows of the documents one after another; counts: how many each document has.
        """
        s = self.shape
        lead = np.cumsum(counts) - counts
        seen, at = self.pooled(x, places=True, pool=pool)
        mean = np.add.reduceat(seen, lead, axis=0) / counts[:, None]
        p = softmax(mean @ self.dense + self.offset)
        p[np.arange(len(target)), target] -= 1
        g = (p * (weight / weight.sum())[:, None]).astype(self.dense.dtype)
        push = (g @ self.dense.T) / counts[:, None]
        own = np.repeat(np.arange(len(counts)), counts)
        # What every byte at every tap of a filter has passed back: both the filters' and the bytes' gradients are products of it.
        pairs = s.features * s.reach
        spots = np.arange(pairs).reshape(s.features, s.reach)
        passed, gb = np.zeros(256 * pairs), np.zeros_like(self.bias)
        for lo in range(0, len(x), SLICE):
            part = x[lo : lo + SLICE]
            back = push[own[lo : lo + SLICE]] * (seen[lo : lo + SLICE] > 0)
            codes = part[np.arange(len(part))[:, None, None], at[lo : lo + SLICE, :, None] + np.arange(s.reach)]  # (windows, features, reach)
            passed += np.bincount((codes * np.int64(pairs) + spots).reshape(-1), np.repeat(back.reshape(-1), s.reach), 256 * pairs)
            gb += back.sum(0)
        passed = passed.reshape(256, pairs)
        gk = (self.embed.T @ passed).reshape(s.dims, s.features, s.reach).transpose(2, 0, 1).reshape(self.kernel.shape) * shape_mask(s)
        ge = passed @ self.kernel.reshape(s.reach, s.dims, s.features).transpose(2, 0, 1).reshape(pairs, s.dims)
        ge[0] = 0
        return [ge.astype(self.embed.dtype), gk.astype(self.kernel.dtype), gb, mean.T.astype(self.dense.dtype) @ g + decay * self.dense, g.sum(0)]

    def fit(self, texts: list[bytes], target: np.ndarray, weight: np.ndarray, *, epochs: int, batch: int, rate: float, decay: float, seed: int, steps: int = 0, visits: int = 0) -> Network:
        """Learn from the whole of every text, in minibatches of documents.

        Small samples are gone through more often than `epochs` times, until `steps` batches are done or `visits` windows seen.
        """
        rng = np.random.default_rng(seed)
        buffer, starts, first = cut(texts, self.shape)
        epochs = max(epochs, min(-(-steps // -(-len(target) // batch)), -(-visits // len(starts))))
        held = [self.embed, self.kernel, self.bias, self.dense, self.offset]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in held]
        step, total = 0, max(1, epochs * -(-len(target) // batch))
        with ThreadPoolExecutor(THREADS) as pool:
            for _ in range(epochs):
                for ids in np.array_split(order := rng.permutation(len(target)), max(1, -(-len(order) // batch))):
                    counts = np.diff(first)[ids]
                    lead = np.cumsum(counts) - counts
                    places = np.repeat(first[ids] - lead, counts) + np.arange(counts.sum())
                    grads = self.gradients(windows(buffer, starts[places], self.shape), counts, target[ids], weight[ids], decay, pool)
                    step += 1
                    now = rate * min(1, step / 30) * (1 - 0.9 * step / total)
                    for q, d, (m, v) in zip(held, grads, moments, strict=True):
                        m += 0.1 * (d - m)
                        v += 0.01 * (d * d - v)
                        q -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def shape_mask(shape: Shape) -> np.ndarray:
    """1 where a filter has a tap: the filters of width w have their first w taps."""
    mask = np.zeros((shape.reach, shape.dims, shape.features), np.float32)
    for i, width in enumerate(shape.widths):
        mask[:width, :, i * shape.filters : (i + 1) * shape.filters] = 1
    return mask.reshape(shape.reach * shape.dims, shape.features)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)
