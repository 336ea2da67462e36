"""A small causal self-attention model over subword ids, in numpy.

One block: embedding and place, one head of masked attention, a hidden layer, and an output in two steps: a
softmax over classes, then one over the members of the id's class. The most frequent ids are dealt evenly over
``groups`` classes by what they follow; the others share ``tails`` classes of about equal mass, in which an id's
share is its smoothed corpus count, so every id has a probability. A text is the sequence end, ids, end; windows
of ``window`` ids overlap by ``overlap``, and an id is scored in the first window that holds it with that much
context.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    width: int = 16
    hidden: int = 32
    window: int = 32
    overlap: int = 8
    rows: int = 8192
    groups: int = 64
    members: int = 24
    tails: int = 8
    contexts: int = 128

    @property
    def own(self) -> int:
        return self.groups * self.members

    @property
    def classes(self) -> int:
        return self.groups + self.tails


def dealt(vectors: np.ndarray, groups: int) -> np.ndarray:
    """Group of each row: halves by the main axis of the rows left, again and again, all groups of equal size. groups: a power of two."""
    out = np.zeros(len(vectors), np.int64)
    parts = [np.arange(len(vectors))]
    while len(parts) < groups:
        halves = []
        for rows in parts:
            x = vectors[rows] - vectors[rows].mean(0)
            axis = np.linalg.eigh(x.T @ x)[1][:, -1]
            axis = axis * np.sign(axis[np.abs(axis).argmax()])
            order = rows[np.argsort(x @ axis, kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        parts = halves
    for k, rows in enumerate(parts):
        out[rows] = k
    return out


class Vocabulary:
    """Embedding row, class, place in the class, and log share in a tail class of each id, from corpus counts.

    follows: for the most frequent ids in order (at most ``own``), how often each followed each of the
    ``contexts`` most frequent ids.
    """

    def __init__(self, counts: np.ndarray, shape: Shape, follows: np.ndarray | None = None):
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        self.row = np.minimum(rank, shape.rows - 1).astype(np.int32)
        self.rows = int(min(len(counts), shape.rows))
        mass = counts + 0.5
        own, rest = order[: shape.own], order[shape.own :]
        self.cls, self.place = np.empty(len(counts), np.int16), np.zeros(len(counts), np.int16)
        if follows is None:
            group = np.arange(len(own)) % shape.groups
        else:
            known = follows[: len(own)] + 1e-3
            group = dealt(np.sqrt(known / known.sum(1, keepdims=True)), shape.groups)
        self.cls[own] = group
        by = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[by], np.arange(shape.groups))
        self.place[own[by]] = np.arange(len(own)) - starts[group[by]]
        self.share = np.zeros(len(counts))
        if len(rest):
            part = np.cumsum(mass[rest]) / mass[rest].sum()
            self.cls[rest] = shape.groups + np.minimum((part * shape.tails).astype(np.int64), shape.tails - 1)
            total = np.bincount(self.cls[rest], mass[rest], shape.classes)
            self.share[rest] = np.log(mass[rest] / total[self.cls[rest]])
        total = np.bincount(self.cls, mass, shape.classes)
        self.class_log = np.log(np.maximum(total, 0.5) / total.sum()).astype(np.float32)
        # places that no id has keep a share too small to count
        self.member_log = np.full((shape.groups, shape.members), -30, np.float32)
        self.member_log[group, self.place[own]] = np.log(mass[own] / total[group])


class Model:
    """Parameters in one flat float32 array, with a view for each. V is the second output step: class, width and bias, member."""

    def __init__(self, shape: Shape, rows: int, flat: np.ndarray | None = None):
        d, h = shape.width, shape.hidden
        self.shape, self.rows = shape, rows
        sizes = {"E": (rows, d), "P": (shape.window, d), "A": (d, 3 * d), "O": (d, d), "H": (d, h), "c": (h,), "G": (h, d), "U": (d + 1, shape.classes), "V": (shape.groups, d + 1, shape.members)}
        self.flat = np.zeros(sum(int(np.prod(s)) for s in sizes.values()), np.float32) if flat is None else flat
        at = 0
        for name, size in sizes.items():
            n = int(np.prod(size))
            setattr(self, name, self.flat[at : at + n].reshape(size))
            at += n
        self.names = list(sizes)
        self.mask = np.tril(np.ones((shape.window, shape.window), np.float32))
        self.shade = (self.mask - 1) * 1e4

    @classmethod
    def first(cls, shape: Shape, vocabulary: Vocabulary, seed: int) -> Model:
        """Random weights; the outputs start at the corpus shares."""
        new, rng = cls(shape, vocabulary.rows), np.random.default_rng(seed)
        d, h = shape.width, shape.hidden
        for name, scale in (("E", 0.3), ("P", 0.1), ("A", d**-0.5), ("O", d**-0.5), ("H", d**-0.5), ("G", h**-0.5), ("U", 0.1), ("V", 0.1)):
            view = getattr(new, name)
            view[:] = rng.standard_normal(view.shape) * scale
        new.U[-1], new.V[:, -1] = vocabulary.class_log, vocabulary.member_log
        return new

    def projection(self) -> np.ndarray:
        """Weights of query, key and value. Queries are scaled, so that their products with the keys need no pass of their own."""
        weights = self.A.copy()
        weights[:, : self.shape.width] *= self.shape.width**-0.5
        return weights

    def hidden(self, x: np.ndarray) -> tuple:
        """x: rows by window of embedding rows. All that the outputs and the gradients need; the last part has a column of ones.

        Only attention goes window by window; all other products are one over all places. Attention is not divided by its sums:
        a column of ones beside the values gives them, and the mixed values, half as many numbers, are divided.
        """
        d, t = self.shape.width, x.shape[1]
        e = self.E.take(x, 0)  # whole rows: several times as fast as by an index
        e += self.P[:t]
        qkv = np.ones((*x.shape, 3 * d + 1), e.dtype)
        np.matmul(places(e), self.projection(), out=places(qkv)[:, : 3 * d])
        a = np.matmul(qkv[..., :d], qkv[..., d : 2 * d].transpose(0, 2, 1))
        large = extreme(a)
        a += self.shade[:t, :t]
        if large:
            a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        mix = np.matmul(a, qkv[..., 2 * d :])
        mix[..., :d] /= mix[..., d:]
        h = np.matmul(places(mix)[:, :d], self.O)
        h += places(e)
        g = np.matmul(h, self.H)
        g.reshape(len(x), -1)[:] += np.tile(self.c, t)
        np.maximum(g, 0, out=g)
        top = np.ones((len(h), d + 1), h.dtype)
        np.add(h, np.matmul(g, self.G), out=top[:, :d])
        return e, qkv, a, mix, h, g, top

    def logs(self, top: np.ndarray, cls: np.ndarray, place: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Natural log of the probability of each class and, where it has members, member. rows: those of top that are meant, else all."""
        # in the order of classes each class's inputs are one slice, and all are gathered once
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(self.shape.groups + 1)).tolist()
        inputs, cls, place = top.take(order if rows is None else rows[order], 0), cls[order], place[order]
        found = np.empty(len(order), top.dtype)
        for k in range(0, len(order), 768):  # small products are the fastest
            part = slice(k, k + 768)
            found[part] = chosen(lambda: inputs[part] @ self.U, cls[part])  # noqa: B023
        for k, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
            if i < j:
                found[i:j] += chosen(lambda: inputs[i:j] @ self.V[k], place[i:j])  # noqa: B023
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradients(self, x: np.ndarray, cls: np.ndarray, place: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean loss; that of E only for the rows returned."""
        d = self.shape.width
        e, qkv, a, mix, h, g, top = self.hidden(x)
        n = len(top)
        # exponentials stay undivided here as well: their sums go into the narrow side of each product
        out, total = powers(np.matmul(top, self.U))
        out[np.arange(n), cls] -= total
        weight = np.float32(1 / n) / total[:, None]
        grad = {"U": (top * weight).T @ out, "V": np.zeros_like(self.V)}
        d_out = np.matmul(out, self.U[:-1].T)
        d_out *= weight
        # places in the order of their classes, so that each class's are one slice
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(self.shape.groups + 1)).tolist()
        order = order[: edges[-1]]
        inputs, found, back = top.take(order, 0), np.empty((len(order), self.shape.members), top.dtype), np.empty((len(order), d), top.dtype)
        parts = [(c, slice(i, j)) for c, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if i < j]
        for c, at in parts:
            np.matmul(inputs[at], self.V[c], out=found[at])
        found, total = powers(found)
        found[np.arange(len(order)), place[order]] -= total
        weight = (np.float32(1 / n) / total)[:, None]
        inputs *= weight
        across = turned(self.V[:, :-1])
        for c, at in parts:
            np.matmul(inputs[at].T, found[at], out=grad["V"][c])
            np.matmul(found[at], across[c], out=back[at])
        back *= weight
        more = np.zeros((n, d), back.dtype)
        more[order] = back
        d_out += more
        grad["G"] = g.T @ d_out
        d_g = np.matmul(d_out, self.G.T)
        d_g *= g > 0
        grad["H"], grad["c"] = h.T @ d_g, np.ones(n, d_g.dtype) @ d_g
        d_e = np.matmul(d_g, self.H.T)
        d_e += d_out
        grad["O"] = places(mix)[:, :d].T @ d_e
        # the last column takes the softmax's own part off, by the ones beside the values
        d_mix = np.empty_like(mix)
        np.matmul(d_e, self.O.T, out=places(d_mix)[:, :d])
        d_mix[..., d] = -np.einsum("bti,bti->bt", d_mix[..., :d], mix[..., :d])
        d_mix /= mix[..., d:]
        d_a = np.matmul(d_mix, qkv[..., 2 * d :].transpose(0, 2, 1))
        d_a *= a
        changes = np.empty((*x.shape, 3 * d), e.dtype)
        np.matmul(d_a, qkv[..., d : 2 * d], out=changes[..., :d])
        np.matmul(d_a.transpose(0, 2, 1), qkv[..., :d], out=changes[..., d : 2 * d])
        np.matmul(a.transpose(0, 2, 1), d_mix[..., :d], out=changes[..., 2 * d :])
        grad["A"] = places(e).T @ places(changes)
        grad["A"][:, :d] *= d**-0.5
        d_e += np.matmul(places(changes), self.projection().T)
        grad["P"] = np.zeros_like(self.P)
        grad["P"][: x.shape[1]] = d_e.reshape(e.shape).sum(0)
        rows = x.ravel()
        order = np.argsort(rows.astype(np.uint16) if self.rows <= 1 << 16 else rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        grad["E"] = np.add.reduceat(d_e.take(order, 0), first, axis=0)
        return grad, rows[first]


def turned(x: np.ndarray) -> np.ndarray:
    """The last two axes changed over, as a copy: products with one are faster than with a view."""
    return np.ascontiguousarray(np.swapaxes(x, -1, -2))


def places(x: np.ndarray) -> np.ndarray:
    """A view of windows by places as rows."""
    return x.reshape(-1, x.shape[-1])


def extreme(x: np.ndarray, most: float = 60) -> bool:
    """Whether exponentials of the values, or their sums, are out of what float32 holds well."""
    return bool(len(x)) and not (x.max() < most and x.min() > -most)


def powers(out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of each row, in place, and their sums: the softmax is their quotient. Rows are shifted only where that is needed."""
    if extreme(out):
        out -= out.max(-1, keepdims=True)
    np.exp(out, out=out)
    return out, out @ np.ones(out.shape[-1], out.dtype)


def chosen(make: Callable[[], np.ndarray], place: np.ndarray) -> np.ndarray:
    """Log of the softmax at one place of each row of outputs. The rows are shifted only where float32 does not hold their sums."""
    out = make()
    wanted = out.ravel().take(np.arange(0, out.size, out.shape[1]) + place)
    with np.errstate(over="ignore"):
        np.exp(out, out=out)
    total = out @ np.ones(out.shape[1], out.dtype)
    if not (total.min(initial=1) > 0 and total.max(initial=1) < np.inf):
        out = make()
        most = out.max(1)
        wanted, total = wanted - most, np.exp(out - most[:, None]).sum(1)
    return wanted - np.log(total)


def train(model: Model, windows: np.ndarray, vocabulary: Vocabulary, steps: int, batch: int, rate: tuple[float, float], seed: int) -> np.ndarray:
    """Adam over even batches of at most so many windows (rows of window + 1 ids), each met once before any is met again.

    The rate goes from one value to the other. Returns how often each embedding row was met.
    """
    rng, parts = np.random.default_rng(seed), []
    first = {n: np.zeros_like(getattr(model, n)) for n in model.names}
    second = {n: np.zeros_like(getattr(model, n)) for n in model.names}
    met = np.zeros(model.rows, np.float32)
    for step in range(steps):
        if not parts:
            parts = np.array_split(rng.permutation(len(windows)), -(-len(windows) // batch))
        some = windows[parts.pop()]
        x, y = vocabulary.row[some[:, :-1]], some[:, 1:].ravel()
        grad, rows = model.gradients(x, vocabulary.cls[y], vocabulary.place[y])
        met += np.bincount(x.ravel(), minlength=model.rows)
        speed = (rate[0] + (rate[1] - rate[0]) * step / steps) * min(1.0, (step + 1) / 20)
        for name, g in grad.items():
            old = first[name], second[name]
            if name == "E":
                old = old[0].take(rows, 0), old[1].take(rows, 0)
            m, v = 0.9 * old[0] + 0.1 * g, 0.99 * old[1] + 0.01 * g * g
            where = rows if name == "E" else slice(None)
            first[name][where], second[name][where] = m, v
            getattr(model, name)[where] -= speed * m / (np.sqrt(v) + 1e-8)
    return met


class Scorer:
    """Log10 probabilities of texts given as ids with the end id last."""

    def __init__(self, model: Model, vocabulary: Vocabulary, end: int, at_once: int = 64):
        self.vocabulary, self.end, self.at_once, self.shape, self.model = vocabulary, end, at_once, model.shape, model
        d = model.shape.width
        # embedding, query, key and value are sums over id and place; a column of ones gives the attention's sums
        self.table = np.concatenate([model.E, model.E @ model.A, np.zeros((model.rows, 1), np.float32)], 1)
        self.places = np.concatenate([model.P, model.P @ model.A, np.ones((len(model.P), 1), np.float32)], 1)
        self.table[:, d : 2 * d] *= d**-0.5
        self.places[:, d : 2 * d] *= d**-0.5
        # no product of a query and a key is larger
        longest = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(1)).max())
        self.bound = np.prod([longest(self.table[:, k * d : (k + 1) * d]) + longest(self.places[:, k * d : (k + 1) * d]) for k in (1, 2)])

    def top(self, x: np.ndarray, skip: int, out: np.ndarray) -> None:
        """Fills the inputs of the output layer of windows of embedding rows, from place skip on."""
        d, t, m = self.shape.width, x.shape[1], self.model
        e = self.table.take(x, 0)
        e += self.places[:t]
        a = np.matmul(e[:, skip:, d : 2 * d], e[:, :, 2 * d : 3 * d].transpose(0, 2, 1))
        if self.bound > 60 and max(a.max(), -a.min()) > 60:  # the shift changes no share, only what float32 holds
            a -= a.max(-1, where=m.mask[skip:t, :t] > 0, initial=-1e4, keepdims=True)
            np.minimum(a, 0, out=a)
        np.exp(a, out=a)
        a *= m.mask[skip:t, :t]
        mix = np.matmul(a, e[:, :, 3 * d :])
        mix[..., :d] /= mix[..., d:]
        h = np.matmul(places(mix)[:, :d], m.O)
        h.reshape(len(x), -1, d)[:] += e[:, skip:, :d]
        g = np.matmul(h, m.H)
        g.reshape(len(x), -1)[:] += np.tile(m.c, t - skip)
        np.maximum(g, 0, out=g)
        np.add(h, np.matmul(g, m.G), out=places(out)[:, :d])

    def __call__(self, texts: list[np.ndarray]) -> np.ndarray:
        """One log10 probability per text."""
        t, step, d, words = self.shape.window, self.shape.window - self.shape.overlap, self.shape.width, self.vocabulary
        total = np.zeros(len(texts))
        if not texts:
            return total
        whole = [np.concatenate([[self.end], ids]) for ids in texts]
        sizes = np.array([len(ids) for ids in texts])
        begins = np.cumsum([0, *(len(w) for w in whole)])[:-1]
        flat = np.concatenate([*whole, np.full(t + 1, self.end)]).astype(np.int64)
        rows = words.row[flat]
        # windows after a text's first: window k of a text holds places k * step to k * step + t
        more = np.maximum(0, -(-(sizes - t) // step))
        owner = np.repeat(np.arange(len(texts)), more)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more) + 1
        for text, start, skip in ((np.arange(len(texts)), begins, 0), (owner, begins[owner] + nth * step, self.shape.overlap)):
            if not len(text):
                continue
            left = begins[text] + sizes[text] - start  # places of the text from the window's begin on
            n = t - skip
            top = np.ones((len(text), n, d + 1), np.float32)
            for k in range(0, len(text), self.at_once):
                at = start[k : k + self.at_once, None] + np.arange(t)
                self.top(rows[at], skip, top[k : k + self.at_once])
            inside = np.flatnonzero((np.arange(skip, t) < left[:, None]).ravel())
            ids = flat[(start[:, None] + np.arange(skip + 1, t + 1)).ravel()[inside]]
            logs = words.share[ids] + self.model.logs(top.reshape(-1, d + 1), words.cls[ids], words.place[ids], inside)
            total += np.bincount(np.repeat(text, np.minimum(n, np.maximum(0, left - skip))), logs, len(texts))
        return total / np.log(10)


def cut(ids: np.ndarray, end: int, window: int) -> np.ndarray:
    """Training windows of a text: rows of window + 1 ids, the last one filled up with end ids."""
    whole = np.concatenate([[end], ids])
    n = max(1, -(-(len(whole) - 1) // window))
    whole = np.concatenate([whole, np.full(n * window + 1 - len(whole), end)])
    return whole[np.arange(n)[:, None] * window + np.arange(window + 1)]


def batches_of(texts: Iterator[tuple], tokens: int) -> Iterator[list[tuple]]:
    """Runs of (key, ids) of about so many tokens."""
    held, size = [], 0
    for item in texts:
        held.append(item)
        size += len(item[1])
        if size >= tokens:
            yield held
            held, size = [], 0
    if held:
        yield held
