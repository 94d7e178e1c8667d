"""Forward-backward over chains of states (numpy): exact, with memory bounded by ``CHUNK`` places at a time.

Texts are cut into segments of ``SEGMENT`` places that advance together, longest first. The product of a segment's
transfer matrices carries forward and backward messages over it, so a text of any length takes SEGMENT interpreter steps at a
time, and one step a segment. Transition and emission scores need not be probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Places of one segment, and of the segments that advance together.
SEGMENT, CHUNK = 2048, 300_000


class Model:
    """``start`` (K), ``step`` (K x K) and ``emit`` (words x K)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.step, self.emit = start, step, emit


class Segments:
    """Texts cut into segments of at most ``size`` tokens; ``first`` has the texts' offsets in ``tokens``."""

    def __init__(self, tokens: np.ndarray, first: np.ndarray, size: int) -> None:
        self.tokens = tokens
        sizes = np.diff(first)
        many = -(-sizes // size)
        self.text = np.repeat(np.arange(len(sizes)), many)
        nth = np.arange(len(self.text)) - np.repeat(np.cumsum(many) - many, many)
        self.begins = first[:-1][self.text] + nth * size
        self.sizes = np.minimum(size, first[1:][self.text] - self.begins)
        self.opens = nth == 0
        self.closes = nth == many[self.text] - 1


class Packed:
    """Segments laid out by time: step t holds the t-th token of every segment that has one, longest first."""

    def __init__(self, tokens: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.argsort(-sizes, kind="stable")
        sizes, begins = sizes[self.order], begins[self.order]
        steps = int(sizes[0]) if len(sizes) else 0
        self.active = np.searchsorted(-sizes, -np.arange(steps), side="left")
        self.base = np.concatenate([[0], np.cumsum(self.active)])
        self.owner = np.arange(self.base[-1]) - np.repeat(self.base[:-1], self.active)
        self.tokens = tokens[begins[self.owner] + np.repeat(np.arange(steps), self.active)]
        self.last = self.base[sizes - 1] + np.arange(len(sizes))


def forward(p: Packed, model: Model, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emissions, scaled forward probabilities and scales of each token, given the state distribution before each segment's first."""
    emitted = model.emit[p.tokens]
    alpha, scale = np.empty_like(emitted), np.empty(len(emitted))
    base, a = p.base.tolist(), None
    for t, n in enumerate(p.active.tolist()):
        at = slice(base[t], base[t + 1])
        a = (entry if t == 0 else a[:n] @ model.step) * emitted[at]
        c = a.sum(axis=1)
        a /= c[:, None]
        alpha[at], scale[at] = a, c
    return emitted, alpha, scale


def transfers(p: Packed, model: Model) -> np.ndarray:
    """For each segment, in its given order, the product of step * diag(emission) over its tokens, up to a factor."""
    k = len(model.start)
    m = np.broadcast_to(np.eye(k), (len(p.order), k, k)).copy()
    base = p.base.tolist()
    for t, n in enumerate(p.active.tolist()):
        e = model.emit[p.tokens[base[t] : base[t + 1]]]
        x = (m[:n].reshape(n * k, k) @ model.step).reshape(n, k, k) * e[:, None, :]
        m[:n] = x / x.sum(axis=(1, 2), keepdims=True)
    out = np.empty_like(m)
    out[p.order] = m
    return out


def _pieces(sizes: np.ndarray, chunk: int) -> Iterator[np.ndarray]:
    """Places of segments in groups of about ``chunk`` tokens, of like size."""
    order = np.argsort(-sizes, kind="stable")
    piece = (np.cumsum(sizes[order]) - sizes[order]) // chunk
    yield from np.split(order, np.flatnonzero(np.diff(piece)) + 1) if len(order) else ()


def messages(s: Segments, model: Model, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward probabilities before each segment (the first of a text: none) and backward ones after it (the last: ones)."""
    k = len(model.start)
    before, after = np.zeros((len(s.sizes), k)), np.ones((len(s.sizes), k))
    cut = np.flatnonzero(~(s.opens & s.closes))
    opening, later = cut[s.opens[cut]], cut[~s.opens[cut]]
    ends, product = np.empty((len(s.sizes), k)), np.empty((len(later), k, k))
    for own in _pieces(s.sizes[opening], chunk):
        p = Packed(s.tokens, s.begins[opening[own]], s.sizes[opening[own]])
        ends[opening[own[p.order]]] = forward(p, model, np.broadcast_to(model.start, (len(own), k)))[1][p.last]
    for own in _pieces(s.sizes[later], max(1, chunk // k)):
        product[own] = transfers(Packed(s.tokens, s.begins[later[own]], s.sizes[later[own]]), model)
    for m, at in zip(product, later.tolist()):  # one step a segment
        before[at] = ends[at - 1]
        a = before[at] @ m
        ends[at] = a / a.sum()
    for m, at in zip(product[::-1], later[::-1].tolist()):
        b = m @ after[at]
        after[at - 1] = b / b.sum()
    return before, after


def log10_likelihood(tokens: np.ndarray, first: np.ndarray, model: Model, segment: int | None = None, chunk: int | None = None) -> np.ndarray:
    """The exact log10 probability of each text."""
    chunk = chunk or CHUNK
    s = Segments(tokens, first, segment or SEGMENT)
    before, _ = messages(s, model, chunk)
    out = np.zeros(len(first) - 1)
    for own in _pieces(s.sizes, chunk):
        p = Packed(tokens, s.begins[own], s.sizes[own])
        entry = np.where(s.opens[own][:, None], model.start, before[own] @ model.step)[p.order]
        scale = forward(p, model, entry)[2]
        logs = np.bincount(p.owner, weights=np.log10(scale), minlength=len(own))
        out += np.bincount(s.text[own][p.order], weights=logs, minlength=len(out))
    return out


def expected_counts(tokens: np.ndarray, first: np.ndarray, model: Model, emissions: np.ndarray, segment: int | None = None, chunk: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts of first states and of transitions; those of emissions are added to ``emissions``."""
    chunk = chunk or CHUNK
    s = Segments(tokens, first, segment or SEGMENT)
    before, after = messages(s, model, chunk)
    k = len(model.start)
    opened, pairs = np.zeros(k), np.zeros((k, k))
    for own in _pieces(s.sizes, chunk):
        _count(Packed(tokens, s.begins[own], s.sizes[own]), model, s.opens[own], before[own], after[own], opened, pairs, emissions)
    return opened, pairs * model.step


def _count(p: Packed, model: Model, opens: np.ndarray, prev: np.ndarray, end: np.ndarray, opened: np.ndarray, pairs: np.ndarray, emissions: np.ndarray) -> None:
    """Add one group's counts; a call of its own, so that its arrays are gone before the next group's are made."""
    opens, prev, end = opens[p.order], prev[p.order], end[p.order]
    emitted, alpha, scale = forward(p, model, np.where(opens[:, None], model.start, prev @ model.step))
    end /= (alpha[p.last] * end).sum(axis=1)[:, None]
    gamma = alpha  # each step's forward probabilities are read last where its own are set
    active, base = p.active.tolist(), p.base.tolist()
    beta = w = None
    for t in range(len(active) - 1, -1, -1):
        at, n = slice(base[t], base[t + 1]), active[t]
        grown = active[t + 1] if t + 1 < len(active) else 0
        now = end[:n].copy() if grown < n else np.empty_like(end[:n])
        if grown:
            now[:grown] = w @ model.step.T
            pairs += alpha[base[t] : base[t] + grown].T @ w
        gamma[at] = alpha[at] * now
        beta = now
        w = emitted[at] * beta / scale[at][:, None]
    if len(active):
        pairs += prev[~opens].T @ w[~opens]
        opened += gamma[: active[0]][opens].sum(axis=0)
    for j in range(len(model.start)):
        emissions[:, j] += np.bincount(p.tokens, weights=gamma[:, j], minlength=len(emissions))
