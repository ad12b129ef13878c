"""A small causal self-attention model in numpy: forward pass, gradients, Adam.

A window holds ``CONTEXT`` places that are only looked at, ``SCORED`` places whose
following symbol is predicted, and one symbol more. Every scored place looks at all
places up to itself, by dot products of queries and keys, which are narrower than the
values, plus a bias for each distance; a masked softmax weighs the values. A residual, a layer of rectified units
and another residual follow. The next symbol is predicted in two steps: its class,
then the symbol within its class, so no step meets the whole vocabulary.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass
from pathlib import Path

import numpy as np

CONTEXT, SCORED = 16, 32
WINDOW = CONTEXT + SCORED + 1
WIDTH, KEYS, HIDDEN = 32, 8, 32
FAR = np.float32(-1e9)
SAFE = 40.0  # exponentials up to it add up within 32 bits
#: Members up to which classes that follow each other are worked on at once, in steps and
#: in scoring, where more rows are at hand; rows of a product that a core's cache holds, and windows whose places are looked at at once.
RUN_MEMBERS, SCORED_RUN_MEMBERS, TALL_ROWS, LOOKED_WINDOWS = 64, 32, 256, 64
#: Parameters that a step goes through at once.
MOVED_AT_ONCE = 16_384

#: distance of each looked-at place from each scored one, and which may be looked at
DISTANCE = np.arange(SCORED)[:, None] + CONTEXT - np.arange(CONTEXT + SCORED)[None, :]
CAUSAL = DISTANCE >= 0


#: Names under which a linear algebra library sets its number of threads.
THREAD_SETTERS = ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads")


#: Numbers of settings of the C library's allocator, and their values.
KEPT_MEMORY = {-3: 1 << 25, -1: 1 << 28, -2: 1 << 26}


def one_thread() -> None:
    """Keep this process's matrix products on one core: a task has one, and for
    matrices as small as these, waiting threads cost as much again. Freed arrays are
    kept for the next ones, where the C library can be told so."""
    keep = getattr(ctypes.CDLL(None), "mallopt", None)
    for setting, value in KEPT_MEMORY.items() if keep else ():
        keep(setting, value)
    maps = Path("/proc/self/maps")
    for path in {line.split()[-1] for line in maps.read_text().splitlines() if "openblas" in line} if maps.exists() else ():
        library = ctypes.CDLL(path)
        for name in THREAD_SETTERS:
            if hasattr(library, name):
                getattr(library, name)(1)


@dataclass
class Run:
    """Classes that follow each other, from ``first`` to before ``last``, whose members
    run from ``begin`` to before ``end``. ``apart`` has a row for each class, which puts
    the members of others out of reach; a class alone needs none."""

    first: int
    last: int
    begin: int
    end: int
    apart: np.ndarray | None

    def bias(self, member_bias: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """What is added to the members' products, for rows of these ``classes``."""
        own = member_bias[self.begin : self.end]
        return own if self.apart is None else np.take(own + self.apart.astype(own.dtype), classes - self.first, 0)


def runs_of(bounds: np.ndarray, most: int) -> list[Run]:
    """All classes of more than one member, small neighbours of up to ``most`` together."""
    found: list[tuple[int, int]] = []
    for c, (begin, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if end - begin == 1:
            continue
        if found and found[-1][1] == c and end - bounds[found[-1][0]] <= most:
            found[-1] = (found[-1][0], c + 1)
        else:
            found.append((c, c + 1))
    made = []
    for first, last in found:
        begin, end = int(bounds[first]), int(bounds[last])
        own = np.repeat(np.arange(first, last), np.diff(bounds[first : last + 1]))
        apart = np.where(own == np.arange(first, last)[:, None], np.float32(0), FAR) if last - first > 1 else None
        made.append(Run(first, last, begin, end, apart))
    return made


@dataclass
class Symbols:
    """The known symbols by falling count, and their classes.

    ``codes`` and ``counts`` in the order of indices, which run by falling count; a
    class is a run of them, from one of ``bounds`` to the next. ``table``: the index of
    each possible code. ``other`` stands for all unknown
    symbols, ``pad`` for no symbol. ``novel``: probability of the unknown together,
    of which there are ``unknown``. ``runs``: the classes of more than one member.
    """

    codes: np.ndarray
    counts: np.ndarray
    class_of: np.ndarray
    bounds: np.ndarray
    table: np.ndarray
    novel: float
    unknown: int
    runs: list[Run]

    @property
    def other(self) -> int:
        return len(self.counts)

    @property
    def pad(self) -> int:
        return len(self.counts) + 1

    def indices(self, codes: np.ndarray) -> np.ndarray:
        return self.table.take(codes)


def symbols(codes: np.ndarray, counts: np.ndarray, possible: int) -> Symbols:
    """``codes`` and their counts (all above 0), out of ``possible`` codes. Classes
    hold about equal counts, and at most four times the root of the number of symbols."""
    order = np.lexsort((codes, -counts))
    codes, counts = codes[order].astype(np.int64), counts[order].astype(np.float64)
    known, total = len(codes), counts.sum()
    classes = max(1, int(np.ceil(np.sqrt(known))))
    if known:
        middle = (np.cumsum(counts) - counts / 2) / total
        rough = np.minimum((middle * classes).astype(np.int64), classes - 1)
        begin = np.searchsorted(rough, rough)
        pair = rough * (known + 1) + (np.arange(known) - begin) // (4 * classes)
        class_of = np.unique(pair, return_inverse=True)[1]
    else:
        class_of = np.zeros(0, np.int64)
    bounds = np.searchsorted(class_of, np.arange(class_of.max() + 2 if known else 1))
    table = np.full(possible, known, np.int32)
    table[codes] = np.arange(known)
    novel = known / (total + known) if known else 1.0
    unknown = max(0, possible - known)
    class_of = class_of.astype(np.uint16 if len(bounds) <= 1 << 16 else np.int64)  # short ones sort by digits
    return Symbols(codes, counts, class_of, bounds, table, novel if unknown else 0.0, unknown, runs_of(bounds, RUN_MEMBERS))


Parameters = dict[str, np.ndarray]


def shapes(known: int, classes: int) -> dict[str, tuple[int, ...]]:
    return {
        "embedding": (known + 2, WIDTH), "bias": (CONTEXT + SCORED,), "query": (WIDTH, KEYS), "key": (WIDTH, KEYS), "value": (WIDTH, WIDTH),
        "up": (WIDTH, HIDDEN), "up_bias": (HIDDEN,), "down": (HIDDEN, WIDTH), "class": (WIDTH, classes), "class_bias": (classes,),
        "member": (known, WIDTH), "member_bias": (known,),
    }


def start(s: Symbols, seed: int = 7) -> Parameters:
    """First parameters: they give each symbol its share of the counts, wherever it stands."""
    rng = np.random.default_rng(seed)
    p = {n: np.zeros(k, np.float32) for n, k in shapes(len(s.counts), len(s.bounds) - 1).items()}
    for name, scale in (("embedding", 0.3), ("query", 0.1), ("key", 0.1), ("value", 0.15), ("up", 0.15), ("down", 0.05)):
        p[name][:] = rng.normal(0, scale, p[name].shape)
    p["embedding"][-2:] = 0
    p["bias"][:] = -0.05 * np.arange(CONTEXT + SCORED)
    if len(s.counts):
        held = np.add.reduceat(s.counts, s.bounds[:-1])
        p["class_bias"][:] = np.log(held / held.sum())
        p["member_bias"][:] = np.log(s.counts / held[s.class_of])
    return p


def pack(p: Parameters) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def unpack(flat: np.ndarray, known: int, classes: int) -> Parameters:
    """Parameters by name; views, if ``flat`` is of 32 bits."""
    found, at = {}, 0
    for name, shape in shapes(known, classes).items():
        size = int(np.prod(shape))
        found[name] = flat[at : at + size].reshape(shape).astype(np.float32, copy=False)
        at += size
    return found


def windows(indices: np.ndarray, s: Symbols, first: int) -> np.ndarray:
    """Windows of a text's symbols, a view: every symbol is the target of one place.
    ``first`` stands before the text."""
    blocks = -(-len(indices) // SCORED)
    row = np.full(CONTEXT + blocks * SCORED + 1, s.pad, np.int32)
    row[CONTEXT] = first
    row[CONTEXT + 1 : CONTEXT + 1 + len(indices)] = indices
    return np.lib.stride_tricks.sliding_window_view(row, WINDOW)[::SCORED]


def laid_out(indices: np.ndarray, sizes: np.ndarray, s: Symbols, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Many texts at once, of these ``sizes`` and one after the other in ``indices``:
    a row that holds all their windows, where these begin, the text of each and its
    number there."""
    blocks = -(-sizes // SCORED)
    held = CONTEXT + blocks * SCORED + 1
    begin = np.cumsum(held) - held
    row = np.full(held.sum(), s.pad, np.int32)
    row[begin + CONTEXT] = first
    row[np.repeat(begin + CONTEXT + 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(indices))] = indices
    of = np.repeat(np.arange(len(sizes)), blocks)
    own = np.arange(len(of)) - (np.cumsum(blocks) - blocks)[of]
    return row, begin[of] + own * SCORED, of, own


def mask(bias: np.ndarray) -> np.ndarray:
    """What is added to the products of each scored place with each looked-at one."""
    return np.where(CAUSAL, bias[np.abs(DISTANCE)], FAR)


def attend(q: np.ndarray, k: np.ndarray, added: np.ndarray, looked: np.ndarray, pad: int, out: np.ndarray | None = None) -> np.ndarray:
    """Unscaled weights (windows, scored, looked at) of a masked softmax, to be
    divided by their sums. Only if a product is so large that its exponential could
    overflow, or a row so small that it could vanish, are rows shifted by their maxima."""
    a = np.matmul(q, k.transpose(0, 2, 1), out=out)
    a += added
    fronts = np.flatnonzero(looked[:, 0] == pad)
    if len(fronts):
        a[fronts] += np.where(looked[fronts] == pad, FAR, np.float32(0))[:, None, :]
    # Every place may look at itself.
    if a.max() > SAFE or a.diagonal(CONTEXT, 1, 2).min() < -SAFE:
        a -= a.max(2, keepdims=True)
    return np.exp(a, out=a)


def _by_class(targets: np.ndarray, s: Symbols, runs: list[Run]) -> tuple[np.ndarray, np.ndarray, list[tuple[Run, slice]]]:
    """Order of targets by class, the classes in it, and each run met with its slice."""
    c = s.class_of[targets]
    order = np.argsort(c, kind="stable")
    c = c[order].astype(np.int64)
    begin, end = (np.searchsorted(c, np.array([getattr(r, n) for r in runs], np.int64)).tolist() for n in ("first", "last"))
    return order, c, [(r, slice(a, b)) for r, a, b in zip(runs, begin, end, strict=True) if b > a]


def _tall(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x.T @ y`` of few columns and many rows, a part of the rows at a time."""
    whole = len(x) // TALL_ROWS * TALL_ROWS
    parts = np.matmul(x[:whole].reshape(-1, TALL_ROWS, x.shape[1]).transpose(0, 2, 1), y[:whole].reshape(-1, TALL_ROWS, y.shape[1]))
    return parts.sum(0) + x[whole:].T @ y[whole:]


def _by_symbol(indices: np.ndarray, rows: np.ndarray, many: int) -> np.ndarray:
    """Sums of ``rows`` by their index, of which there are ``many``."""
    wide = rows.shape[1]
    if many > 4 * len(rows):
        found = np.zeros((many, wide), rows.dtype)
        by = np.argsort(indices, kind="stable")
        met, begin = np.unique(indices[by], return_index=True)
        found[met] = np.add.reduceat(np.take(rows, by, 0), begin, axis=0)
        return found
    found = np.zeros(many * wide, rows.dtype)
    np.add.at(found, ((indices.astype(np.int64) * wide)[:, None] + np.arange(wide)).ravel(), rows.ravel())
    return found.reshape(many, wide)


class Scorer:
    """Log10 probabilities by fixed parameters, with keys, values and queries of all
    symbols made once. Large arrays are kept from batch to batch: memory taken anew
    from the system for each would cost as much as the products."""

    def __init__(self, p: Parameters, s: Symbols):
        p = {n: v.astype(np.float32) for n, v in p.items()}
        self.p, self.s, e = p, s, p["embedding"]
        self.runs = runs_of(s.bounds, SCORED_RUN_MEMBERS)
        ones = np.ones((len(e), 1), np.float32)
        self.keys, self.values = e @ p["key"], np.hstack([e @ p["value"], ones])
        self.queries, self.added = e @ p["query"] * np.float32(WIDTH**-0.5), mask(p["bias"])
        self.own = np.ascontiguousarray(e)
        self.room: dict[str, np.ndarray] = {}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.room or self.room[name].size < size:
            self.room[name] = np.empty(size, np.float32)
        return self.room[name][:size].reshape(shape)

    def _taken(self, name: str, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.take(table, at, 0, out=self._room(name, *at.shape, table.shape[1]), mode="clip")

    def places(self, batch: np.ndarray) -> np.ndarray:
        """Natural log probability of each target of ``batch`` (windows); 0 at pads."""
        s, p = self.s, self.p
        looked, targets = np.ascontiguousarray(batch[:, :-1]), batch[:, CONTEXT + 1 :].ravel()
        out = np.where(targets == s.pad, 0.0, np.log(s.novel / s.unknown) if s.unknown else 0.0)
        known = targets < s.other
        if not known.any():
            return out.reshape(len(batch), SCORED)
        asking = np.ascontiguousarray(looked[:, CONTEXT:])
        every = self._room("r", len(batch) * SCORED, WIDTH)
        for begin in range(0, len(batch), LOOKED_WINDOWS):
            part, own = looked[begin : begin + LOOKED_WINDOWS], asking[begin : begin + LOOKED_WINDOWS]
            n = len(part)
            q, k = self._taken("q", self.queries, own), self._taken("k", self.keys, part)
            a = attend(q, k, self.added, part, s.pad, self._room("a", n, SCORED, CONTEXT + SCORED))
            met = np.matmul(a, self._taken("v", self.values, part), out=self._room("met", n, SCORED, WIDTH + 1)).reshape(-1, WIDTH + 1)
            r = every[begin * SCORED : (begin + n) * SCORED]
            np.divide(met[:, :-1], met[:, -1:], out=r)
            r += self._taken("own", self.own, own.ravel())
        # Places in the order of their targets' classes, from here on; unknown ones fall away.
        at = np.flatnonzero(known)
        targets = targets[at]
        order, kind, groups = _by_class(targets, s, self.runs)
        at, targets = at[order], targets[order]
        r = self._taken("rows", every, at)
        hidden = np.matmul(r, p["up"], out=self._room("hidden", len(at), HIDDEN))
        hidden += p["up_bias"]
        np.maximum(hidden, 0, out=hidden)
        r += np.matmul(hidden, p["down"], out=self._room("down", len(at), WIDTH))
        logits = np.matmul(r, p["class"], out=self._room("logits", len(at), p["class"].shape[1]))
        logits += p["class_bias"]
        found = _log_share(logits, kind)
        for run, part in groups:
            begin, end = run.begin, run.end
            logits = np.matmul(r[part], p["member"][begin:end].T, out=self._room("logits", part.stop - part.start, end - begin))
            logits += run.bias(p["member_bias"], kind[part])
            found[part] += _log_share(logits, targets[part] - begin)
        out[at] = found + np.log1p(-s.novel)
        return out.reshape(len(batch), SCORED)


def _log_share(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax share at one place of each row."""
    own = logits[np.arange(len(at)), at]
    top = logits.max()
    if top > SAFE or own.min() < -SAFE:
        top = logits.max(1)
        logits -= top[:, None]
        own = own - top
    np.exp(logits, out=logits)
    return own - np.log(logits @ np.ones(logits.shape[1], np.float32))


def _softmax(logits: np.ndarray, at: np.ndarray, n) -> np.ndarray:
    """Turns ``logits`` in place into the gradient, over ``n``, of the negative log of
    the softmax share at one place of each row, and gives these logs."""
    rows = np.arange(len(at))
    own = logits[rows, at]
    if logits.max() > SAFE or own.min() < -SAFE:
        top = logits.max(1)
        logits -= top[:, None]
        own = own - top
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    logits *= (1 / (total * n))[:, None]
    logits[rows, at] -= 1 / n
    return own - np.log(total)


def loss_and_gradients(p: Parameters, s: Symbols, batch: np.ndarray) -> tuple[float, Parameters]:
    """Mean negative log likelihood of the known targets of a batch, and its gradients."""
    g = {n: np.zeros_like(p[n]) for n in ("member", "member_bias")}
    looked, targets = np.ascontiguousarray(batch[:, :-1]), batch[:, CONTEXT + 1 :].ravel()
    at = np.flatnonzero(targets < s.other)
    if not len(at):
        return 0.0, {n: np.zeros_like(v) for n, v in p.items()}
    # Targets in the order of their classes.
    order, classes, groups = _by_class(targets[at], s, s.runs)
    at = at[order]
    targets, kind = targets[at], p["embedding"].dtype.type
    n, scale, many = kind(len(at)), kind(WIDTH**-0.5), len(batch)
    flat = np.take(p["embedding"], looked.ravel(), 0)
    flat_q = flat.reshape(many, -1, WIDTH)[:, CONTEXT:].reshape(-1, WIDTH)
    both = np.hstack([p["key"], p["value"]])
    kv = (flat @ both).reshape(many, -1, KEYS + WIDTH)
    k, v = kv[:, :, :KEYS], kv[:, :, KEYS:]
    q = (flat_q @ (p["query"] * scale)).reshape(many, SCORED, KEYS)
    a = attend(q, k, mask(p["bias"]).astype(kind), looked, s.pad)
    a /= (a @ np.ones(a.shape[2], kind))[:, :, None]
    r = np.matmul(a, v).reshape(-1, WIDTH)
    r += flat_q
    r = np.take(r, at, 0)
    before = r @ p["up"]
    before += p["up_bias"]
    hidden = np.maximum(before, 0)
    h = hidden @ p["down"]
    h += r

    share = h @ p["class"]
    share += p["class_bias"]
    loss = -_softmax(share, classes, n).sum()
    g["class"], g["class_bias"] = _tall(h, share), np.ones(len(at), kind) @ share
    dh = share @ p["class"].T
    for run, part in groups:
        begin, end = run.begin, run.end
        share = h[part] @ p["member"][begin:end].T
        share += run.bias(p["member_bias"], classes[part])
        loss -= _softmax(share, targets[part] - begin, n).sum()
        g["member"][begin:end], g["member_bias"][begin:end] = share.T @ h[part], np.ones(len(share), kind) @ share
        dh[part] += share @ p["member"][begin:end]

    g["down"] = _tall(hidden, dh)
    dhidden = dh @ p["down"].T
    dhidden *= before > 0
    g["up"], g["up_bias"] = _tall(r, dhidden), np.ones(len(at), kind) @ dhidden
    dh += dhidden @ p["up"].T
    dr = np.zeros((many * SCORED, WIDTH), kind)
    dr[at] = dh
    by_place = dr.reshape(many, SCORED, WIDTH)

    da = np.matmul(by_place, v.transpose(0, 2, 1))
    dkv = np.empty_like(kv)
    np.matmul(a.transpose(0, 2, 1), by_place, out=dkv[:, :, KEYS:])
    # What the softmax takes off: at each place, the product of its gradient and output.
    da *= a
    a *= (da @ np.ones(a.shape[2], kind))[:, :, None]
    da -= a
    g["bias"] = np.bincount(np.abs(DISTANCE).ravel(), np.where(CAUSAL, da.sum(0), 0).ravel(), CONTEXT + SCORED).astype(kind)
    dq = np.matmul(da, k).reshape(-1, KEYS)
    dq *= scale
    np.matmul(da.transpose(0, 2, 1), q, out=dkv[:, :, :KEYS])
    dkv = dkv.reshape(-1, KEYS + WIDTH)
    of_both = _tall(flat, dkv)
    g["key"], g["value"], g["query"] = of_both[:, :KEYS], of_both[:, KEYS:], _tall(flat_q, dq)
    dx = dkv @ both.T
    dr += dq @ p["query"].T
    dx.reshape(many, -1, WIDTH)[:, CONTEXT:] += by_place
    g["embedding"] = _by_symbol(looked.ravel(), dx, len(p["embedding"]))
    g["embedding"][-2:] = 0  # unknown symbols and pads stay at nought
    return float(loss / n), {name: g[name] for name in p}


class Fit:
    """Adam from parameters ``p``, with a rate that falls to a third within ``steps`` steps.

    All parameters lie in one array, which a step goes through a part at a time, so
    that the core's cache holds what the passes over a part share."""

    def __init__(self, p: Parameters, s: Symbols, rate: float, steps: float):
        self.flat = pack(p)
        self.p, self.s, self.rate, self.steps, self.done = unpack(self.flat, len(s.counts), len(s.bounds) - 1), s, rate, max(1.0, steps), 0
        self.first, self.second = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def step(self, rows: np.ndarray) -> None:
        _, g = loss_and_gradients(self.p, self.s, rows)
        left = 1 - 2 / 3 * min(1.0, self.done / self.steps)
        self.done += 1
        pace = np.float32(self.rate * left * np.sqrt(1 - 0.99**self.done) / (1 - 0.9**self.done))
        every = pack(g)
        for begin in range(0, len(every), MOVED_AT_ONCE):
            grad, m, w, own = (x[begin : begin + MOVED_AT_ONCE] for x in (every, self.first, self.second, self.flat))
            moved = grad - m
            moved *= np.float32(0.1)
            m += moved
            grad *= grad
            grad -= w
            grad *= np.float32(0.01)
            w += grad
            np.sqrt(w, out=moved)
            moved += np.float32(1e-8)
            np.divide(m, moved, out=moved)
            moved *= pace
            own -= moved
