"""A small causal self-attention language model on subword ids, in numpy.

One attention layer reads a window of the last ``CONTEXT`` to 2 * ``CONTEXT`` - 1 ids: queries, keys
and values are linear in the ids' embeddings, scores carry a learned bias for each distance, and
the layer's output is added to the last id's embedding. A rectified hidden layer follows, whose
output is added as well. The softmax covers the whole vocabulary in two levels: first the group of
the next id, then the id within its group, both learned. Groups have about equal size and hold ids
that occur between the same neighbours, so a target costs about 2 * sqrt(vocabulary) units and the
probabilities of all ids sum to one.

A text is scored in windows of 2 * ``CONTEXT`` ids that overlap by half: the first half of a window
is context, the second half is scored, so each id is scored exactly once. Windows are batched, with
one causal mask. The steps of a batch go over blocks of it that a core's cache holds, first over
blocks of windows, then over blocks of targets in the order of their groups.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

CONTEXT = 16
WIDTH, KEY, HIDDEN = 32, 16, 64
VOCABULARY = 49_408
#: Ids of the tokenizer that stand for a text's start and end.
START, END = 49_406, 49_407
#: Neighbouring ids that tell groups apart.
NEIGHBOURS = 256
#: Windows scored at a time.
WINDOWS = 1024
#: Inputs or targets of a block, about, and weights of a block of the optimiser: what lies in a core's cache together.
BLOCK, WEIGHT_BLOCK = 2048, 1 << 14
#: Ids of context before the targets of a window that is learned from.
TRAIN_BACK = 0
#: Windows of a step, its rate, and passes over the sample that gives the first weights.
BATCH, RATE, EPOCHS = 64, 0.004, 5
#: The same for ``Learner`` over the whole training corpus, which sees each window once.
SHARD_BATCH, SHARD_RATE = 256, 0.004
#: Sums of exponentials between which the largest term need not be taken off first.
FEW, MANY = 1e-20, 1e20


@functools.cache
def _mask(back: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the inputs before each target of a window with ``back`` ids of context, and what hides later ones."""
    ahead = np.arange(back, 2 * CONTEXT)[:, None] - np.arange(2 * CONTEXT)[None, :]
    return ahead.clip(0), np.where(ahead >= 0, 0, -1e9).astype(np.float32)


def window_count(rows: np.ndarray, back: int = CONTEXT) -> np.ndarray:
    """Windows of each text; a window has 2 ``CONTEXT`` - ``back`` targets, the text's end among them."""
    return -(-(np.diff(rows) + 1) // (2 * CONTEXT - back))


def windows(ids: np.ndarray, rows: np.ndarray, number: np.ndarray, back: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (windows x 2 CONTEXT) and targets (-1 beyond the end) of the windows numbered, and their text.

    Target t of a window follows input ``back`` + t. Every text gets its end id as last target.
    """
    edge = np.concatenate([[0], np.cumsum(window_count(rows, back))])
    owner = np.searchsorted(edge, number, "right") - 1
    span = 2 * CONTEXT - back
    place = ((number - edge[owner]) * span - back)[:, None] + np.arange(2 * CONTEXT)[None, :]
    length, start = np.diff(rows)[owner][:, None], rows[:-1][owner][:, None]
    held = ids if len(ids) else np.zeros(1, np.uint16)

    def at(p: np.ndarray) -> np.ndarray:
        out = held.take(start + p, mode="clip").astype(np.int32)
        out[p < 0] = START
        over = p >= length
        out[over] = np.where(p == length, END, -1)[over]
        return out

    given, target = at(place - 1), at(place[:, back:])
    return np.where(given < 0, END, given), target, owner


def grouped_ids(ids: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """All ids in groups of about sqrt(vocabulary), by halves along the main axis of their neighbours.

    Ids that do not occur in ``ids`` have no neighbours and fill groups by their number.
    """
    known = np.flatnonzero(counts > 0)
    near = np.argsort(-counts, kind="stable")[:NEIGHBOURS]
    place = np.full(VOCABULARY, NEIGHBOURS)
    place[near] = np.arange(len(near))
    row = np.full(VOCABULARY, -1)
    row[known] = np.arange(len(known))
    x = np.zeros(len(known) * 2 * (NEIGHBOURS + 1), np.float32)
    if len(ids) > 1:
        left, right = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
        width = 2 * (NEIGHBOURS + 1)
        x += np.bincount(row[right] * width + place[left], minlength=len(x))
        x += np.bincount(row[left] * width + NEIGHBOURS + 1 + place[right], minlength=len(x))
    x = np.sqrt(x.reshape(len(known), -1))
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1))[:, None]
    size = max(2.0, np.sqrt(max(1, len(known))))

    def halves(members: np.ndarray) -> list[np.ndarray]:
        if len(members) <= size:
            return [members]
        y = x[members] - x[members].mean(axis=0)
        axis = np.random.default_rng(len(members)).standard_normal(y.shape[1]).astype(np.float32)
        for _ in range(8):
            axis = y.T @ (y @ axis)
            axis /= max(1e-9, float(np.linalg.norm(axis)))
        order = np.argsort(y @ axis, kind="stable")
        half = len(order) // 2
        return halves(members[order[:half]]) + halves(members[order[half:]])

    out = [known[m] for m in halves(np.arange(len(known)))] if len(known) else []
    rest = np.setdiff1d(np.arange(VOCABULARY), known)
    return out + [rest] if len(rest) else out


WEIGHTS = ("embed", "query", "key", "value", "bias", "enter", "enter_bias", "leave", "group", "group_bias", "within", "within_bias")


@dataclass
class Model:
    """Weights by name; ``slot`` is an id's row in ``embed`` and ``within``, in which a group's ids are neighbours.

    Unseen ids share the last row and have equal parts of its probability.
    """

    slot: np.ndarray
    edges: np.ndarray  # first row of each group, and the number of rows
    spare: float  # log10 of an unseen id's part
    weights: dict[str, np.ndarray]
    group_of: np.ndarray = field(init=False)
    padded: np.ndarray = field(init=False)  # rows of each group, and beyond its end the number of all rows

    def __post_init__(self) -> None:
        size = np.diff(self.edges)
        self.group_of = np.repeat(np.arange(len(size)), size)
        place = np.arange(size.max())
        self.padded = np.where(place < size[:, None], self.edges[:-1, None] + place, self.edges[-1])

    def with_weights(self, weights: dict[str, np.ndarray]) -> Model:
        return Model(self.slot, self.edges, self.spare, weights)

    def score(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """log10 probability of each text, its end included."""
        w, output = self.weights, _Output.of(self.weights)
        total = np.zeros(len(rows) - 1)
        asking = np.concatenate([(w["embed"] @ w["query"]) / np.float32(np.sqrt(KEY)), w["embed"]], axis=1)
        asked = np.concatenate([w["embed"] @ w["key"], w["embed"] @ w["value"]], axis=1)
        distance, hidden = _mask(CONTEXT)
        shift = w["bias"][distance] + hidden
        count = int(window_count(rows).sum())
        for lo in range(0, count, WINDOWS):
            given, target, owner = windows(ids, rows, np.arange(lo, min(count, lo + WINDOWS)))
            x = self.slot.take(given)
            h = np.empty((*target.shape, WIDTH), np.float32)
            for i, j in _window_blocks(x):
                q, kv = asking.take(x[i:j, CONTEXT:], axis=0), asked.take(x[i:j], axis=0)
                np.matmul(_attention(q[..., :KEY], kv[..., :KEY], shift), kv[..., KEY:], out=h[i:j])
                h[i:j] += q[..., KEY:]
            order, goal, cuts = self._sorted(target)
            h = h.reshape(-1, WIDTH)
            log = np.empty(len(order))
            for i, j in _target_blocks(cuts):
                top = _hidden(w, h.take(order[i:j], axis=0))[2]
                log[i:j] = self._logs(w, top, goal[i:j], cuts.clip(i, j) - i, output=output)[0]
            log = log / np.log(10) + np.where(goal == len(self.group_of) - 1, self.spare, 0)
            total += np.bincount(owner.take(order // CONTEXT), log, len(total))
        return total

    def _sorted(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of real targets in the order of their groups, their rows, and where each group starts."""
        y = target.ravel()
        # Short integers, which a radix sort takes.
        row = np.where(y >= 0, self.slot.take(y, mode="clip"), np.int32(len(self.group_of))).astype(np.uint16)
        order = np.argsort(row, kind="stable")
        order = order[: len(order) - int((y < 0).sum())]
        goal = row[order].astype(np.int64)
        return order, goal, np.searchsorted(goal, self.edges)

    def _logs(
        self, w: dict[str, np.ndarray], h: np.ndarray, goal: np.ndarray, cuts: np.ndarray, learn: bool = False, output: _Output | None = None, total: int | None = None
    ) -> tuple[np.ndarray, dict | None]:
        """Natural log probability of each target's row, in the order of groups; with ``learn`` the gradients too, that of ``h`` as ``h``.

        Of a block of ``total`` targets, ``output`` holds the layer's weights and the sums of its gradients.
        """
        n = len(h)
        output = output or _Output.of(w)
        counted, group = np.arange(n), self.group_of.take(goal)
        filled = np.flatnonzero(np.diff(cuts)).tolist()
        # The block's groups are padded to one width, so that all but the products are done for all of them at once.
        low, high = (filled[0], filled[-1] + 1) if filled else (0, 0)
        width = int(np.diff(self.edges[low : high + 1]).max(initial=0))
        padded = self.padded[low:high, :width]
        laid = output.within.take(padded, axis=0)
        at, own = (counted, group), (counted, goal - self.edges.take(group))
        h1 = np.ones((n, WIDTH + 1), output.top.dtype)
        h1[:, :WIDTH] = h

        def inside() -> np.ndarray:
            out = np.empty((n, width), h1.dtype)
            for k in filled:
                np.matmul(h1[cuts[k] : cuts[k + 1]], laid[k - low].T, out=out[cuts[k] : cuts[k + 1]])
            return out

        log, z, top_sums = _softmax(lambda: h1 @ output.top, at)
        chosen, v, sums = _softmax(inside, own)
        log += chosen
        if not learn:
            return log, None
        part = z.dtype.type(1 / max(1, n if total is None else total))
        z *= (part / top_sums)[:, None]
        z[at] -= part
        v *= (part / sums)[:, None]
        v[own] -= part
        moved, dh = np.zeros_like(laid), np.empty((n, WIDTH), h1.dtype)
        for k in filled:
            i, j = cuts[k], cuts[k + 1]
            np.matmul(v[i:j].T, h1[i:j], out=moved[k - low])
            np.matmul(v[i:j], laid[k - low, :, :WIDTH], out=dh[i:j])
        dh += z @ output.top[:WIDTH].T
        output.top_sum += h1.T @ z
        output.within_sum[self.edges[low] : self.edges[high]] += moved[padded < self.edges[-1]]
        return log, output.gradients() | {"h": dh}

    def gradients(self, w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss over a batch's targets (rows ``x`` and ids ``y``)."""
        back = x.shape[1] - y.shape[1]
        distance, hidden = _mask(back)
        shift = w["bias"][distance] + hidden
        scale = np.float32(1 / np.sqrt(KEY))
        # All rows of a block go through one product; stacks of small ones would be multiplied one by one.
        mixing = np.concatenate([w["key"], w["value"], w["query"] * scale], axis=1)
        h, held = np.empty((*y.shape, WIDTH), mixing.dtype), []
        for i, j in _window_blocks(x):
            e = w["embed"].take(x[i:j], axis=0)
            made = (e.reshape(-1, WIDTH) @ mixing).reshape(*e.shape[:2], -1)
            a = _attention(made[:, back:, KEY + WIDTH :], made[..., :KEY], shift)
            np.matmul(a, made[..., KEY : KEY + WIDTH], out=h[i:j])
            h[i:j] += e[:, back:]
            held.append((e, made, a))

        order, goal, cuts = self._sorted(y)
        h, dh = h.reshape(-1, WIDTH), np.zeros((y.size, WIDTH), mixing.dtype)
        output, g = _Output.of(w), {k: np.zeros_like(w[k]) for k in ("enter", "enter_bias", "leave")}
        for i, j in _target_blocks(cuts):
            own = h.take(order[i:j], axis=0)
            inner, on, top = _hidden(w, own)
            dtop = self._logs(w, top, goal[i:j], cuts.clip(i, j) - i, True, output, len(order))[1]["h"]
            dinner = dtop @ w["leave"].T
            dinner *= on
            g["leave"] += inner.T @ dtop
            g["enter"] += own.T @ dinner
            g["enter_bias"] += np.ones(j - i, dinner.dtype) @ dinner
            dtop += dinner @ w["enter"].T
            dh[order[i:j]] = dtop
        g |= output.gradients()

        dh = dh.reshape(*y.shape, WIDTH)
        de, dmixing, dshift = np.empty((*x.shape, WIDTH), mixing.dtype), np.zeros_like(mixing), np.zeros_like(shift)
        for (i, j), (e, made, a) in zip(_window_blocks(x), held, strict=True):
            k, v, q = made[..., :KEY], made[..., KEY : KEY + WIDTH], made[:, back:, KEY + WIDTH :]
            dmade = np.zeros_like(made) if back else np.empty_like(made)
            ds = np.matmul(dh[i:j], v.transpose(0, 2, 1))
            np.matmul(a.transpose(0, 2, 1), dh[i:j], out=dmade[..., KEY : KEY + WIDTH])
            ds -= np.einsum("bij,bij->bi", ds, a)[:, :, None]
            ds *= a
            dshift += ds.sum(axis=0)
            np.matmul(ds.transpose(0, 2, 1), q, out=dmade[..., :KEY])
            np.matmul(ds, k, out=dmade[:, back:, KEY + WIDTH :])
            dmade = dmade.reshape(-1, KEY + WIDTH + KEY)
            dmixing += e.reshape(-1, WIDTH).T @ dmade
            np.matmul(dmade, mixing.T, out=de[i:j].reshape(-1, WIDTH))
            de[i:j, back:] += dh[i:j]
        g["bias"] = np.bincount(distance.ravel(), dshift.ravel(), 2 * CONTEXT).astype(np.float32)
        g["key"], g["value"], g["query"] = np.split(dmixing, [KEY, KEY + WIDTH], axis=1)
        g["query"] = g["query"] * scale
        g["embed"] = _scattered(x.ravel(), de.reshape(-1, WIDTH), len(w["embed"]))
        return g


@dataclass
class _Output:
    """Weights of the output layer with their biases, as its products take them, and the sums of their gradients."""

    top: np.ndarray
    within: np.ndarray  # the last row is that beyond a group's end
    top_sum: np.ndarray
    within_sum: np.ndarray

    @classmethod
    def of(cls, w: dict[str, np.ndarray]) -> _Output:
        top = np.concatenate([w["group"], w["group_bias"][None, :]])
        within = np.zeros((len(w["within"]) + 1, WIDTH + 1), top.dtype)
        within[:-1, :WIDTH], within[:-1, WIDTH], within[-1, WIDTH] = w["within"], w["within_bias"], -1e9
        return cls(top, within, np.zeros_like(top), np.zeros_like(within[:-1]))

    def gradients(self) -> dict[str, np.ndarray]:
        top, within = self.top_sum, self.within_sum
        return {"group": top[:WIDTH], "group_bias": top[WIDTH], "within": within[:, :WIDTH], "within_bias": within[:, WIDTH]}


def _window_blocks(x: np.ndarray) -> Iterator[tuple[int, int]]:
    step = max(1, BLOCK // x.shape[1])
    return ((i, min(len(x), i + step)) for i in range(0, len(x), step))


def _target_blocks(cuts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``BLOCK`` targets that hold whole groups."""
    i = int(cuts[0])
    while i < cuts[-1]:
        j = int(cuts[np.searchsorted(cuts, i + BLOCK, "right") - 1])
        j = j if j > i else int(cuts[np.searchsorted(cuts, i, "right")])
        yield i, j
        i = j


def _exponentials(z: np.ndarray) -> np.ndarray | None:
    """Turns ``z`` into exponentials and gives the sum of each row, or None if one is out of bounds."""
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
        sums = z @ np.ones(z.shape[1], np.float32)
    return sums if not len(sums) or (sums.min() > FEW and sums.max() < MANY) else None


def _softmax(logits: Callable[[], np.ndarray], at: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities at the places ``at``, and the exponentials and their sums, of which all probabilities are quotients."""
    z = logits()
    log = z[at]
    sums = _exponentials(z)
    if sums is None:
        z = logits()
        z -= z.max(axis=1, keepdims=True)
        log = z[at]
        np.exp(z, out=z)
        sums = z.sum(axis=1)
    log -= np.log(sums)
    return log, z, sums


def _attention(q: np.ndarray, k: np.ndarray, shift: np.ndarray) -> np.ndarray:
    a = np.matmul(q, k.transpose(0, 2, 1))
    a += shift
    sums = _exponentials(a.reshape(-1, a.shape[2]))
    if sums is None:
        a = np.matmul(q, k.transpose(0, 2, 1))
        a += shift
        a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        sums = a.sum(axis=2)
    a *= (1 / sums).reshape(*a.shape[:2], 1)
    return a


def _hidden(w: dict[str, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inner = h @ w["enter"]
    inner += w["enter_bias"]
    np.maximum(inner, 0, out=inner)
    top = inner @ w["leave"]
    top += h
    return inner, inner > 0, top


def _scattered(index: np.ndarray, grads: np.ndarray, rows: int) -> np.ndarray:
    """The sum of the gradients of each row."""
    out = np.zeros((rows, grads.shape[1]), np.float32)
    index = index.astype(np.uint16) if rows < 1 << 16 else index
    order = np.argsort(index, kind="stable")
    first = np.flatnonzero(np.diff(index[order].astype(np.int64), prepend=-1))
    out[index[order[first]]] = np.add.reduceat(grads.take(order, axis=0), first, axis=0)
    return out


class Adam:
    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.weights, self.steps = weights, 0
        self.slow = {k: np.zeros_like(v) for k, v in weights.items()}
        self.fast = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        one, two = 1 - 0.9**self.steps, np.sqrt(1 - 0.99**self.steps)
        least, rate = np.float32(1e-8 * two), np.float32(rate * two / one)
        spare = np.empty(WEIGHT_BLOCK, np.float32)
        for name, weight in self.weights.items():
            own = [v.reshape(-1) for v in (weight, grads[name], self.slow[name], self.fast[name])]
            for lo in range(0, weight.size, WEIGHT_BLOCK):
                w, g, slow, fast = (v[lo : lo + WEIGHT_BLOCK] for v in own)
                t = spare[: len(w)]
                np.subtract(g, slow, out=t)
                t *= np.float32(0.1)
                slow += t
                np.multiply(g, g, out=t)
                t -= fast
                t *= np.float32(0.01)
                fast += t
                np.sqrt(fast, out=t)
                t += least
                np.divide(slow, t, out=t)
                t *= rate
                w -= t


def first_weights(ids: np.ndarray, rows: np.ndarray, counts: np.ndarray, seed: int = 3) -> Model:
    """A model with drawn weights; ``counts`` has each id's occurrences in all training texts."""
    draw = np.random.default_rng(seed)
    counts = np.append(counts, np.zeros(max(0, VOCABULARY - len(counts))))[:VOCABULARY].astype(np.float64)
    counts[END] = max(counts[END], len(rows) - 1, 1)
    groups = grouped_ids(ids, counts)
    unseen = np.flatnonzero(counts == 0)
    seen = groups[:-1] if len(unseen) else groups
    slot = np.zeros(VOCABULARY, np.int32)
    laid = np.concatenate(seen)
    slot[laid] = np.arange(len(laid))
    edges = np.concatenate([[0], np.cumsum([len(s) for s in seen])])
    mass = counts[laid] + 0.5
    # One row for all unseen ids, a group of its own; it is there even if none is unseen.
    slot[unseen] = len(laid)
    edges, mass = np.append(edges, len(laid) + 1), np.append(mass, 0.5)
    share = np.add.reduceat(mass, edges[:-1])

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (draw.standard_normal(shape) * scale).astype(np.float32)

    weights = {
        "embed": normal(len(mass), WIDTH, scale=0.3),
        "query": normal(WIDTH, KEY, scale=0.3),
        "key": normal(WIDTH, KEY, scale=0.3),
        "value": normal(WIDTH, WIDTH, scale=0.1),
        "bias": (-0.5 * np.arange(2 * CONTEXT)).astype(np.float32),
        "enter": normal(WIDTH, HIDDEN, scale=0.3),
        "enter_bias": np.zeros(HIDDEN, np.float32),
        "leave": normal(HIDDEN, WIDTH, scale=0.05),
        "group": normal(WIDTH, len(share), scale=0.1),
        "group_bias": np.log(share / share.sum()).astype(np.float32),
        "within": normal(len(mass), WIDTH, scale=0.1),
        "within_bias": np.log(mass).astype(np.float32),
    }
    return Model(slot, edges, -float(np.log10(max(1, len(unseen)))), weights)


def train(ids: np.ndarray, rows: np.ndarray, counts: np.ndarray, seed: int = 3, epochs: int = EPOCHS) -> Model:
    """``first_weights`` fitted to the texts given, ``epochs`` times over."""
    model = first_weights(ids, rows, counts, seed)
    draw, adam, count = np.random.default_rng(seed), Adam(model.weights), int(window_count(rows, TRAIN_BACK).sum())
    for epoch in range(epochs):
        order = draw.permutation(count)
        for lo in range(0, count, BATCH):
            given, target, _ = windows(ids, rows, order[lo : lo + BATCH], TRAIN_BACK)
            rate = RATE * (1 - (epoch + lo / count) / epochs) + 1e-4
            adam.step(model.gradients(model.weights, model.slot[given], target), rate)
    return model


class Learner:
    """Goes over the texts of one shard from the weights of ``model``; ``change`` is how far they went, in one vector."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.adam = Adam({k: v.copy() for k, v in model.weights.items()})
        self.windows = 0

    def learn(self, ids: np.ndarray, rows: np.ndarray) -> None:
        count = int(window_count(rows, TRAIN_BACK).sum())
        self.windows += count
        # Neighbouring windows of a text go to different batches.
        order = np.random.default_rng(self.windows).permutation(count)
        for lo in range(0, count, SHARD_BATCH):
            given, target, _ = windows(ids, rows, order[lo : lo + SHARD_BATCH], TRAIN_BACK)
            grads = self.model.gradients(self.adam.weights, self.model.slot[given], target)
            self.adam.step(grads, SHARD_RATE * len(given) / SHARD_BATCH)

    def change(self) -> np.ndarray:
        return np.concatenate([(self.adam.weights[k] - self.model.weights[k]).ravel() for k in WEIGHTS])


def changed(model: Model, change: np.ndarray) -> Model:
    """The model moved by a mean change."""
    out, start = {}, 0
    for k in WEIGHTS:
        w = model.weights[k]
        out[k] = (w + change[start : start + w.size].reshape(w.shape)).astype(np.float32)
        start += w.size
    return model.with_weights(out)
