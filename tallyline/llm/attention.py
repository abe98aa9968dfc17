"""A small causal self-attention model of classes of subword ids, in numpy.

One head attends to the last ``WINDOW`` places with a learned weight per distance; a hidden layer
follows. Every id that occurs in the corpus is a class with an embedding and an output of its own.
The next one is chosen in steps: one of ``HEAD`` frequent ids, a group of frequent ids or the tail;
then an id of the group, or a group of the tail and an id of that. Ids that the corpus lacks, of which
nothing can be learnt, share the class ``RARE`` in equal parts.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np

HEAD, GROUPS, SIZE = 24, 24, 40
COMMON = HEAD + GROUPS * SIZE
TAILS = 222  # groups of the tail, and classes in each: room for all ids of the tokenizer
RARE = COMMON + TAILS * TAILS
BEGIN = RARE + 1
CLASSES = RARE + 2
TOPS = HEAD + GROUPS + 1
WIDTH, HIDDEN = 32, 32
WINDOW, STRIDE = 32, 16
_F = np.float32
_ONES = np.ones(TAILS + 1, _F)
_BATCH = 24000  # classes scored at once
_PLACES = 512  # places of windows that go through the layers at once
_NEVER = 1e-20  # for a count of a class that no id has


class Classes:
    """The class of every id, from the ids' counts in the corpus: the most frequent ids first."""

    def __init__(self, counts: np.ndarray) -> None:
        top = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        if len(top) > RARE:
            raise ValueError(f"{len(top)} ids, but {RARE} classes")
        self.of = np.full(len(counts), RARE, np.int32)
        self.of[top] = np.arange(len(top))
        rare = self.of == RARE
        self.log_share = np.where(rare, -np.log(max(rare.sum(), 1)), 0.0)
        self.counts = np.bincount(self.of, counts, minlength=CLASSES)
        self.counts[: len(top)] += 1.0
        self.counts[RARE:] += 1.0


def top_of(target: np.ndarray) -> np.ndarray:
    """The first choice that leads to a class."""
    group = HEAD + (target - HEAD) // SIZE
    return np.where(target < HEAD, target, np.where(target < COMMON, group, HEAD + GROUPS))


def initial(counts: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Small random weights; biases of the choices from the classes' counts."""
    random = np.random.default_rng(seed)
    counts = np.maximum(counts, _NEVER)
    inner = counts[HEAD:COMMON].reshape(GROUPS, SIZE)
    last = counts[COMMON:RARE].reshape(TAILS, TAILS)
    tail = np.append(last.sum(axis=1), counts[RARE])
    tops = np.concatenate([counts[:HEAD], inner.sum(axis=1), [tail.sum()]])
    shapes = {
        "embed": (CLASSES, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH),
        "mix": (WIDTH, WIDTH), "widen": (WIDTH, HIDDEN), "narrow": (HIDDEN, WIDTH), "top": (TOPS, WIDTH),
        "inner": (GROUPS, SIZE, WIDTH), "tail": (TAILS + 1, WIDTH), "last": (TAILS, TAILS, WIDTH),
    }
    small = ("embed", "top", "inner", "tail", "last")
    weights = {name: random.normal(0, 0.1 if name in small else 0.2, s) for name, s in shapes.items()}
    weights |= {
        "distance": np.zeros(WINDOW), "shift": np.zeros(HIDDEN),
        "top_bias": np.log(tops / tops.sum()), "inner_bias": np.log(inner / inner.sum(axis=1, keepdims=True)),
        "tail_bias": np.log(tail / tail.sum()), "last_bias": np.log(last / last.sum(axis=1, keepdims=True)),
    }
    return {name: w.astype(_F) for name, w in weights.items()}


def to_bytes(weights: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **weights)
    return out.getvalue()


def from_bytes(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as stored:
        return {name: stored[name] for name in stored.files}


_AGO = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
_CAUSAL = np.where(_AGO >= 0, 0, -1e9).astype(_F)
_SEEN = (_AGO >= 0).astype(_F)
_AGO = np.maximum(_AGO, 0)


def decay(distance: np.ndarray) -> np.ndarray:
    """What the distances of the places of a window make of their attention."""
    return np.exp(np.clip(distance, -30, 30))[_AGO] * _SEEN


def shares(pull: np.ndarray, fading: np.ndarray) -> np.ndarray:
    """Attention of every place of windows to the places up to it; ``pull`` is used up."""
    if max(pull.max(), -pull.min()) > 30:
        pull += _CAUSAL
        pull -= pull.max(axis=-1, keepdims=True)
    np.exp(pull, out=pull)
    pull *= fading
    pull /= (pull @ _ONES[:WINDOW])[..., None]
    return pull


def _step_table() -> np.ndarray:
    target = np.arange(CLASSES)
    return np.where(target < COMMON, top_of(target), HEAD + GROUPS + (target - COMMON) // TAILS).astype(np.uint16)


_STEP = _step_table()


def _steps_of(target: np.ndarray) -> np.ndarray:
    """A number per target that tells all its choices but the last: frequent ids, then groups, then groups
    of the tail, then RARE. Numbers of 16 bits are put in order by their digits, without comparisons."""
    return _STEP.take(target)


def _choices_of(target: np.ndarray, step: np.ndarray) -> Iterator[tuple[str, int | None, int, int, np.ndarray]]:
    """All choices on the way to targets that are ordered by their steps: weights, group in them, first and
    last row that choose, what they choose."""
    top, tail = np.minimum(step, HEAD + GROUPS), HEAD + GROUPS
    yield "top", None, 0, len(target), top
    edges = np.searchsorted(step, np.arange(HEAD, HEAD + GROUPS + TAILS + 2)).tolist()
    for group, (a, b) in enumerate(zip(edges[:GROUPS], edges[1 : GROUPS + 1])):
        if a < b:
            yield "inner", group, a, b, (target[a:b] - HEAD) % SIZE
    first = edges[GROUPS]
    if first < len(target):
        yield "tail", None, first, len(target), step[first:] - np.uint16(tail)  # RARE is what follows the last group
    for group, (a, b) in enumerate(zip(edges[GROUPS : GROUPS + TAILS], edges[GROUPS + 1 : GROUPS + TAILS + 1])):
        if a < b:
            yield "last", group, a, b, (target[a:b] - COMMON) % TAILS


def _forward(w: dict[str, np.ndarray], fading: np.ndarray, inputs: np.ndarray) -> tuple[np.ndarray, tuple]:
    """What windows end in, and what its derivatives are made of."""
    x = w["embed"].take(inputs.ravel(), axis=0)
    q, k, v = ((x @ w[name]).reshape(-1, WINDOW, WIDTH) for name in ("query", "key", "value"))
    share = shares(q @ _turned(k), fading)
    seen = (share @ v).reshape(-1, WIDTH)
    h = seen @ w["mix"]
    h += x
    active = h @ w["widen"]
    active += w["shift"]
    np.maximum(active, 0, out=active)
    z = active @ w["narrow"]
    z += h
    return z, (x, q, k, v, share, seen, h, active)


def _backward(turned: dict[str, np.ndarray], made: tuple, dz: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Derivatives of the embeddings of windows' inputs, and of the small weights."""
    x, q, k, v, share, seen, h, active = made
    g = {"narrow": active.T @ dz}
    d_raw = dz @ turned["narrow"]
    d_raw *= active > 0
    g["widen"], g["shift"] = h.T @ d_raw, d_raw.sum(axis=0)
    dh = d_raw @ turned["widen"]
    dh += dz
    g["mix"] = seen.T @ dh
    d_seen = (dh @ turned["mix"]).reshape(v.shape)
    d_share = d_seen @ _turned(v)
    d_share -= ((d_share * share) @ _ONES[:WINDOW])[..., None]
    d_share *= share
    g["distance"] = d_share.sum(axis=0)
    for name, d in (
        ("query", d_share @ k), ("key", d_share.transpose(0, 2, 1) @ q), ("value", share.transpose(0, 2, 1) @ d_seen)
    ):
        d = d.reshape(-1, WIDTH)
        g[name] = x.T @ d
        dh += d @ turned[name]
    return dh, g


def _with_biases(weights: np.ndarray, biases: np.ndarray) -> np.ndarray:
    return _turned(np.concatenate([weights, biases[..., None]], axis=-1))


def _turned(a: np.ndarray) -> np.ndarray:
    """The transposed matrices in their own order: products with them take half the time."""
    return np.ascontiguousarray(a.swapaxes(-1, -2))


def _choose(zs: np.ndarray, weights: np.ndarray, both: np.ndarray, choice: np.ndarray, each: float, dz: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss of one choice of rows, and the derivatives of its weights with the biases; those of the rows go to
    ``dz``. ``both``: weights and biases, turned."""
    loss, slopes = 0.0, np.zeros(both.shape[::-1], both.dtype)
    for a in range(0, len(zs), _PLACES):
        own = zs[a : a + _PLACES]
        p = own @ both
        if p.max() > 60:  # exp would leave the range of the type
            p -= p.max(axis=1, keepdims=True)
        flat, at = p.reshape(-1), np.arange(0, p.size, p.shape[1]) + choice[a : a + _PLACES]
        chosen = flat.take(at)
        np.exp(p, out=p)
        sums = p @ _ONES[: p.shape[1]]
        loss += float((np.log(sums) - chosen).sum())
        p *= (each / sums)[:, None]
        flat[at] -= each
        dz[a : a + _PLACES] += p @ weights
        slopes += p.T @ own
    return loss, slopes


def gradients(w: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, tuple]]:
    """Mean loss of a batch of windows and its derivatives; targets below 0 do not count. Of the large
    weights only the rows that the batch uses have any: each is given as rows and derivatives. Places are
    taken a few at a time: their arrays stay in the cache, and products of small matrices take less time."""
    scale, some = _F(1 / np.sqrt(WIDTH)), _PLACES // WINDOW
    scaled, fading = w | {"query": w["query"] * scale}, decay(w["distance"])
    made = [_forward(scaled, fading, inputs[a : a + some]) for a in range(0, len(inputs), some)]
    z = np.concatenate([part for part, _ in made])

    y = targets.ravel()
    rows = np.flatnonzero(y >= 0)
    step = _steps_of(y[rows])
    order = np.argsort(step, kind="stable")
    rows, step = rows[order], step[order]
    y, zs = y[rows], np.ones((len(rows), WIDTH + 1), z.dtype)  # the last column takes the biases
    zs[:, :WIDTH] = z.take(rows, axis=0)
    each = _F(1 / max(len(rows), 1))
    dz = np.zeros((len(rows), WIDTH), z.dtype)
    loss = 0.0
    g: dict[str, tuple] = {}
    parts: dict[str, list] = {"inner": [], "last": []}
    whole = {name: _with_biases(w[name], w[name + "_bias"]) for name in ("top", "inner", "tail")}
    for name, place, a, b, choice in _choices_of(y, step):
        if name == "last":
            both = _with_biases(w[name][place], w[name + "_bias"][place])
        else:
            both = whole[name] if place is None else whole[name][place]
        lost, slopes = _choose(zs[a:b], w[name] if place is None else w[name][place], both, choice, each, dz[a:b])
        loss += lost
        if place is None:
            g[name], g[name + "_bias"] = (..., slopes[:, :WIDTH]), (..., slopes[:, WIDTH])
        else:
            parts[name].append((place, slopes))
    for name, found in parts.items():
        if found:
            places, slopes = np.array([place for place, _ in found]), np.stack([slopes for _, slopes in found])
            g[name], g[name + "_bias"] = (places, slopes[..., :WIDTH]), (places, slopes[..., WIDTH])
    full = z  # is not needed any more
    full[:] = 0
    full[rows] = dz
    turned = {name: _turned(scaled[name]) for name in ("query", "key", "value", "mix", "widen", "narrow")}
    dx, small = np.empty_like(full), {}
    for number, (_, kept) in enumerate(made):
        at = slice(number * _PLACES, (number + 1) * _PLACES)
        dx[at], slopes = _backward(turned, kept, full[at])
        for name, slope in slopes.items():
            small[name] = np.add(small[name], slope, out=small[name]) if number else slope
    small["query"] *= scale
    small["distance"] = np.bincount(_AGO.ravel(), (small["distance"] * _SEEN).ravel(), minlength=WINDOW).astype(_F)
    g |= {name: (..., slope) for name, slope in small.items()}
    short = inputs.ravel().astype(np.uint16)  # there are under 65,536 classes
    order = np.argsort(short, kind="stable")
    short = short[order]
    starts = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
    g["embed"] = short[starts].astype(np.int64), np.add.reduceat(dx.take(order, axis=0), starts, axis=0)
    return loss * float(each), g


class Adam:
    """Weights in training, and how often each row of the large ones had derivatives."""

    def __init__(self, w: dict[str, np.ndarray]) -> None:
        self.w = {name: value.copy() for name, value in w.items()}
        self.first = {name: np.zeros_like(value) for name, value in w.items()}
        self.second = {name: np.zeros_like(value) for name, value in w.items()}
        self.steps = 0
        self.uses = {name: np.zeros(w[name].shape[0] if name in BY_ROW else 1) for name in w}

    def step(self, inputs: np.ndarray, targets: np.ndarray, rate: float) -> None:
        self.steps += 1
        _, g = gradients(self.w, inputs, targets)
        for name, (touched, slope) in g.items():
            if touched is not ... and len(touched) == len(self.w[name]):
                touched = ...  # each row once, in order
            one, two = self.first[name][touched], self.second[name][touched]
            one *= _F(0.9)
            one += _F(0.1) * slope
            two *= _F(0.99)
            two += _F(0.01) * slope**2
            if touched is not ...:
                self.first[name][touched], self.second[name][touched] = one, two
            size = two / _F(1 - 0.99**self.steps)
            np.sqrt(size, out=size)
            size += _F(1e-8)
            self.w[name][touched] -= _F(rate / (1 - 0.9**self.steps)) * one / size
            self.uses[name][touched if name in BY_ROW else ...] += 1

    def over(self, inputs: np.ndarray, targets: np.ndarray, rate: Callable[[int], float], random, batch: int) -> None:
        """All the windows once, in a random order."""
        order = random.permutation(len(inputs))
        for k in range(0, len(order), batch):
            at = order[k : k + batch]
            self.step(inputs[at], targets[at], rate(self.steps + 1))

    def moves(self, start: dict[str, np.ndarray]) -> np.ndarray:
        """How far the weights are from the start times their uses, and the uses, in one vector: sums of
        such vectors make the mean in which a row counts as often as it was used."""
        parts = []
        for name in sorted(start):
            uses = self.uses[name]
            moved = (self.w[name] - start[name]).reshape(len(uses), -1) * uses[:, None]
            parts += [moved.ravel(), uses]
        return np.concatenate(parts).astype(_F)


BY_ROW = ("embed", "last", "last_bias")


def moved(start: dict[str, np.ndarray], moves: np.ndarray) -> dict[str, np.ndarray]:
    """The start and the mean of the moves that were summed."""
    out, at = {}, 0
    for name in sorted(start):
        rows = start[name].shape[0] if name in BY_ROW else 1
        sums, uses = moves[at : at + start[name].size], moves[at + start[name].size :][:rows]
        at += len(sums) + rows
        mean = sums.reshape(rows, -1) / np.maximum(uses, 1)[:, None]
        out[name] = (start[name] + mean.reshape(start[name].shape)).astype(_F)
    return out


def windows(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of a stream of classes; every class but the first and the begin marks is a
    target once."""
    number = -(-(len(stream) - 1) // WINDOW)
    padded = np.full(number * WINDOW + 1, BEGIN, np.int32)
    padded[: len(stream)] = stream
    inputs, following = padded[:-1].reshape(-1, WINDOW), padded[1:].reshape(-1, WINDOW)
    return inputs, np.where(following == BEGIN, -1, following)


def train(w: dict[str, np.ndarray], stream: np.ndarray, steps: int, rate: float, seed: int, batch: int = 64) -> dict[str, np.ndarray]:
    """Adam over random windows of a stream of classes (documents one after the other)."""
    random = np.random.default_rng(seed)
    adam = Adam(w)
    if len(stream) <= WINDOW + 1:
        stream = np.resize(stream, WINDOW + 2) if len(stream) else np.full(WINDOW + 2, BEGIN)
    places = np.arange(WINDOW)
    for step in range(1, steps + 1):
        at = random.integers(0, len(stream) - WINDOW, batch)[:, None] + places
        following = stream[at + 1]
        targets = np.where(following == BEGIN, -1, following)
        adam.step(stream[at], targets, falling(rate, steps)(step))
    return adam.w


def falling(rate: float, steps: int) -> Callable[[int], float]:
    """Rate of a step: rising at first, then falling to three tenths."""
    return lambda step: rate * min(1.0, step / 30) * (1 - 0.7 * min(1.0, step / max(steps, 1)))


def _pairs(blocks: np.ndarray) -> np.ndarray:
    """Every block but the first, with the one before it in front: a view, nothing is copied."""
    n, size, width = blocks.shape
    return np.lib.stride_tricks.as_strided(blocks, (n - 1, 2 * size, width), blocks.strides, writeable=False)


class Scorer:
    """Log probabilities of whole documents. As inputs are classes, their queries, keys and mixed
    values are tables, made once."""

    def __init__(self, w: dict[str, np.ndarray]) -> None:
        self.w = w
        self.queries = w["embed"] @ w["query"] * _F(1 / np.sqrt(WIDTH))
        self.keys = w["embed"] @ w["key"]
        self.values = w["embed"] @ w["value"] @ w["mix"]
        ago = STRIDE + np.arange(STRIDE)[:, None] - np.arange(WINDOW)[None, :]
        self.near = np.where(ago >= 0, np.exp(np.clip(w["distance"][np.maximum(ago, 0)], -30, 30)), 0).astype(_F)
        self.choices = {n: np.concatenate([w[n], w[n + "_bias"][..., None]], axis=-1) for n in ("top", "inner", "tail", "last")}
        self.choices = {n: np.ascontiguousarray(both.swapaxes(-1, -2)) for n, both in self.choices.items()}

    def log_chances(self, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of every class but the first of each document, given those before it.

        Documents are taken a few at a time, and places of theirs in still smaller parts, so that the arrays stay
        in the cache; choices are made for all of the batch, as a group has few rows.
        """
        parts, first = [], 0
        while first < len(bounds) - 1:
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + _BATCH, side="right")) - 1)
            parts.append(self._batch(classes[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]))
            first = last
        return np.concatenate(parts) if parts else np.zeros(0, _F)

    def _batch(self, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """A window is a block of ``STRIDE`` places that are scored and the block before it, which is
        context only; the first block of a document has none.
        """
        sizes = np.diff(bounds) - 1
        blocks = -(-sizes // STRIDE)
        total = int(blocks.sum())
        starts = np.cumsum(blocks) - blocks
        doc = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        source = bounds[:-1][doc] + place
        slot = starts[doc] * STRIDE + place
        inputs = np.full((total + 1) * STRIDE, BEGIN, np.int32)
        inputs[slot + STRIDE] = classes[source]  # a block lies before the first
        inputs = inputs.reshape(-1, STRIDE)
        alone = np.zeros(total, bool)
        alone[starts[sizes > 0]] = True
        z = np.ones((total * STRIDE, WIDTH + 1), _F)  # the last column takes the biases
        some = _PLACES // STRIDE
        for a in range(0, total, some):
            z[a * STRIDE : (a + some) * STRIDE, :WIDTH] = self._ends(inputs[a : a + some + 1], alone[a : a + some])
        return self._choices(z, slot, classes[source + 1])

    def _ends(self, inputs: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """What the places of all blocks but the first end in. Each sees the block before, if it is not alone."""
        own = inputs[1:].ravel()
        keys, values = (_pairs(table.take(inputs, axis=0, mode="clip")) for table in (self.keys, self.values))
        pull = self.queries.take(own, axis=0, mode="clip").reshape(-1, STRIDE, WIDTH) @ keys.swapaxes(1, 2)
        if max(pull.max(), -pull.min()) > 30:
            np.clip(pull, -30, 30, out=pull)
        np.exp(pull, out=pull)
        pull *= self.near
        pull[alone, :, : WINDOW - STRIDE] = 0
        h = pull @ values
        h /= (pull @ _ONES[:WINDOW])[:, :, None]
        h = h.reshape(-1, WIDTH)
        h += self.w["embed"].take(own, axis=0, mode="clip")
        wide = h @ self.w["widen"]
        wide += self.w["shift"]
        np.maximum(wide, 0, out=wide)
        h += wide @ self.w["narrow"]
        return h

    def _choices(self, z: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
        step = _steps_of(target)
        order = np.argsort(step, kind="stable")
        z, found = z.take(rows[order], axis=0), np.zeros(len(rows), _F)
        for name, group, a, b, choice in _choices_of(target[order], step[order]):
            weights = self.choices[name] if group is None else self.choices[name][group]
            found[a:b] += self._chance(z[a:b], weights, choice)
        out = np.empty_like(found)
        out[order] = found
        return out

    @staticmethod
    def _chance(z: np.ndarray, weights: np.ndarray, choice: np.ndarray) -> np.ndarray:
        logits = z @ weights
        if logits.size and logits.max() > 60:  # exp would leave the range of the type
            logits -= logits.max(axis=1, keepdims=True)
        chosen = logits.reshape(-1).take(np.arange(0, logits.size, logits.shape[1]) + choice)
        np.exp(logits, out=logits)
        return chosen - np.log(logits @ _ONES[: logits.shape[1]])
