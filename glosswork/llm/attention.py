"""A small causal self-attention model over subword ids, in numpy.

P(id | before) = P(group | before) * P(class | group, before) * P(id | class). Classes hold ids that stand beside the same
ids in the corpus (see ``Contexts``), and groups such classes, so that they tell language and kind and little is left to
P(id | class), which comes from smoothed corpus counts; without contexts they are ranges of ids by frequency. One attention
layer with relative positions predicts the group and, within it, the class. Queries, keys and values depend on the id alone, so they are tables once
the model is trained. Text is read in blocks: a window is a block and the one before, and every token is scored once,
in its own block, with between a half and a whole window before it.
"""

from __future__ import annotations

import numpy as np

BLOCK, DIM, GROUPS, EACH = 16, 16, 32, 16
#: Numbers for each side that stand for an id's neighbours, and turns of grouping ids by them.
SIDE, TURNS = 24, 15
STEPS, BATCH, RATE = 400, 128, 0.01


def _by_frequency(counts: np.ndarray, classes: int) -> np.ndarray:
    """A class for each id: ranges by frequency of about equal mass."""
    order = np.argsort(-counts, kind="stable")
    mass = counts[order] + 1
    left, class_of = mass.sum(), np.empty(len(counts), np.int32)
    c = held = 0
    for i, m in zip(order, mass):  # a class closes once it has its share of what was left when it began
        if not held:
            share = left / max(1, classes - c)
        class_of[i] = c
        held += m
        left -= m
        if held >= share * (1 - 1e-9) and c < classes - 1:
            c, held = c + 1, 0.0
    return class_of


def powers(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """Exponentials, their sums by row, and what was taken off each row before.

    Sums are products with ones; the greatest of a row is looked for only where some row is out of range without it.
    """
    ones, top = np.ones(z.shape[1], z.dtype), 0.0
    with np.errstate(over="ignore"):
        made = np.exp(z)
        total = made @ ones
    if len(z) and not (total.min() > 1e-20 and total.max() < 1e20):
        top = z.max(-1)
        made = np.exp(z - top[:, None])
        total = made @ ones
    return made, total, top


class Contexts:
    """What stands before and after each id, as sums of random signs of the neighbours, rarer ones weighing more."""

    def __init__(self, counts: np.ndarray, side: int = SIDE, seed: int = 3):
        signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (len(counts), side))
        self.signs = signs / np.sqrt(counts + 10)[:, None].astype(np.float32)
        self.sums = np.zeros((len(counts), 2 * side), np.float32)

    def add(self, texts: list[np.ndarray]) -> None:
        """Counts the neighbours in texts' ids, with the end mark (the last id) around each text."""
        size, side = len(self.signs), self.signs.shape[1]
        end = np.array([size - 1])
        row = np.concatenate([end, *(x for t in texts for x in (t, end))]).astype(np.int64)
        pairs, n = np.unique(row[:-1] * size + row[1:], return_counts=True)
        a, b, n = pairs // size, pairs % size, n.astype(np.float32)[:, None]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        self.sums[a[first], side:] += np.add.reduceat(self.signs[b] * n, first, 0)
        order = np.argsort(b, kind="stable")
        b = b[order]
        first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        self.sums[b[first], :side] += np.add.reduceat(self.signs[a[order]] * n[order], first, 0)


def grouped(sums: np.ndarray, counts: np.ndarray, groups: int = GROUPS, each: int = EACH, turns: int = TURNS) -> np.ndarray:
    """A class for each id, group * ``each`` + place in it, by its contexts.

    Classes are k-means, in which an id weighs the root of its count, begun at the most frequent ids. Their centres are
    halved at the median of their widest side until there are ``groups`` (a power of two) of equal size.
    """
    x, weight = (sums / (counts + 5)[:, None]).astype(np.float32), np.sqrt(counts.astype(np.float64))
    centres = x[np.argsort(-counts, kind="stable")[: groups * each]].copy()
    of = np.zeros(len(x), np.int64)
    for _ in range(turns):
        of = ((centres * centres).sum(1)[None, :] - 2 * (x @ centres.T)).argmin(1)
        held = np.bincount(of, weight, len(centres))
        for j in range(x.shape[1]):
            centres[:, j] = np.bincount(of, weight * x[:, j], len(centres)) / np.maximum(held, 1e-9)
    parts = [np.arange(len(centres))]
    while len(parts) < groups:
        parts = [half for own in parts for half in np.array_split(own[np.argsort(centres[own][:, int(centres[own].var(0).argmax())] if len(own) else own, kind="stable")], 2)]
    place = np.empty(len(centres), np.int64)
    for g, own in enumerate(parts):
        place[own] = g * each + np.arange(len(own))
    return place[of]


class Model:
    """``counts``: how often the corpus has each id; the last one ends a text, and one more stands for what is not there."""

    def __init__(self, counts: np.ndarray, groups: int = GROUPS, each: int = EACH, dim: int = DIM, block: int = BLOCK, seed: int = 7, class_of: np.ndarray | None = None):
        self.block, self.dim, self.groups, self.each = block, dim, groups, each
        counts = counts.astype(np.float64)
        self.size = len(counts)
        self.class_of = (_by_frequency(counts, groups * each) if class_of is None else class_of).astype(np.int32)
        self.group_of = self.class_of // each
        total = np.bincount(self.class_of, counts + 1, groups * each)
        self.within = np.log((counts + 1) / total[self.class_of])
        total = total.reshape(groups, each)
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.place = np.full(self.size + 1, -1, np.int64)  # an id's row of the trained embeddings
        share = np.log(np.maximum(total.sum(1), 1e-9) / total.sum())
        self.p = {"q": draw(dim, dim), "k": draw(dim, dim), "v": draw(dim, dim), "o": draw(dim, groups), "e": draw(dim, groups), "b": share.astype(np.float32), "r": np.zeros(2 * block, np.float32)}
        # by group: weights of what the attention gives, of the id itself and of a constant; places without a class have none
        inside = np.where(total > 0, np.log(np.maximum(total, 1e-9) / np.maximum(total.sum(1), 1e-9)[:, None]), -1e4)
        self.p["c"] = np.concatenate([draw(2 * dim, groups * each).reshape(2 * dim, groups, each).transpose(1, 0, 2), inside[:, None, :].astype(np.float32)], 1)
        self.draw = draw
        i, j = np.arange(block)[:, None] + block, np.arange(2 * block)[None, :]
        self.gap, self.late = np.maximum(i - j, 0), j > i

    def blocks(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs by block, targets by block (-1: none), and whose text a block is; a text's first block has -1: nothing is before it.

        A text of n ids is n + 1 predictions: each id and the end, from an opening mark and the ids before.
        """
        s, pad, end = self.block, self.size, self.size - 1
        steps = counts + 1
        own = 1 + -(-steps // s)
        starts = (np.cumsum(own) - own) * s
        inputs = np.full(int(own.sum()) * s, pad, np.int64)
        targets = np.full(len(inputs), -1, np.int64)
        first = np.cumsum(counts) - counts
        to = np.arange(len(ids)) + np.repeat(starts + s - first, counts)
        targets[to] = ids
        inputs[to + 1] = ids  # a text of n ids has n + 1 places, so this stays inside its blocks
        targets[starts + s + counts] = end
        inputs[starts + s] = end
        owner = np.repeat(np.arange(len(counts)), own)
        owner[np.cumsum(own) - own] = -1
        return inputs.reshape(-1, s), targets.reshape(-1, s), owner

    def begin(self, known: np.ndarray) -> "Model":
        """Draws embeddings for the ``known`` ids; row 0 stands for every other id, the last one for what is not there."""
        self.place[:] = 0
        self.place[known] = np.arange(1, len(known) + 1)
        self.place[self.size] = len(known) + 1
        self.p["emb"] = self.draw(len(known) + 2, self.dim) * np.float32(np.sqrt(len(known) + 2))
        return self

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients for windows ``x`` of embedding rows and targets ``y``; that of the embeddings is for the rows given besides.

        A column more of the keys shuts out what is not there, one of the values adds up the weights, which are never divided.
        """
        p, d, s, n = self.p, self.dim, self.block, len(x)
        own = p["q"].dtype.type
        scale = own(1 / np.sqrt(d))
        flat, y = x.ravel(), y.ravel()
        e = p["emb"].take(flat, 0)
        eq = e.reshape(n, 2 * s, d)[:, s:].reshape(-1, d)
        none = np.zeros((d, 1), own)
        both, query = np.concatenate([p["k"], none, p["v"], none], 1), np.concatenate([p["q"] * scale, none], 1)
        kv = e @ both
        kv[:, d] = (flat == len(p["emb"]) - 1) * own(-1e4)
        kv[:, -1] = 1
        kv = kv.reshape(n, 2 * s, -1)
        k, val = kv[..., : d + 1], kv[..., d + 1 :]
        q = eq @ query
        q[:, d] = 1
        q = q.reshape(n, s, d + 1)
        a, o = self.attended(q, k, val, np.where(self.late, own(-1e4), p["r"][self.gap]))
        o = o.reshape(-1, d + 1)
        # what the attention gives, the id itself and a constant in one product
        inner = np.empty((n * s, 2 * d + 1), own)
        np.divide(o[:, :d], o[:, d:], out=inner[:, :d])
        inner[:, d : 2 * d] = eq
        inner[:, 2 * d] = 1
        outer = np.concatenate([p["o"], p["e"], p["b"][None]])
        at = np.flatnonzero(y >= 0)
        share = own(1 / max(1, len(at)))
        dl, total, _ = powers(inner @ outer)
        dl *= ((y >= 0) * share / total)[:, None]
        dl[at, self.group_of.take(y.take(at))] -= share
        whole = inner.T @ dl
        back = dl @ np.ascontiguousarray(outer[: 2 * d].T)
        g = {"o": whole[:d], "e": whole[d : 2 * d], "b": whole[2 * d], "c": np.zeros_like(p["c"])}
        # the classes, by group
        at, cuts = self.by_group(y, at)
        z, inside, more = np.empty((len(at), self.each), own), inner.take(at, 0), np.empty((len(at), 2 * d), own)
        for group, i, j in cuts:
            np.matmul(inside[i:j], p["c"][group], out=z[i:j])
        z, total, _ = powers(z)
        z *= (share / total)[:, None]
        z[np.arange(len(at)), self.class_of.take(y.take(at)) % self.each] -= share
        turned = np.ascontiguousarray(p["c"][:, : 2 * d].transpose(0, 2, 1))
        for group, i, j in cuts:
            np.matmul(inside[i:j].T, z[i:j], out=g["c"][group])
            np.matmul(z[i:j], turned[group], out=more[i:j])
        more += back.take(at, 0)
        back[at] = more
        do = np.empty_like(o)
        np.divide(back[:, :d], o[:, d:], out=do[:, :d])
        do[:, d] = -np.einsum("ij,ij->i", do[:, :d], inner[:, :d])
        do = do.reshape(n, s, d + 1)
        ds = do @ val.transpose(0, 2, 1)
        ds *= a
        g["r"] = np.bincount(self.gap.ravel(), (np.ones(n, own) @ ds.reshape(n, -1)) * ~self.late.ravel(), 2 * s).astype(np.float32)
        dkv = np.empty_like(kv)
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., : d + 1])
        np.matmul(a.transpose(0, 2, 1), do, out=dkv[..., d + 1 :])
        dkv = dkv.reshape(-1, 2 * d + 2)
        dq = (ds @ k).reshape(-1, d + 1)
        whole = e.T @ dkv
        g["q"], g["k"], g["v"] = (eq.T @ dq)[:, :d] * scale, whole[:, :d], whole[:, d + 1 : 2 * d + 1]
        de = dkv @ np.ascontiguousarray(both.T)
        de.reshape(n, 2 * s, d)[:, s:] += (dq @ np.ascontiguousarray(query.T) + back[:, d:]).reshape(n, s, d)
        held = np.zeros(len(p["emb"]), bool)
        held[flat] = True
        rows, to = np.flatnonzero(held), np.empty(len(held), np.int64)
        to[rows] = np.arange(0, len(rows) * d, d)
        g["emb"] = np.bincount((to.take(flat)[:, None] + np.arange(d)).ravel(), de.ravel(), len(rows) * d).reshape(-1, d)
        return g, rows

    @staticmethod
    def attended(q: np.ndarray, k: np.ndarray, val: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights that are not divided by their sums, and the sums of values by them, whose last column holds the sums."""
        for stable in (False, True):
            a = q @ k.transpose(0, 2, 1)
            a += bias
            if stable:
                a -= a.max(-1, keepdims=True)
            with np.errstate(over="ignore", invalid="ignore"):
                np.exp(a, out=a)
                o = a @ val
            if stable or (o[..., -1].min(initial=1) > 1e-20 and o[..., -1].max(initial=1) < 1e20):
                return a, o

    def by_group(self, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Places ``at`` of the targets ``y`` in the order of their groups, and (group, first, end) in these."""
        of = self.group_of.take(y.take(at))
        order = np.argsort(of.astype(np.uint16), kind="stable")
        cuts = np.append(0, np.cumsum(np.bincount(of, minlength=self.groups))).tolist()
        return at[order], [(g, a, b) for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]

    def train(self, ids: np.ndarray, counts: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> "Model":
        """Fits the layer to the texts whose ``ids`` are given in a row, by Adam on random windows."""
        known, often = np.unique(np.append(ids, self.size - 1), return_counts=True)
        self.begin(known[often >= 3])
        inputs, targets, owner = self.blocks(ids, counts)
        usable, inputs = np.flatnonzero(owner >= 0), self.place[inputs]
        rng, learner = np.random.default_rng(seed), Learner(self)
        for step in range(1, steps + 1) if len(usable) else ():
            at = rng.choice(usable, batch)
            learner.step(np.concatenate([inputs[at - 1], inputs[at]], 1), targets[at], rate * min(1.0, 3 * (1 - step / (steps + 1))))
        return self.freeze()

    def freeze(self) -> "Model":
        """Turns embeddings and matrices into tables by id; values get a column of ones that adds up the weights."""
        if "emb" not in self.p:
            self.place[:] = 0
            self.p["emb"] = np.zeros((1, self.dim), np.float32)
        p, emb = self.p, self.p["emb"]
        self.q = emb @ p["q"] * np.float32(1 / np.sqrt(self.dim))
        self.kv = np.concatenate([emb @ p["k"], emb @ p["v"], np.ones((len(emb), 1), np.float32)], 1)
        self.outer = np.concatenate([p["o"], p["e"], p["b"][None]])
        if self.place[self.size] > 0:
            self.kv[self.place[self.size], self.dim :] = 0  # what is not there has no weight
        self.bias = np.where(self.late, np.float32(-1e4), p["r"][self.gap]).astype(np.float32)
        return self

    def score(self, ids: np.ndarray, counts: np.ndarray, windows: int = 256) -> np.ndarray:
        """log10 probability of each text, its end included; ``ids`` of all texts in a row."""
        inputs, targets, owner = self.blocks(ids, counts)
        usable = np.flatnonzero(owner >= 0)
        rows, out, p, d, s = self.place[inputs], np.zeros(len(counts)), self.p, self.dim, self.block
        for a in range(0, len(usable), windows):
            at = usable[a : a + windows]
            x, y = np.concatenate([rows.take(at - 1, 0), rows.take(at, 0)], 1), targets.take(at, 0).ravel()
            here, kv = x[:, s:].ravel(), self.kv.take(x, 0)
            _, o = self.attended(self.q.take(here, 0).reshape(-1, s, d), kv[..., :d], kv[..., d:], self.bias)
            o = o.reshape(-1, d + 1)
            real, cuts = self.by_group(y, np.flatnonzero(y >= 0))
            inner = np.empty((len(real), 2 * d + 1), np.float32)
            o = o.take(real, 0)
            np.divide(o[:, :d], np.maximum(o[:, d:], np.float32(1e-30)), out=inner[:, :d])
            inner[:, d : 2 * d] = p["emb"].take(here.take(real), 0)
            inner[:, 2 * d] = 1
            y, each = y.take(real), np.arange(len(real))
            value = self.within.take(y)
            z = np.empty((len(real), self.each), np.float32)
            for group, i, j in cuts:
                np.matmul(inner[i:j], p["c"][group], out=z[i:j])
            for z, picked in ((inner @ self.outer, self.group_of.take(y)), (z, self.class_of.take(y) % self.each)):
                value += z[each, picked]
                _, total, top = powers(z)
                value -= np.log(total) + top
            out += np.bincount(np.repeat(owner[at], s)[real], value, len(counts))
        return out / np.log(10)


class Learner:
    """Adam on a model's parameters; an embedding row moves only in steps that have it. Counts the steps that moved each."""

    def __init__(self, model: Model):
        self.model, self.steps, self.moved = model, 0, np.zeros(len(model.p["emb"]))
        self.names = [k for k in model.p if k != "emb"]
        # all but the embeddings lie in one row, of which the model's parameters are parts
        self.dense = np.concatenate([model.p[k].ravel() for k in self.names])
        ends = np.cumsum([model.p[k].size for k in self.names])
        model.p = {k: part.reshape(model.p[k].shape) for k, part in zip(self.names, np.split(self.dense, ends[:-1]))} | {"emb": model.p["emb"].copy()}
        self.m, self.v = (np.zeros_like(self.dense) for _ in range(2))
        self.rows = np.zeros((len(self.moved), 2, model.dim), np.float32)  # the two means of an embedding row

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        g, rows = self.model.gradient(x, y)
        self.steps += 1
        self.moved[rows] += 1
        own = np.concatenate([g[k].ravel() for k in self.names])
        self.m += np.float32(0.1) * (own - self.m)
        own *= own
        self.v += np.float32(0.01) * (own - self.v)
        root = np.sqrt(self.v * np.float32(1 / (1 - 0.99**self.steps)))
        root += np.float32(1e-8)
        self.dense -= np.float32(rate / (1 - 0.9**self.steps)) * self.m / root
        own, held, turn = g["emb"].astype(np.float32), self.rows.take(rows, 0), self.moved.take(rows)
        held[:, 0] += np.float32(0.1) * (own - held[:, 0])
        held[:, 1] += np.float32(0.01) * (own * own - held[:, 1])
        self.rows[rows] = held
        root = np.sqrt(held[:, 1] * (1 / (1 - 0.99**turn)).astype(np.float32)[:, None])
        root += np.float32(1e-8)
        self.model.p["emb"][rows] -= held[:, 0] * (rate / (1 - 0.9**turn)).astype(np.float32)[:, None] / root

    def learn(self, ids: np.ndarray, counts: np.ndarray, batch: int, rate, rng: np.random.Generator) -> None:
        """One step for each ``batch`` windows of the texts, every window once; ``rate`` gives a step's rate by its number."""
        inputs, targets, owner = self.model.blocks(ids, counts)
        usable, inputs = rng.permutation(np.flatnonzero(owner >= 0)), self.model.place.take(inputs)
        for a in range(0, len(usable), batch):
            at = usable[a : a + batch]
            self.step(np.concatenate([inputs.take(at - 1, 0), inputs.take(at, 0)], 1), targets.take(at, 0), rate(self.steps + 1))
