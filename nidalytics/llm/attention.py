"""A small causal self-attention model of token ranks, in numpy.

The input at a place is the token there, plus a hashed embedding of it and the token before. One
attention layer looks back over the window with a learned bias per distance. The output is a softmax
over classes and one over the 64 members of the class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MEMBERS = 64
#: Attention scores are clipped here; exponentials of it are far from the limits of single precision.
SCORE = np.float32(30)


@dataclass(frozen=True)
class Shape:
    """Sizes of the model. Ranks run from 0 to ``MEMBERS * classes - 1``; one more stands for the text's start."""

    classes: int = 32
    width: int = 24
    keys: int = 16
    window: int = 32
    pairs: int = 2**14

    @property
    def ranks(self) -> int:
        return MEMBERS * self.classes

    def parts(self) -> dict[str, tuple[int, ...]]:
        return {
            "token": (self.ranks + 1, self.width),
            "pair": (self.pairs, self.width),
            "query": (self.width, self.keys),
            "key": (self.width, self.keys),
            "value": (self.width, self.width),
            "mix": (self.width, self.width),
            "distance": (self.window,),
            "class": (self.width, self.classes),
            "class_bias": (self.classes,),
            "member": (self.classes, self.width, MEMBERS),
            "member_bias": (self.classes, MEMBERS),
        }


Params = dict[str, np.ndarray]


def start(shape: Shape, share: np.ndarray, seed: int = 1) -> Params:
    """Random weights and biases such that the untrained model gives each rank its ``share`` of the corpus."""
    draw = np.random.default_rng(seed)
    out = {}
    for name, size in shape.parts().items():
        scale = 0.3 if name in ("token",) else 0.0 if name in ("pair", "distance", "mix") or "bias" in name else size[-2] ** -0.5
        if name in ("class", "member"):
            scale = 0.02
        out[name] = (scale * draw.standard_normal(size)).astype(np.float32)
    table = np.maximum(share.reshape(shape.classes, MEMBERS), 1e-12)
    out["class_bias"] = np.log(table.sum(1)).astype(np.float32)
    out["member_bias"] = np.log(table / table.sum(1, keepdims=True)).astype(np.float32)
    return out


def pair_of(previous: np.ndarray, token: np.ndarray, shape: Shape) -> np.ndarray:
    mixed = previous.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + token.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % shape.pairs


def _context(p: Params, shape: Shape, inputs: np.ndarray, before: np.ndarray) -> tuple:
    """Hidden state after attention for windows of ranks (B, T); ``before`` is the rank ahead of each.

    Attention weights are exponentials times a factor per distance, which is zero for places to come.
    Scores are small by construction, and clipped where they are not, so that no row needs its maximum.
    """
    n, t = inputs.shape
    pair = pair_of(before, inputs, shape)
    x = p["token"].take(inputs.ravel(), axis=0)
    x += p["pair"].take(pair.ravel(), axis=0)
    width, keys = shape.width, shape.keys
    joint = np.concatenate((p["query"] * np.float32(keys**-0.5), p["key"], p["value"]), axis=1)
    made = (x @ joint).reshape(n, t, 2 * keys + width)
    q, k, v = made[..., :keys], made[..., keys : 2 * keys], made[..., 2 * keys :]
    back = np.arange(t)[:, None] - np.arange(t)[None]
    factor = np.where(back >= 0, np.exp(p["distance"])[np.maximum(back, 0)], np.float32(0))
    a = q @ k.transpose(0, 2, 1)
    if max(a.max(), -a.min()) > SCORE:
        np.clip(a, -SCORE, SCORE, out=a)
    np.exp(a, out=a)
    a *= factor
    total = (a @ np.ones(t, dtype=np.float32))[..., None]
    c = a @ v
    c /= total
    x = x.reshape(n, t, width)
    return pair, x, q, k, v, a, total, c, x + (c.reshape(-1, width) @ p["mix"]).reshape(n, t, width)


def _by_class(classes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(classes.astype(np.uint8 if count <= 256 else np.uint16), kind="stable")
    return order, np.searchsorted(classes[order], np.arange(count + 1))


class Windows:
    """Overlapping context windows over texts, each a sequence of ranks.

    Windows step by ``stride``. Their first ``window - stride`` places are context only, the others are
    scored, so each token of a text is scored once. Ahead of a text stand start marks, so that its first
    window is like all others; a window that reaches beyond a text is scored within it only.
    """

    def __init__(self, texts: list[np.ndarray], shape: Shape, stride: int):
        self.shape, self.texts, self.stride = shape, len(texts), stride
        self.mark, self.context = shape.ranks, shape.window - stride
        first, count, text, joined, base = [], [], [], [], 0
        for i, ranks in enumerate(texts):
            n = len(ranks)
            if not n:
                continue
            starts = np.arange(0, n, stride)
            first.append(base + starts)
            count.append(np.minimum(stride, n - starts))
            text.append(np.full(len(starts), i))
            size = int(starts[-1]) + shape.window + 1
            padded = np.full(size, self.mark, dtype=np.int32)
            padded[self.context + 1 : self.context + 1 + n] = ranks
            joined.append(padded)
            base += size
        nothing = [np.zeros(0, np.int64)]
        self.flat = np.concatenate(joined or [np.zeros(0, np.int32)])
        self.first, self.count, self.text = (np.concatenate(x or nothing) for x in (first, count, text))
        self.before = np.concatenate(([self.mark], self.flat[:-1])).astype(np.int32)[: len(self.flat)]
        self.before[self.flat == self.mark] = self.mark

    def batch(self, which) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, the rank before each, targets, and which places are scored: (B, T) each."""
        place = np.arange(self.shape.window)
        at = self.first[which, None] + place
        scored = (place >= self.context) & (place < self.context + self.count[which, None])
        return self.flat[at], self.before[at], np.where(scored, self.flat[at + 1], 0), scored


def log_probabilities(p: Params, shape: Shape, windows: Windows, batch: int = 64, together: int = 2048) -> np.ndarray:
    """Natural log probability of each text under the model, each of its tokens scored once.

    Embeddings, queries, keys and values are made once per token, for ``together`` windows; attention runs
    over ``batch`` of them at a time, which stay in the processor's cache, and only scored places ask; the
    output within classes covers all of them, so that each class has enough places.
    """
    total = np.zeros(windows.texts)
    t, keys, width, context = shape.window, shape.keys, shape.width, windows.context
    joint = np.concatenate((p["query"] * np.float32(keys**-0.5), p["key"], p["value"]), axis=1)
    back = np.arange(context, t)[:, None] - np.arange(t)[None]
    factor = np.where(back >= 0, np.exp(p["distance"])[np.maximum(back, 0)], np.float32(0)).astype(np.float32)
    ones, place = np.ones(t, dtype=np.float32), np.arange(t)
    for start in range(0, len(windows.first), together):
        first, counts, texts = (x[start : start + together] for x in (windows.first, windows.count, windows.text))
        low, high = int(first[0]), int(first[-1]) + t
        tokens = windows.flat[low:high]
        x = p["token"].take(tokens, axis=0)
        x += p["pair"].take(pair_of(windows.before[low:high], tokens, shape), axis=0)
        made = x @ joint
        held = []
        for at in range(0, len(first), batch):
            rows = first[at : at + batch, None] - low + place
            m = made.take(rows, axis=0)
            a = m[:, context:, :keys] @ m[:, :, keys : 2 * keys].transpose(0, 2, 1)
            if max(a.max(), -a.min()) > SCORE:
                np.clip(a, -SCORE, SCORE, out=a)
            np.exp(a, out=a)
            a *= factor
            c = a @ m[:, :, 2 * keys :]
            c /= (a @ ones)[..., None]
            o = x.take(rows[:, context:].ravel(), axis=0)
            o += c.reshape(-1, width) @ p["mix"]
            count = counts[at : at + batch]
            target = windows.flat[low + rows[:, context:] + 1]
            if count.min() < windows.stride:
                scored = place[: windows.stride] < count[:, None]
                o, target = o[scored.ravel()], target[scored]
            target = target.ravel()
            held.append((o, target, np.repeat(texts[at : at + batch], count), _of_class(p, o, target)))
        o, target, text, value = (np.concatenate(parts) for parts in zip(*held, strict=True))
        value = value.astype(np.float64) + _of_member(p, shape, o, target)
        total += np.bincount(text, weights=value, minlength=len(total))
    return total


def _log_softmax_at(o: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax of ``o @ weights + bias`` at one column per row."""
    z = o @ weights
    z += bias
    chosen = z[np.arange(len(z)), at]
    with np.errstate(over="ignore"):
        total = np.exp(z, out=z) @ np.ones(z.shape[1], dtype=np.float32)
    if not (np.isfinite(total).all() and (total > 1e-30).all()):  # rare: far from zero
        z = o @ weights + bias
        peak = z.max(axis=1)
        return chosen - peak - np.log(np.exp(z - peak[:, None]).sum(axis=1))
    return chosen - np.log(total)


def _of_class(p: Params, o: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of the targets' classes."""
    return _log_softmax_at(o, p["class"], p["class_bias"], target // MEMBERS)


def _of_member(p: Params, shape: Shape, o: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of the targets within their classes."""
    order, bounds = _by_class(target // MEMBERS, shape.classes)
    o, member = o.take(order, axis=0), (target % MEMBERS)[order]
    inner = np.empty(len(o), dtype=np.float32)
    for c in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[c], bounds[c + 1]
        inner[a:b] = _log_softmax_at(o[a:b], p["member"][c], p["member_bias"][c], member[a:b])
    out = np.empty_like(inner)
    out[order] = inner
    return out


def gradients(p: Params, shape: Shape, inputs: np.ndarray, before: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> tuple[float, int, dict]:
    """Summed loss, places, and gradients of the mean loss; those of embeddings as (rows, values)."""
    pair, x, q, k, v, a, total, c, full = _context(p, shape, inputs, before)
    a /= total
    o, target = full[scored], targets[scored]
    m = len(o)
    group, member = target // MEMBERS, target % MEMBERS
    order, bounds = _by_class(group, shape.classes)
    o, group, member = o[order], group[order], member[order]
    here = np.arange(m)
    z = o @ p["class"] + p["class_bias"]
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    loss = -np.log(np.maximum(z[here, group], 1e-30)).sum()
    z[here, group] -= 1
    z /= m
    grad = {"class": o.T @ z, "class_bias": z.sum(axis=0), "member": np.zeros_like(p["member"]), "member_bias": np.zeros_like(p["member_bias"])}
    do = z @ p["class"].T
    for g in range(shape.classes):
        s, e = bounds[g], bounds[g + 1]
        if s < e:
            y = o[s:e] @ p["member"][g] + p["member_bias"][g]
            y -= y.max(axis=1, keepdims=True)
            np.exp(y, out=y)
            y /= y.sum(axis=1, keepdims=True)
            i = np.arange(e - s)
            loss -= np.log(np.maximum(y[i, member[s:e]], 1e-30)).sum()
            y[i, member[s:e]] -= 1
            y /= m
            grad["member"][g] = o[s:e].T @ y
            grad["member_bias"][g] = y.sum(axis=0)
            do[s:e] += y @ p["member"][g].T
    back = np.empty_like(do)
    back[order] = do
    dfull = np.zeros_like(full)
    dfull[scored] = back
    flat = lambda w: w.reshape(-1, w.shape[-1])
    dh = dfull
    grad["mix"] = flat(c).T @ flat(dh)
    dc = dh @ p["mix"].T
    da = dc @ v.transpose(0, 2, 1)
    dv = a.transpose(0, 2, 1) @ dc
    da -= (da * a).sum(axis=2, keepdims=True)
    da *= a
    t = inputs.shape[1]
    summed = da.sum(axis=0)
    grad["distance"] = np.array([np.trace(summed, offset=-d) for d in range(t)] + [0.0] * (shape.window - t), dtype=np.float32)
    scale = np.float32(shape.keys**-0.5)
    dq, dk = da @ k, da.transpose(0, 2, 1) @ q
    grad["query"] = flat(x).T @ flat(dq) * scale
    grad["key"] = flat(x).T @ flat(dk)
    grad["value"] = flat(x).T @ flat(dv)
    dx = dh + dq @ (p["query"].T * scale) + dk @ p["key"].T + dv @ p["value"].T
    for name, rows in (("token", inputs.ravel()), ("pair", pair.ravel())):
        by = np.argsort(rows, kind="stable")
        firsts = np.flatnonzero(np.concatenate(([True], rows[by][1:] != rows[by][:-1])))
        grad[name] = (rows[by][firsts], np.add.reduceat(flat(dx)[by], firsts, axis=0))
    return float(loss), m, grad


def adagrad(p: Params, seen: Params, grad: dict, rate: float) -> None:
    """One step in place; embeddings change only where they were read."""
    for name, g in grad.items():
        if isinstance(g, tuple):
            rows, g = g
            seen[name][rows] += g * g
            p[name][rows] -= rate * g / np.sqrt(seen[name][rows] + 1e-10)
        else:
            seen[name] += g * g
            p[name] -= rate * g / np.sqrt(seen[name] + 1e-10)


def train(p: Params, seen: Params, shape: Shape, windows: Windows, rate: float, batch: int = 16, seed: int = 0) -> int:
    """One pass over the windows in random order, in place; returns the number of places."""
    places = 0
    order = np.random.default_rng(seed).permutation(len(windows.first))
    for at in range(0, len(order), batch):
        inputs, before, targets, scored = windows.batch(order[at : at + batch])
        _, m, grad = gradients(p, shape, inputs, before, targets, scored)
        adagrad(p, seen, grad, rate)
        places += m
    return places
