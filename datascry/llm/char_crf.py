"""Bidirectional LSTM over letters with CRF transitions, in numpy: training, scores and best tag paths."""

from __future__ import annotations

import numpy as np

SYMBOLS = 131


def symbols(text: str):
    """One number per letter: ASCII as it stands, other letters 128, other signs 129; 130 pads."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, points, np.where(points < 0x2000, 128, 129)).astype(np.int64)


def fresh(tags: int, embed: int, hidden: int, seed: int) -> dict:
    rng = np.random.default_rng(seed)
    out = {"E": rng.normal(0, 0.3, (SYMBOLS, embed)), "O": rng.normal(0, 0.3, (2 * hidden, tags)), "o": np.zeros(tags),
           "T": np.zeros((tags, tags)), "S": np.zeros(tags)}
    for side in "fb":
        out[f"W{side}"] = rng.normal(0, 0.3, (embed, 4 * hidden))
        out[f"U{side}"] = rng.normal(0, 0.3, (hidden, 4 * hidden))
        out[f"c{side}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
    return {k: v.astype(np.float32) for k, v in out.items()}


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run_side(p, x, side, keep: bool):
    """Hidden states (T, B, H) of one direction over embedded letters (T, B, E), with what the way back needs."""
    steps, batch, h_size = x.shape[0], x.shape[1], p[f"U{side}"].shape[0]
    inputs = x @ p[f"W{side}"] + p[f"c{side}"]
    h, c = np.zeros((batch, h_size), x.dtype), np.zeros((batch, h_size), x.dtype)
    states, kept = np.zeros((steps, batch, h_size), x.dtype), [None] * steps
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = inputs[t] + h @ p[f"U{side}"]
        gates = sigmoid(z[:, :3 * h_size])
        i, f, o = gates[:, :h_size], gates[:, h_size:2 * h_size], gates[:, 2 * h_size:]
        g = np.tanh(z[:, 3 * h_size:])
        before, c = c, f * c + i * g
        squashed = np.tanh(c)
        if keep:
            kept[t] = (h, before, i, f, o, g, squashed)
        h = o * squashed
        states[t] = h
    return states, kept


def emissions(p, codes, keep: bool = False):
    """Scores (T, B, tags) of codes (B, T)."""
    x = p["E"][codes.T]
    forth, kept_f = run_side(p, x, "f", keep)
    back, kept_b = run_side(p, x, "b", keep)
    both = np.concatenate([forth, back], -1)
    return both @ p["O"] + p["o"], (x, both, kept_f, kept_b)


def logsum(x, axis):
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def crf_loss(p, scores, tags):
    """Mean negative log likelihood of tag paths (B, T) and its gradients for scores, transitions and starts."""
    steps, batch, n = scores.shape
    each, path = np.arange(batch), tags.T
    ahead = np.zeros_like(scores)
    ahead[0] = scores[0] + p["S"]
    for t in range(1, steps):
        ahead[t] = scores[t] + logsum(ahead[t - 1][:, :, None] + p["T"], 1)
    total = logsum(ahead[-1], 1)
    behind = np.zeros_like(scores)
    for t in range(steps - 2, -1, -1):
        behind[t] = logsum(p["T"] + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
    share = np.exp(ahead + behind - total[None, :, None])
    gold = scores[np.arange(steps)[:, None], each, path].sum(0) + p["S"][path[0]] + p["T"][path[:-1], path[1:]].sum(0)
    d_scores = share.copy()
    d_scores[np.arange(steps)[:, None], each, path] -= 1
    d_t = np.zeros_like(p["T"])
    for t in range(1, steps):
        d_t += np.exp(ahead[t - 1][:, :, None] + p["T"] + (scores[t] + behind[t])[:, None, :] - total[:, None, None]).sum(0)
    np.add.at(d_t, (path[:-1].ravel(), path[1:].ravel()), -1)
    d_s = share[0].sum(0)
    np.add.at(d_s, path[0], -1)
    return float((total - gold).mean()), d_scores / batch, d_t / batch, d_s / batch


def side_gradients(p, side, kept, d_states, grads, x):
    """Adds one direction's gradients to `grads`; returns that of the embedded letters."""
    steps, batch, h_size = d_states.shape
    d_h, d_c, d_z = np.zeros((batch, h_size), x.dtype), np.zeros((batch, h_size), x.dtype), np.zeros((steps, batch, 4 * h_size), x.dtype)
    for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
        h, before, i, f, o, g, squashed = kept[t]
        d_h = d_h + d_states[t]
        d_c = d_c + d_h * o * (1 - squashed ** 2)
        d_z[t] = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - g ** 2)], 1)
        grads[f"U{side}"] += h.T @ d_z[t]
        d_h, d_c = d_z[t] @ p[f"U{side}"].T, d_c * f
    flat = d_z.reshape(-1, 4 * h_size)
    grads[f"W{side}"] += x.reshape(-1, x.shape[-1]).T @ flat
    grads[f"c{side}"] += flat.sum(0)
    return d_z @ p[f"W{side}"].T


def gradients(p, codes, tags):
    scores, (x, both, kept_f, kept_b) = emissions(p, codes, keep=True)
    loss, d_scores, d_t, d_s = crf_loss(p, scores, tags)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    grads["T"], grads["S"] = d_t.astype(x.dtype), d_s.astype(x.dtype)
    flat = d_scores.reshape(-1, d_scores.shape[-1]).astype(x.dtype)
    grads["O"], grads["o"] = both.reshape(-1, both.shape[-1]).T @ flat, flat.sum(0)
    d_both, h_size = (flat @ p["O"].T).reshape(both.shape), both.shape[-1] // 2
    d_x = side_gradients(p, "f", kept_f, d_both[..., :h_size], grads, x) + side_gradients(p, "b", kept_b, d_both[..., h_size:], grads, x)
    np.add.at(grads["E"], codes.T.ravel(), d_x.reshape(-1, d_x.shape[-1]))
    return loss, grads


def train(codes, tags, n_tags: int, embed: int = 8, hidden: int = 16, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 3) -> dict:
    """Parameters learnt from windows (N, T) and their tags with Adam."""
    p, rng = fresh(n_tags, embed, hidden, seed), np.random.default_rng(seed)
    first, second, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for start in range(0, len(order), batch):
            part, step = order[start:start + batch], step + 1
            _, grads = gradients(p, codes[part], tags[part])
            size = np.sqrt(sum(float((g ** 2).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / max(size, 1e-9))
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g ** 2
                p[k] = (p[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return p


def best_paths(p, codes):
    """Most likely tags (B, T) of windows (B, T)."""
    scores, _ = emissions(p, codes)
    steps, batch, n = scores.shape
    back = np.zeros((steps, batch, n), np.int8)
    best = scores[0] + p["S"]
    for t in range(1, steps):
        moves = best[:, :, None] + p["T"]
        back[t] = moves.argmax(1)
        best = moves.max(1) + scores[t]
    path = np.zeros((batch, steps), np.int64)
    path[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = back[t][np.arange(batch), path[:, t]]
    return path
