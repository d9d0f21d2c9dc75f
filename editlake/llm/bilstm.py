"""A small bidirectional LSTM that labels the items of sequences; numpy only."""

from __future__ import annotations

import numpy as np

HIDDEN = 16


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new(width: int, seed: int = 3) -> dict[str, np.ndarray]:
    draw, net = np.random.default_rng(seed), {}
    for way in "fb":
        net[f"x{way}"] = draw.normal(0, 1 / np.sqrt(width), (width, 4 * HIDDEN))
        net[f"h{way}"] = draw.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        net[f"c{way}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
    return net | {"out": draw.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}


def _turned(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each sequence (time, row) backwards within its own length."""
    t = np.arange(len(x))[:, None]
    return x[np.where(t < n, n - 1 - t, t), np.arange(x.shape[1])]


def _run(x: np.ndarray, net: dict, way: str, keep: bool) -> tuple[np.ndarray, list]:
    steps, rows, _ = x.shape
    h, c, out, past = np.zeros((rows, HIDDEN)), np.zeros((rows, HIDDEN)), np.empty((steps, rows, HIDDEN)), []
    given = x @ net[f"x{way}"] + net[f"c{way}"]
    for t in range(steps):
        z = given[t] + h @ net[f"h{way}"]
        s, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        new_c = f * c + i * g
        tc = np.tanh(new_c)
        if keep:
            past.append((h, c, i, f, o, g, tc))
        h, c = o * tc, new_c
        out[t] = h
    return out, past


def _back(x: np.ndarray, net: dict, way: str, past: list, grad: np.ndarray) -> dict:
    dz = np.empty((*x.shape[:2], 4 * HIDDEN))
    dh, dc, wh = np.zeros(grad.shape[1:]), np.zeros(grad.shape[1:]), np.zeros_like(net[f"h{way}"])
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, tc = past[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        wh += h.T @ dz[t]
        dh, dc = dz[t] @ net[f"h{way}"].T, dc * f
    return {f"x{way}": np.tensordot(x, dz, axes=([0, 1], [0, 1])), f"h{way}": wh, f"c{way}": dz.sum(axis=(0, 1))}


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(p) for p in pages])
    x = np.zeros((n.max(), len(pages), pages[0].shape[1]))
    for k, p in enumerate(pages):
        x[: len(p), k] = p
    return x, n


def predict(net: dict, pages: list[np.ndarray], rows: int = 128, cells: int = 1 << 16) -> list[np.ndarray]:
    """The probability of label 1 for each item; sequences of like length run together, at most `cells` items at once."""
    out: list = [np.zeros(0)] * len(pages)
    order, at = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k])), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < rows and (end + 1 - at) * len(pages[order[end]]) <= cells:
            end += 1
        x, n = padded([pages[k] for k in order[at:end]])
        forth, back = _run(x, net, "f", False)[0], _turned(_run(_turned(x, n), net, "b", False)[0], n)
        p = _sigmoid(np.concatenate([forth, back], axis=2) @ net["out"] + net["bias"])
        for j, k in enumerate(order[at:end]):
            out[k] = p[: n[j], j]
        at = end
    return out


def _batches(lengths: list[int], rows: int, cells: int, draw: np.random.Generator) -> list[np.ndarray]:
    """Random batches of sequences; long ones are put together with few others, so that a batch has `cells` items or one sequence."""
    order, out = draw.permutation(len(lengths)), []
    few = np.array([n * rows > cells for n in lengths])[order]
    for part in (order[~few], sorted(order[few], key=lambda k: lengths[k])):
        held: list[int] = []
        for k in part:
            if held and (len(held) == rows or max(lengths[k], *(lengths[j] for j in held)) * (len(held) + 1) > cells):
                out.append(np.array(held))
                held = []
            held.append(k)
        if held:
            out.append(np.array(held))
    return [out[i] for i in draw.permutation(len(out))]


def fit(net: dict, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 8, rows: int = 48, rate: float = 0.01, seed: int = 11, cells: int = 1 << 14) -> dict:
    """Trained by Adam on whole sequences."""
    draw, t = np.random.default_rng(seed), 0
    m, s = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}
    for epoch in range(epochs):
        for some in _batches([len(p) for p in pages], rows, cells, draw):
            t += 1
            x, n = padded([pages[k] for k in some])
            y, w = np.zeros(x.shape[:2]), np.zeros(x.shape[:2])
            for j, k in enumerate(some):
                y[: n[j], j], w[: n[j], j] = labels[k], 1
            xb = _turned(x, n)
            (hf, pf), (hb, pb) = _run(x, net, "f", True), _run(xb, net, "b", True)
            h = np.concatenate([hf, _turned(hb, n)], axis=2)
            e = (_sigmoid(h @ net["out"] + net["bias"]) - y) * w / w.sum()
            dh = e[:, :, None] * net["out"]
            g = {"out": np.tensordot(e, h, axes=([0, 1], [0, 1])), "bias": np.array([e.sum()])}
            g |= _back(x, net, "f", pf, dh[:, :, :HIDDEN]) | _back(xb, net, "b", pb, _turned(dh[:, :, HIDDEN:], n))
            size = np.sqrt(sum((v * v).sum() for v in g.values()))
            for k in net:
                v = g[k] * min(1, 2 / (size + 1e-9))
                m[k], s[k] = 0.9 * m[k] + 0.1 * v, 0.999 * s[k] + 0.001 * v * v
                net[k] = net[k] - rate * 0.8**epoch * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return net
