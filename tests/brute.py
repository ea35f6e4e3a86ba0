"""Plain NumPy restatements used as expectations: one row at a time, straight from the definitions."""

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p, x, z0=None):
    A = -np.exp(p["A_log"])
    z = np.zeros(len(A)) if z0 is None else np.array(z0, dtype=float)
    out = {k: [] for k in ("z", "dt", "recon", "a", "u")}
    for row in np.asarray(x, dtype=float):
        h = np.tanh(p["W_in"] @ row + p["b_in"])
        dt = np.log1p(np.exp(p["W_dt"] @ h + p["b_dt"][0]))
        a = np.exp(dt * A)
        u = (a - 1) / (A + 1e-8) * dt * (p["W_B"] @ h)
        z = a * z + u
        out["z"].append(z)
        out["dt"].append(dt)
        out["a"].append(a)
        out["u"].append(u)
        out["recon"].append(p["W_out"] @ np.tanh(p["W_C"] @ z) + p["b_out"])
    return {k: np.array(v) for k, v in out.items()}


def loss(p, x):
    """The quantity the exact gradient differentiates: squared error summed over features, averaged over rows."""
    return ((forward(p, x)["recon"] - x) ** 2).sum() / len(x)


def finite_difference(p, x, name, step=1e-6):
    grad = np.zeros(p[name].size)
    for i in range(grad.size):
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name].ravel()[i] += step
        down[name].ravel()[i] -= step
        grad[i] = (loss(up, x) - loss(down, x)) / (2 * step)
    return grad.reshape(p[name].shape)


def scores(z, dt, err, weights=(0.4, 0.4, 0.2)):
    velocity = np.concatenate([[0.0], np.sqrt((np.diff(z, axis=0) ** 2).sum(axis=1))])
    total = 0
    for w, s in zip(weights, (dt, velocity, err)):
        total = total + w * (s - s.mean()) / (s.std() + 1e-8)
    return sigmoid(total)


def silhouette(points, labels):
    d = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    out = []
    for i in range(len(points)):
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][labels == k].mean() for k in set(labels) if k != labels[i])
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def lloyd(points, start, max_iter=200):
    c = np.array(start, dtype=float)
    for _ in range(max_iter):
        label = np.sqrt(((points[:, None] - c[None]) ** 2).sum(axis=2)).argmin(axis=1)
        new = np.array([points[label == k].mean(axis=0) if (label == k).any() else c[k] for k in range(len(c))])
        if np.linalg.norm(new - c) < 1e-7:
            break
        c = new
    return c
