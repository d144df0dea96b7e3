"""Numeric kernels over numpy arrays, from the published methods."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import numpy as np


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline whose end third derivatives are those of the cubics through the four end points (Forsythe, Malcolm and Moler); NaN outside."""
    order = np.argsort(x)
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    n = len(x)
    out = np.full(len(at), np.nan)
    inside = (at >= x[0]) & (at <= x[-1]) if n else np.zeros(len(at), bool)
    if n < 4:
        if n > 1:
            out[inside] = np.polyval(np.polyfit(x, y, n - 1), at[inside])
        return out
    h, s = np.diff(x), np.diff(y) / np.diff(x)

    def third(k):
        """The divided difference of four points from k."""
        d2 = [(s[k + 1] - s[k]) / (x[k + 2] - x[k]), (s[k + 2] - s[k + 1]) / (x[k + 3] - x[k + 1])]
        return (d2[1] - d2[0]) / (x[k + 3] - x[k])

    lower, main, upper, right = np.append(h[:-1], h[-1]), np.empty(n), np.append(h[0], h[1:]), np.empty(n)
    main[1:-1], right[1:-1] = 2 * (h[:-1] + h[1:]), np.diff(s)
    main[0], right[0] = -h[0], h[0] ** 2 * third(0)
    main[-1], right[-1] = -h[-1], -(h[-1] ** 2) * third(n - 4)
    for k in range(1, n):
        f = lower[k - 1] / main[k - 1]
        main[k] -= f * upper[k - 1]
        right[k] -= f * right[k - 1]
    c = np.empty(n)
    c[-1] = right[-1] / main[-1]
    for k in range(n - 2, -1, -1):
        c[k] = (right[k] - upper[k] * c[k + 1]) / main[k]
    k = np.clip(np.searchsorted(x, at[inside], "right") - 1, 0, n - 2)
    t = at[inside] - x[k]
    b = s[k] - h[k] * (c[k + 1] + 2 * c[k])
    out[inside] = y[k] + t * (b + t * (3 * c[k] + t * (c[k + 1] - c[k]) / h[k]))
    return out


def als(y: np.ndarray, lam: float, p: float = 0.05, maxit: int = 20) -> np.ndarray:
    """Asymmetric least squares baseline; lam is a power of ten. The banded system is solved by LDL'."""
    n, lam = len(y), 10.0**lam
    if n < 3:
        return np.asarray(y, float).copy()
    d0, d1, d2 = np.full(n, 6.0), np.full(n - 1, -4.0), np.full(n - 2, 1.0)
    d0[[0, -1]] = 1
    d0[[1, -2]] = 5 if n > 3 else 4
    d1[[0, -1]] = -2
    w = np.ones(n)
    for _ in range(maxit):
        z = solve_five(w + lam * d0, lam * d1, lam * d2, w * y)
        new = np.where(y > z, p, 1 - p)
        if (new == w).all():
            break
        w = new
    return z


def solve_five(d0: np.ndarray, d1: np.ndarray, d2: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A symmetric system with two bands beside the diagonal."""
    n = len(d0)
    d, e, f = [0.0] * n, [0.0] * n, [0.0] * n
    a0, a1, a2, y = d0.tolist(), d1.tolist() + [0.0], d2.tolist() + [0.0, 0.0], b.tolist()
    for k in range(n):
        d[k] = a0[k] - (d[k - 1] * e[k - 1] ** 2 if k else 0) - (d[k - 2] * f[k - 2] ** 2 if k > 1 else 0)
        e[k] = (a1[k] - (d[k - 1] * e[k - 1] * f[k - 1] if k else 0)) / d[k]
        f[k] = a2[k] / d[k]
    for k in range(n):
        y[k] -= (e[k - 1] * y[k - 1] if k else 0) + (f[k - 2] * y[k - 2] if k > 1 else 0)
    z = [v / q for v, q in zip(y, d)]
    for k in range(n - 1, -1, -1):
        z[k] -= (e[k] * z[k + 1] if k + 1 < n else 0) + (f[k] * z[k + 2] if k + 2 < n else 0)
    return np.array(z)


def savgol_second(y: np.ndarray, h: float, half: int = 10) -> np.ndarray:
    """Second derivative of the quadratic fit over 2 * half + 1 points; at the ends that of the first and last fit."""
    i = np.arange(-half, half + 1)
    q = i * i - (i * i).mean()
    inner = np.convolve(y, (2 * q / (q * q).sum())[::-1], "valid") / h**2
    return np.concatenate([np.full(half, inner[0]), inner, np.full(half, inner[-1])])


def lorentz(x, x0, gamma, area):
    return area / np.pi * gamma / ((x - x0) ** 2 + gamma**2)


def fit_lorentz(x: np.ndarray, y: np.ndarray, x0: float, gamma: float, area: float, steps: int = 60) -> tuple[float, float, float, bool]:
    """Levenberg-Marquardt on (x0, gamma, area); the start is kept if it does not improve. (x0, gamma, area, improved)."""
    p, good = fit_lorentzians(np.asarray(x, float)[None], np.asarray(y, float)[None], np.array([[x0, gamma, area]], float), steps)
    return (*p[0].tolist(), bool(good[0]))


def fit_lorentzians(x: np.ndarray, y: np.ndarray, start: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """fit_lorentz() for many peaks of as many points each, side by side, each with its own damping and end: x, y (peaks, points), start (peaks, 3). (parameters, improved)."""

    def cost(q, k):
        return ((lorentz(x[k], q[:, :1], q[:, 1:2], q[:, 2:]) - y[k]) ** 2).sum(1)

    with np.errstate(all="ignore"):
        p, damp, live = start.copy(), np.full(len(x), 1e-3), np.arange(len(x))
        first = cost(p, live)
        now = first.copy()
        for _ in range(steps):
            if not len(live):
                break
            q, (x0, g, area) = p[live], p[live].T[:, :, None]
            d = x[live] - x0
            s = d * d + g * g
            j = np.stack([area / np.pi * g * 2 * d / s**2, area / np.pi * (d * d - g * g) / s**2, g / np.pi / s], 2)
            r = y[live] - lorentz(x[live], x0, g, area)
            jt = j.transpose(0, 2, 1)
            a, b = jt @ j, (jt @ r[:, :, None])[:, :, 0]
            diagonal = a[:, [0, 1, 2], [0, 1, 2]]
            a[:, [0, 1, 2], [0, 1, 2]] = diagonal + damp[live, None] * (diagonal + 1e-300)
            step, solved = _solved(a, b)
            new = cost(q + step, live)
            better = solved & np.isfinite(new) & (new < now[live])
            done = better & (now[live] - new < 1e-14 * np.maximum(now[live], 1e-300))
            up, down = live[better], live[~better]
            p[up], now[up], damp[up] = (q + step)[better], new[better], damp[up] / 10
            damp[down] *= 10
            live = live[solved & ~done & (better | (damp[live] <= 1e12))]
    turn = (p[:, 1] < 0) & (p[:, 2] < 0)
    p[turn, 1:] = -p[turn, 1:]
    good = (now < first) & (p[:, 1] > 0)
    return np.where(good[:, None], p, start), good


def _solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of a stack of systems, and which of them have one."""
    try:
        return np.linalg.solve(a, b[:, :, None])[:, :, 0], np.ones(len(a), bool)
    except np.linalg.LinAlgError:  # one of them is singular
        out, good = np.zeros(b.shape), np.ones(len(a), bool)
        for k in range(len(a)):
            try:
                out[k] = np.linalg.solve(a[k], b[k])
            except np.linalg.LinAlgError:
                good[k] = False
        return out, good


def ricker(width: int, scale: float) -> np.ndarray:
    t = np.arange(-width, width + 1) / scale
    return (1 - t * t) * np.exp(-t * t / 2) * 2 / (np.sqrt(3 * scale) * np.pi**0.25)


def cwt_peaks(y: np.ndarray, scales=(1, 3, 5, 7, 9, 11, 13, 15), snr: float = 3.0, least: float = -np.inf, gap: int = 2) -> list[tuple[int, float]]:
    """(position, signal over noise) of the ridge lines of Mexican-hat coefficients, from the largest scale down (Du, Kibbe and Lin)."""
    n = len(y)
    c = []
    for s in scales:
        k = ricker(min(int(5 * s), max(1, (n - 1) // 2)), s)
        full = np.convolve(np.pad(y, len(k) // 2, "edge"), k, "valid")
        c.append(full[:n])
    c = np.array(c)
    tops = [np.flatnonzero((row[1:-1] > row[:-2]) & (row[1:-1] >= row[2:])) + 1 for row in c]
    ridges = [[(len(scales) - 1, int(p))] for p in tops[-1]]
    open_, done = [(r, 0) for r in ridges], []
    for level in range(len(scales) - 2, -1, -1):
        free, still = set(tops[level].tolist()), []
        for r, missed in open_:
            reach = max(1, int(scales[level]))
            near = [p for p in free if abs(p - r[-1][1]) <= reach]
            if near:
                p = min(near, key=lambda q: (abs(q - r[-1][1]), q))
                free.discard(p)
                r.append((level, p))
                still.append((r, 0))
            elif missed < gap:
                still.append((r, missed + 1))
            else:
                done.append(r)
        open_ = still + [([(level, p)], 0) for p in sorted(free)]
    found = {}
    noise_row = np.abs(c[0])
    for r in [r for r, _ in open_] + done:
        if len(r) < 2:
            continue
        level, at = max(r, key=lambda q: c[q[0], q[1]])
        lowest = min(r)[1]
        part = noise_row[max(0, at - 250) : at + 250]
        noise = max(np.quantile(part, 0.95), 1e-12 * (np.abs(y).max() or 1))
        ratio = c[level, at] / noise
        top = max(0, lowest - 2) + int(np.argmax(y[max(0, lowest - 2) : lowest + 3]))
        if ratio >= snr and y[top] >= least:
            found[top] = max(found.get(top, 0), float(ratio))
    return sorted(found.items())


def shift_of(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The shift of b, at most so many points, with the largest cross-correlation with a."""
    n = 1 << int(np.ceil(np.log2(max(2 * len(a), 2))))
    r = np.fft.irfft(np.fft.rfft(a - a.mean(), n) * np.conj(np.fft.rfft(b - b.mean(), n)), n)
    shifts = np.arange(-most, most + 1)
    return int(shifts[np.argmax(r[shifts])])


def moved(y: np.ndarray, by: int) -> np.ndarray:
    if by > 0:
        return np.concatenate([np.full(by, y[0]), y[:-by]])
    return np.concatenate([y[-by:], np.full(-by, y[-1])]) if by else y


def align(y: np.ndarray, ref: np.ndarray, peaks: list[int], ref_peaks: list[int], most: int) -> np.ndarray:
    """Shifts segments of y onto ref, from the whole down; a segment is split in the widest gap of both peak lists together, between its two clusters."""
    y = y.astype(float).copy()

    def go(a: int, b: int, level: int) -> None:
        if b - a < 4 or level > 20:
            return
        own = [p for p in peaks if a <= p < b]
        theirs = [p for p in ref_peaks if a <= p < b]
        if not own or not theirs:
            return
        by = shift_of(ref[a:b], y[a:b], min(most, (b - a) // 2))
        if by and float(np.dot(moved(y[a:b], by) - y[a:b], ref[a:b] - ref[a:b].mean())) > 0:
            y[a:b] = moved(y[a:b], by)
        pooled = sorted(own + theirs)
        gaps = np.diff(pooled)
        if len(gaps) and gaps.max() > 2 * most + 1:
            k = int(np.argmax(gaps))
            cut = (pooled[k] + pooled[k + 1]) // 2
            go(a, cut, level + 1)
            go(cut, b, level + 1)

    go(0, len(y), 0)
    return y


def complete_linkage(x: np.ndarray, group: np.ndarray, cut: float, factor: float = 3.0) -> np.ndarray:
    """Cluster numbers of points on a line; two points of a group are factor * cut apart. Merges nearer than cut, nearest first.

    Points at one place merge before all others, each into the first cluster there without its group; so the matrix is of clusters by place, not of points.
    """
    group = np.unique(group, return_inverse=True)[1]
    at: dict[float, list[tuple[int, set[int]]]] = {}  # (first point, groups) of the clusters at a place
    label = np.arange(len(x))
    for k, (place, g) in enumerate(zip(x.tolist(), group.tolist())):
        here = at.setdefault(place, [])
        for first, groups in here if cut > 0 else ():
            if g not in groups:
                groups.add(g)
                label[k] = first
                break
        else:
            here.append((k, {g}))
    first, owner = np.unique(label, return_inverse=True)
    n = len(first)
    d = np.abs(x[first][:, None] - x[first][None]).astype(float)
    apart = max(factor * cut, d.max(initial=0) * factor)
    order = np.argsort(group, kind="stable")
    for points in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        d[np.ix_(owner[points], owner[points])] = apart
    np.fill_diagonal(d, np.inf)
    label, alive = np.arange(n), np.ones(n, bool)
    while n > 1:
        k = int(np.argmin(d))
        i, j = sorted(divmod(k, n))
        if not d[i, j] < cut:
            break
        d[i] = np.maximum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        alive[j] = False
        label[label == j] = i
    return np.searchsorted(np.flatnonzero(alive), label)[owner]


def pls(x: np.ndarray, y: np.ndarray, ncomp: int, steps: int = 200) -> dict[str, np.ndarray]:
    """NIPALS regression on scaled x and y: scores, weights, loadings, coefficients by number of components, and the means and scales."""
    mx, sx = x.mean(0), x.std(0, ddof=1)
    my, sy = y.mean(0), y.std(0, ddof=1)
    sx, sy = np.where(sx > 0, sx, 1.0), np.where(sy > 0, sy, 1.0)
    e, f = (x - mx) / sx, (y - my) / sy
    t_all, w_all, p_all, c_all, coefs = [], [], [], [], []
    for _ in range(min(ncomp, x.shape[0] - 1, x.shape[1])):
        # The steps need no sample: with u = f c and t = e w, what they take of e and f is in these two products.
        w = _weight(e.T @ e, e.T @ f, int(np.argmax((f * f).sum(0))), steps)
        if not w.any():
            break
        t = e @ w
        p, c = e.T @ t / (t @ t), f.T @ t / (t @ t)
        e, f = e - np.outer(t, p), f - np.outer(t, c)
        for to, v in ((t_all, t), (w_all, w), (p_all, p), (c_all, c)):
            to.append(v)
        wm, pm, cm = np.array(w_all).T, np.array(p_all).T, np.array(c_all).T
        coefs.append(wm @ np.linalg.pinv(pm.T @ wm) @ cm.T)
    return {"scores": np.array(t_all).T, "weights": np.array(w_all).T, "loadings": np.array(p_all).T, "c": np.array(c_all).T, "coefs": np.array(coefs), "mx": mx, "sx": sx, "my": my, "sy": sy}


def pls_of_rows(x: np.ndarray, use: np.ndarray, y: np.ndarray, ncomp: int, steps: int = 200) -> dict[str, np.ndarray]:
    """pls() of x[use] and y, without the scores but with their squares' sums, tt: x is read in stretches of rows and never copied."""
    n = int(use.sum())
    mx = sum((part.sum(0) for part in stretches(x, use)), np.zeros(x.shape[1])) / n
    sx = np.sqrt(sum((((part - mx) ** 2).sum(0) for part in stretches(x, use)), np.zeros(x.shape[1])) / max(1, n - 1))
    my, sy = y.mean(0), y.std(0, ddof=1)
    sx, sy = np.where(sx > 0, sx, 1.0), np.where(sy > 0, sy, 1.0)
    f = (y - my) / sy
    ff, ee, ef, at = (f * f).sum(0), np.zeros((x.shape[1],) * 2), np.zeros((x.shape[1], y.shape[1])), 0
    for part in stretches(x, use):
        part = (part - mx) / sx
        ee += part.T @ part
        ef += part.T @ f[at : at + len(part)]
        at += len(part)
    del f
    w_all, p_all, c_all, tt_all, coefs = [], [], [], [], []
    for _ in range(min(ncomp, n - 1, x.shape[1])):
        w = _weight(ee, ef, int(np.argmax(ff)), steps)
        if not w.any():
            break
        tt = w @ ee @ w
        p, c = ee @ w / tt, ef.T @ w / tt
        ee, ef, ff = ee - tt * np.outer(p, p), ef - tt * np.outer(p, c), ff - tt * c * c
        for to, v in ((w_all, w), (p_all, p), (c_all, c), (tt_all, tt)):
            to.append(v)
        wm, pm, cm = np.array(w_all).T, np.array(p_all).T, np.array(c_all).T
        coefs.append(wm @ np.linalg.pinv(pm.T @ wm) @ cm.T)
    return {"tt": np.array(tt_all), "weights": np.array(w_all).T, "loadings": np.array(p_all).T, "c": np.array(c_all).T, "coefs": np.array(coefs), "mx": mx, "sx": sx, "my": my, "sy": sy}


#: Rows that are in work at once where a matrix is read in stretches.
ROWS = 1 << 13


def stretches(x: np.ndarray, use: np.ndarray):
    """x[use], ROWS rows of x at a time."""
    for i in range(0, len(x), ROWS):
        yield x[i : i + ROWS][use[i : i + ROWS]]


def _weight(ee: np.ndarray, ef: np.ndarray, start: int, steps: int) -> np.ndarray:
    """The weight of a component, by steps from a column of x'y; zeros if there is none."""
    first, w = ef[:, start], np.zeros(len(ee))
    for _ in range(steps):
        new = first
        size = np.linalg.norm(new)
        if size < 1e-12:
            break
        new = new / size
        c = ef.T @ new / (new @ ee @ new)
        first = ef @ c / max(c @ c, 1e-300)
        if np.linalg.norm(new - w) < 1e-10:
            return new
        w = new
    return w


def pls_predict(m: dict[str, np.ndarray], x: np.ndarray, ncomp: int) -> np.ndarray:
    return ((x - m["mx"]) / m["sx"]) @ m["coefs"][ncomp - 1] * m["sy"] + m["my"]


def vip(m: dict[str, np.ndarray]) -> np.ndarray:
    """(features, components): importance of each feature in the first h components."""
    w, c = m["weights"], m["c"]
    r2 = (m["tt"] if "tt" in m else (m["scores"] ** 2).sum(0)) * (c * c).sum(0)
    total = np.cumsum(r2)
    return np.sqrt(len(w) * np.cumsum(r2 * w**2, axis=1) / total)


def vip_drops(x: np.ndarray, y: np.ndarray, ncomp: int, rng: np.random.Generator, values: int = 1 << 22, rows: np.ndarray | None = None) -> np.ndarray:
    """For each feature, its importance in the fit of all components less that after its column is shuffled; rows: of these rows of x, in whose order y is.

    A fit needs no sample, only the products of scaled x and y; a shuffled column changes one row and column of them. So
    the fits of many features go side by side, as many as give at most so many values. x[rows] is made in stretches only.
    """
    n, width = len(y), x.shape[1]
    rows = np.arange(n) if rows is None else rows
    cuts = [slice(i, i + ROWS) for i in range(0, n, ROWS)]
    mx = sum((x[rows[c]].sum(0) for c in cuts), np.zeros(width)) / n
    sx = np.sqrt(sum((((x[rows[c]] - mx) ** 2).sum(0) for c in cuts), np.zeros(width)) / max(1, n - 1))
    sx, sy = np.where(sx > 0, sx, 1.0), y.std(0, ddof=1)
    f = y - y.mean(0)
    f /= np.where(sy > 0, sy, 1.0)
    ee, ef = np.zeros((width, width)), np.zeros((width, f.shape[1]))
    for c in cuts:
        e = (x[rows[c]] - mx) / sx
        ee += e.T @ e
        ef += e.T @ f[c]
    count = min(ncomp, n - 1, width)
    base = _vip_of_products(ee[None].copy(), ef[None].copy(), count)[0]
    out, block = np.empty(width), max(1, values // max(1, width * width, n // 2))
    for start in range(0, width, block):
        js = np.arange(start, min(width, start + block))
        mixed, row, at = np.empty((len(js), n)), np.zeros((len(js), width)), np.arange(len(js))
        for k, j in enumerate(js):
            mixed[k] = rng.permutation((x[rows, j] - mx[j]) / sx[j])
        for c in cuts:
            row += mixed[:, c] @ ((x[rows[c]] - mx) / sx)
        own = mixed @ f
        row[at, js] = ee[js, js]
        products, sides = np.repeat(ee[None], len(js), 0), np.repeat(ef[None], len(js), 0)
        products[at, js], products[at, :, js], sides[at, js] = row, row, own
        out[js] = base[js] - _vip_of_products(products, sides, count)[at, js]
    return out


def _vip_of_products(ee: np.ndarray, ef: np.ndarray, ncomp: int) -> np.ndarray:
    """(fits, features): importances from stacks of x'x and x'y, which are deflated in place; a weight is the first singular vector of x'y, the limit of the steps in pls()."""
    share, total = np.zeros(ee.shape[:2]), np.zeros(len(ee))
    for _ in range(ncomp):
        w = (ef @ np.linalg.eigh(ef.transpose(0, 2, 1) @ ef)[1][:, :, -1:])[:, :, 0]
        size = np.linalg.norm(w, axis=1)
        live = size >= 1e-12
        if not live.any():
            break
        w = np.where(live[:, None], w / np.where(live, size, 1.0)[:, None], 0.0)
        p = (ee @ w[:, :, None])[:, :, 0]
        tt = (w * p).sum(1)
        scale = np.where(tt > 0, tt, 1.0)
        p, c = p / scale[:, None], (w[:, None, :] @ ef)[:, 0] / scale[:, None]
        r2 = tt * (c * c).sum(1)
        share, total = share + r2[:, None] * w**2, total + r2
        ee -= tt[:, None, None] * p[:, :, None] * p[:, None, :]
        ef -= tt[:, None, None] * p[:, :, None] * c[:, None, :]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.sqrt(share.shape[1] * share / total[:, None])


def auc(score: np.ndarray, positive: np.ndarray) -> float:
    """Mann-Whitney statistic with average ranks."""
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    s = score[order]
    edges = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
    ends = np.append(edges[1:], len(s))[: len(edges)]
    ranks[order] = np.repeat((edges + ends + 1) / 2, ends - edges)
    n1 = int(positive.sum())
    n0 = len(score) - n1
    return float("nan") if not n1 or not n0 else float((ranks[positive].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


def pca(x: np.ndarray, ncomp: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, loadings, variances of centred data by the smaller Gram matrix; each loading's largest entry is positive."""
    x = x - x.mean(0)
    gram = x @ x.T if x.shape[0] <= x.shape[1] else x.T @ x
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][:ncomp]
    values = np.maximum(values[order], 0)
    load = x.T @ vectors[:, order] / np.sqrt(np.maximum(values, 1e-300)) if x.shape[0] <= x.shape[1] else vectors[:, order]
    sign = np.sign(load[np.abs(load).argmax(0), np.arange(load.shape[1])])
    load = load * np.where(sign == 0, 1, sign)
    return x @ load, load, values / max(1, x.shape[0] - 1)


#: Values of a line that are in work at once, and rows that tell where its median lies.
LINE, TOLD = 1 << 17, 1 << 12


def _middle(n: int, part, told: np.ndarray) -> float:
    """The median of n values, exactly. part(i, j): values i to j, made anew at each call; told: some of them.

    The values told give bounds that the median most likely lies between; only those between them are sorted. If it
    does not, all are.
    """
    told, reach = np.sort(told), 2 * int(len(told) ** 0.5)
    lo, hi = told[max(0, len(told) // 2 - reach)], told[min(len(told) - 1, len(told) // 2 + reach)]
    below, between = 0, []
    for i in range(0, n, LINE):
        v = part(i, i + LINE)
        over = v >= lo
        below += len(v) - np.count_nonzero(over)
        over &= v <= hi
        between.append(v[over])
    v, a, b = np.concatenate(between), (n - 1) // 2 - below, n // 2 - below
    if a < 0 or b >= len(v):
        return float(np.median(np.concatenate([part(i, i + LINE) for i in range(0, n, LINE)])))
    v = np.partition(v, (a, b))
    return float((v[a] + v[b]) / 2)


def turned_mads(base: np.ndarray, unit: np.ndarray, angles: np.ndarray, pool: ThreadPoolExecutor | None = None) -> np.ndarray:
    """The median absolute deviation of cos(angle) * base + sin(angle) * unit for each angle; angles side by side, each a stretch of rows at a time."""
    n, step = len(base), max(1, len(base) // TOLD)
    some = base[::step], unit[::step]

    def one(at):
        c, s = at
        line = lambda i, j: c * base[i:j] + s * unit[i:j]
        told = c * some[0] + s * some[1]
        middle = _middle(n, line, told)
        return 1.4826 * _middle(n, lambda i, j: np.abs(line(i, j) - middle), np.abs(told - middle))

    return np.array(list((pool.map if pool else map)(one, zip(np.cos(angles), np.sin(angles)))))


def robust_pca(x: np.ndarray, ncomp: int, angles: int = 25, rounds: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projection pursuit for the largest median absolute deviation, on a grid of angles in coordinate planes, narrowed round by round; inside the span of the samples."""
    x = x - np.median(x, 0)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    v = v[s > 1e-10 * max(s[0], 1e-300)] if len(s) else v
    z, basis = x @ v.T, np.eye(len(v))
    none, zero = np.zeros(1), np.zeros(len(x))
    mad = lambda a: turned_mads(a, zero, none)[0]
    loads, var = [], []
    threads = min(4, len(os.sched_getaffinity(0)), len(x) // 50_000)  # more are in each other's way, and on few rows any
    with ThreadPoolExecutor(max(1, threads)) as pool:
        pool = pool if threads > 1 else None
        for _ in range(min(ncomp, len(v))):
            q = z @ basis
            columns = np.ascontiguousarray(q.T)
            order = np.argsort(np.array([mad(c) for c in columns]))[::-1]
            a = np.zeros(q.shape[1])
            a[order[0]] = 1
            base, now = q @ a, mad(q @ a)
            for r in range(rounds):
                grid = np.linspace(-np.pi / 2, np.pi / 2, angles) / 2**r
                for k in order:
                    g = grid[int(np.argmax(turned_mads(base, columns[k], grid, pool)))]
                    new = np.cos(g) * a
                    new[k] += np.sin(g)
                    size = np.linalg.norm(new)
                    if size > 1e-12:
                        line = q @ (new / size)
                        if (then := mad(line)) > now:
                            a, base, now = new / size, line, then
            full = basis @ a
            loads.append(full)
            var.append(mad(z @ full) ** 2)
            u, sv, _ = np.linalg.svd(np.eye(len(v)) - np.array(loads).T @ np.array(loads))
            basis = u[:, sv > 0.5]
            if not basis.shape[1]:
                break
    load = v.T @ np.array(loads).T
    return x @ load, load, np.array(var)


def t_quantile(p: float, df: int) -> float:
    """Student's t, by bisection on its distribution function (by Simpson's rule)."""
    from math import gamma, pi, sqrt

    c = gamma((df + 1) / 2) / (sqrt(df * pi) * gamma(df / 2)) if df < 300 else None
    if c is None:
        from statistics import NormalDist

        z = NormalDist().inv_cdf(p)
        return z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)

    def cdf(x):
        t = np.linspace(0, x, 2001)
        f = c * (1 + t * t / df) ** (-(df + 1) / 2)
        return 0.5 + x / 2000 / 3 * float(f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())

    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def chi2_quantile(p: float, df: int) -> float:
    """By bisection on the regularised incomplete gamma function's series."""
    from math import exp, lgamma, log

    def cdf(x):
        a, x = df / 2, x / 2
        term = total = 1 / a
        for k in range(1, 2000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return total * exp(-x + a * log(x) - lgamma(a)) if x > 0 else 0.0

    lo, hi = 0.0, 10.0 * df + 200
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def wilcoxon_greater(d: np.ndarray) -> float:
    """One-sided signed-rank p-value: exact for up to 25 differences without ties, else normal with continuity correction."""
    from statistics import NormalDist

    d = d[d != 0]
    n = len(d)
    if not n:
        return 1.0
    size = np.abs(d)
    order = np.sort(size)
    ranks = np.array([(np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2 for v in size])
    w = ranks[d > 0].sum()
    counts = np.unique(size, return_counts=True)[1]
    if n <= 25 and (counts == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k].copy()
        return float(ways[int(w) :].sum() / 2.0**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48
    return 1 - NormalDist().cdf((w - n * (n + 1) / 4 - 0.5) / np.sqrt(var))
