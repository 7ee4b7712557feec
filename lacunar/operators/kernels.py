"""Imputation of one matrix in numpy: what a task does for its group or window.

x is samples x features with NaN for missing; every function returns a new array.
"""

from __future__ import annotations

import time
import warnings

import numpy as np

from lacunar.operators.result import InfeasibleError

EPS = float(np.finfo(float).eps)
SMALL_SD = 1e-15
#: The block iteration gives up after so many rounds without a smaller residual, or when it grows by this factor.
STALL, DIVERGED = 5, 10.0
#: The automatic choice: the exact solver below so many rows of the Gram matrix or over this share of its
#: eigenpairs; else as many timed rounds of the other, which must take less than this share of the exact one's time.
LEAST_GRAM, MOST_SHARE, PROBES, FASTER = 250, 0.1, 5, 0.9


def fill_means(x: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
    """Missing values of the columns by their means; columns without any value stay as they are."""
    out = x.copy()
    for j in range(x.shape[1]) if columns is None else columns:
        gone = np.isnan(x[:, j])
        if gone.any() and not gone.all():
            out[gone, j] = x[~gone, j].mean()
    return out


def checked(x: np.ndarray) -> None:
    if np.isinf(x).any():
        i, j = np.argwhere(np.isinf(x))[0] + 1
        raise ValueError(f"infinite value in row {i}, column {j}")
    if np.isnan(x).all(axis=0).any():
        raise ValueError("a column has no finite value")


def distances(target: np.ndarray, others: np.ndarray, method: str) -> np.ndarray:
    """Mean squared or absolute difference over rows that both have; infinity where there is none."""
    diff = others - target[:, None]
    each = np.abs(diff) if method == "manhattan" else diff * diff
    n = np.isfinite(each).sum(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, np.nansum(each, axis=0) / n, np.inf)


def weights(d: np.ndarray, power: float) -> np.ndarray:
    if power == 0:
        return np.ones(len(d))
    positive = d[(d > 0) & np.isfinite(d)]
    if not len(positive):
        return np.ones(len(d))
    least = positive.min()
    if (d <= 0).any():
        floor = least * np.sqrt(EPS)
        return (floor / np.maximum(d, floor)) ** power
    return np.where(np.isinf(d), 0.0, (least / d) ** power)


def combine(values: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted mean of the neighbours (columns of values) that each row has; NaN without any."""
    there = ~np.isnan(values)
    total = (there * w).sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(total > 0, np.nansum(values * w, axis=1) / total, np.nan)


def knn(x: np.ndarray, k: int, subset: np.ndarray | None = None, colmax: float = 0.9, method: str = "euclidean", post_imp: bool = True, dist_pow: float = 0.0) -> np.ndarray:
    """Missing values by the k nearest columns; subset: positions of the columns to complete."""
    n, p = x.shape
    checked(x)
    if n < 1 or p < 2 or not 1 <= k <= p - 1:
        raise ValueError("k must be from 1 to the number of columns less one")
    wanted = np.zeros(p, bool)
    wanted[np.arange(p) if subset is None else subset] = True
    gone = np.isnan(x)
    if not gone[:, wanted].any():
        return x.copy()
    eligible = gone.mean(0) < min(colmax, 1)
    if k > eligible.sum() - 1:
        raise InfeasibleError("too few eligible columns for k")
    todo = np.flatnonzero(eligible & wanted & gone.any(0))
    if not len(todo):
        raise InfeasibleError("no eligible column has missing values")
    # ties: complete columns first, then those completed here, then the others
    role = np.where(~gone.any(0), 0, np.where(wanted, 1, 2))
    pool = np.flatnonzero(eligible)
    pool = pool[np.lexsort((pool, role[pool]))]
    out = x.copy()
    for t in todo:
        others = pool[pool != t]
        d = distances(x[:, t], x[:, others], method)
        near = np.argsort(d, kind="stable")[:k]
        rows = gone[:, t]
        out[rows, t] = combine(x[np.ix_(rows, others[near])], weights(d[near], dist_pow))
    return fill_means(out, np.flatnonzero(wanted)) if post_imp else out


def top_pairs(gram: np.ndarray, k: int, solver: str, warm: np.ndarray | None, tol: float, maxiter: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Largest k eigenpairs, descending; and whether the iterative solver gave them."""
    if solver == "lobpcg" and warm is not None and warm.shape[1] == k and gram.shape[0] > 5 * k:
        found = blocked(gram, warm, tol, maxiter)
        if found is not None:
            return *found, True
    values, vectors = np.linalg.eigh(gram)
    return values[::-1][:k], vectors[:, ::-1][:, :k], False


def blocked(a: np.ndarray, x: np.ndarray, tol: float, maxiter: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Locally optimal block iteration for the largest eigenpairs from a warm start; None if it doesn't settle."""
    x, k, last, least, stale = np.linalg.qr(x)[0], x.shape[1], None, np.inf, 0
    for _ in range(max(1, maxiter)):
        ax = a @ x
        values, rot = np.linalg.eigh(x.T @ ax)
        x, ax = x @ rot, ax @ rot
        rest = ax - x * values
        size = np.linalg.norm(rest)
        if size <= tol * max(1e-300, abs(values).max()) * np.sqrt(k):
            return values[::-1], x[:, ::-1]
        stale = 0 if size < least else stale + 1
        if stale >= STALL or size > DIVERGED * least:
            return None
        least = min(least, size)
        basis = np.linalg.qr(np.concatenate([x, rest] + ([last] if last is not None else []), 1))[0]
        values, rot = np.linalg.eigh(basis.T @ a @ basis)
        new = basis @ rot[:, -k:]
        last = new - x @ (x.T @ new)
        x = new
    return None


def signed(u: np.ndarray) -> np.ndarray:
    top = u[np.abs(u).argmax(0), np.arange(u.shape[1])]
    return u * np.where(top < 0, -1.0, 1.0)


def triplet(z: np.ndarray, w: np.ndarray, k: int, solver: str, warm: np.ndarray | None, tol: float, maxiter: int):
    """Singular values, left vectors (rows unweighted), right vectors, total energy, eigenvectors; of sqrt(w) z."""
    n, p = z.shape
    b = z * np.sqrt(w)[:, None]
    gram = b.T @ b if n >= p else b @ b.T
    k = min(k, gram.shape[0])
    values, vectors, ok = top_pairs(gram, k, solver, warm, tol, maxiter)
    vectors = signed(vectors)
    s = np.sqrt(np.maximum(values, 0))
    inverse = np.where(s > SMALL_SD, 1 / np.maximum(s, SMALL_SD), 0)
    u, v = (b @ vectors * inverse, vectors) if n >= p else (vectors, b.T @ vectors * inverse)
    return s, u / np.sqrt(w)[:, None], v, float(np.trace(gram)), vectors, ok


def shrunk(s: np.ndarray, trace: float, n: int, p: int, ncp: int, method: str, ridge: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Of singular values: the shrunk leading ones, the energy of the rest, and the leading ones as they are."""
    main = s[:ncp]
    tail = max(0.0, trace - (main**2).sum())
    noise = 0.0
    if method == "regularized":
        free = (p - ncp) * (n - 1 - ncp)
        noise = (n * p / min(p, n - 1)) * tail / free if free > 0 else 0.0
        noise = min(ridge * noise, s[ncp] ** 2 if len(s) > ncp else 0.0)
    return np.where(main > SMALL_SD, main - noise / np.maximum(main, SMALL_SD), 0.0), tail, main


def pca(x: np.ndarray, ncp: int = 2, scale: bool = True, method: str = "regularized", coeff_ridge: float = 1.0, row_w=None, threshold: float = 1e-6, seed: int | None = None, nb_init: int = 1, maxiter: int = 1000, miniter: int = 5, solver: str = "auto", eigen=None, colmax: float = 0.9, post_imp: bool = True, clamp=None) -> tuple[np.ndarray, dict]:
    """Missing values by iterated regularised (or EM) principal components; and a report."""
    n, p_all = x.shape
    checked(x)
    if ncp > p_all - 1:
        raise ValueError("ncp must be below the number of columns")
    gone_all = np.isnan(x)
    if not gone_all.any():
        return x.copy(), {}
    with np.errstate(invalid="ignore"):
        centred = x - np.nanmean(x, axis=0)
        seen = n - gone_all.sum(0)
        variance = np.where(seen > 1, np.nansum(centred**2, axis=0) / np.maximum(seen - 1, 1), np.nan)
    eligible = (gone_all.mean(0) <= min(colmax, 1)) & ~np.isnan(variance) & (variance >= EPS)
    cap = min(n - 2, eligible.sum() - 1)
    if cap < 1 or ncp > cap or not gone_all[:, eligible].any():
        raise InfeasibleError("too few eligible columns or rows for ncp, or none with missing values")
    if isinstance(row_w, str):
        if row_w != "n_miss":
            raise ValueError("row_w must be weights or 'n_miss'")
        w = np.maximum(1 - gone_all.mean(1), 1e-10)
    else:
        w = np.ones(n) if row_w is None else np.asarray(row_w, float)
        if len(w) != n or not (w > 0).all():
            raise ValueError("row_w must be positive, one weight a row")
    w = w / w.sum()
    e = x[:, eligible]
    gone = np.isnan(e)
    p = e.shape[1]
    k = ncp + 1 if method == "regularized" else ncp
    tol, inner = (eigen.tol, eigen.maxiter) if eigen else (1e-9, 20)
    warmup = eigen.warmup_iters if eigen else 10
    use, probing, took = solver, False, {"exact": [], "lobpcg": []}
    if solver == "auto":
        probing = min(n, p) >= LEAST_GRAM and k / min(n, p) <= MOST_SHARE and not (eigen and eigen.maxiter == 0)
        use = "lobpcg" if probing else "exact"
        warmup = min(50, max(warmup, int(np.ceil(1.5 * k))))
    best = None
    for init in range(1, nb_init + 1):
        rng = np.random.default_rng(None if seed is None else seed * (init - 1))
        seen_w = (w[:, None] * ~gone).sum(0)
        mu = np.nansum(w[:, None] * e, axis=0) / seen_w
        sd = np.sqrt(np.nansum(w[:, None] * (e - mu) ** 2, axis=0) / seen_w) if scale else np.ones(p)
        sd = np.maximum(sd, SMALL_SD)
        z = np.where(gone, 0.0 if init == 1 else rng.standard_normal(e.shape), (e - mu) / sd)
        old, fit, warm, done, crit, ok_n, bad_n = np.inf, None, None, False, np.inf, 0, 0
        for it in range(1, maxiter + 1):
            if fit is not None:
                full = np.where(gone, fit, z) * sd + mu
                mu = (w[:, None] * full).sum(0)
                if scale:
                    sd = np.maximum(np.sqrt((w[:, None] * (full - mu) ** 2).sum(0)), SMALL_SD)
                z = (full - mu) / sd
            how = use if it > warmup else "exact"
            began = time.perf_counter()
            s, u, v, trace, warm, ok = triplet(z, w, k, how, warm, tol, inner)
            ok_n, bad_n = ok_n + ok, bad_n + (how == "lobpcg" and not ok)
            if probing:
                took[how].append(time.perf_counter() - began)
                if len(took["lobpcg"]) >= PROBES:  # holds for later starts too
                    probing = False
                    use = "lobpcg" if np.mean(took["lobpcg"]) < FASTER * np.mean(took["exact"] or [np.inf]) else "exact"
            lam, tail, main = shrunk(s, trace, n, p, ncp, method, coeff_ridge)
            fit = (u[:, :ncp] * lam) @ v[:, :ncp].T
            objective = max(0.0, tail + ((main - lam) ** 2).sum() - (w[:, None] * (z - fit) ** 2)[gone].sum())
            crit = abs(1 - objective / old) if old > 0 else 0.0
            old = objective
            if it >= miniter and (crit < threshold or objective < threshold):
                done = True
                break
        error = (((z - fit) * sd)[~gone] ** 2).mean()
        if best is None or error < best[0]:
            best = (error, z * sd + mu, {"n_iter": it, "converged": done, "criterion": float(crit), "solver": use, "n_exact": it - ok_n, "n_iterative": ok_n, "n_failed": bad_n})
    _, full, report = best
    if not report["converged"]:
        warnings.warn(f"no convergence within {maxiter} rounds", stacklevel=2)
    values = full if clamp is None else np.clip(full, *clamp)
    out = x.copy()
    out[:, eligible] = np.where(gone, values, e)
    return (fill_means(out) if post_imp else out), report


def impute(name: str, x: np.ndarray, params: dict, subset: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
    """The completed matrix and the method's report."""
    if name == "knn":
        return knn(x, int(params["k"]), subset, params["colmax"], params["method"], params["post_imp"], params["dist_pow"]), {}
    return pca(x, **params)
