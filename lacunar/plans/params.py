"""Parameters of the methods: names, defaults, checks."""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import asdict, dataclass

import numpy as np

KNN = {"k": None, "colmax": 0.9, "method": "euclidean", "post_imp": True, "dist_pow": 0.0}
PCA = {"ncp": None, "scale": True, "method": "regularized", "coeff_ridge": 1.0, "row_w": None, "threshold": 1e-6, "seed": None, "nb_init": 1, "maxiter": 1000, "miniter": 5, "solver": "auto", "eigen": None, "colmax": 0.9, "post_imp": True, "clamp": None}
WINDOWS = {"window_size": None, "overlap_size": 0.0, "flank": False, "min_window_n": None}
METHODS = {"knn": KNN, "pca": PCA}


@dataclass(frozen=True)
class EigenControl:
    """Options of the iterative eigensolver; maxiter = 0 asks for the exact one."""

    warmup_iters: int = 10
    tol: float = 1e-9
    maxiter: int = 20

    def __post_init__(self):
        if self.warmup_iters < 0 or self.maxiter < 0 or not self.tol > 0:
            raise ValueError("warmup_iters and maxiter must not be negative, tol must be positive")


def dumped(name: str, p: dict) -> str:
    """Method and parameters as JSON, for a column."""

    def plain(v):
        if isinstance(v, EigenControl):
            return asdict(v)
        return v.tolist() if isinstance(v, (np.ndarray, np.generic)) else v

    return json.dumps({"_method": name, **{k: plain(v) for k, v in p.items()}})


def loaded(text: str) -> tuple[str, dict]:
    """What `dumped` was given."""
    p = json.loads(text)
    if isinstance(p.get("eigen"), dict):
        p["eigen"] = EigenControl(**p["eigen"])
    return p.pop("_method"), p


def pinned(builder):
    """A session builder whose Python workers use one BLAS thread each, as every task has one core."""
    for name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
        builder = builder.config(f"spark.executorEnv.{name}", "1")
    return builder


def resolve(given: dict, extra: tuple[str, ...] = ()) -> tuple[str, dict]:
    """(method, all parameters) from what is given: exactly one of k and ncp tells the method."""
    given = {k: v for k, v in given.items() if v is not None}
    if ("k" in given) == ("ncp" in given):
        raise ValueError("give exactly one of k and ncp")
    name = "knn" if "k" in given else "pca"
    known = METHODS[name]
    if unknown := set(given) - set(known) - set(extra):
        raise ValueError(f"unknown parameters for {name}: {sorted(unknown)}")
    out = {**known, **given}
    check(name, out)
    return name, out


def check(name: str, p: dict) -> None:
    if not 0 <= p["colmax"] <= 1:
        raise ValueError("colmax must be from 0 to 1")
    if name == "knn":
        if int(p["k"]) != p["k"] or p["k"] < 1:
            raise ValueError("k must be a positive integer")
        if p["method"] not in ("euclidean", "manhattan"):
            raise ValueError(f"unknown distance {p['method']}")
        if not (math.isfinite(p["dist_pow"]) and p["dist_pow"] >= 0):
            raise ValueError("dist_pow must be finite and not negative")
        return
    if int(p["ncp"]) != p["ncp"] or p["ncp"] < 1:
        raise ValueError("ncp must be a positive integer")
    if p["seed"] is not None and abs(p["seed"] * (p["nb_init"] - 1)) >= 1 << 31:
        raise ValueError("seed * (nb_init - 1) is too large")
    if (w := p["row_w"]) is not None and (w != "n_miss" if isinstance(w, str) else not all(x > 0 for x in w)):
        raise ValueError("row_w must be positive weights or 'n_miss'")
    if p["method"] not in ("regularized", "EM"):
        raise ValueError(f"unknown PCA method {p['method']}")
    if p["miniter"] > p["maxiter"]:
        raise ValueError("miniter is over maxiter")
    if p["solver"] not in ("auto", "exact", "lobpcg"):
        raise ValueError(f"unknown solver {p['solver']}")
    if p["clamp"] is not None:
        low, high = p["clamp"]
        if math.isnan(low) or math.isnan(high) or low > high:
            raise ValueError("clamp must be a lower and an upper limit")
    if isinstance(p["eigen"], dict):
        p["eigen"] = EigenControl(**p["eigen"])
    if (e := p["eigen"]) is not None and e.maxiter == 0 and p["solver"] == "lobpcg":
        raise ValueError("maxiter = 0 goes with the exact solver only")


def capped(name: str, p: dict, columns: int, rows: int) -> dict:
    """k or ncp lowered to what a matrix of that size allows; ValueError if that leaves none."""
    key, most = ("k", columns - 1) if name == "knn" else ("ncp", min(columns - 1, rows - 2))
    if most < 1:
        raise ValueError(f"a group of {columns} columns and {rows} rows is too small")
    if p[key] > most:
        warnings.warn(f"{key} = {p[key]} is lowered to {most} for a group of {columns} columns", stacklevel=3)
    return {**p, key: min(p[key], most)}
