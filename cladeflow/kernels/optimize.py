"""Small optimisers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_G = (np.sqrt(5) - 1) / 2


def golden(f: Callable[[np.ndarray], np.ndarray], lo, hi, rounds: int = 60) -> np.ndarray:
    """Minimum of many unimodal functions at once: f takes and gives an array."""
    a, b = np.array(lo, float), np.array(hi, float)
    c, d = b - _G * (b - a), a + _G * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(rounds):
        left = fc < fd
        b, a = np.where(left, d, b), np.where(left, a, c)
        new = np.where(left, b - _G * (b - a), a + _G * (b - a))
        fn = f(new)
        c, d, fc, fd = np.where(left, new, d), np.where(left, c, new), np.where(left, fn, fd), np.where(left, fc, fn)
    return (a + b) / 2


def simplex(f: Callable[[np.ndarray], float], x0: np.ndarray, step: float = 0.5, rounds: int = 400, tol: float = 1e-8) -> np.ndarray:
    """Nelder-Mead minimum."""
    n = len(x0)
    pts = np.vstack([x0, x0 + step * np.eye(n)])
    val = np.array([f(p) for p in pts])
    for _ in range(rounds):
        order = np.argsort(val, kind="stable")
        pts, val = pts[order], val[order]
        if val[-1] - val[0] < tol:
            break
        mid = pts[:-1].mean(axis=0)
        for k in (1.0, 2.0, 0.5, -0.5):
            trial = mid + k * (mid - pts[-1])
            v = f(trial)
            if k == 1.0:
                first, fv = trial, v
                if val[0] <= v < val[-2]:
                    break
                continue
            if k == 2.0:
                if fv < val[0]:
                    trial, v = (trial, v) if v < fv else (first, fv)
                    break
                continue
            if v < min(fv, val[-1]):
                break
        else:
            pts[1:] = pts[0] + 0.5 * (pts[1:] - pts[0])
            val[1:] = [f(p) for p in pts[1:]]
            continue
        if k == 1.0:
            trial, v = first, fv
        pts[-1], val[-1] = trial, v
    return pts[np.argmin(val)]
