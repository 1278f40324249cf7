"""Numpy kernels over whole frames of a signal: each takes an array of samples and gives per-frame values.

They run inside Arrow groups of one signal; framing is a strided view, the transforms are batched.
"""

from __future__ import annotations

import numpy as np

TINY = 1e-12
#: The analysis grids (rate, transform length, hop).
FEATURE_GRID, LANDMARK_GRID, CFA_GRID = (8000, 2048, 512), (8000, 1024, 512), (11025, 1024, 256)
#: Modulation bands in Hz.
ENVELOPE_BANDS = ((80, 300), (300, 800), (800, 2000), (2000, 4000))


def hann(n: int, periodic: bool = False) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n if periodic else n - 1))


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """max(0, (n - size) // hop + 1) rows of size samples."""
    if len(x) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), size)[::hop]


def spectra(x: np.ndarray, size: int, hop: int, periodic: bool = False) -> np.ndarray:
    """Magnitudes, frames x (size // 2 + 1)."""
    return np.abs(np.fft.rfft(frames(x, size, hop) * hann(size, periodic), axis=1))


def spectral_features(x: np.ndarray, rate: int = 8000, size: int = 2048, hop: int = 512, low_hz: float = 250) -> dict[str, np.ndarray]:
    """log_rms, low_ratio, flatness and flux of each frame."""
    windowed = frames(x, size, hop) * hann(size)
    mag = np.abs(np.fft.rfft(windowed, axis=1))
    power = mag * mag
    low = int(low_hz * size / rate + 0.5)
    total = power.sum(axis=1)
    rise = np.maximum(0, np.diff(mag, axis=0, prepend=mag[:1])).sum(axis=1)
    return {
        "log_rms": 20 * np.log10(np.sqrt((windowed**2).mean(axis=1)) + TINY),
        "low_ratio": power[:, : low + 1].sum(axis=1) / np.maximum(total, TINY),
        "flatness": np.exp(np.log(power + TINY).mean(axis=1)) / (power.mean(axis=1) + TINY),
        "flux": rise / np.maximum(mag.sum(axis=1), TINY),
    }


def pitch_classes(size: int, rate: int, low: float = 55, high: float = 4000) -> np.ndarray:
    """Pitch class (A is 0) of each transform bin, -1 outside [low, high] Hz."""
    f = np.arange(size // 2 + 1) * rate / size
    inside = (f >= low) & (f <= high)
    return np.where(inside, np.mod(np.floor(12 * np.log2(np.where(inside, f, 440.0) / 440) + 0.5), 12), -1).astype(int)


def chroma(x: np.ndarray, rate: int = 8000, size: int = 2048, hop: int = 512, gate: float = 0.02) -> np.ndarray:
    """frames x 12: magnitudes by class, centred over the signal, quiet frames zero, unit length."""
    mag, of = spectra(x, size, hop), pitch_classes(size, rate)
    c = np.stack([mag[:, of == k].sum(axis=1) for k in range(12)], axis=1)
    if not len(c):
        return c
    energy = np.linalg.norm(c, axis=1)
    quiet = energy < gate * np.sort(energy)[len(energy) // 2]
    c = c - c.mean(axis=0)
    length = np.linalg.norm(c, axis=1, keepdims=True)
    return np.where(quiet[:, None] | (length == 0), 0, c / np.maximum(length, TINY))


def self_similarity(c: np.ndarray, lags: tuple[int, ...] = (8, 16, 31)) -> np.ndarray:
    out = np.zeros(len(c))
    for lag in lags:
        if lag < len(c):
            out[:-lag] = np.maximum(out[:-lag], (c[:-lag] * c[lag:]).sum(axis=1))
    return out


def peaks(mag: np.ndarray, level: np.ndarray, most: int = 3, silence_db: float = -50) -> list[np.ndarray]:
    """Bins of each frame's loudest local peaks over frequency and time; silent frames have none and bound no neighbour."""
    n, bins = mag.shape
    silent = level < silence_db
    gap = np.full((1, bins), -np.inf)
    before = np.where(np.concatenate([[True], silent[:-1]])[:, None], -np.inf, np.concatenate([gap, mag[:-1]]))
    after = np.where(np.concatenate([silent[1:], [True]])[:, None], -np.inf, np.concatenate([mag[1:], gap]))
    core = mag[:, 1:-1]
    top = (core > mag[:, :-2]) & (core >= mag[:, 2:]) & (core >= before[:, 1:-1]) & (core >= after[:, 1:-1])
    out = []
    for t in range(n):
        k = np.flatnonzero(top[t]) + 1 if not silent[t] else np.zeros(0, int)
        out.append(k[np.argsort(-mag[t, k], kind="stable")[:most]])
    return out


def landmarks(x: np.ndarray, size: int = 1024, hop: int = 512, max_dt: int = 32, targets: int = 4, quant: int = 2, occur: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(hash, anchor frame) of peak pairs: ((q1 * 1024 + q2) * 64 + dt). The last max_dt frames anchor nothing."""
    windowed = frames(x, size, hop) * hann(size)
    mag = np.abs(np.fft.rfft(windowed, axis=1))
    level = 20 * np.log10(np.sqrt((windowed**2).mean(axis=1)) + TINY) if len(mag) else np.zeros(0)
    found = peaks(mag, level) if len(mag) else []
    rows: list[tuple[int, int]] = []
    for t in range(len(found) - max_dt):
        ahead = [(-mag[t + d, found[t + d][0]], d, found[t + d][0]) for d in range(1, max_dt + 1) if len(found[t + d])]
        rows += [((int(a // quant) * 1024 + int(b // quant)) * 64 + d, t) for _, d, b in sorted(ahead)[:targets] for a in found[t]]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, t = np.array(rows, np.int64).T
    order = np.lexsort((t, h))
    h, t = h[order], t[order]
    rank = np.arange(len(h)) - np.searchsorted(h, h)
    return h[rank < occur], t[rank < occur]


def activation(x: np.ndarray, size: int = 1024, hop: int = 256, width: int = 21, block: int = 100, step: int = 50, top: int = 5, over_db: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Continuous-frequency activation of blocks of frames: block centre frames and the sum of the most prominent peaks
    of how often each bin stands out from the mean of the ``width`` bins around it."""
    mag = spectra(x, size, hop, periodic=True)
    if len(mag) < block:
        return np.zeros(0), np.zeros(0)
    db = 20 * np.log10(np.maximum(mag, TINY))
    db = np.maximum(db, db.max(axis=1, keepdims=True) - 120)
    half, bins = width // 2, db.shape[1]
    sums = np.concatenate([np.zeros((len(db), 1)), np.cumsum(db, axis=1)], axis=1)
    lo, hi = np.maximum(np.arange(bins) - half, 0), np.minimum(np.arange(bins) + half + 1, bins)
    on = db - (sums[:, hi] - sums[:, lo]) / (hi - lo) > over_db
    centres, values = [], []
    for a in range(0, len(on) - block + 1, step):
        curve = on[a: a + block].mean(axis=0)
        values.append(np.sort(prominences(curve))[::-1][:top].sum())
        centres.append(a + block / 2)
    return np.array(centres), np.array(values)


def prominences(curve: np.ndarray) -> np.ndarray:
    """For each local maximum the smaller drop to the nearest valleys over the distance to that valley."""
    out = []
    rise = np.diff(curve)
    for k in np.flatnonzero((rise[:-1] > 0) & (rise[1:] <= 0)) + 1:
        a = k
        while a > 0 and curve[a - 1] < curve[a]:
            a -= 1
        b = k
        while b < len(curve) - 1 and curve[b + 1] <= curve[b] and (b == k or curve[b + 1] < curve[b]):
            b += 1
        left, right = curve[k] - curve[a], curve[k] - curve[b]
        width = k - a if left < right else b - k
        out.append(min(left, right) / width if width else 0.0)
    return np.array(out) if out else np.zeros(0)
