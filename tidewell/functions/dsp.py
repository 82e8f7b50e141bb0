"""Array kernels of raw signals on numpy, without Spark. Missing samples are NaN; results that too few samples support are NaN or empty."""

from __future__ import annotations

import math

import numpy as np


def hann(n: int) -> np.ndarray:
    """Symmetric Hann window."""
    return np.ones(n) if n < 2 else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def fill_gaps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filled, mask of missing): gaps bridged linearly and ends held, for filtering only."""
    bad = ~np.isfinite(x)
    if bad.all() or not bad.any():
        return np.where(bad, 0.0, x), bad
    at = np.arange(len(x))
    return np.interp(at, at[~bad], x[~bad]), bad


def detrend(x: np.ndarray) -> np.ndarray:
    """Least-squares line over the finite samples taken off; missing samples stay missing."""
    good = np.isfinite(x)
    if good.sum() < 2:
        return x - np.nanmean(x) if good.any() else x
    at = np.arange(len(x), dtype=float)
    slope, level = np.polyfit(at[good], x[good], 1)
    return x - (slope * at + level)


def welch(x: np.ndarray, fs: float, window: int | None = None, overlap: float = 0.5, nfft: int | None = None, least_segments: int = 3) -> tuple[np.ndarray, np.ndarray, int]:
    """(f, density, segments): mean periodogram of detrended Hann segments; those with a missing sample are left out.
    Fewer than least_segments give an empty spectrum: too few to average."""
    n = window or min(len(x), int(round(fs)))
    step = max(1, int(round(n * (1 - overlap))))
    w = hann(n)
    m = nfft or n
    got = [np.abs(np.fft.rfft(detrend(s) * w, m)) ** 2 for i in range(0, len(x) - n + 1, step) if np.isfinite(s := x[i : i + n]).all()]
    if len(got) < least_segments:
        return np.zeros(0), np.zeros(0), len(got)
    p = np.mean(got, axis=0) / (fs * (w**2).sum())
    p[1 : None if m % 2 else -1] *= 2
    return np.fft.rfftfreq(m, 1 / fs), p, len(got)


def band_power(f: np.ndarray, p: np.ndarray, low: float, high: float) -> float:
    """Trapezoid of the density over the closed band."""
    at = (f >= low) & (f <= high)
    return float(np.trapezoid(p[at], f[at])) if at.sum() > 1 else math.nan


def peak(f: np.ndarray, p: np.ndarray, low: float, high: float) -> tuple[float, float]:
    """(frequency, power) of the greatest density in the closed band; the first of equals."""
    at = np.flatnonzero((f >= low) & (f <= high))
    if not len(at):
        return math.nan, math.nan
    i = at[int(np.argmax(p[at]))]
    return float(f[i]), float(p[i])


def biquads(kind: str, fs: float, low: float, high: float | None = None, order: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order Butterworth sections by the bilinear transform: low-pass, high-pass, or both for a band."""
    if kind == "band":
        return biquads("high", fs, low, order=order) + biquads("low", fs, high, order=order)
    k = math.tan(math.pi * min(low / fs, 0.4999))
    out = []
    for i in range(order // 2):
        q = 1 / (2 * math.cos(math.pi * (2 * i + 1) / (2 * order)))
        norm = 1 / (1 + k / q + k * k)
        a = np.array([1.0, 2 * (k * k - 1) * norm, (1 - k / q + k * k) * norm])
        b = np.array([k * k, 2 * k * k, k * k]) * norm if kind == "low" else np.array([1.0, -2.0, 1.0]) * norm
        out.append((b, a))
    return out


def filtered(x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Zero phase: each section forth and back, by its frequency response on the mirrored signal; missing samples stay missing."""
    y, bad = fill_gaps(np.asarray(x, float))
    n = len(y)
    if n < 2:
        return np.where(bad, np.nan, y)
    both = np.concatenate([y[::-1], y, y[::-1]])
    z = np.exp(-2j * np.pi * np.fft.rfftfreq(len(both)))
    gain = np.ones(len(z))
    for b, a in sections:
        gain = gain * np.abs((b[0] + b[1] * z + b[2] * z * z) / (a[0] + a[1] * z + a[2] * z * z)) ** 2
    y = np.fft.irfft(np.fft.rfft(both) * gain, len(both))[n : 2 * n]
    return np.where(bad, np.nan, y)


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal by the Hilbert transform."""
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0 and n:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def envelope(x: np.ndarray, fs: float, low: float, high: float) -> np.ndarray:
    y, bad = fill_gaps(filtered(x, biquads("band", fs, low, high)))
    return np.where(bad, np.nan, np.abs(analytic(y)))


def bursts(x: np.ndarray, fs: float, low: float, high: float, percentile: float = 75.0, least_s: float = 0.1) -> list[tuple[float, float, float]]:
    """(start, seconds, greatest amplitude) of the stretches whose envelope is over its percentile for least_s or longer."""
    e = envelope(x, fs, low, high)
    if not np.isfinite(e).any():
        return []
    over = np.where(np.isfinite(e), e, -np.inf) > np.nanpercentile(e, percentile)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], over.astype(np.int8), [0]])))
    return [(a / fs, (z - a) / fs, float(e[a:z].max())) for a, z in edge.reshape(-1, 2) if (z - a) / fs >= least_s]


def aperiodic(f: np.ndarray, p: np.ndarray, low: float, high: float, rounds: int = 3) -> tuple[float, float, float]:
    """(offset, exponent, r²) of log10 density against log10 frequency, refitted without what stands out above the line."""
    at = (f >= low) & (f <= high) & (f > 0) & (p > 0)
    if at.sum() < 4:
        return math.nan, math.nan, math.nan
    u, v = np.log10(f[at]), np.log10(p[at])
    use = np.ones(len(u), bool)
    for _ in range(rounds):
        slope, level = np.polyfit(u[use], v[use], 1)
        rest = v - (level + slope * u)
        limit = np.quantile(rest, 0.75)
        if (rest <= limit).sum() < 4:
            break
        use = rest <= limit
    fit = level + slope * u
    total = ((v[use] - v[use].mean()) ** 2).sum()
    return float(level), float(-slope), float(1 - ((v[use] - fit[use]) ** 2).sum() / total) if total > 0 else math.nan


def coherence(x: np.ndarray, y: np.ndarray, fs: float, window: int | None = None, overlap: float = 0.5) -> tuple[np.ndarray, np.ndarray, int]:
    """(f, magnitude-squared coherence, segments) over segments that both signals have whole; three at least."""
    n = window or min(len(x), int(round(fs)))
    step, w = max(1, int(round(n * (1 - overlap)))), hann(n)
    xx = yy = xy = 0.0
    k = 0
    for i in range(0, min(len(x), len(y)) - n + 1, step):
        a, b = x[i : i + n], y[i : i + n]
        if np.isfinite(a).all() and np.isfinite(b).all():
            a, b = np.fft.rfft(detrend(a) * w), np.fft.rfft(detrend(b) * w)
            xx, yy, xy, k = xx + np.abs(a) ** 2, yy + np.abs(b) ** 2, xy + a * np.conj(b), k + 1
    if k < 3:
        return np.zeros(0), np.zeros(0), k
    return np.fft.rfftfreq(n, 1 / fs), np.abs(xy) ** 2 / np.maximum(xx * yy, 1e-300), k


def coupling(x: np.ndarray, fs: float, phase: tuple[float, float], amplitude: tuple[float, float], surrogates: int = 50, seed: int = 13572468) -> tuple[float, float]:
    """(mean vector length, z against circular shifts) of the amplitude of one band by the phase of another."""
    y, _ = fill_gaps(np.asarray(x, float))
    angle = np.angle(analytic(filtered(y, biquads("band", fs, *phase))))
    size = np.abs(analytic(filtered(y, biquads("band", fs, *amplitude))))
    strength = abs(np.mean(size * np.exp(1j * angle))) / max(size.mean(), 1e-300)
    rng = np.random.default_rng(seed)
    n = len(y)
    null = [abs(np.mean(np.roll(size, int(s)) * np.exp(1j * angle))) / max(size.mean(), 1e-300) for s in rng.integers(max(1, n // 10), max(2, n - n // 10), surrogates)]
    return float(strength), float((strength - np.mean(null)) / max(np.std(null), 1e-300))


def heart_beats(x: np.ndarray, fs: float, most_bpm: float = 180.0) -> np.ndarray:
    """Samples of heartbeats' main deflection: greatest rectified slope, at least one beat's least distance apart."""
    y, _ = fill_gaps(np.asarray(x, float))
    e = filtered(y, biquads("band", fs, 5.0, min(40.0, 0.45 * fs)))
    e = np.convolve(np.gradient(e) ** 2, np.ones(max(1, int(0.08 * fs))), "same")
    gap = int(60 / most_bpm * fs)
    limit = np.median(e) + 0.3 * (np.quantile(e, 0.995) - np.median(e))
    order = np.flatnonzero((e > limit) & (e >= np.roll(e, 1)) & (e >= np.roll(e, -1)))
    out: list[int] = []
    for i in order[np.argsort(-e[order], kind="stable")]:
        if all(abs(i - j) >= gap for j in out):
            out.append(int(i))
    return np.array(sorted(out), np.int64)


def without_beats(x: np.ndarray, fs: float, beats: np.ndarray, before_s: float = 0.1, after_s: float = 0.25, components: int = 2) -> np.ndarray:
    """The signal less each beat's projection on the leading shapes of all beats (singular vectors)."""
    y, bad = fill_gaps(np.asarray(x, float))
    a, z = int(before_s * fs), int(after_s * fs)
    beats = beats[(beats >= a) & (beats + z <= len(y))]
    if len(beats) < 4:
        return np.where(bad, np.nan, y)
    rows = y[beats[:, None] + np.arange(-a, z)]
    mean = rows.mean(axis=0)
    _, _, shape = np.linalg.svd(rows - mean, full_matrices=False)
    basis = np.concatenate([mean[None] / max(np.linalg.norm(mean), 1e-300), shape[: components - 1]])
    basis = np.linalg.qr(basis.T)[0].T
    taper = np.minimum(1, np.minimum(np.arange(1, a + z + 1), np.arange(a + z, 0, -1)) / max(1, int(0.02 * fs)))
    for b in beats:
        y[b - a : b + z] -= taper * (basis.T @ (basis @ y[b - a : b + z]))
    return np.where(bad, np.nan, y)
