"""Picture descriptors on single pictures (arrays), for use batch by batch: histograms, key points, matching, alignment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def windows(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    """(rows, columns, height, width): every patch."""
    return np.lib.stride_tricks.sliding_window_view(picture, (height, width))


def filtered(picture: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation with the nearest cell's value beyond the border."""
    h, w = kernel.shape
    padded = np.pad(picture, ((h // 2, (h - 1) // 2), (w // 2, (w - 1) // 2)), mode="edge")
    return (windows(padded, h, w) * kernel).sum((-1, -2))


def gradient(picture: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)
    return filtered(picture, k), filtered(picture, k.T)


def oriented_histograms(picture: np.ndarray, cell: int = 8, block: int = 2, buckets: int = 9, split: bool = True, clip: float = 0.2) -> np.ndarray:
    """Votes of unsigned directions by magnitude, by cell, in overlapping normalised blocks."""
    gx, gy = gradient(picture)
    size, angle = np.hypot(gx, gy), np.mod(np.arctan2(gy, gx), np.pi) / np.pi * buckets
    low = np.floor(angle - 0.5 if split else angle).astype(int)
    part = angle - 0.5 - low if split else np.zeros_like(angle)
    rows, cols = picture.shape[0] // cell, picture.shape[1] // cell
    votes = np.zeros((rows, cols, buckets))
    r, c = np.indices(picture.shape)
    inside = (r < rows * cell) & (c < cols * cell)
    for bucket, weight in ((low, 1 - part), (low + 1, part)):
        np.add.at(votes, (r[inside] // cell, c[inside] // cell, bucket[inside] % buckets), (size * weight)[inside])
    out = []
    for i in range(rows - block + 1):
        for j in range(cols - block + 1):
            v = votes[i : i + block, j : j + block].ravel()
            v = np.minimum(v / np.sqrt((v**2).sum() + 1e-12), clip)
            out.append(v / np.sqrt((v**2).sum() + 1e-12))
    return np.array(out)


def corners(picture: np.ndarray, side: int = 3, k: float = 0.04) -> np.ndarray:
    gx, gy = gradient(picture)
    box = np.ones((side, side))
    xx, yy, xy = (filtered(v, box) for v in (gx * gx, gy * gy, gx * gy))
    return xx * yy - xy * xy - k * (xx + yy) ** 2


def peaks(strength: np.ndarray, least: float = 0.0, separation: int = 3, limit: int | None = None, border: int = 0) -> list[tuple[int, int]]:
    """Strongest first, none nearer than ``separation`` to a stronger one."""
    free = np.ones_like(strength, bool)
    if border:
        free[:border] = free[-border:] = False
        free[:, :border] = free[:, -border:] = False
    out: list[tuple[int, int]] = []
    for at in np.argsort(-strength, axis=None, kind="stable"):
        r, c = divmod(int(at), strength.shape[1])
        if strength[r, c] <= least or limit is not None and len(out) >= limit:
            break
        if free[r, c]:
            out.append((r, c))
            free[max(0, r - separation + 1) : r + separation, max(0, c - separation + 1) : c + separation] = False
    return out


def pyramid(picture: np.ndarray, levels: int = 3) -> list[np.ndarray]:
    """Each level smoothed and halved."""
    k = np.outer([1, 2, 1], [1, 2, 1]) / 16
    out = [picture]
    while len(out) < levels and min(out[-1].shape) >= 4:
        out.append(filtered(out[-1], k)[::2, ::2])
    return out


def binary_descriptor(picture: np.ndarray, point: tuple[int, int], angle: float = 0.0, bits: int = 128, reach: int = 7, seed: int = 0) -> np.ndarray:
    """Bits of brightness comparisons at drawn places, turned by the key point's angle."""
    pairs = np.clip(np.random.default_rng(seed).normal(0, reach / 2.5, (bits, 2, 2)), -reach, reach)
    turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    at = np.rint(pairs @ turn.T).astype(int) + np.array(point)
    r, c = np.clip(at[..., 0], 0, picture.shape[0] - 1), np.clip(at[..., 1], 0, picture.shape[1] - 1)
    v = picture[r, c]
    return (v[:, 0] < v[:, 1]).astype(np.uint8)


def gradient_descriptor(picture: np.ndarray, point: tuple[int, int], cells: int = 4, side: int = 4, buckets: int = 8) -> np.ndarray:
    """Direction histograms of cells around a point, normalised, clipped and normalised again."""
    gx, gy = gradient(picture)
    out = np.zeros((cells, cells, buckets))
    half = cells * side // 2
    for dr in range(-half, half):
        for dc in range(-half, half):
            r, c = point[0] + dr, point[1] + dc
            if 0 <= r < picture.shape[0] and 0 <= c < picture.shape[1]:
                b = int(np.mod(np.arctan2(gy[r, c], gx[r, c]), 2 * np.pi) / (2 * np.pi) * buckets) % buckets
                out[(dr + half) // side, (dc + half) // side, b] += np.hypot(gx[r, c], gy[r, c])
    v = out.ravel()
    v = np.minimum(v / (np.linalg.norm(v) + 1e-12), 0.2)
    return v / (np.linalg.norm(v) + 1e-12)


def matched(first: np.ndarray, second: np.ndarray, ratio: float = 0.8) -> list[tuple[int, int]]:
    """Pairs whose nearest descriptor is clearly nearer than the next one."""
    d = np.sqrt(((first[:, None].astype(float) - second[None]) ** 2).sum(-1))
    order = np.argsort(d, axis=1, kind="stable")
    best = d[np.arange(len(d)), order[:, 0]]
    next_ = d[np.arange(len(d)), order[:, 1]] if d.shape[1] > 1 else np.full(len(d), np.inf)
    return [(i, int(order[i, 0])) for i in range(len(d)) if best[i] <= ratio * next_[i]]


def similarity(first: np.ndarray, second: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(scale, turn, shift) that bring the first points nearest to the second."""
    a, b = first - first.mean(0), second - second.mean(0)
    z, w = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1]
    m = (np.conj(z) @ w) / (np.abs(z) ** 2).sum()
    centre = m * complex(*first.mean(0))
    return float(abs(m)), float(np.angle(m)), second.mean(0) - np.array([centre.real, centre.imag])


def aligned(first: np.ndarray, second: np.ndarray, inlier: float = 3.0, trials: int = 200, seed: int = 0) -> tuple[tuple[float, float, np.ndarray], np.ndarray]:
    """(transform, inliers): the pair of matches that most others agree with, fitted again on those."""
    n = len(first)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    if len(pairs) > trials:
        draw = np.random.default_rng(seed)
        pairs = [pairs[k] for k in draw.choice(len(pairs), trials, replace=False)]
    best: tuple = (-1, np.inf, None)
    for i, j in pairs:
        if np.allclose(first[i], first[j]):
            continue
        error = _errors(similarity(first[[i, j]], second[[i, j]]), first, second)
        inside = error <= inlier
        score = (int(inside.sum()), float((error[inside] ** 2).sum()))
        if score[0] > best[0] or score[0] == best[0] and score[1] < best[1]:
            best = (*score, inside)
    return similarity(first[best[2]], second[best[2]]), best[2]


def _errors(t: tuple[float, float, np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    scale, turn, shift = t
    r = scale * np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
    return np.sqrt(((first @ r.T + shift - second) ** 2).sum(1))


def cascade(pictures: np.ndarray, labels: np.ndarray, stages: int = 4, rules: int = 4, candidates: int = 200, keep: float = 1.0, seed: int = 0) -> list[tuple[list, float]]:
    """Boosted stages of two-rectangle rules on integral images; a stage's bound lets ``keep`` of the positives pass."""
    draw = np.random.default_rng(seed)
    h, w = pictures.shape[1:]
    sums = np.pad(pictures.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
    rects = []
    while len(rects) < candidates:
        r, c = int(draw.integers(0, h - 1)), int(draw.integers(0, w - 1))
        a, b = int(draw.integers(1, h - r + 1)), int(draw.integers(1, w - c + 1))
        if a % 2 == 0 or b % 2 == 0:
            rects.append((r, c, a, b, a % 2 == 0))
    values = np.stack([rectangle_rule(sums, *x) for x in rects], 1)
    alive, out = np.ones(len(labels), bool), []
    for _ in range(stages):
        y = labels[alive]
        if not (y == 0).any():
            break
        x, weight = values[alive], np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / (y == 0).sum())
        score, chosen = np.zeros(len(y)), []
        for _ in range(rules):
            weight = weight / weight.sum()
            best: tuple = (1.0,)
            for k in range(x.shape[1]):
                for t in np.quantile(x[:, k], np.linspace(0.05, 0.95, 10)):
                    e = float((weight * ((x[:, k] > t) != y)).sum())
                    for sign, error in ((1, e), (-1, 1 - e)):
                        if error < best[0]:
                            best = (error, k, float(t), sign)
            error, k, t, sign = best
            voice = 0.5 * np.log((1 - error + 1e-9) / (error + 1e-9))
            says = np.where(x[:, k] > t, 1, -1) * sign
            score += voice * says
            chosen.append((rects[k], t, sign, float(voice)))
            weight = weight * np.exp(-voice * says * np.where(y == 1, 1, -1))
        bound = float(np.quantile(score[y == 1], 1 - keep)) - 1e-9
        out.append((chosen, bound))
        alive[np.flatnonzero(alive)[score < bound]] = False
    return out


def rectangle_rule(sums: np.ndarray, r: int, c: int, a: int, b: int, halves_rows: bool) -> np.ndarray:
    area = lambda r0, c0, r1, c1: sums[:, r1, c1] - sums[:, r0, c1] - sums[:, r1, c0] + sums[:, r0, c0]
    if halves_rows:
        return area(r, c, r + a // 2, c + b) - area(r + a // 2, c, r + a, c + b)
    return area(r, c, r + a, c + b // 2) - area(r, c + b // 2, r + a, c + b)


def passes(stages: Sequence[tuple[list, float]], pictures: np.ndarray) -> np.ndarray:
    sums = np.pad(pictures.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
    alive = np.ones(len(pictures), bool)
    for chosen, bound in stages:
        score = sum(voice * sign * np.where(rectangle_rule(sums, *rect) > t, 1, -1) for rect, t, sign, voice in chosen)
        alive &= score >= bound
    return alive
