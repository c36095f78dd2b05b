"""Flat colours of a crop: seeded k-means, the knee of its cost, and paint layers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .raster import opened

# The seed, multiplier and increment of the 64-bit generator, and the defaults of the quantiser.
SEED, MULTIPLIER, INCREMENT = 0x9E3779B97F4A7C15, 6364136223846793005, 1442695040888963407
K_MOST, SAMPLES, ROUNDS, LEAST, ALPHA = 12, 2048, 10, 4, 128


def draws() -> Iterator[int]:
    """64-bit numbers; one below n is the high half of its product with n."""
    state = SEED
    while True:
        state = (state * MULTIPLIER + INCREMENT) % (1 << 64)
        yield state


def squared(samples: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((samples[:, None, :].astype(np.int64) - centres[None].astype(np.int64)) ** 2).sum(axis=2)


def seeds(samples: np.ndarray, k: int, source: Iterator[int]) -> np.ndarray:
    """k samples: the first at random, each next with odds of its squared distance from those before."""
    below = lambda n: next(source) * n >> 64
    chosen = [below(len(samples))]
    near = np.full(len(samples), np.iinfo(np.int64).max)
    while len(chosen) < k:
        near = np.minimum(near, squared(samples, samples[chosen[-1:]])[:, 0])
        upto = np.cumsum(near)
        chosen.append(int(np.searchsorted(upto, below(int(upto[-1])), side="right")) if upto[-1] else below(len(samples)))
    return samples[chosen].astype(np.int64)


def kmeans(samples: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Integer centres and each sample's (ties: the first), after at most `rounds` moves."""
    centres = seeds(samples, max(k, 1), draws())
    for _ in range(rounds):
        own = np.argmin(squared(samples, centres), axis=1)
        count = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, weights=samples[:, c], minlength=len(centres)) for c in range(samples.shape[1])], axis=1).astype(np.int64)
        moved = np.where(count[:, None] > 0, sums // np.maximum(count, 1)[:, None], centres)
        if (moved == centres).all():
            break
        centres = moved
    return centres, np.argmin(squared(samples, centres), axis=1)


def inertia(samples: np.ndarray, centres: np.ndarray, own: np.ndarray) -> float:
    return float(((samples.astype(np.int64) - centres[own]) ** 2).sum())


def knee(costs: list[float]) -> int:
    """The k (from 1) after which the cost falls least more; the largest where there are fewer than three."""
    if len(costs) < 3:
        return len(costs)
    bend = -np.diff(-np.diff(np.asarray(costs, dtype=np.float64)))
    return int(np.argmax(bend)) + 2 if bend.max() > 0 else 2


def layers(rgba: np.ndarray, k_most: int = K_MOST) -> list[dict]:
    """rgba (mean), area and mask of each paint layer, largest first (ties: by colour); small ones and specks are left out."""
    solid = rgba[..., 3] >= ALPHA
    colours = rgba[solid][:, :3]
    if not len(colours):
        return []
    samples = colours[:: max(1, len(colours) // SAMPLES)]
    most = min(max(1, min(k_most, 32)), len(samples))
    k = knee([inertia(samples, *kmeans(samples, n)) for n in range(1, most + 1)])
    own = np.argmin(squared(colours, kmeans(samples, k)[0]), axis=1)
    out = []
    for n in range(k):
        if not (own == n).any():
            continue
        mask = np.zeros(solid.shape, dtype=bool)
        mask[solid] = own == n
        paint = tuple(int(v) for v in rgba[mask].astype(np.int64).sum(axis=0) // mask.sum())
        mask = opened(mask)
        if mask.sum() >= max(LEAST, 1):
            out.append({"rgba": paint, "area": int(mask.sum()), "mask": mask})
    return sorted(out, key=lambda x: (-x["area"], x["rgba"]))


def composed(found: list[dict], shape: tuple[int, int]) -> np.ndarray:
    """Layers painted in order: of those that cover a pixel the last shows."""
    out = np.zeros((*shape, 4), dtype=np.uint8)
    for layer in found:
        out[layer["mask"]] = layer["rgba"]
    return out
