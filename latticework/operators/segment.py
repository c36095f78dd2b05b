"""From pixels to a mask: which background a sheet has, and which pixels are ink on it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .raster import border_consensus, clean, delta_e76, kmeans_two, luma, srgb_to_lab


@dataclass(frozen=True)
class SegParams:
    # Defaults of the segmentation.
    share: float = 0.85
    delta: float = 12.0
    alpha: int = 128
    passes: int = 1
    clear: float = 0.10


@dataclass(frozen=True)
class Background:
    kind: str  # alpha, border, kmeans or otsu
    rgba: tuple[int, int, int, int]
    consensus: float


def otsu_split(rgba: np.ndarray) -> tuple[int, bool, float]:
    """Threshold of the luma, whether the darker side is ink (the smaller one), and the ink's share."""
    level = np.clip(np.floor(luma(rgba[..., :3]) + 0.5), 0, 255).astype(np.int64).ravel()
    hist = np.bincount(level, minlength=256).astype(np.float64)
    below, mass = np.cumsum(hist), np.cumsum(hist * np.arange(256))
    above = below[-1] - below
    ok = (below > 0) & (above > 0)
    mean_gap = np.divide(mass, below, out=np.zeros(256), where=ok) - np.divide(mass[-1] - mass, above, out=np.zeros(256), where=ok)
    spread = np.where(ok, below * above * mean_gap**2, -1)
    cut = int(np.argmax(spread)) if ok.any() else 0
    dark = 2 * below[cut] <= below[-1]
    return cut, bool(dark), float((below[cut] if dark else above[cut]) / below[-1])


def detect(rgba: np.ndarray, p: SegParams = SegParams()) -> Background:
    """The first that tells: clear pixels, one colour along the border, two colours along it, or the luma alone."""
    clear = float((rgba[..., 3] == 0).mean())
    if clear >= p.clear:
        return Background("alpha", (0, 0, 0, 0), clear)
    if min(rgba.shape[:2]) >= 2:
        colour, share = border_consensus(rgba)
        if share >= p.share:
            return Background("border", (*colour, 255), share)
        ring = np.concatenate([np.stack([rgba[0], rgba[-1]], axis=1).reshape(-1, rgba.shape[2]), np.stack([rgba[1:-1, 0], rgba[1:-1, -1]], axis=1).reshape(-1, rgba.shape[2])])[:, :3]
        centres, side = kmeans_two(ring)
        own = int((side == 1).sum() > (side == 0).sum())
        return Background("kmeans", (*(int(c) for c in centres[own]), 255), float((side == own).mean()))
    return Background("otsu", (0, 0, 0, 0), 1 - otsu_split(rgba)[2])


def ink(rgba: np.ndarray, bg: Background, p: SegParams = SegParams()) -> np.ndarray:
    """Ink by alpha, by colour distance from the background, or by the luma's smaller side."""
    if bg.kind == "alpha":
        return rgba[..., 3] >= p.alpha
    if bg.kind == "otsu":
        cut, dark, _ = otsu_split(rgba)
        level = np.clip(np.floor(luma(rgba[..., :3]) + 0.5), 0, 255)
        return level <= cut if dark else level > cut
    far = delta_e76(srgb_to_lab(rgba[..., :3]), srgb_to_lab(np.array(bg.rgba[:3], dtype=np.uint8))) > p.delta
    return far & (rgba[..., 3] >= p.alpha)


def segment(rgba: np.ndarray, p: SegParams = SegParams()) -> tuple[np.ndarray, Background]:
    """The cleaned mask and the background it was made against."""
    bg = detect(rgba, p)
    return clean(ink(rgba, bg, p), p.passes), bg
