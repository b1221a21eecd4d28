"""Image operators on arrays: segmentation of a dark region, crop, evaluation transform, over Spark's image source."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Segmenter = Callable[[np.ndarray], np.ndarray]


def rgb(row) -> np.ndarray | None:
    """Pixels of a row of the image source (which are BGR); None if it couldn't be read."""
    if row["height"] is None or row["height"] < 0:
        return None
    flat = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    return np.repeat(flat, 3, axis=2) if flat.shape[2] == 1 else flat[:, :, 2::-1]


def lightness(image: np.ndarray) -> np.ndarray:
    """L of CIE LAB, scaled to 0..255."""
    c = image.astype(np.float64) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    y = c @ np.array([0.2126, 0.7152, 0.0722])
    level = np.where(y > 216 / 24389, 116 * np.cbrt(y) - 16, y * 24389 / 27)
    return np.round(level * 2.55).astype(np.uint8)


def blurred(plane: np.ndarray, size: int = 11) -> np.ndarray:
    """Gaussian blur, mirrored at the edges."""
    sigma, half = 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2
    k = np.exp(-((np.arange(size) - half) ** 2) / (2 * sigma**2))
    k /= k.sum()
    out = plane.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(out, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="reflect" if out.shape[axis] > half else "edge")
        out = sum(w * np.take(padded, range(i, i + out.shape[axis]), axis) for i, w in enumerate(k))
    return np.round(out).astype(np.uint8)


def otsu(plane: np.ndarray) -> int:
    """The threshold with the largest variance between both sides."""
    hist = np.bincount(plane.ravel(), minlength=256).astype(np.float64)
    below, total = hist.cumsum(), hist.sum()
    mass = (hist * np.arange(256)).cumsum()
    with np.errstate(all="ignore"):
        between = (mass[-1] * below / total - mass) ** 2 / (below * (total - below))
    return int(np.nan_to_num(between).argmax())


def disc(size: int) -> np.ndarray:
    y, x = np.mgrid[:size, :size] - size // 2
    return (x * x + y * y) <= (size / 2) ** 2


def dilated(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    half = shape.shape[0] // 2
    padded = np.pad(mask, half)
    out = np.zeros_like(mask)
    for dy, dx in zip(*np.nonzero(shape)):
        out |= padded[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
    return out


def closed(mask: np.ndarray, size: int = 15) -> np.ndarray:
    shape, pad = disc(size), size
    grown = dilated(np.pad(mask, pad), shape)
    return ~dilated(~grown, shape)[pad:-pad, pad:-pad]


def labelled(mask: np.ndarray, corners: bool = True) -> tuple[np.ndarray, int]:
    """Connected parts numbered from 1 in reading order; with ``corners`` diagonal neighbours touch."""
    out, n = np.zeros(mask.shape, np.int32), 0
    steps = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if corners else [])
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n += 1
        out[start], queue = n, deque([start])
        while queue:
            y, x = queue.popleft()
            for dy, dx in steps:
                p = (y + dy, x + dx)
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not out[p]:
                    out[p] = n
                    queue.append(p)
    return out, n


def filled(mask: np.ndarray) -> np.ndarray:
    """Holes that don't reach the border become part of the mask."""
    parts, n = labelled(~mask, corners=False)
    outside = set(np.r_[parts[0], parts[-1], parts[:, 0], parts[:, -1]].tolist()) - {0}
    return mask | ~(np.isin(parts, list(outside)) | mask) if n else mask


def largest_part(mask: np.ndarray) -> np.ndarray:
    """The largest connected part, the first of equals, without holes."""
    parts, n = labelled(mask)
    if not n:
        return mask
    return filled(parts == np.bincount(parts.ravel())[1:].argmax() + 1)


def colour_segment(image: np.ndarray, least_area: float = 0.01, closing: int = 15) -> np.ndarray:
    """Mask (0/1) of the dark region; the whole image if it covers less than ``least_area`` of it."""
    plane = blurred(lightness(image))
    mask = largest_part(filled(closed(plane <= otsu(plane), closing)))
    if mask.mean() < least_area:
        mask = np.ones(mask.shape, bool)
    return mask.astype(np.uint8)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    y = np.clip((np.arange(height) + 0.5) * image.shape[0] / height - 0.5, 0, image.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * image.shape[1] / width - 0.5, 0, image.shape[1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    source = image.astype(np.float64)
    top = source[y0][:, x0] * (1 - fx) + source[y0][:, x1] * fx
    low = source[y1][:, x0] * (1 - fx) + source[y1][:, x1] * fx
    return np.round(top * (1 - fy) + low * fy).astype(np.uint8)


def cubic_weights(n: int, out: int) -> np.ndarray:
    """Matrix of a cubic resize of one axis (kernel parameter -0.75, edges repeated)."""
    at = (np.arange(out) + 0.5) * n / out - 0.5
    base, weights = np.floor(at).astype(int), np.zeros((out, n))
    for k in range(-1, 3):
        d = np.abs(at - (base + k))
        near = 1.25 * d**3 - 2.25 * d**2 + 1
        far = -0.75 * (d**3 - 5 * d**2 + 8 * d - 4)
        np.add.at(weights, (np.arange(out), np.clip(base + k, 0, n - 1)), np.where(d <= 1, near, np.where(d < 2, far, 0)))
    return weights


def resized_cubic(image: np.ndarray, height: int, width: int) -> np.ndarray:
    rows, columns = cubic_weights(image.shape[0], height), cubic_weights(image.shape[1], width)
    out = np.einsum("hy,yxc,wx->hwc", rows, image.astype(np.float64), columns, optimize=True)
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def crop(image: np.ndarray, mask: np.ndarray, margin: float = 0.1, side: int = 224) -> np.ndarray:
    """The mask's bounding box (its last row and column too) and a margin, black outside the mask, resized."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return resized_cubic(image, side, side)
    top, bottom, left, right = ys.min(), ys.max(), xs.min(), xs.max()
    py, px = int((bottom - top) * margin), int((right - left) * margin)
    box = (slice(max(0, top - py), min(image.shape[0], bottom + py + 1)), slice(max(0, left - px), min(image.shape[1], right + px + 1)))
    return resized_cubic(np.where(mask[..., None] > 0, image, 0)[box], side, side)


def evaluation_input(image: np.ndarray, mean: tuple, std: tuple, resize: int = 256, side: int = 224) -> np.ndarray:
    """Shorter side to ``resize``, centre crop, scaled to 0..1 and normalised: (3, side, side)."""
    h, w = image.shape[:2]
    scale = resize / min(h, w)
    big = resized(image, max(side, round(h * scale)), max(side, round(w * scale)))
    y, x = (big.shape[0] - side) // 2, (big.shape[1] - side) // 2
    cut = big[y : y + side, x : x + side].astype(np.float32) / 255
    return ((cut - np.array(mean, np.float32)) / np.array(std, np.float32)).transpose(2, 0, 1)


def segment_images(images: DataFrame, segment: Segmenter = colour_segment, margin: float = 0.1, side: int = 224) -> DataFrame:
    """Crop every image of ``images(origin, height, width, nChannels, data)``.

    Returns origin, data (RGB bytes of the crop, ``side`` squared), area (share
    of the mask), fallback (the mask is the whole image) and readable.
    Unreadable images become black and are flagged.  Leave images that are done out first, by an anti join.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                image = rgb(row)
                if image is None:
                    rows.append((row["origin"], bytes(side * side * 3), 0.0, False, False))
                    continue
                mask = segment(image)
                rows.append((row["origin"], crop(image, mask, margin, side).tobytes(), float(mask.mean()), bool(mask.all()), True))
            yield pd.DataFrame(rows, columns=["origin", "data", "area", "fallback", "readable"])

    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "origin string, data binary, area double, fallback boolean, readable boolean")


def overlaid(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The image with its mask shown in green, at four tenths."""
    return np.where(mask[..., None] > 0, image * 0.6 + np.array([0, 102, 0]), image).astype(np.uint8)


def montage(images: DataFrame, segment: Segmenter = colour_segment, margin: float = 0.1, side: int = 224) -> DataFrame:
    """What an inspector looks at: the image, its mask and its crop side by side.

    Takes ``images(origin, height, width, nChannels, data)``, some rows that a
    sampling operator chose, and returns origin, height, width and data (RGB
    bytes of the three panels, ``side`` high and 3 * ``side`` wide). Unreadable images are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                image = rgb(row)
                if image is not None:
                    mask = segment(image)
                    panels = [resized(image, side, side), resized(overlaid(image, mask), side, side), crop(image, mask, margin, side)]
                    rows.append((row["origin"], side, 3 * side, np.concatenate(panels, axis=1).tobytes()))
            yield pd.DataFrame(rows, columns=["origin", "height", "width", "data"])

    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "origin string, height int, width int, data binary")
