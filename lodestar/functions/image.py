"""Dense image steps in numpy, for use inside Arrow UDFs. An image is a 2-D float32 array of 0..1."""

from __future__ import annotations

import math

import numpy as np

#: Alignment windows, detection width, output size, and limits of a plausible quadrilateral.
ORIGINS, EXTENT = (0.0, 0.06, 0.12), 0.88
DETECT_WIDTH, RECT_W, RECT_H = 160, 439, 380
MIN_AREA, MAX_AREA, MIN_SIDE, ASPECT_LOW, ASPECT_HIGH, MIN_FILL = 0.05, 0.97, 0.22, 0.85, 1.7, 0.6
_COS = np.cos(np.outer(2 * np.arange(32) + 1, np.arange(8)) * math.pi / 64)


def gray(width: int, height: int, data: bytes, channels: int = 4, bgr: bool = False) -> np.ndarray:
    """Luma of interleaved bytes; alpha is ignored and missing bytes count 0."""
    need = width * height * channels
    raw = np.frombuffer(bytes(data[:need]).ljust(need, b"\0"), np.uint8).reshape(height, width, channels).astype(np.float64)
    if channels == 1:
        return (raw[:, :, 0] / 255).astype(np.float32)
    red, blue = (2, 0) if bgr else (0, 2)
    return ((0.299 * raw[:, :, red] + 0.587 * raw[:, :, 1] + 0.114 * raw[:, :, blue]) / 255).astype(np.float32)


def resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean over boxes with whole-pixel edges; a box has one pixel at least, so boxes overlap when growing."""
    h, w = img.shape
    y0, x0 = np.arange(height) * h // height, np.arange(width) * w // width
    y1 = np.maximum(y0 + 1, (np.arange(height) + 1) * h // height)
    x1 = np.maximum(x0 + 1, (np.arange(width) + 1) * w // width)
    sums = np.zeros((h + 1, w + 1))
    sums[1:, 1:] = img.astype(np.float64).cumsum(0).cumsum(1)
    box = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    return (box / np.outer(y1 - y0, x1 - x0)).astype(np.float32)


def crop(img: np.ndarray, x: float, y: float, w: float, h: float) -> np.ndarray:
    """A part given in shares of the sides, edges to the nearest pixel, ties to even; outside the image is an error."""
    rows, cols = img.shape
    left, top, wide, high = (int(np.rint(v)) for v in (cols * x, rows * y, cols * w, rows * h))
    if left < 0 or top < 0 or wide <= 0 or high <= 0 or left + wide > cols or top + high > rows:
        raise ValueError("the crop lies outside the image")
    return img[top : top + high, left : left + wide]


def inset(img: np.ndarray, share: float) -> np.ndarray:
    """Cut the share off all sides; none for 0 or less, an error from 0.4 on."""
    if share <= 0:
        return img
    if share >= 0.4:
        raise ValueError("the inset is too large")
    return crop(img, share, share, 1 - 2 * share, 1 - 2 * share)


def windows(img: np.ndarray) -> list[np.ndarray]:
    """The whole image and nine shifted parts of it."""
    return [img, *(crop(img, x, y, EXTENT, EXTENT) for x in ORIGINS for y in ORIGINS)]


def _signed(bits: np.ndarray) -> int:
    value = sum(1 << int(i) for i in np.flatnonzero(bits))
    return value - (1 << 64) if value >> 63 else value


def phash(img: np.ndarray) -> int:
    """Signs of the low cosine coefficients against the mean of the two below their middle; the first bit is 0."""
    low = (_COS.T @ resize(img, 32, 32).astype(np.float64) @ _COS).ravel()
    ordered = np.sort(low[1:])
    bits = low > (ordered[30] + ordered[31]) / 2
    bits[0] = False
    return _signed(bits)


def dhash(img: np.ndarray) -> int:
    """Whether each pixel of a 9 x 8 image is darker than its right neighbour."""
    small = resize(img, 9, 8)
    return _signed((small[:, :-1] < small[:, 1:]).ravel())


def levels(small: np.ndarray) -> bytes:
    return np.clip(np.rint(small.astype(np.float64) * 255), 0, 255).astype(np.uint8).tobytes()


def bandpass(small: np.ndarray) -> bytes:
    """Difference to the mean of the nine neighbours, edges repeated, as bytes around 128."""
    p = np.pad(small.astype(np.float64), 1, mode="edge")
    n, m = small.shape
    mean = sum(p[i : i + n, j : j + m] for i in range(3) for j in range(3)) / 9
    return np.clip(np.rint((small - mean) * 400) + 128, 0, 255).astype(np.uint8).tobytes()


def features(img: np.ndarray) -> tuple[int, int, bytes, bytes]:
    small = resize(img, 16, 16)
    return phash(img), dhash(img), levels(small), bandpass(small)


def otsu(values: np.ndarray, low: float = 0.3, high: float = 0.8) -> float:
    hist = np.bincount(np.clip(np.floor(values.ravel().astype(float) * 64), 0, 63).astype(int), minlength=64).astype(float)
    below, weighted = hist.cumsum(), (hist * np.arange(64)).cumsum()
    above = below[-1] - below
    ok = (below > 0) & (above > 0)
    if not ok.any():
        return min(high, max(low, 33 / 64))
    gap = np.where(ok, weighted / np.maximum(below, 1) - (weighted[-1] - weighted) / np.maximum(above, 1), 0)
    score = np.where(ok, below * above * gap**2, -1.0)
    return min(high, max(low, (int(score.argmax()) + 1) / 64))


def components(mask: np.ndarray) -> list[np.ndarray]:
    """4-connected components as (y, x) pixel arrays, in the order of their first pixel; labels spread along rows and columns."""
    h, w = mask.shape
    runs, parent = [], []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[tuple[int, int, int]] = []
    for y in range(h):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        row = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            k = len(parent)
            parent.append(k)
            runs.append((y, a, b))
            row.append((a, b, k))
            for c, d, j in above:
                if c < b and a < d:
                    i, j = find(k), find(j)
                    parent[max(i, j)] = min(i, j)
        above = row
    groups: dict[int, list] = {}
    for k, (y, a, b) in enumerate(runs):
        groups.setdefault(find(k), []).append(np.stack([np.full(b - a, y), np.arange(a, b)], 1))
    return [np.concatenate(g) for _, g in sorted(groups.items())]


def detect_quad(img: np.ndarray) -> np.ndarray | None:
    """Corners (x, y), clockwise from the top left, of the first plausible bright quadrilateral; None if there is none."""
    h, w = img.shape
    dw, dh = DETECT_WIDTH, max(16, math.floor(h * DETECT_WIDTH / w + 0.5))
    small = resize(img, dw, dh)
    parts = sorted(components(small > np.float64(otsu(small))), key=len, reverse=True)[:3]
    for part in parts:
        if not MIN_AREA <= len(part) / (dw * dh) <= MAX_AREA:
            continue
        y, x = part[:, 0], part[:, 1]
        at = [int(i) for i in ((x + y).argmin(), (x - y).argmax(), (x + y).argmax(), (x - y).argmin())]
        q = part[at][:, ::-1].astype(float)
        top, right, bottom, left = (float(np.hypot(*(q[i] - q[j]))) for i, j in ((1, 0), (2, 1), (2, 3), (3, 0)))
        if min(top, bottom) < dw * MIN_SIDE or min(left, right) < dh * MIN_SIDE:
            continue
        wide, high = (top + bottom) / 2, (left + right) / 2
        if not ASPECT_LOW <= wide / high <= ASPECT_HIGH or len(part) / (wide * high) < MIN_FILL:
            continue
        return (q + 0.5) * np.array([w / dw, h / dh])
    return None


def homography(quad: np.ndarray, width: float, height: float) -> np.ndarray:
    """The eight coefficients that map the output rectangle onto the quadrilateral; degenerate ones are an error."""
    corners = np.array([[0, 0], [width, 0], [width, height], [0, height]], float)
    rows, right = [], []
    for (x, y), (u, v) in zip(corners, quad, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    system = np.array(rows)
    if np.linalg.matrix_rank(system) < 8:
        raise ValueError("the quadrilateral is degenerate")
    return np.linalg.solve(system, np.array(right, float))


def rectify(img: np.ndarray, quad: np.ndarray, width: int = RECT_W, height: int = RECT_H) -> np.ndarray:
    """The quadrilateral seen from the front, bilinear, clamped at the image's edges."""
    a, b, c, d, e, f, g, k = homography(quad, width, height)
    h, w = img.shape
    y, x = np.mgrid[0:height, 0:width].astype(float)
    scale = g * x + k * y + 1
    sx = np.clip((a * x + b * y + c) / scale, 0, w - 1.001)
    sy = np.clip((d * x + e * y + f) / scale, 0, h - 1.001)
    ix, iy = np.floor(sx).astype(int), np.floor(sy).astype(int)
    tx, ty = sx - ix, sy - iy
    top = img[iy, ix] * (1 - tx) + img[iy, ix + 1] * tx
    low = img[iy + 1, ix] * (1 - tx) + img[iy + 1, ix + 1] * tx
    return (top * (1 - ty) + low * ty).astype(np.float32)


def try_rectify(img: np.ndarray) -> np.ndarray | None:
    quad = detect_quad(img)
    try:
        return None if quad is None else rectify(img, quad)
    except (ValueError, np.linalg.LinAlgError):
        return None


def blur_rows(img: np.ndarray, radius: int) -> np.ndarray:
    """Mean of 2 * radius + 1 neighbours in the row, edges repeated."""
    p = np.pad(img.astype(np.float64), ((0, 0), (radius, radius)), mode="edge")
    return (sum(p[:, i : i + img.shape[1]] for i in range(2 * radius + 1)) / (2 * radius + 1)).astype(np.float32)


def box_mean(img: np.ndarray, radius: int) -> np.ndarray:
    """Mean over the square around each pixel as far as it lies in the image."""
    h, w = img.shape
    sums = np.zeros((h + 1, w + 1))
    sums[1:, 1:] = img.astype(np.float64).cumsum(0).cumsum(1)
    y0, y1 = np.maximum(np.arange(h) - radius, 0), np.minimum(np.arange(h) + radius + 1, h)
    x0, x1 = np.maximum(np.arange(w) - radius, 0), np.minimum(np.arange(w) + radius + 1, w)
    box = sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]
    return (box / np.outer(y1 - y0, x1 - x0)).astype(np.float32)


def ink_mask(img: np.ndarray) -> np.ndarray:
    """Pixels of the strip at the top left that are brighter than what is around them, where that is dark."""
    h, w = img.shape
    strip = blur_rows(img, 2)[: max(8, math.floor(0.2 * h)), : max(8, math.floor(0.7 * w))]
    local = box_mean(strip, max(4, len(strip) // 3))
    ordered = np.sort(strip.ravel())
    bright = float(ordered[min(len(ordered) - 1, math.floor(len(ordered) * 0.8))])
    return (strip.astype(float) - local > 0.08) & (local < bright - 0.06)


def zone_band(img: np.ndarray) -> np.ndarray | None:
    """The line of text at the top left as a black-on-white image, three times as large with a margin; None if there is none."""
    ink = ink_mask(img)
    sh, sw = ink.shape
    if not 0.005 <= ink.mean() <= 0.35:
        return None
    kept = []
    for part in components(ink):
        (y0, x0), (y1, x1) = part.min(0), part.max(0)
        high, wide = y1 - y0 + 1, x1 - x0 + 1
        if len(part) >= 12 and 0.08 * sh <= high <= 0.6 * sh and wide <= 3 * high and wide <= 0.2 * sw:
            kept.append((part, (y0 + y1) / 2, high))
    if len(kept) < 3:
        return None
    mid_y, mid_h = sorted(c for _, c, _ in kept)[len(kept) // 2], sorted(g for _, _, g in kept)[len(kept) // 2]
    line = [part for part, c, _ in kept if abs(c - mid_y) < mid_h]
    if len(line) < 3:
        return None
    every = np.concatenate(line)
    (y0, x0), (y1, x1) = np.maximum(every.min(0) - 4, 0), np.minimum(every.max(0) + 4, [sh - 1, sw - 1])
    if y1 - y0 + 1 < 10 or x1 - x0 + 1 < 0.1 * sw:
        return None
    page = np.full((y1 - y0 + 1, x1 - x0 + 1), 255, np.uint8)
    page[every[:, 0] - y0, every[:, 1] - x0] = 0
    return np.pad(page.repeat(3, 0).repeat(3, 1), 12, constant_values=255)


def average(frames: list[np.ndarray]) -> np.ndarray | None:
    """Mean of three or more frames of one size, summed in single precision."""
    if len(frames) < 3:
        return None
    total = np.zeros_like(frames[0], dtype=np.float32)
    for f in frames:
        total += f.astype(np.float32)
    return total / np.float32(len(frames))


def preview(img: np.ndarray) -> bytes:
    """RGBA bytes of a gray image."""
    v = np.floor(np.clip(img.astype(float), 0, 1) * 255 + 0.5).astype(np.uint8)
    return np.dstack([v, v, v, np.full_like(v, 255)]).tobytes()
