"""Page images: diagnostics, variants and line boxes, with NumPy alone, one row per image in and out.

Pages are straightened before anything else, so all variants share one frame;
the matrix that leads into it goes along, and boxes found in it are led back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators import recognition

VARIANTS = ("original", "normalisiert", "kontrast", "binarisiert")


def gray_of(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Grey values of the bytes that Spark's image source gives (blue, green, red)."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    return a[:, :, 0] if channels == 1 else a[:, :, 0] * 0.114 + a[:, :, 1] * 0.587 + a[:, :, 2] * 0.299


def box_mean(a: np.ndarray, radius: int) -> np.ndarray:
    """Mean over a square window, edges repeated, by integral images."""
    n = 2 * radius + 1
    p = np.pad(a, radius, mode="edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / n**2


# ------------------------------------------------------------ edges and skew

#: Gradients of weak and strong edges; least votes of a line; degrees within which a page may lean.
WEAK, STRONG, VOTES, LEAN = 50, 150, 80, 8.0
#: Tenths of a degree.
STEP = 0.1


def edges(gray: np.ndarray) -> np.ndarray:
    """Edge pixels: ridges of the gradient, strong ones and the weak ones connected with them."""
    p = np.pad(gray.astype(np.int32), 1, mode="edge")
    down, across = p[2:] - p[:-2], p[:, 2:] - p[:, :-2]
    dx = across[:-2] + 2 * across[1:-1] + across[2:]
    dy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    steep = np.abs(dx) + np.abs(dy)
    m = np.pad(steep, 1)
    at = lambda y, x: m[1 + y : m.shape[0] - 1 + y, 1 + x : m.shape[1] - 1 + x]
    flat, upright = np.abs(dy) < np.tan(np.pi / 8) * np.abs(dx), np.abs(dy) > np.tan(3 * np.pi / 8) * np.abs(dx)
    same = (dx < 0) == (dy < 0)
    ridge = np.where(
        flat, (steep > at(0, -1)) & (steep >= at(0, 1)),
        np.where(upright, (steep > at(-1, 0)) & (steep >= at(1, 0)), np.where(same, (steep > at(-1, -1)) & (steep > at(1, 1)), (steep > at(-1, 1)) & (steep > at(1, -1)))),
    )
    weak = ridge & (steep > WEAK)
    part = components(weak)
    held = np.zeros(part.max(initial=0) + 1, bool)
    held[part[weak & (steep > STRONG)]] = True
    held[0] = False
    return held[part]


def components(mask: np.ndarray) -> np.ndarray:
    """A number from 1 for each set of true pixels that touch, also by a corner; 0 elsewhere.

    Every pixel takes the smallest number among its neighbours', then that number's own, until nothing changes.
    """
    number = np.zeros(mask.shape, np.int64)
    n = int(mask.sum())
    number[mask] = np.arange(1, n + 1)
    pairs = []
    for y, x in ((0, 1), (1, 0), (1, 1), (1, -1)):
        here = number[: number.shape[0] - y, max(0, -x) : number.shape[1] - max(0, x)]
        there = number[y:, max(0, x) : number.shape[1] + min(0, x)]
        both = (here > 0) & (there > 0)
        pairs.append(np.stack((here[both], there[both])))
    a, b = np.concatenate(pairs, axis=1)
    label = np.arange(n + 1)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, shorter := label[label]):
            label = shorter
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label[number]


def skew(gray: np.ndarray) -> float:
    """Degrees by which text lines descend to the right, in tenths, within ``LEAN``; 0 where no line is long enough.

    Each edge pixel votes for the lines through it, a tenth of a degree and a pixel
    apart. The angle is that at which votes gather in the fewest lines (the sum of
    their squares), or the middle of those as good within a hundredth.
    """
    y, x = np.nonzero(edges(gray))
    if not len(x):
        return 0.0
    y, x = y - gray.shape[0] / 2, x - gray.shape[1] / 2
    angles, gathered, most = np.round(np.arange(-LEAN, LEAN + STEP / 2, STEP), 1), [], 0
    for a in angles:
        votes = np.bincount(np.rint(y * np.cos(np.radians(a)) - x * np.sin(np.radians(a))).astype(np.int64) + sum(gray.shape))
        gathered.append(float((votes.astype(float) ** 2).sum()))
        most = max(most, int(votes.max()))
    if most <= max(VOTES, gray.shape[1] // 8):
        return 0.0
    best = int(np.argmax(gathered))
    near = [k for k in range(len(angles)) if abs(k - best) <= 3 and gathered[k] >= 0.99 * gathered[best]]
    return float(np.median(angles[near]))


def diagnostics(gray: np.ndarray) -> dict[str, float]:
    p = np.pad(gray, 1, mode="reflect")
    edges = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * gray
    return {
        "brightness": float(gray.mean() / 255), "contrast": float(gray.std() / 128), "sharpness": float(min(edges.var() / 1000, 1.0)), "skew_degrees": skew(gray),
        "clipped_dark": float((gray <= 3).mean()), "clipped_light": float((gray >= 252).mean()),
    }


def rotation(shape: tuple[int, ...], angle: float) -> np.ndarray:
    """The 3 x 3 matrix that leads a page's points (x, y, 1) into the straightened page; angles under 0.2 or over 8 degrees are left."""
    if not 0.2 <= abs(angle) <= LEAN:
        return np.eye(3)
    c, s, x, y = np.cos(np.radians(angle)), np.sin(np.radians(angle)), shape[1] / 2, shape[0] / 2
    return np.array([[c, s, (1 - c) * x - s * y], [-s, c, s * x + (1 - c) * y], [0, 0, 1]])


#: Rows of a page that are turned at once.
BAND = 256


def _cubic(part: np.ndarray) -> list[np.ndarray]:
    """Weights of the four pixels around a place, ``part`` of the way from the second to the third."""
    a = -0.75
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return [far(1 + part), near(part), near(1 - part), far(2 - part)]


def turned(gray: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A page led through a matrix, by cubic interpolation, onto white."""
    if np.array_equal(matrix, np.eye(3)):
        return gray
    h, w = gray.shape
    back, framed, out = np.linalg.inv(matrix), np.pad(gray, 2, constant_values=255.0), np.empty((h, w))
    for top in range(0, h, BAND):
        y, x = np.mgrid[top : min(h, top + BAND), :w].astype(float)
        u, v = (back[k, 0] * x + back[k, 1] * y + back[k, 2] for k in (0, 1))
        left, above = np.floor(u).astype(np.int64), np.floor(v).astype(np.int64)
        across, down = _cubic(u - left), _cubic(v - above)
        total = np.zeros(x.shape)
        for i in range(4):
            row = np.clip(above + i + 1, 0, h + 3)
            total += down[i] * sum(across[k] * framed[row, np.clip(left + k + 1, 0, w + 3)] for k in range(4))
        out[top : top + BAND] = total
    return np.clip(out, 0, 255)


def deskewed(gray: np.ndarray, angle: float) -> np.ndarray:
    """A page whose lines descend by ``angle`` degrees, straightened about its centre."""
    return turned(gray, rotation(gray.shape, angle))


def box_back(box: Column, matrix: Column) -> Column:
    """A box (x1, y1, x2, y2) of a straightened page on the page as it was: the whole pixels around its four corners."""
    m = lambda k: F.get(matrix, F.lit(k))
    x = lambda u, v: m(0) * (box[u] - m(2)) + m(3) * (box[v] - m(5))
    y = lambda u, v: m(1) * (box[u] - m(2)) + m(4) * (box[v] - m(5))
    corners = [("x1", "y1"), ("x2", "y1"), ("x1", "y2"), ("x2", "y2")]
    ends = {f"{name}{k}": F.round(f(*(g(*c) for c in corners))).cast("int") for name, g in (("x", x), ("y", y)) for k, f in ((1, F.least), (2, F.greatest))}
    turned_ = F.struct(*(F.greatest(F.lit(0), ends[n]).alias(n) for n in ("x1", "y1", "x2", "y2")))
    return F.when((m(1) == 0) | m(1).isNull(), F.struct(*(box[n].cast("int").alias(n) for n in ("x1", "y1", "x2", "y2")))).otherwise(turned_)


# ------------------------------------------------------------ variants


def median(gray: np.ndarray, size: int) -> np.ndarray:
    """Median over a square window of odd ``size``, edges repeated, of whole grey values.

    For large windows of pages that are thinned to a sixteenth of the window, and drawn out again.
    """
    thin = max(1, size // 16)
    a = np.rint(gray[::thin, ::thin]).astype(np.int64)
    radius = size // thin // 2
    half = ((2 * radius + 1) ** 2 + 1) // 2
    out = np.zeros(a.shape)
    for level in np.unique(a)[:-1]:
        out[np.rint(box_mean((a <= level).astype(float), radius) * (2 * radius + 1) ** 2) < half] = level + 1
    values = np.unique(a)
    out = values[np.minimum(np.searchsorted(values, out), len(values) - 1)].astype(float)
    if thin == 1:
        return out
    row, column = (np.minimum(np.arange(n) / thin, m - 1) for n, m in zip(gray.shape, a.shape, strict=True))
    tall = np.array([np.interp(row, np.arange(a.shape[0]), out[:, k]) for k in range(a.shape[1])]).T
    return np.array([np.interp(column, np.arange(a.shape[1]), r) for r in tall])


def lit(gray: np.ndarray) -> np.ndarray:
    """A page divided by its background and stretched over all grey values."""
    smallest = min(gray.shape)
    size = min(max(3, smallest // 20 | 1), smallest if smallest % 2 else smallest - 1)
    flat = np.clip(gray / np.maximum(median(gray, max(size, 1)), 1) * 240, 0, 255)
    low, high = flat.min(), flat.max()
    return np.rint((flat - low) * (255 / (high - low))) if high > low else np.zeros_like(flat)


def denoised(gray: np.ndarray, h: float = 4.0, patch: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: each pixel the mean of those around, by how alike the patches about them are.

    Differences of all patches one offset apart come from one integral image; opposite offsets share it.
    """
    r, s = patch // 2, search // 2
    rows, columns = gray.shape
    framed = np.pad(gray.astype(np.float64), r + s, mode="reflect" if min(gray.shape) > r + s else "symmetric")
    out = np.empty(gray.shape)
    for top in range(0, rows, BAND):
        high = min(BAND, rows - top)
        total, weight = np.zeros((high, columns)), np.zeros((high, columns))
        centre = framed[top + s : top + s + high + 2 * r, s : s + columns + 2 * r]
        for y in range(-s, s + 1):
            for x in range(-s, s + 1):
                moved = framed[top + s + y : top + s + y + high + 2 * r, s + x : s + x + columns + 2 * r]
                sums = np.zeros((high + 2 * r + 1, columns + 2 * r + 1))
                np.square(centre - moved).cumsum(0).cumsum(1, out=sums[1:, 1:])
                apart = sums[patch:, patch:] - sums[:-patch, patch:] - sums[patch:, :-patch] + sums[:-patch, :-patch]
                w = np.exp(-np.maximum(apart, 0) / (patch**2 * h**2))
                weight += w
                total += w * moved[r : r + high, r : r + columns]
        out[top : top + high] = np.rint(total / weight)
    return out


def equalized(gray: np.ndarray, limit: float = 1.8, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation: histograms of tiles, cut off and the rest spread, mixed between the tiles' centres."""
    h, w = gray.shape
    high, wide = -(-h // tiles), -(-w // tiles)
    a = np.pad(np.rint(gray).astype(np.int64), ((0, high * tiles - h), (0, wide * tiles - w)), mode="reflect" if min(h, w) > tiles else "symmetric")
    area, most = high * wide, max(int(limit * high * wide / 256), 1)
    tile = (np.arange(high * tiles)[:, None] // high * tiles + np.arange(wide * tiles) // wide) * 256
    counts = np.bincount((tile + a).reshape(-1), minlength=tiles * tiles * 256).reshape(-1, 256)
    over = np.maximum(counts - most, 0).sum(1)
    counts = np.minimum(counts, most) + (over // 256)[:, None]
    for k, rest in enumerate((over % 256).tolist()):
        if rest:
            counts[k, np.arange(0, 256, max(256 // rest, 1))[:rest]] += 1
    curve = np.clip(np.rint(counts.cumsum(1) * 255 / area), 0, 255).reshape(tiles, tiles, 256)
    y, x = np.arange(h) / high - 0.5, np.arange(w) / wide - 0.5
    top, left = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
    down, across = (y - top)[:, None], (x - left)[None]
    at = lambda j, i: curve[np.clip(j, 0, tiles - 1)[:, None], np.clip(i, 0, tiles - 1)[None], a[:h, :w]]
    upper = at(top, left) * (1 - across) + at(top, left + 1) * across
    lower = at(top + 1, left) * (1 - across) + at(top + 1, left + 1) * across
    return np.rint(upper * (1 - down) + lower * down)


def blurred(gray: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, edges mirrored."""
    radius = max(1, int(np.rint(3 * sigma)))
    line = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    line /= line.sum()
    p = np.pad(gray, radius, mode="reflect" if min(gray.shape) > radius else "symmetric")
    rows = sum(v * p[k : k + gray.shape[0]] for k, v in enumerate(line))
    return sum(v * rows[:, k : k + gray.shape[1]] for k, v in enumerate(line))


def binary(flat: np.ndarray, k: float = 0.18) -> np.ndarray:
    """Black where darker than a share of the neighbourhood's mean, the smaller the less it varies."""
    radius = max(25, min(flat.shape) // 40 | 1) // 2
    mean = box_mean(flat, radius)
    deviation = np.sqrt(np.maximum(box_mean(flat**2, radius) - mean**2, 0))
    return np.where(flat > mean * (1 + k * (deviation / 128 - 1)), 255.0, 0.0)


def straight_variants(gray: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The four variants of the straightened page by name, and the matrix that leads into it: as it is, its light made
    even, denoised with local contrast, binarised."""
    matrix = rotation(gray.shape, skew(gray))
    straight = turned(gray, matrix)
    flat = lit(straight)
    strong = equalized(denoised(flat))
    sharp = np.clip(np.rint(1.12 * strong - 0.12 * blurred(strong, 0.7)), 0, 255)
    return dict(zip(VARIANTS, (straight, flat, sharp, binary(flat)), strict=True)), matrix


def variants(gray: np.ndarray) -> dict[str, np.ndarray]:
    return straight_variants(gray)[0]


def threshold(gray: np.ndarray) -> float:
    """Otsu's threshold."""
    count = np.bincount(gray.astype(np.uint8).reshape(-1), minlength=256).astype(float)
    below, total = count.cumsum(), (count * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (total[-1] * below / below[-1] - total) ** 2 / (below * (below[-1] - below))
    return float(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def line_boxes(gray: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes of text lines from top to bottom: ink joined sideways, connected, sized, and given a margin."""
    ink = gray <= threshold(gray)
    h, w = ink.shape
    gap = max(15, w // 60)
    joined = box_mean(ink.astype(float), 1) > 0
    for row in joined:  # close gaps along each row
        at = np.flatnonzero(row)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if 1 < b - a <= gap:
                row[a:b] = True
    boxes: dict[int, list[int]] = {}
    parent: list[int] = [0]

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    above: list[tuple[int, int, int]] = []
    for y in range(h):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], joined[y].astype(np.int8), [0]))))
        runs = []
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            met = {root(k) for c, d, k in above if c < b and a < d}
            k = min(met) if met else len(parent)
            if not met:
                parent.append(k)
                boxes[k] = [a, y, b, y + 1]
            for other in met - {k}:
                parent[other] = k
                o = boxes.pop(other)
                boxes[k] = [min(boxes[k][0], o[0]), min(boxes[k][1], o[1]), max(boxes[k][2], o[2]), max(boxes[k][3], o[3])]
            boxes[k] = [min(boxes[k][0], a), boxes[k][1], max(boxes[k][2], b), y + 1]
            runs.append((a, b, k))
        above = runs
    out = []
    for x1, y1, x2, y2 in boxes.values():
        if x2 - x1 >= 0.04 * w and 8 <= y2 - y1 <= 0.2 * h:
            m = max(2, (y2 - y1) // 8)
            out.append((int(max(0, x1 - m)), int(max(0, y1 - m)), int(min(w, x2 + m)), int(min(h, y2 + m))))
    return sorted(out, key=lambda b: (b[1], b[0]))


def prepared(images: DataFrame) -> DataFrame:
    """path, position, name, diagnostics, transform (the matrix into the straightened page, row by row) and boxes of every
    variant of ``images`` (path, width, height, channels, data)."""
    schema = (
        "path string, position int, name string, d struct<brightness:double,contrast:double,sharpness:double,skew_degrees:double,clipped_dark:double,clipped_light:double>, "
        "transform array<double>, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                found, matrix = straight_variants(gray_of(r.data, r.width, r.height, r.channels))
                for k, (name, a) in enumerate(found.items()):
                    boxes = [dict(zip(("x1", "y1", "x2", "y2"), b, strict=True)) for b in line_boxes(a)] if name == "original" else []
                    out.append((r.path, k, name, diagnostics(a), matrix.reshape(-1).tolist(), boxes))
            yield pd.DataFrame(out, columns=["path", "position", "name", "d", "transform", "boxes"])

    return images.mapInPandas(run, schema)


def graymap(gray: np.ndarray) -> bytes:
    """Grey values as a binary portable graymap file."""
    return b"P5 %d %d 255\n" % (gray.shape[1], gray.shape[0]) + np.clip(np.rint(gray), 0, 255).astype(np.uint8).tobytes()


def chosen(images: DataFrame, limit: int = 2) -> DataFrame:
    """page, variant, choice (from 0), image (a graymap file), transform of the original and best variants of ``images``
    (page, width, height, channels, data). The choice is made within the row, so no image is shuffled."""
    measures = "struct<brightness:double,contrast:double,sharpness:double,skew_degrees:double,clipped_dark:double,clipped_light:double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                found, matrix = straight_variants(gray_of(r.data, r.width, r.height, r.channels))
                made = [{"position": k, "name": name, "d": diagnostics(a), "image": graymap(a)} for k, (name, a) in enumerate(found.items())]
                yield pd.DataFrame({"page": [r.page], "transform": [matrix.reshape(-1).tolist()], "made": [made]})

    made = images.select("page", "width", "height", "channels", "data").mapInPandas(run, f"page string, transform array<double>, made array<struct<position:int,name:string,d:{measures},image:binary>>")
    rated = F.transform("made", lambda v: F.struct((v["name"] != "original").alias("other"), (-recognition.variant_quality(v["d"])).alias("worse"), v["position"].alias("position"), v["name"].alias("name"), v["image"].alias("image")))
    best = made.select("page", "transform", F.posexplode(F.slice(F.array_sort(rated), 1, limit)).alias("choice", "v"))
    return best.select("page", F.col("v.name").alias("variant"), "choice", F.col("v.image").alias("image"), "transform")
