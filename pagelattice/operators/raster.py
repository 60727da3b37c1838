"""Pixel stages on whole images, one image a row: numpy arrays (height, width, channels) inside Arrow batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the raster rules.
DISTANCE_MAX = 441.673
COMPONENT_DISTANCE = 30.0
SAMPLES = 250
CORNERS = 0.025


def half_up(x: float) -> int:
    return floor(x + 0.5)


def upper_median(values: np.ndarray, empty: float = 255.0) -> float:
    return float(np.sort(values)[len(values) // 2]) if len(values) else empty


def median_color(pixels: np.ndarray) -> np.ndarray:
    return np.array([upper_median(pixels[:, c]) for c in range(3)]) if len(pixels) else np.full(3, 255.0)


def luminance(p: np.ndarray) -> np.ndarray:
    return p[..., 0] * 0.2126 + p[..., 1] * 0.7152 + p[..., 2] * 0.0722


def saturation(p: np.ndarray) -> np.ndarray:
    most, least = p[..., :3].max(-1), p[..., :3].min(-1)
    return np.divide(most - least, most, out=np.zeros_like(most), where=most > 0)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[..., :3] - b[..., :3]) ** 2).sum(-1))


def quantized(p: np.ndarray, step: int) -> np.ndarray:
    return np.minimum(255.0, np.floor(p[..., :3] / step + 0.5) * step)


def alpha(image: np.ndarray) -> np.ndarray:
    return image[..., 3] if image.shape[-1] == 4 else np.full(image.shape[:2], 255.0)


def resized(image: np.ndarray, wide: int, high: int) -> np.ndarray:
    """Area-weighted mean of the source pixels under each target pixel."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        lo, hi = np.maximum.outer(edge[:-1], np.arange(n)), np.minimum.outer(edge[1:], np.arange(1, n + 1))
        w = np.clip(hi - lo, 0, None)
        return w / w.sum(1, keepdims=True)

    out = np.einsum("ij,jkc->ikc", weights(image.shape[0], high), image.astype(float), optimize=True)
    return np.floor(np.einsum("ij,kjc->kic", weights(image.shape[1], wide), out, optimize=True) + 0.5)


def background(image: np.ndarray) -> np.ndarray:
    """Upper median per channel of four corner squares."""
    h, w = image.shape[:2]
    side = max(2, half_up(min(w, h) * CORNERS))
    squares = [image[y : y + side, x : x + side, :3].reshape(-1, 3) for y in (0, max(0, h - side)) for x in (0, max(0, w - side))]
    return median_color(np.concatenate(squares).astype(float))


def foreground_mask(image: np.ndarray, back: np.ndarray) -> np.ndarray:
    p = image[..., :3].astype(float)
    step = np.zeros(p.shape[:2])
    step[:, :-1] = np.abs(p[:, 1:] - p[:, :-1]).sum(-1)
    step[:-1] = np.maximum(step[:-1], np.abs(p[1:] - p[:-1]).sum(-1))
    return (distance(p, back) > 24) | (step > 48)


def edge_mask(image: np.ndarray) -> np.ndarray:
    p = image[..., :3].astype(float)
    out = np.zeros(p.shape[:2], bool)
    if min(p.shape[:2]) > 2:
        across = np.abs(p[1:-1, 2:] - p[1:-1, :-2]).sum(-1)
        down = np.abs(p[2:, 1:-1] - p[:-2, 1:-1]).sum(-1)
        out[1:-1, 1:-1] = across + down > 105
    return out


def shifts(radius: int) -> Iterator[tuple[int, int]]:
    return ((dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1))


def shifted(x: np.ndarray, dy: int, dx: int, fill: float) -> np.ndarray:
    """out[y, x] = x[y + dy, x + dx], or fill outside."""
    out = np.full_like(x, fill)
    h, w = x.shape[:2]
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = x[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def dilated(mask: np.ndarray, radius: int) -> np.ndarray:
    out = np.zeros_like(mask)
    for dy, dx in shifts(radius):
        if abs(dy) < mask.shape[0] and abs(dx) < mask.shape[1]:
            out |= shifted(mask, dy, dx, False)
    return out


def tolerant_overlap(a: np.ndarray, b: np.ndarray, radius: int = 1) -> float:
    """F1 of two masks, a pixel matching within the radius; two empty masks agree."""
    na, nb = int(a.sum()), int(b.sum())
    if not na and not nb:
        return 1.0
    recall = int((a & dilated(b, radius)).sum()) / max(1, na)
    precision = int((b & dilated(a, radius)).sum()) / max(1, nb)
    return 2 * recall * precision / max(0.000001, recall + precision)


def clamp01(x: float) -> float:
    return 0.0 if x != x else min(1.0, max(0.0, x))


def local_color_similarity(reference: np.ndarray, rendered: np.ndarray, mask: np.ndarray, radius: int = 1) -> float:
    if not mask.any():
        return 1.0
    best = np.full(mask.shape, np.inf)
    for dy, dx in shifts(radius):
        if abs(dy) < mask.shape[0] and abs(dx) < mask.shape[1]:
            there = shifted(np.ones(mask.shape, bool), dy, dx, False)
            near = distance(reference.astype(float), shifted(rendered.astype(float), dy, dx, 0))
            best = np.where(there, np.minimum(best, near), best)
    return clamp01(1 - float(best[mask].mean()) / DISTANCE_MAX)


def background_similarity(reference: np.ndarray, rendered: np.ndarray, mask: np.ndarray) -> float:
    rest = ~mask
    if not rest.any():
        return 1.0
    gap = np.abs(reference[..., :3].astype(float) - rendered[..., :3].astype(float)).sum(-1) / 3
    return clamp01(1 - float(gap[rest].mean()) / 255)


def compared(reference: np.ndarray, rendered: np.ndarray, most: int = 640) -> dict[str, float]:
    """Visual metrics of a rendering against its reference, at most `most` pixels wide."""
    scale = min(1.0, most / reference.shape[1])
    wide, high = max(32, half_up(reference.shape[1] * scale)), max(18, half_up(reference.shape[0] * scale))
    a, b = (x[..., :3] if x.shape[:2] == (high, wide) else resized(x[..., :3], wide, high) for x in (reference, rendered))
    fa, fb = foreground_mask(a, background(a)), foreground_mask(b, background(b))
    coverage, edges = tolerant_overlap(fa, fb, 2), tolerant_overlap(edge_mask(a), edge_mask(b), 2)
    color, back = local_color_similarity(a, b, fa, 1), background_similarity(a, b, fa)
    raw = clamp01(color * 0.35 + edges * 0.25 + coverage * 0.25 + back * 0.15)
    return {
        "width": wide, "height": high, "rawSimilarity": raw,
        "similarity": raw if raw <= 0.85 else 0.85 + 0.15 * ((raw - 0.85) / 0.15) ** 0.5,
        "layoutScore": clamp01(edges * 0.55 + coverage * 0.45), "appearanceScore": clamp01(color * 0.72 + back * 0.28),
        "foregroundCoverage": coverage, "edgeSimilarity": edges, "foregroundColorSimilarity": color, "backgroundSimilarity": back,
    }


def difference(reference: np.ndarray, rendered: np.ndarray) -> tuple[dict[str, float], np.ndarray]:
    """Error metrics, and a heat map that runs from cyan to red."""
    gap = np.abs(reference[..., :3].astype(float) - rendered[..., :3].astype(float)).sum(-1) / 3
    cold = np.maximum(0, 255 - gap * 2)
    heat = np.stack([np.minimum(255, gap * 3), cold, cold], -1).astype(np.uint8)
    mean = float(gap.mean())
    return {"mae": mean, "changed_ratio": float((gap > 24).mean()), "similarity": max(0.0, 1 - mean / 255)}, heat


def text_mask(lines: list[dict], wide: int, high: int) -> np.ndarray:
    """Pixels of text boxes, widened by 0.18 of the glyph height, 3 pixels at least."""
    mask = np.zeros((high, wide), bool)
    for line in lines:
        x0, y0, x1, y1 = (line["bbox"][k] for k in ("x0", "y0", "x1", "y1"))
        pad = max(3, half_up(max(1.0, line.get("glyph") or (y1 - y0)) * 0.18))
        mask[max(0, int(y0 - pad)) : min(high, int(y1 + pad)), max(0, int(x0 - pad)) : min(wide, int(x1 + pad))] = True
    return mask


def text_color(image: np.ndarray, bbox: tuple[int, int, int, int]) -> tuple[int, ...]:
    """The frequent colour of a box that is farthest from its surroundings; ties go to the first seen."""
    h, w = image.shape[:2]
    x0, y0, x1, y1 = bbox

    def histogram(x0: int, y0: int, x1: int, y1: int, hole: bool) -> dict[tuple, int]:
        seen: dict[tuple, int] = {}
        area = image[max(0, y0) : min(h, y1), max(0, x0) : min(w, x1)].astype(float)
        keep = alpha(area) > 100
        if hole:
            ys, xs = np.mgrid[max(0, y0) : min(h, y1), max(0, x0) : min(w, x1)]
            keep &= ~((xs >= bbox[0]) & (xs < bbox[2]) & (ys >= bbox[1]) & (ys < bbox[3]))
        for q in map(tuple, quantized(area, 16)[keep].astype(int).tolist()):
            seen[q] = seen.get(q, 0) + 1
        return seen

    inside, ring = histogram(x0 - 1, y0 - 1, x1 + 1, y1 + 1, False), histogram(x0 - 4, y0 - 4, x1 + 4, y1 + 4, True)
    if not inside:
        return (0, 0, 0)
    back = np.array(max(ring or inside, key=(ring or inside).get), float)
    size = (min(w, x1 + 1) - max(0, x0 - 1)) * (min(h, y1 + 1) - max(0, y0 - 1))
    least = max(2, half_up(size * 0.004))
    far = {q: float(distance(np.array(q, float), back)) for q, n in sorted(inside.items(), key=lambda x: -x[1]) if n >= least}
    far = {q: d for q, d in far.items() if d >= 42}
    if far:
        return max(far, key=far.get)
    return (20, 20, 20) if luminance(back) > 170 else (255, 255, 255)


def _grown(ok: np.ndarray, free: np.ndarray, start: tuple[int, int]) -> list[tuple[int, int]]:
    """Four-neighbour flood from start over ok pixels, in the order they are reached (right, left, down, up)."""
    h, w = ok.shape
    queue, order = deque([start]), [start]
    free[start] = False
    while queue:
        y, x = queue.popleft()
        for ny, nx in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)):
            if 0 <= ny < h and 0 <= nx < w and free[ny, nx] and ok[ny, nx]:
                free[ny, nx] = False
                queue.append((ny, nx))
                order.append((ny, nx))
    return order


def connected_components(image: np.ndarray, masked: np.ndarray) -> list[dict]:
    """Regions of like colour, grown from every second pixel that is dark enough and not masked."""
    p = image.astype(float)
    h, w = p.shape[:2]
    dark = (alpha(p) > 80) & (luminance(p) < 244)
    coarse = quantized(p, 24)
    free = dark & ~masked
    least = max(10, half_up(w * h * 0.000004))
    out = []
    for y in range(0, h, 2):
        for x in range(0, w, 2):
            if free[y, x]:
                near = distance(coarse, coarse[y, x]) <= COMPONENT_DISTANCE
                order = _grown(near, free, (y, x))
                if len(order) >= least:
                    out.append(component_stats(p, order))
    return out


def _probes(lo: int, hi: int, parts: int, side: int) -> range:
    return range(lo, hi + 1, max(1, half_up(side / parts)))


def component_stats(p: np.ndarray, order: list[tuple[int, int]]) -> dict:
    """Box, fill, mean colour and its spread, and colours inside and around a region."""
    h, w = p.shape[:2]
    ys, xs = np.array(order).T
    x0, x1, y0, y1 = int(xs.min()), int(xs.max()), int(ys.min()), int(ys.max())
    wide, high = x1 - x0 + 1, y1 - y0 + 1
    some = p[ys[:SAMPLES], xs[:SAMPLES], :3]
    mean = some.mean(0)
    inset_x, inset_y = max(1, half_up(wide * 0.18)), max(1, half_up(high * 0.18))
    inner = [p[y, x, :3] for y in _probes(y0 + inset_y, y1 - inset_y, 12, high) for x in _probes(x0 + inset_x, x1 - inset_x, 12, wide)]
    around = [(y, x) for x in _probes(x0, x1, 16, wide) for y in (y0 - 3, y1 + 3)]
    around += [(y, x) for y in _probes(y0, y1, 12, high) for x in (x0 - 3, x1 + 3)]
    outer = [p[y, x, :3] for y, x in around if 0 <= y < h and 0 <= x < w]
    inner_color, outer_color = (median_color(np.array(c)) if c else np.full(3, 255.0) for c in (inner, outer))
    probe = max(1, half_up(min(wide, high) * 0.04))
    corners = [(y, x) for y in (y0 + probe, y1 - probe) for x in (x0 + probe, x1 - probe)]
    sharp = sum(0 <= y < h and 0 <= x < w and distance(p[y, x], mean) < 65 for y, x in corners)
    return {
        "x0": float(x0), "y0": float(y0), "x1": x1 + 1.0, "y1": y1 + 1.0, "width": float(wide), "height": float(high),
        "count": len(order), "fillRatio": len(order) / (wide * high), "color": mean.tolist(),
        "colorVariance": float(np.sqrt((distance(some, mean) ** 2).mean())), "aspect": wide / high,
        "interiorColor": inner_color.tolist(), "exteriorColor": outer_color.tolist(),
        "hasDistinctInterior": bool(distance(inner_color, outer_color) > 18), "hasSharpCorners": bool(sharp >= 2),
    }


def without_speckles(mask: np.ndarray) -> np.ndarray:
    """Eight-connected spots of fewer pixels than max(3, 0.0012 of the image) go."""
    h, w = mask.shape
    least, left, out = max(3, half_up(w * h * 0.0012)), mask.copy(), np.zeros_like(mask)
    for y, x in zip(*np.nonzero(mask), strict=True):
        if left[y, x]:
            spot, todo = [], [(y, x)]
            left[y, x] = False
            while todo:
                cy, cx = todo.pop()
                spot.append((cy, cx))
                for dy, dx in shifts(1):
                    ny, nx = cy + dy, cx + dx
                    if 0 <= ny < h and 0 <= nx < w and left[ny, nx]:
                        left[ny, nx] = False
                        todo.append((ny, nx))
            if len(spot) >= least:
                out[tuple(np.array(spot).T)] = True
    return out


def _row_runs(p: np.ndarray) -> list[dict]:
    """Dense coloured runs on every second row."""
    w = p.shape[1]
    gap, least = max(5, half_up(w * 0.012)), max(60, half_up(w * 0.09))
    fits = (alpha(p) > 100) & (saturation(p) > 0.22) & (luminance(p) < 224)
    out = []
    for y in range(0, p.shape[0], 2):
        xs = np.flatnonzero(fits[y, ::2]) * 2
        for some in np.split(xs, np.flatnonzero(np.diff(xs) > gap) + 1):
            if len(some):
                x0, x1 = int(some[0]), int(some[-1]) + 2
                if x1 - x0 >= least and len(some) * 2 / (x1 - x0) >= 0.52:
                    out.append({"y": y, "x0": x0, "x1": x1, "color": median_color(p[y, some])})
    return out


def solid_bands(image: np.ndarray) -> list[dict]:
    """Wide coloured bands: row runs chained downwards, edges refined, contained ones dropped."""
    p = image.astype(float)
    h, w = p.shape[:2]
    bands: list[dict] = []
    for row in _row_runs(p):
        for band in reversed(bands):
            both = min(row["x1"], band["x1"]) - max(row["x0"], band["x0"])
            small, large = sorted((row["x1"] - row["x0"], band["x1"] - band["x0"]))
            if row["y"] - band["y1"] <= 4 and max(0, both) / max(1, small) > 0.72 and small / max(1, large) > 0.68 and distance(row["color"], band["color"]) < 85:
                band["colors"].append(row["color"])
                band |= {"x0": min(band["x0"], row["x0"]), "x1": max(band["x1"], row["x1"]), "y1": row["y"] + 2, "color": median_color(np.array(band["colors"]))}
                break
        else:
            bands.append({"x0": row["x0"], "x1": row["x1"], "y0": row["y"], "y1": row["y"] + 2, "color": row["color"], "colors": [row["color"]]})
    tint = (alpha(p) > 100) & (saturation(p) > 0.18) & (luminance(p) < 235)
    for band in bands:
        columns = [max(0, min(w - 1, half_up(band["x0"] + (band["x1"] - band["x0"]) * r))) for r in (0.08, 0.18, 0.82, 0.92)]
        match = (tint[:, columns] & (distance(p[:, columns], band["color"]) < 105)).sum(1) >= 2
        while band["y0"] > 0 and match[band["y0"] - 1]:
            band["y0"] -= 1
        while band["y1"] < h and match[band["y1"]]:
            band["y1"] += 1
    tall = [b for b in bands if b["y1"] - b["y0"] >= max(8, h * 0.012)]
    kept: list[dict] = []
    for band in sorted(tall, key=lambda b: -(b["x1"] - b["x0"]) * (b["y1"] - b["y0"])):
        size = (band["x1"] - band["x0"]) * (band["y1"] - band["y0"])
        over = lambda o: max(0, min(band["x1"], o["x1"]) - max(band["x0"], o["x0"])) * max(0, min(band["y1"], o["y1"]) - max(band["y0"], o["y0"]))  # noqa: B023, E731
        if not any(over(o) / max(1, size) > 0.72 and distance(band["color"], o["color"]) < 45 for o in kept):
            kept.append(band)
    out = []
    for b in kept:
        part = tint[b["y0"] : b["y1"] : 2, b["x0"] : b["x1"] : 2]
        density, aspect = float(part.mean()) if part.size else 0.0, (b["x1"] - b["x0"]) / max(1, b["y1"] - b["y0"])
        if density >= 0.46 and aspect >= 3.2:
            out.append({k: float(b[k]) for k in ("x0", "y0", "x1", "y1")} | {"color": b["color"].tolist(), "bandDensity": density, "aspect": aspect})
    return out


def _pixels(row, name: str = "data") -> np.ndarray:  # noqa: ANN001
    """The image source's bytes (BGR or BGRA) as RGB(A)."""
    raw = np.frombuffer(row[name], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    if raw.shape[-1] == 1:
        return np.repeat(raw, 3, -1)
    return raw[..., [2, 1, 0, *range(3, raw.shape[-1])]]


_BOX = "x0 double, y0 double, x1 double, y1 double"
COMPONENTS = (
    f"page_id string, seq bigint, {_BOX}, width double, height double, count bigint, fillRatio double, color array<double>, "
    "colorVariance double, aspect double, interiorColor array<double>, exteriorColor array<double>, "
    "hasDistinctInterior boolean, hasSharpCorners boolean"
)
BANDS = f"page_id string, seq bigint, {_BOX}, color array<double>, bandDensity double, aspect double"
METRICS = (
    "page_id string, width bigint, height bigint, rawSimilarity double, similarity double, layoutScore double, "
    "appearanceScore double, foregroundCoverage double, edgeSimilarity double, foregroundColorSimilarity double, backgroundSimilarity double"
)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.replace("array<double>", "list").split(", ")]


def page_components(images: DataFrame) -> DataFrame:
    """Components of images (page_id, height, width, nChannels, data, lines array<struct<bbox, glyph>>)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for _, r in frame.iterrows():
                lines = [x.asDict() if hasattr(x, "asDict") else x for x in (r["lines"] if r["lines"] is not None else [])]
                got = connected_components(_pixels(r), text_mask(lines, r["width"], r["height"]))
                rows += [{"page_id": r["page_id"], "seq": i} | c for i, c in enumerate(got)]
            yield pd.DataFrame(rows, columns=_names(COMPONENTS))

    return images.mapInPandas(run, COMPONENTS)


def page_bands(images: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"page_id": r["page_id"], "seq": i} | b for _, r in frame.iterrows() for i, b in enumerate(solid_bands(_pixels(r)))]
            yield pd.DataFrame(rows, columns=_names(BANDS))

    return images.mapInPandas(run, BANDS)


def page_metrics(pairs: DataFrame) -> DataFrame:
    """Visual metrics of pairs (page_id, height, width, nChannels, data, r_height, r_width, r_nChannels, r_data)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for _, r in frame.iterrows():
                other = {"height": r["r_height"], "width": r["r_width"], "nChannels": r["r_nChannels"], "data": r["r_data"]}
                rows.append({"page_id": r["page_id"]} | compared(_pixels(r), _pixels(other)))
            yield pd.DataFrame(rows, columns=_names(METRICS))

    return pairs.mapInPandas(run, METRICS)
