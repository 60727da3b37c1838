"""Raster metrics and components on synthetic slides."""

import numpy as np
from pyspark.sql import functions as F

from pagelattice.operators import joins, raster


def slide(x=40, circle=True, color=(0x0E, 0x67, 0xD1)):
    image = np.full((180, 320, 3), 255, np.uint8)
    image[45:115, x : x + 130] = color
    if circle:
        yy, xx = np.mgrid[:180, :320]
        image[(yy - 90) ** 2 + (xx - 250) ** 2 <= 28**2] = (0xE3, 0x3D, 0x56)
    return image


def test_metrics_find_injected_faults():
    same = raster.compared(slide(), slide())
    assert same["similarity"] > 0.9999
    gone = raster.compared(slide(), slide(circle=False))
    assert gone["similarity"] < 0.99 and gone["foregroundCoverage"] < 0.99
    assert raster.compared(slide(), slide(x=90))["layoutScore"] < 0.9
    assert raster.compared(slide(), slide(color=(0x17, 0xA6, 0x73)))["appearanceScore"] < 0.95


def test_difference_and_masks():
    metrics, heat = raster.difference(slide(), slide())
    assert metrics == {"mae": 0.0, "changed_ratio": 0.0, "similarity": 1.0} and (heat[0, 0] == (0, 255, 255)).all()
    empty = np.zeros((5, 5), bool)
    one = empty.copy()
    one[2, 2] = True
    near = empty.copy()
    near[2, 4] = True
    assert raster.tolerant_overlap(empty, empty) == 1.0 and raster.tolerant_overlap(one, near, 1) == 0.0 and raster.tolerant_overlap(one, near, 2) == 1.0


def test_pixel_join_agrees_with_dilation(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((12, 9)) < 0.2, rng.random((12, 9)) < 0.1
    table = lambda m: spark.createDataFrame([(1, int(x), int(y)) for y, x in zip(*np.nonzero(m))], "page_id int, x int, y int")  # noqa: B905, E731
    got = {(r.y, r.x) for r in joins.near_set_pixels(table(a), table(b), 2).collect()}
    assert got == set(zip(*(v.tolist() for v in np.nonzero(a & raster.dilated(b, 2))), strict=True))


def test_components_and_text_mask():
    image = slide()
    found = raster.connected_components(image, np.zeros(image.shape[:2], bool))
    assert [(c["x0"], c["y0"], c["x1"], c["y1"]) for c in found] == [(40.0, 45.0, 170.0, 115.0), (222.0, 62.0, 279.0, 119.0)]
    assert found[0]["fillRatio"] == 1.0 and found[0]["hasDistinctInterior"] and 0.7 < found[1]["fillRatio"] < 0.9
    mask = raster.text_mask([{"bbox": {"x0": 40, "y0": 45, "x1": 170, "y1": 115}, "glyph": 20.0}], 320, 180)
    assert len(raster.connected_components(image, mask)) == 1 and mask[41, 36] and not mask[40, 36]


def test_bands_and_text_colour():
    image = np.full((200, 400, 3), 255, np.uint8)
    image[51:80, 20:380] = (10, 60, 200)
    image[60:64, 100:140] = 255
    (band,) = raster.solid_bands(image)
    assert (band["x0"], band["y0"], band["x1"], band["y1"]) == (20.0, 51.0, 380.0, 80.0) and band["bandDensity"] > 0.9
    assert raster.text_color(image, (100, 60, 140, 64)) == (255, 255, 255)
    assert raster.text_color(image, (200, 100, 240, 120)) == (20, 20, 20)


def test_speckles():
    mask = np.zeros((50, 50), bool)
    mask[5:9, 5:9] = True
    mask[20, 20] = mask[21, 21] = True
    assert raster.without_speckles(mask).sum() == 16


def test_images_through_spark(spark):
    image = slide()
    raw = image[..., ::-1].tobytes()
    df = spark.createDataFrame([("p", 180, 320, 3, bytearray(raw))], "page_id string, height int, width int, nChannels int, data binary")
    none = F.array().cast("array<struct<bbox:struct<x0:double,y0:double,x1:double,y1:double>,glyph:double>>")
    assert raster.page_components(df.withColumn("lines", none)).count() == 2
    assert raster.page_bands(df).count() == 0
    pair = df.withColumns({f"r_{c}": F.col(c) for c in ("height", "width", "nChannels", "data")})
    assert raster.page_metrics(pair).first().similarity > 0.9999
