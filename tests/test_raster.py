"""Pages as images against a raster pixel by pixel, read back by Spark's image source."""

import random

import numpy as np
from pyspark.sql import functions as F

from foliant.functions import raster
from foliant.functions.nested import FONT_SIZE, LINE_SPACING, MARGIN
from foliant.sources import files


def plain_lines(text, width):
    size = lambda s: sum(14 + 3 * ("A" <= c <= "Z") + 6 * (c in "mwMW@%") - 7 * (c in "ijlt.,:;'!|") for c in s)
    lines, line = [], ""
    for word in (text or "").split():
        longer = f"{line} {word}".strip()
        if line and size(longer) > width:
            lines.append(line)
            line = word
        else:
            line = longer
    return [*lines, line] if line else lines


def plain_page(lines, width, height):
    page = [[255] * width for _ in range(height)]
    for k, line in enumerate(lines):
        x, y = MARGIN, MARGIN + k * (FONT_SIZE + LINE_SPACING)
        for ch in line:
            wide = raster.advance(ch)
            n = ord(ch) * 0x9E3779B97F4A7C15 % (1 << 64) >> 29 | 1
            for dy in range(FONT_SIZE):
                for dx in range(wide - 1):
                    if ch != " " and n >> (dy * 7 // FONT_SIZE * 5 + dx * 5 // (wide - 1)) & 1 and y + dy < height and x + dx < width:
                        page[y + dy][x + dx] = 0
            x += wide
    return np.array(page, np.uint8)


def test_pages_are_the_plain_raster(spark, tmp_path):
    rng = random.Random(9)
    words = ["a", "Mit", "illi", "wWm@%", "été", "it's", "x" * 40, "12:30", "日本", "😀", "OK|!", "über"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(12)] + ["", None, " \n\t ", "word " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string").repartition(3)
    width, height = 320, 260
    lines = {r.id: (r.l, r.n) for r in df.select("id", raster.wrap_pixels(F.col("body"), width - 2 * MARGIN).alias("l"), raster.text_width(F.col("body")).alias("n")).collect()}
    most = (height - 2 * MARGIN) // (FONT_SIZE + LINE_SPACING) + 1
    want = {}
    for i, t in enumerate(texts):
        assert lines[i][0] == plain_lines(t, width - 2 * MARGIN), t
        assert t is None or lines[i][1] == sum(map(raster.advance, t))
        want[i] = plain_page(plain_lines(t, width - 2 * MARGIN)[:most], width, height)
    got = {int(r.origin): r for r in raster.rendered(df, "id", "body", width, height).collect()}
    for i, page in want.items():
        assert (got[i].height, got[i].width, got[i].nChannels) == (height, width, 1) and bytes(got[i].data) == page.tobytes()
    for r in raster.rendered(df, "id", "body", width, height, file=True).collect():
        (tmp_path / f"{r.origin}.png").write_bytes(r.content)
    back = {int(r.origin.rsplit("/", 1)[1][:-4]): r for r in files.read_images(spark, str(tmp_path)).collect()}
    assert set(back) == set(want)
    for i, page in want.items():
        channels = np.frombuffer(back[i].data, np.uint8).reshape(height, width, back[i].nChannels)
        assert (channels[:, :, 0] == page).all()
    features = files.image_features(raster.rendered(df.where("id = 15"), "id", "body"), 224, (0, 0, 0), (1, 1, 1)).first().features
    assert len(features) == 3 * 224 * 224 and 0 <= min(features) < 0.9 and max(features) <= 1 + 1e-9
    assert raster.rendered(df.where("false"), "id", "body").count() == 0


def test_page_features_are_those_of_the_rendered_page(spark):
    """Against the raster, pixel for pixel: also words that leave the page, more lines than it has room for, and what is kept of the features."""
    texts = ["The Mill, it's 12:30|", "", None, "W" * 90 + " x " + "i" * 400 + " été 日本 😀", "word Mit wWm@% " * 900, "ab " * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string").repartition(2)
    for mean, std in (((0, 0, 0), (1, 1, 1)), ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))):
        want = {r.origin: np.array(r.features) for r in files.image_features(raster.rendered(df, "id", "body"), 224, mean, std).collect()}
        got = {r.origin: np.array(r.features) for r in raster.page_features(df, "id", "body", 224, mean, std).collect()}
        assert set(got) == set(want) and all(np.abs(got[k] - want[k]).max() < 1e-9 for k in want)
        kept = raster.page_features(df, "id", "body", 224, mean, std, lambda f: (len(f), float(f.mean())), "n int, m double").collect()
        assert all(r.n == 3 * 224 * 224 and abs(r.m - want[r.origin].mean()) < 1e-9 for r in kept) and len(kept) == len(texts)


def test_a_line_is_cut_in_one_pass_over_its_text(spark):
    """A text of 300,000 words; before, each word looked through the lines that were done."""
    lines = spark.createDataFrame([(1, "a bc Mit " * 100_000)], "id int, body string").select(raster.wrapped(F.col("body"), 200).alias("l")).first().l
    assert [r.line for r in lines] == plain_lines("a bc Mit " * 100_000, 200) and all(r.width == sum(map(raster.advance, r.line)) <= 200 for r in lines)


def test_heat_images(spark, tmp_path):
    cells = spark.createDataFrame([("m", t, p, 10 * i, 20, 255) for i, (t, p) in enumerate([("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")])], "model string, true_label string, predicted_label string, red int, green int, blue int")
    row = raster.heat_images(cells, ["a", "b"], 3).first()
    (tmp_path / "m.png").write_bytes(row.content)
    back = files.read_images(spark, str(tmp_path)).first()
    bgr = np.frombuffer(back.data, np.uint8).reshape(6, 6, 3)
    assert (bgr[:, :, 0] == 255).all() and (bgr[:3, :3, 2] == 0).all() and (bgr[:3, 3:, 2] == 10).all() and (bgr[3:, :3, 2] == 20).all() and (bgr[3:, 3:, 2] == 30).all()
