"""OCR payloads, boxes, mappings and text wrapping as expressions over arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.num import bind, clamp_1000, lenient_double
from foliant.functions.text import clean_text, strip_space

#: Fixed values of the page that text is rendered to.
PAGE_WIDTH, PAGE_HEIGHT, MARGIN, LINE_SPACING, FONT_SIZE = 1200, 1600, 60, 8, 28
#: Why a document has no boxes.
BOX_SHAPE, BOX_ORDER, NO_WORDS = "box of the wrong shape", "box with coordinates out of order", "no readable words"
PAYLOAD = "struct<label:string,words:array<string>,boxes:array<array<int>>,confidences:array<double>,page_indices:array<int>>"
OCR_JSON = "words array<string>, boxes array<array<double>>, image_width string, image_height string"


def empty_payload(label: Column) -> Column:
    return F.struct(label.alias("label"), F.array().cast("array<string>").alias("words"), F.array().cast("array<array<int>>").alias("boxes"), F.array().cast("array<double>").alias("confidences"), F.array().cast("array<int>").alias("page_indices")).cast(PAYLOAD)


def assemble_payload(label: Column, text: Column, left: Column, top: Column, width: Column, height: Column, conf: Column, page: Column) -> Column:
    """Parallel OCR lists of a page as a payload: words cleaned, empty ones dropped, corners instead of sizes."""
    rows = F.transform(F.arrays_zip(text.alias("w"), left.alias("l"), top.alias("t"), width.alias("x"), height.alias("y"), conf.alias("c")), lambda r: F.struct(clean_text(r["w"]).alias("w"), F.array(r["l"], r["t"], r["l"] + r["x"], r["t"] + r["y"]).alias("b"), lenient_double(r["c"], None).alias("c")))
    rows = F.filter(rows, lambda r: r["w"] != "")
    return F.struct(label.alias("label"), F.transform(rows, lambda r: r["w"]).alias("words"), F.transform(rows, lambda r: r["b"]).alias("boxes"), F.transform(rows, lambda r: r["c"]).alias("confidences"), F.transform(rows, lambda r: page).alias("page_indices")).cast(PAYLOAD)


def payload_text(payload: Column) -> Column:
    return clean_text(F.array_join(payload["words"], " "))


def merge_payloads(label: Column, payloads: Column) -> Column:
    """The payloads of a document's pages, in the list's order, as one."""
    parts = [F.flatten(payloads[n]) for n in ("words", "boxes", "confidences", "page_indices")]
    return F.struct(label.alias("label"), *(p.alias(n) for p, n in zip(parts, ("words", "boxes", "confidences", "page_indices"), strict=True))).cast(PAYLOAD)


def box_error(box: Column) -> Column:
    """Why a raw box is invalid, else null."""
    return F.when(box.isNull() | (F.size(box) != 4) | F.exists(box, lambda v: v.isNull()), BOX_SHAPE).when((F.get(box, F.lit(2)) < F.get(box, F.lit(0))) | (F.get(box, F.lit(3)) < F.get(box, F.lit(1))), BOX_ORDER)


def scaled_corners(corners: list[Column], width: Column, height: Column) -> list[Column]:
    """Left, top, right and bottom on a page of 1000 by 1000; for rows of one word, which need no lists."""
    return [clamp_1000(F.try_divide(v.cast("double") * 1000, side.cast("double"))) for v, side in zip(corners, (width, height, width, height), strict=True)]


def scale_box(box: Column, width: Column, height: Column) -> Column:
    """A valid raw box on a page of 1000 by 1000; null where the page has no extent."""
    return F.when((width > 0) & (height > 0), F.array(*scaled_corners([F.get(box, F.lit(i)) for i in range(4)], width, height)))


def normalize_ocr(words: Column, boxes: Column, width: Column, height: Column, clean=clean_text) -> Column:
    """struct(error, words, boxes): words cleaned, empty ones dropped with their boxes, boxes scaled; one bad box fails the document.

    clean: clean_text as inference does, or strip_space as training does.
    """
    given = F.struct(words.alias("words"), boxes.alias("boxes"), width.cast("double").alias("width"), height.cast("double").alias("height"))
    return bind(given, lambda g: bind(_cleaned_rows(g, clean), lambda rows: bind(_ocr_error(g, rows), lambda error: _normalized(g, rows, error))))


def _cleaned_rows(given: Column, clean) -> Column:
    rows = F.transform(F.arrays_zip(given["words"].alias("w"), given["boxes"].alias("b")), lambda r: F.struct(clean(r["w"]).alias("w"), r["b"].alias("b")))
    return F.filter(rows, lambda r: F.coalesce(r["w"], F.lit("")) != "")


def _ocr_error(given: Column, rows: Column) -> Column:
    words, boxes = given["words"], given["boxes"]
    return (
        F.when(words.isNull() | boxes.isNull(), "words and boxes must be lists")
        .when(F.size(words) != F.size(boxes), F.format_string("mismatch of %d words and %d boxes", F.size(words), F.size(boxes)))
        .when(F.size(rows) == 0, NO_WORDS)
        .otherwise(F.coalesce(F.get(F.filter(F.transform(rows, lambda r: box_error(r["b"])), lambda e: e.isNotNull()), F.lit(0)), F.when(~F.coalesce((given["width"] > 0) & (given["height"] > 0), F.lit(False)), "page without extent")))
    )


def _normalized(given: Column, rows: Column, error: Column) -> Column:
    boxes = F.transform(rows, lambda r: scale_box(r["b"], given["width"], given["height"]))
    return F.struct(error.alias("error"), F.when(error.isNull(), F.transform(rows, lambda r: r["w"])).alias("words"), F.when(error.isNull(), boxes).alias("boxes"))


def load_ocr(json: Column, image_width: Column, image_height: Column, clean=strip_space) -> Column:
    """normalize_ocr() of a JSON payload. Its image size counts where it is a positive number, else the given one."""
    side = lambda own, given: F.coalesce(F.when(lenient_double(own, None) > 0, lenient_double(own, None)), given.cast("double"))
    parsed = F.from_json(json, OCR_JSON, {"mode": "PERMISSIVE"})
    return bind(parsed, lambda p: normalize_ocr(p["words"], p["boxes"], side(p["image_width"], image_width), side(p["image_height"], image_height), clean))


def mapping_consistent(label2id: Column, id2label: Column) -> Column:
    """Labels in the order of their ids are the same in either direction. label2id: map string to int; id2label: map string to string."""
    forward = F.transform(F.array_sort(F.transform(F.map_entries(label2id), lambda e: F.struct(e["value"].alias("i"), e["key"].alias("l")))), lambda e: e["l"])
    back = F.transform(F.array_sort(F.transform(F.map_entries(id2label), lambda e: F.struct(e["key"].try_cast("int").alias("i"), e["value"].alias("l")))), lambda e: e["l"])
    return F.coalesce(forward == back, F.lit(False))


def invert_map(m: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))


def keep_keys(m: Column, allowed: list[str]) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*allowed))


def tokens(text: Column, most: int | None = 512) -> Column:
    """Words of the cleaned text, cut to the model's length; none for an empty text."""
    clean = clean_text(text)
    words = F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))
    return words if most is None else F.slice(words, 1, most)


def wrap_words(text: Column, columns: int) -> Column:
    """Greedy lines of at most so many characters, a longer word alone on its line, as when every character has one width."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def step(acc: Column, w: Column) -> Column:
        longer = F.when(acc["line"] == "", w).otherwise(F.concat(acc["line"], F.lit(" "), w))
        fits = F.length(longer) <= columns
        done = F.when(fits | (acc["line"] == ""), acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["line"])))
        return F.struct(done.alias("lines"), F.when(fits, longer).otherwise(w).alias("line"))

    return F.aggregate(tokens(text, None), start, step, lambda a: F.when(a["line"] == "", a["lines"]).otherwise(F.concat(a["lines"], F.array(a["line"]))))


def page_lines(text: Column, char_width: int = 14, line_height: int = FONT_SIZE) -> Column:
    """The lines that fit on the rendered page: drawn from the margin down, until the next would start below the lower margin."""
    lines = wrap_words(text, (PAGE_WIDTH - 2 * MARGIN) // char_width)
    return F.slice(lines, 1, (PAGE_HEIGHT - 2 * MARGIN) // (line_height + LINE_SPACING) + 1)
