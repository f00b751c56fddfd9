"""Text functions as Column expressions; none runs Python on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exactly the characters that Python's str.isspace() has in the basic plane.
WHITE = r"(?U)[\s\x1c-\x1f]+"
#: The fewest characters of a usable text, and the characters that a preview shows.
MIN_CHARS, PREVIEW_CHARS = 20, 1000
#: The file types of ingest and text scoring, and of image scoring.
TEXT_TYPES = (".pdf", ".png", ".jpg", ".jpeg", ".txt", ".html", ".htm", ".docx")
IMAGE_TYPES = (".pdf", ".png", ".jpg", ".jpeg")


def clean_text(c: Column) -> Column:
    """Null as empty, NUL as space, any run of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\0"), F.lit(" ")), WHITE, " "))


def strip_space(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def strip_html(c: Column) -> Column:
    """Script and style blocks, then tags, each as a space (fixed patterns); then clean. Entities stay as they are."""
    out = F.coalesce(c, F.lit(""))
    for block in ("script", "style"):
        out = F.regexp_replace(out, rf"(?isu)<{block}.*?</{block}>", " ")
    return clean_text(F.regexp_replace(out, "<[^>]+>", " "))


def joined_length(c: Column) -> Column:
    """Length with white space collapsed, NUL kept as a character."""
    return F.length(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WHITE, " ")))


def clean_length(c: Column) -> Column:
    return F.length(clean_text(c))


def is_short(c: Column, least: int = MIN_CHARS) -> Column:
    return clean_length(c) < least


def preview(c: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.substring(c, 1, chars)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty without one. A leading dot alone makes no suffix."""
    return F.lower(F.regexp_extract(path, r"[^\\/.](?:[^\\/]*?)(\.[^.\\/]+)$", 1))


def supported(path: Column, types: tuple[str, ...] = TEXT_TYPES) -> Column:
    return extension(path).isin(*types)


def slashes(path: Column) -> Column:
    """Backslashes as slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def path_order(path: Column) -> Column:
    """The components of a path; sorting by it sorts paths as paths, not as strings."""
    return F.split(slashes(path), "/")


def surrogate_id(label: Column, number: Column) -> Column:
    """label_0001, wider beyond 9999."""
    return F.format_string("%s_%04d", label, number)


def artifact_path(folder: str, label: Column, key: Column, suffix: str) -> Column:
    return F.concat(F.lit(f"{folder}/"), label, F.lit("/"), key, F.lit(suffix))


def project_relative(path: Column, root: str) -> Column:
    """Below the root: the rest of the path; else the path."""
    inside = root.rstrip("/") + "/"
    return F.when(path.startswith(inside), F.substring(path, len(inside) + 1, 1 << 30)).otherwise(path)


def resolve_path(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def percent_text(value: Column) -> Column:
    """For display only: Spark rounds the decimal half up."""
    return F.format_string("%.2f%%", value * 100)


def seconds_text(value: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f s", value)


def out_of_memory(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    return m.contains("cuda") & m.contains("out of memory")
