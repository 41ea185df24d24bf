"""Paths, folder names and the keys derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import normalized_name, title_key

# Wrapper folders that carry no title, tags before a title, characters a folder name must not hold.
WRAPPER_FOLDER = r"(?i)^(?:folder|source|copy|set)[ _.-]*\d+$"
TITLE_TAG = r"(?i)^\s*\[F\d+\]\s*"
RESERVED = r'[<>:"/\\|?*\x00-\x1f]'


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def inside(path: Column, root: Column) -> Column:
    """Whether a path is a root or lies below it."""
    return (path == root) | path.startswith(F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def folder_name(name: Column) -> Column:
    """A folder name fit for use, or null: trimmed, not empty, no reserved character."""
    value = F.regexp_replace(F.trim(name), "[. ]+$", "")
    return F.when((value != "") & ~value.rlike(RESERVED), value)


def relative_destination(path: Column) -> Column:
    """A destination that stays inside its title, or null; '.' for the title itself."""
    text = F.trim(path)
    parts = F.filter(F.split(text, "/"), lambda x: (x != "") & (x != "."))
    bad = text.startswith("/") | F.exists(parts, lambda x: (x == "..") | x.rlike(RESERVED) | x.rlike("[. ]$"))
    return F.when(~bad, F.when(F.size(parts) == 0, F.lit(".")).otherwise(F.array_join(parts, "/")))


def final_name(folder: Column) -> Column:
    """A title folder's name without its tag."""
    plain = F.trim(F.regexp_replace(folder, TITLE_TAG, ""))
    return F.coalesce(folder_name(F.when(plain == "", folder).otherwise(plain)), folder_name(folder))


def suggested_destination(relative: Column, title: Column) -> Column:
    """Where a source folder's files go in the title: nowhere deeper if its leaf only repeats the title."""
    leaf = F.try_element_at(F.filter(F.split(relative, "/"), lambda x: (x != "") & ~x.rlike(WRAPPER_FOLDER)), F.lit(-1))
    compact = lambda x: F.regexp_replace(title_key(normalized_name(x)["core_title"]), r"(?U)[^\p{L}\p{N}]", "")
    same = compact(leaf) == compact(title)
    ends = (compact(title) != "") & compact(leaf).endswith(compact(title))
    return F.when(leaf.isNull() | same | ends, F.lit(".")).otherwise(leaf)


def group_id(category: Column, paths: Column) -> Column:
    """A review item's identity: its category and 16 hex digits over category and sorted paths."""
    text = F.concat_ws("\0", category, F.array_join(F.array_sort(paths), "\0"))
    return F.concat(category, F.lit(":"), F.substring(F.sha2(text, 256), 1, 16))


def preset_id(prefix: Column, arguments: Column) -> Column:
    """A custom preset's identity: a prefix and 8 hex digits over its arguments."""
    return F.concat(prefix, F.lit("-"), F.substring(F.sha1(F.array_join(arguments, "\0")), 1, 8))


# What a custom preset may name.
ENCODERS, PIXEL_FORMATS, QUALITY = ("libx265", "av1_nvenc", "hevc_nvenc"), ("yuv420p", "yuv420p10le"), (0, 51)


def preset_problem(encoder: Column, quality: Column, pixel_format: Column) -> Column:
    """What keeps a custom preset from being used: 'encoder', 'quality' or 'pixel format'; null where nothing does."""
    return (
        F.when(~F.coalesce(encoder.isin(*ENCODERS), F.lit(False)), "encoder")
        .when(~F.coalesce(quality.between(*QUALITY), F.lit(False)), "quality")
        .when(~F.coalesce(pixel_format.isin(*PIXEL_FORMATS), F.lit(False)), "pixel format")
    )


def quarantine_path(base: Column, root: Column, path: Column) -> Column:
    """Where a file is put aside: the root's name and a short hash of it, then the path below the root."""
    name = F.concat(file_name(root), F.lit("-"), F.substring(F.sha2(F.lower(root), 256), 1, 8))
    below = F.when(inside(path, root), F.substr(path, F.length(root) + 2)).otherwise(file_name(path))
    return F.concat_ws("/", base, name, below)


def numbered(path: Column, nth: Column) -> Column:
    """A path with `` (n)`` before its suffix from the second use on."""
    stem, ending = F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 2)
    return F.when(nth <= 0, path).otherwise(F.concat(stem, F.lit(" ("), nth.cast("string"), F.lit(")"), ending))


def output_path(source: Column, preset: Column) -> Column:
    """Where an encoded copy goes: the source's stem, the preset, .mkv."""
    return F.concat(F.regexp_replace(source, r"\.[^./]*$", ""), F.lit("."), preset, F.lit(".mkv"))
