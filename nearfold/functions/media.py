"""Media types by suffix, probe reports, and how sizes and durations are written."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of the media types.
VIDEO = (".mkv .mp4 .avi .mov .ts .m2ts .wmv .flv .webm .mpg .mpeg .m4v .mts .vob .ogv .3gp .3g2 .asf .divx .f4v .mxf .rm .rmvb").split()
IMAGE = ".jpg .jpeg .png .webp .bmp .gif .tif .tiff".split()
AUDIO = ".mp3 .flac .wav .m4a .aac .ogg .opus .wma .aiff .aif".split()
MEDIA = {"video": VIDEO, "image": IMAGE, "audio": AUDIO}

PROBE_SCHEMA = (
    "struct<format: struct<format_name: string, duration: string, bit_rate: string>, streams: array<struct<index: string, codec_type: string, "
    "codec_name: string, width: string, height: string, pix_fmt: string, avg_frame_rate: string, sample_rate: string, channels: string, "
    "duration: string, tags: map<string,string>, disposition: map<string,int>>>, chapters: array<struct<id: string>>>"
)


def normalize_extensions(extensions: Iterable[str] | None) -> set[str]:
    """Suffixes in lower case with a dot; all media suffixes where none are given."""
    if not extensions:
        return {*VIDEO, *IMAGE, *AUDIO}
    return {x if x.startswith(".") else f".{x}" for x in (e.lower() for e in extensions)}


def suffix(path: Column) -> Column:
    """The lower-case suffix of a path's last part with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def media_type(path: Column) -> Column:
    """'video', 'image', 'audio' or 'file'."""
    kind = F.lit("file")
    for name in ("audio", "image", "video"):
        kind = F.when(suffix(path).isin(*MEDIA[name]), F.lit(name)).otherwise(kind)
    return kind


def has_extension(path: Column, extensions: Iterable[str] | None = None) -> Column:
    return suffix(path).isin(*sorted(normalize_extensions(extensions)))


def frame_rate(text: Column) -> Column:
    """``n/d`` as a number; null for 0/0, a zero divisor and anything else."""
    top, bottom = (F.regexp_extract(text, r"^\s*([^/]+?)\s*(?:/\s*(.+?)\s*)?$", i).try_cast("double") for i in (1, 2))
    rate = F.when(text.contains("/"), F.try_divide(top, bottom)).otherwise(top)
    return F.when(rate != 0, rate)


def stream_struct(stream: Column) -> Column:
    """A probed stream with its numbers read softly and its flags and tags brought out."""
    return F.struct(
        stream["index"].try_cast("int").alias("index"), stream["codec_type"].alias("kind"), stream["codec_name"].alias("codec"),
        stream["width"].try_cast("int").alias("width"), stream["height"].try_cast("int").alias("height"), stream["pix_fmt"].alias("pixel_format"),
        frame_rate(stream["avg_frame_rate"]).alias("frame_rate"), stream["sample_rate"].try_cast("int").alias("sample_rate"),
        stream["channels"].try_cast("int").alias("channels"), stream["tags"]["language"].alias("language"), stream["tags"]["title"].alias("title"),
        (F.coalesce(stream["disposition"]["default"], F.lit(0)) != 0).alias("default"),
        (F.coalesce(stream["disposition"]["forced"], F.lit(0)) != 0).alias("forced"),
    )


def probe(report: Column) -> Column:
    """Container facts of a probe report in JSON; the duration falls back to the longest stream's."""
    parsed = F.from_json(report, PROBE_SCHEMA)
    longest = F.array_max(F.transform(parsed["streams"], lambda s: s["duration"].try_cast("double")))
    return F.struct(
        parsed["format"]["format_name"].alias("container"), F.coalesce(parsed["format"]["duration"].try_cast("double"), longest).alias("duration"),
        parsed["format"]["bit_rate"].try_cast("long").alias("bit_rate"), F.transform(parsed["streams"], stream_struct).alias("streams"),
        F.coalesce(F.when(parsed["chapters"].isNotNull(), F.size(parsed["chapters"])), F.lit(0)).alias("chapters"),
    )


def streams_of(streams: Column, kind: str) -> Column:
    return F.filter(streams, lambda s: s["kind"] == kind)


def human_size(size: Column) -> Column:
    """Bytes on the KiB ladder: whole bytes, else one decimal, halves to the even one."""
    text = F.concat(size.cast("long").cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        text = F.when(size >= 1024**power, F.concat(F.format_string("%.1f", F.bround(size / F.lit(float(1024**power)), 1)), F.lit(f" {unit}"))).otherwise(text)
    return text


def clock(seconds: Column) -> Column:
    """Seconds as h:mm:ss, or m:ss below an hour, halves to the even second, 0:00 below none; null for null and NaN."""
    whole = F.when(seconds.isNotNull() & ~F.isnan(seconds), F.greatest(F.lit(0), F.bround(seconds).cast("long")))
    hours, minutes, rest = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    return F.when(whole >= 3600, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.when(whole.isNotNull(), F.format_string("%d:%02d", minutes, rest)))


def savings(before: Column, after: Column) -> tuple[Column, Column]:
    """Bytes saved, and their percentage; 0 % where there was nothing before."""
    saved = before - after
    return saved, F.when(before > 0, F.lit(100.0) * saved / before).otherwise(F.lit(0.0))


def progress(block: Column, duration: Column) -> Column:
    """``struct<seconds, percent, fps, speed, message>`` of a key=value progress block; percent of ``duration`` within 0 to 100."""
    pairs = F.str_to_map(block, F.lit("\n"), F.lit("="))
    seconds = F.coalesce(progress_seconds(block), F.lit(0.0))
    percent = F.when(duration > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.lit(100.0) * seconds / duration))).otherwise(F.lit(0.0))
    return F.struct(
        seconds.alias("seconds"), percent.alias("percent"), pairs["fps"].try_cast("double").alias("fps"), pairs["speed"].alias("speed"),
        F.coalesce(pairs["progress"], F.lit("")).alias("message"),
    )


def progress_seconds(block: Column) -> Column:
    """Seconds encoded so far of a progress block, by its clock or else its microseconds; null where it has neither."""
    pairs = F.str_to_map(block, F.lit("\n"), F.lit("="))
    time = F.split(pairs["out_time"], ":")
    by_clock = F.when(F.size(time) == 3, time[0].try_cast("double") * 3600 + time[1].try_cast("double") * 60 + time[2].try_cast("double"))
    return F.coalesce(F.when(by_clock > 0, by_clock), pairs["out_time_us"].try_cast("double") / 1e6, pairs["out_time_ms"].try_cast("double") / 1e6)


def cosine_table(size: int, kept: int) -> np.ndarray:
    return np.cos((2 * np.arange(size) + 1) * np.arange(kept)[:, None] * np.pi / (2 * size))


def phash(grey: np.ndarray, hash_size: int = 8) -> np.ndarray:
    """Perceptual hashes of grey square images (n, side, side): low DCT-II coefficients above their median, as signed words."""
    grey = np.asarray(grey, float).reshape(-1, *np.shape(grey)[-2:])
    table = cosine_table(grey.shape[-1], hash_size)
    scale = np.where(np.arange(hash_size) == 0, 1 / np.sqrt(2), 1.0)
    low = 0.25 * scale[:, None] * scale * (table @ grey @ table.T)
    flat = low.reshape(len(low), -1)
    rest = np.sort(flat[:, 1:], axis=1)
    median = rest[:, rest.shape[1] // 2]
    bits = (flat > median[:, None]).astype(np.uint64)
    weights = np.uint64(1) << np.arange(hash_size * hash_size - 1, -1, -1, dtype=np.uint64)
    return (bits * weights).sum(1, dtype=np.uint64).view(np.int64)
