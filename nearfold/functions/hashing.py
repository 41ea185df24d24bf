"""Digests that tell contents apart. The algorithm's name is kept beside each digest, and digests of different algorithms never compare."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

ALGORITHM = "sha256"
WINDOW = 65536


def full_hash(content: Column) -> Column:
    """Hex digest of the whole content; null for null."""
    return F.sha2(content.cast("binary"), 256)


def window_starts(size: Column) -> Column:
    """Ascending distinct starts of the windows: the beginning, the end, and a third, half and two thirds in."""
    last = size - F.lit(WINDOW)
    inner = [F.greatest(F.lit(0).cast("long"), F.least(F.floor(size * F.lit(f)).cast("long"), last)) for f in (1 / 3, 1 / 2, 2 / 3)]
    return F.when(size <= WINDOW, F.array(F.lit(0).cast("long"))).otherwise(F.array_sort(F.array_distinct(F.array(F.lit(0).cast("long"), last, *inner))))


def partial_hash(content: Column) -> Column:
    """Hex digest over the size and a few 64 KiB windows; the windows are the whole of a content that fits into one."""
    content = content.cast("binary")
    size = F.octet_length(content).cast("long")
    joined = F.aggregate(
        window_starts(size), size.cast("string").cast("binary"),
        lambda so_far, start: F.concat(so_far, F.substring(content, (start + 1).cast("int"), F.lit(WINDOW))),
    )
    return F.sha2(joined, 256)


def full_digest(path: str, piece: int = 1 << 20) -> str:
    """``full_hash`` of a file, read a piece at a time."""
    digest = hashlib.new(ALGORITHM)
    with open(path, "rb") as file:
        while part := file.read(piece):
            digest.update(part)
    return digest.hexdigest()


def partial_digest(path: str) -> str:
    """``partial_hash`` of a file, of which only the windows are read."""
    with open(path, "rb") as file:
        size = os.fstat(file.fileno()).st_size
        last = size - WINDOW
        starts = [0] if last <= 0 else sorted({0, last, *(max(0, min(int(size * f), last)) for f in (1 / 3, 1 / 2, 2 / 3))})
        digest = hashlib.new(ALGORITHM, str(size).encode())
        for start in starts:
            file.seek(start)
            digest.update(file.read(WINDOW))
    return digest.hexdigest()
