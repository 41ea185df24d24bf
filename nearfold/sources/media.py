"""Decoders behind one interface: what turns files into durations and fingerprints, on the executors, with errors kept as rows.

A decoder is a plain object with ``duration(path)``, ``frames(path, times)`` (grey 32 x 32 arrays or
None), ``picture(path)`` (grey 32 x 32 array and mean colour) and ``words(path)`` (audio words). The
one here calls ffmpeg and ffprobe where they are installed; tests give their own.
"""

from __future__ import annotations

import json
import os
import shutil
import subprocess
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.media import media_type, phash

FINGERPRINT_VERSION = 2
#: Where in a video its fifteen frames are taken.
SAMPLE_POINTS = tuple(i / 16 for i in range(1, 16))
SIDE = 32
PRINTS = "path string, duration double, fingerprint array<long>, fingerprint_version int, image_fingerprint array<long>, audio_fingerprint array<long>, error string"


class Decoder(Protocol):
    def duration(self, path: str) -> float | None: ...
    def frames(self, path: str, times: list[float]) -> list[np.ndarray | None]: ...
    def picture(self, path: str) -> tuple[np.ndarray, tuple[int, int, int]] | None: ...
    def words(self, path: str) -> list[int] | None: ...


def resolved_binary(name: str) -> str | None:
    """An existing path as it is, else what the search path has."""
    return name if os.path.exists(name) else shutil.which(name)


class FfmpegDecoder:
    """Decoding by ffmpeg and ffprobe; anything that fails gives None."""

    def __init__(self, ffmpeg: str = "ffmpeg", ffprobe: str = "ffprobe"):
        self.ffmpeg, self.ffprobe = ffmpeg, ffprobe

    def available(self) -> bool:
        return bool(resolved_binary(self.ffmpeg) and resolved_binary(self.ffprobe))

    def _run(self, command: list[str], seconds: int) -> bytes | None:
        try:
            done = subprocess.run(command, capture_output=True, timeout=seconds, check=True)
        except (OSError, subprocess.SubprocessError):
            return None
        return done.stdout

    def duration(self, path: str) -> float | None:
        out = self._run([self.ffprobe, "-v", "error", "-show_entries", "format=duration", "-of", "json", path], 30)
        try:
            return float(json.loads(out)["format"]["duration"]) if out else None
        except (KeyError, ValueError):
            return None

    def _grey(self, source: list[str]) -> np.ndarray | None:
        out = self._run([self.ffmpeg, "-v", "error", *source, "-frames:v", "1", "-vf", f"scale={SIDE}:{SIDE}:flags=lanczos,format=gray", "-f", "rawvideo", "-"], 60)
        return np.frombuffer(out, np.uint8).reshape(SIDE, SIDE) if out and len(out) == SIDE * SIDE else None

    def frames(self, path: str, times: list[float]) -> list[np.ndarray | None]:
        return [self._grey(["-ss", f"{max(0.0, t):.3f}", "-i", path]) for t in times]

    def picture(self, path: str) -> tuple[np.ndarray, tuple[int, int, int]] | None:
        grey = self._grey(["-i", path])
        mean = self._run([self.ffmpeg, "-v", "error", "-i", path, "-frames:v", "1", "-vf", "scale=1:1:flags=lanczos,format=rgb24", "-f", "rawvideo", "-"], 60)
        return (grey, tuple(mean[:3])) if grey is not None and mean and len(mean) >= 3 else None

    def words(self, path: str) -> list[int] | None:
        out = self._run([self.ffmpeg, "-v", "error", "-i", path, "-f", "chromaprint", "-fp_format", "raw", "-"], 60)
        return np.frombuffer(out, "<u4").tolist() if out and len(out) % 4 == 0 else None


def video_words(decoder: Decoder, path: str, span: float, offset: float = 0.0) -> list[int] | None:
    """Fifteen frame hashes over a span; None where any frame is missing."""
    frames = decoder.frames(path, [offset + span * p for p in SAMPLE_POINTS])
    return None if any(f is None for f in frames) else phash(np.stack(frames)).tolist()


def image_words(decoder: Decoder, path: str) -> list[int] | None:
    picture = decoder.picture(path)
    return None if picture is None else [int(phash(picture[0])[0]), *(int(c) for c in picture[1])]


def _fingerprinted(decoder: Decoder, skip: set[str]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind in zip(batch["path"], batch["kind"]):
                row = dict.fromkeys(("duration", "fingerprint", "fingerprint_version", "image_fingerprint", "audio_fingerprint", "error"))
                try:
                    if kind in skip:
                        pass
                    elif kind == "image":
                        row["image_fingerprint"] = image_words(decoder, path)
                    else:
                        row["duration"] = decoder.duration(path)
                        if kind == "audio":
                            row["audio_fingerprint"] = decoder.words(path)
                        elif row["duration"] is not None:
                            row["fingerprint"] = video_words(decoder, path, row["duration"])
                            row["fingerprint_version"] = FINGERPRINT_VERSION if row["fingerprint"] is not None else None
                except Exception as error:  # noqa: BLE001 - a broken file must not end the task
                    row["error"] = f"{type(error).__name__}: {error}"
                rows.append({"path": path, **row})
            yield pd.DataFrame(rows, columns=["path", "duration", "fingerprint", "fingerprint_version", "image_fingerprint", "audio_fingerprint", "error"]).astype({"fingerprint_version": "Int32", "duration": "float64"}).astype(object).where(lambda d: d.notna(), None)

    return run


def fingerprints(files: DataFrame, decoder: Decoder, skip: set[str] = frozenset(), parts: int | None = None) -> DataFrame:
    """Durations and fingerprints of the media among ``files`` (path), decoded on the executors."""
    wanted = files.select("path", media_type(F.col("path")).alias("kind")).where("kind <> 'file'")
    wanted = wanted.repartition(parts) if parts else wanted.repartition("path")
    return wanted.mapInPandas(_fingerprinted(decoder, set(skip)), PRINTS)


def refingerprinter(decoder: Decoder) -> Callable:
    """For ``matching.realigned``: frames of a video over another span."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(words=[video_words(decoder, p, s, o) for p, s, o in zip(batch["path"], batch["span"], batch["offset"])])

    return run
