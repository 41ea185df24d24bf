"""Options of a run: defaults, a JSON or YAML file over them, then explicit settings; everything checked once."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from .functions.media import normalize_extensions

PROVIDERS = ("auto", "anthropic", "lmstudio", "none")
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")
THRESHOLDS = ("video_threshold", "image_threshold", "audio_threshold", "folder_threshold", "name_threshold")
# What the keys of a section mean where they are not named as the option is.
SECTIONS = {
    "reports": {"html": "output", "json": "json_output"},
    "video": {"skip": "skip_video"},
    "images": {"skip": "skip_images", "threshold": "image_threshold", "max_candidates": "max_image_candidates", "max_image_candidates": "max_image_candidates"},
    "audio": {"skip": "skip_audio", "threshold": "audio_threshold"},
    "matching": {
        "video": "video_threshold", "video_similarity": "video_threshold", "image": "image_threshold", "images": "image_threshold",
        "image_similarity": "image_threshold", "audio": "audio_threshold", "audio_similarity": "audio_threshold", "folder": "folder_threshold",
        "folder_similarity": "folder_threshold", "name": "name_threshold", "name_similarity": "name_threshold",
    },
    "cache": {"path": "cache"},
    "names": {},
}
#: Sections whose other keys are options as they are named; of the rest the section's name comes first, or (reports, cache) they are not read.
PLAIN = ("video", "matching", "names")


@dataclass
class Options:
    folders: list[str] = field(default_factory=list)
    output: str = "report.html"
    json_output: str = "report.json"
    cache: str = "nearfold-store"
    extensions: Any = None
    video_threshold: float = 85.0
    image_threshold: float = 90.0
    audio_threshold: float = 94.0
    folder_threshold: float = 50.0
    name_threshold: float = 92.0
    name_provider: str = "auto"
    lmstudio_url: str | None = None
    lmstudio_model: str | None = None
    workers: int = 4
    skip_video: bool = False
    skip_images: bool = False
    skip_audio: bool = False
    refresh_hashes: bool = False
    refresh_video: bool = False
    refresh_images: bool = False
    refresh_audio: bool = False
    refresh_names: bool = False
    max_video_candidates_per_bucket: int = 250
    max_image_candidates: int = 250
    inspect_cache: bool = False
    ffmpeg: str = "ffmpeg"
    ffprobe: str = "ffprobe"
    log_level: str = "INFO"

    def __post_init__(self):
        for name in THRESHOLDS:
            try:
                value = float(getattr(self, name))
            except (TypeError, ValueError):
                raise ValueError(f"{name} is not a number") from None
            if not (math.isfinite(value) and 0 <= value <= 100):
                raise ValueError(f"{name} is not within 0 and 100")
            setattr(self, name, value)
        try:
            self.workers = int(self.workers)
        except (TypeError, ValueError):
            raise ValueError("workers is not an integer") from None
        if not 1 <= self.workers <= 64:
            raise ValueError("workers is not within 1 and 64")
        for name, known in (("name_provider", PROVIDERS), ("log_level", LEVELS)):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} is none of {', '.join(known)}")
        self.extensions = normalize_extensions(self.extensions)
        for name in ("max_video_candidates_per_bucket", "max_image_candidates"):
            setattr(self, name, max(2, int(getattr(self, name))))


def flattened(config: Mapping[str, Any]) -> dict[str, Any]:
    """Sections of a configuration brought to option names."""
    out: dict[str, Any] = {}
    for key, value in config.items():
        key = key.replace("-", "_")
        if not isinstance(value, Mapping):
            out[key] = value
            continue
        names = SECTIONS.get(key)
        for inner, item in value.items():
            inner = inner.replace("-", "_")
            if names is not None and inner in names:
                out[names[inner]] = item
            elif key in PLAIN:
                out[inner] = item
            elif key not in ("reports", "cache"):
                out[f"{key}_{inner}"] = item
    if out.get("ai_names") is False:
        out["name_provider"] = "none"
    return out


def read_file(path: str) -> dict[str, Any]:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError:
            raise ValueError("YAML configurations need PyYAML") from None
        loaded = yaml.safe_load(text)
    else:
        loaded = json.loads(text)
    if not isinstance(loaded, dict):
        raise ValueError("a configuration is an object")
    return flattened(loaded)


def load(path: str | None = None, environment: Mapping[str, str] | None = None, **settings: Any) -> Options:
    """Options from a file and settings; settings that are None do not count. Unknown keys are ignored."""
    merged = {**(read_file(path) if path else {}), **{k: v for k, v in settings.items() if v is not None}}
    for option, variable in (("lmstudio_url", "LMSTUDIO_URL"), ("lmstudio_model", "LMSTUDIO_MODEL")):
        if not merged.get(option) and environment and environment.get(variable):
            merged[option] = environment[variable]
    known = {f.name for f in fields(Options)}
    return Options(**{k: v for k, v in merged.items() if k in known and v is not None})
