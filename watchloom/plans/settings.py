"""Settings of a run: parsing, defaults, validation."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

DEFAULT_PORT = 9092


def cli_bool(text: str) -> bool:
    """Strict: anything that isn't a known word is an error."""
    word = text.strip().lower()
    if word in ("1", "true", "yes", "y", "on"):
        return True
    if word in ("0", "false", "no", "n", "off"):
        return False
    raise ValueError(f"not a boolean: {text!r}")


def config_bool(value: Any, default: bool = True) -> bool:
    """Lenient: a string is true unless it is 0, false, no or empty; other kinds of value give the default."""
    if isinstance(value, bool):
        return value
    return value.strip().lower() not in ("0", "false", "no", "") if isinstance(value, str) else default


def broker(entry: str) -> str:
    """host:port without a web scheme; the default port where none is given."""
    entry = entry.strip().rstrip("/")
    for scheme in ("http://", "https://"):
        if entry.lower().startswith(scheme):
            entry = entry[len(scheme) :].lstrip("/")
    return f"{entry}:{DEFAULT_PORT}" if entry and ":" not in entry else entry


def brokers(config: dict) -> str:
    raw = str(config.get("brokers") or config.get("bootstrap_servers") or "localhost")
    return ",".join(broker(p) for p in raw.split(",") if p.strip())


@dataclass(frozen=True)
class RunSettings:
    filter: bool = True
    detect: bool = False
    chunk: bool = True
    publish: bool = False
    site_id: str = ""
    camera_id: str = ""
    run_id: str = "run"
    app_id: int = 0
    stride: int = 4
    conf_delta: float = 0.15
    pad: int = 2
    max_gap: int = 30
    fps: float = 25.0
    chunk_seconds: float = 2.0
    audio_spikes: bool = False
    rms_z: float = 2.5
    delta_z: float = 2.5
    night_limit: float = 25.0
    sensitivity: str = "medium"
    extra: dict = field(default_factory=dict)

    @classmethod
    def of(cls, config: dict, **overrides: Any) -> RunSettings:
        """From a config and then from the given values; None leaves the config's."""
        known = {f.name for f in fields(cls)}
        base = cls(**{k: v for k, v in config.items() if k in known}, extra={k: v for k, v in config.items() if k not in known})
        return replace(base, **{k: v for k, v in overrides.items() if v is not None})

    def check(self) -> RunSettings:
        """Raises ValueError for what can't be run."""
        if not (self.filter or self.detect or self.chunk):
            raise ValueError("no stage is switched on")
        if self.publish and not self.chunk:
            raise ValueError("publishing needs chunks")
        if self.publish and not (self.site_id and self.camera_id):
            raise ValueError("publishing needs site_id and camera_id")
        if self.stride < 1 or self.max_gap < 1 or self.pad < 0 or self.fps <= 0 or self.chunk_seconds <= 0:
            raise ValueError("stride and max_gap are at least 1, pad at least 0, fps and chunk_seconds above 0")
        return self
