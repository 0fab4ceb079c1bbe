"""Settings of the engine, and their JSON file."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from datetime import UTC, datetime
from pathlib import Path

#: Languages of the interface, by code.
LANGUAGES = ("ko", "en", "ja", "zh", "es", "fr", "de")
SORT_COLUMNS = ("drive", "name", "path", "size", "date", "kind")


@dataclass(frozen=True)
class EngineConfig:
    """Query-time settings; a new value and a new query replace any live toggling (nothing is kept in between)."""

    hide_hidden: bool = True
    hide_recycled: bool = True
    excluded_folders: tuple[str, ...] = ()
    include_removable: bool = False
    max_results: int | None = 1_000_000  # None: a search gives all its hits
    sort_column: str = "name"
    sort_ascending: bool = True
    time_zone: str = "UTC"
    language: str = "en"
    restore_last_search: bool = False
    last_search: str = ""
    pinned: tuple[str, ...] = ()
    history: tuple[str, ...] = ()
    now: datetime | None = field(default=None, compare=False)  # an injected clock, for relative dates

    def clock(self) -> datetime:
        return self.now or datetime.now(UTC)


def parse_excluded(text: str) -> tuple[str, ...]:
    """The excluded-folder setting: split on semicolons, trimmed, without empties."""
    return tuple(x.strip() for x in text.split(";") if x.strip())


def excluded_changed(old: tuple[str, ...], new: tuple[str, ...]) -> bool:
    return sorted(x.lower() for x in old) != sorted(x.lower() for x in new)


def load(path: str | Path) -> EngineConfig:
    """The settings in a file; defaults if it is missing or can't be read."""
    try:
        raw = json.loads(Path(path).read_text("utf-8"))
        known = {f.name for f in fields(EngineConfig)} - {"now"}
        return EngineConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known})
    except (OSError, ValueError, TypeError, AttributeError):
        return EngineConfig()


def save(config: EngineConfig, path: str | Path) -> bool:
    """Writes indented JSON; False if that isn't possible."""
    try:
        Path(path).write_text(json.dumps({k: v for k, v in asdict(config).items() if k != "now"}, indent=2, ensure_ascii=False), "utf-8")
        return True
    except OSError:
        return False


def toggle_pin(pinned: tuple[str, ...], query: str) -> tuple[str, ...]:
    """Unpins the query in any case, or pins it as the newest."""
    rest = tuple(q for q in pinned if q.lower() != query.lower())
    return rest if len(rest) < len(pinned) else (query, *pinned)


def remember(history: tuple[str, ...], query: str, most: int = 10) -> tuple[str, ...]:
    """The newest queries first, each once in any case."""
    return (query, *(q for q in history if q.lower() != query.lower()))[:most]


def forget(config: EngineConfig, query: str) -> EngineConfig:
    """Removes a query from history and pins."""
    keep = lambda xs: tuple(q for q in xs if q.lower() != query.lower())
    return EngineConfig(**{**{f.name: getattr(config, f.name) for f in fields(config)}, "history": keep(config.history), "pinned": keep(config.pinned)})
