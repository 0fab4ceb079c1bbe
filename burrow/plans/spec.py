"""The search language: text to a QuerySpec. Plain values, made once on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from burrow.config import EngineConfig

#: Factors of size units, and the words of relative dates.
UNITS = {"B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}
RELATIVE = ("today", "week", "month", "year")
MOST_BYTES = 9.2e18
FOLDERS, FILES = "folder", "file"


@dataclass(frozen=True)
class QuerySpec:
    """What a query asks for. All parts hold together; extensions are alternatives."""

    text: tuple[str, ...] = ()
    extensions: frozenset[str] = frozenset()
    patterns: tuple[str, ...] = ()
    without_text: tuple[str, ...] = ()
    without_extensions: frozenset[str] = frozenset()
    paths: tuple[str, ...] = ()
    kind: str | None = None
    size_over: int | None = None
    size_under: int | None = None
    since: datetime | None = None  # UTC, inclusive
    until: datetime | None = None  # UTC, exclusive

    @property
    def selects(self) -> bool:
        """Whether it asks for anything: paths, kinds and exclusions alone don't."""
        bounds = (self.size_over, self.size_under, self.since, self.until)
        return bool(self.text or self.extensions or self.patterns or any(b is not None for b in bounds))


def tokens(query: str) -> list[str]:
    """Splits at spaces outside quotes; the quotes go."""
    out, quoted = [""], False
    for c in query:
        if c == '"':
            quoted = not quoted
        elif c == " " and not quoted:
            out.append("")
        else:
            out[-1] += c
    return [t for t in out if t]


def size_literal(text: str) -> int | None:
    """Digits and dots with a unit, as bytes; None if it isn't a size."""
    m = re.fullmatch(r"([0-9.]+)(\D.*)", text, re.DOTALL)
    if not m or (unit := UNITS.get(m[2].strip().upper())) is None:
        return None
    try:
        value = float(m[1]) * unit
    except ValueError:
        return None
    return int(value) if value <= MOST_BYTES else None


def date_literal(text: str, config: EngineConfig) -> datetime | None:
    """The first moment of a day, month, year or relative date of the configured zone, in UTC without a zone; None if it isn't a date."""
    text, zone = text.strip(), ZoneInfo(config.time_zone)
    day = None
    if (word := text.lower()) in RELATIVE:
        today = config.clock().astimezone(zone).replace(hour=0, minute=0, second=0, microsecond=0, tzinfo=None)
        if word == "year":
            day = today.replace(year=today.year - 1, day=28 if (today.month, today.day) == (2, 29) else today.day)
        else:
            day = today - timedelta(days={"today": 0, "week": 7, "month": 30}[word])
    else:
        parts = re.split(r"[-./]", text)
        if len(parts) > 3 or len(parts[0]) != 4 or not all(re.fullmatch(r"[0-9]+", p) for p in parts):
            return None
        try:
            day = datetime(*map(int, parts), *[1] * (3 - len(parts)))
        except ValueError:
            return None
        if not 1970 <= day.year <= 2999:
            return None
    return day.replace(tzinfo=zone).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)


def _least(a, b):
    return b if a is None else min(a, b)


def _most(a, b):
    return b if a is None else max(a, b)


def parse(query: str, config: EngineConfig = EngineConfig()) -> QuerySpec:
    """Reads tokens in order; the first rule that fits a token holds."""
    text, extensions, patterns, no_text, no_ext, paths = [], set(), [], [], set(), []
    found: dict = {}
    for t in tokens(query or ""):
        rest = t[1:]
        if rest and t[0] in "<>":
            size = size_literal(rest)
            when = None if size is not None else date_literal(rest, config)
            if size is not None:
                key, pick = ("size_over", _most) if t[0] == ">" else ("size_under", _least)
                found[key] = pick(found.get(key), size)
            elif when is not None:
                key, pick = ("since", _most) if t[0] == ">" else ("until", _least)
                found[key] = pick(found.get(key), when)
            else:
                text.append(t.lower())
        elif rest and t[0] == "-":
            if rest.startswith("*.") and len(rest) > 2:
                no_ext.add(rest[2:].lower())
            elif rest.startswith(".") and len(rest) > 1 and "\\" not in rest:
                no_ext.add(rest[1:].lower())
            else:
                no_text.append(rest.lower())
        elif t.lower() in ("folder:", "dir:", "file:"):
            found["kind"] = FILES if t.lower() == "file:" else FOLDERS
        elif "\\" in t or "/" in t:
            paths.append(t.replace("/", "\\"))
        elif t.startswith("*.") and len(t) > 2 and not re.search(r"[*?]", t[2:]):
            extensions.add(t[2:].lower())
        elif re.search(r"[*?]", t):
            patterns.append(t)
        elif t.startswith(".") and len(t) > 1:
            extensions.add(t[1:].lower())
        else:
            text.append(t.lower())
    return QuerySpec(tuple(text), frozenset(extensions), tuple(patterns), tuple(no_text), frozenset(no_ext), tuple(paths), **found)
