"""A QuerySpec as a Catalyst predicate over entries with paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from burrow.config import EngineConfig
from burrow.functions import BACKSLASH
from burrow.plans.spec import FOLDERS, QuerySpec

RECYCLED_NAME = r"^[$][RI][0-9A-Za-z]{6}([.]|$)"


def like_pattern(pattern: str) -> str:
    """``*`` any run, ``?`` one character, everything else literal; ``!`` escapes."""
    for c in "!%_":
        pattern = pattern.replace(c, "!" + c)
    return pattern.lower().replace("*", "%").replace("?", "_")


def _path(part: str) -> Column:
    path, part = F.lower("path"), part.lower()
    return F.startswith(path, F.lit(part)) if part[1:2] == ":" else F.contains(path, F.lit(part))


def drive_of(part: str) -> str | None:
    """The drive that a path filter fixes: entries of others needn't be read."""
    return part[:2].upper() if part[1:2] == ":" else None


def visible(config: EngineConfig) -> list[Column]:
    """What the settings hide: tombstones, hidden entries, the recycle bin, excluded folders and all below them."""
    out = [~F.col("is_deleted")]
    if config.hide_hidden:
        out.append(~F.col("hidden_effective"))
    if config.hide_recycled:
        out.append(~(F.col("in_recycle") | F.col("name").rlike(RECYCLED_NAME)))
    segments = F.concat(F.lower("path"), F.lit(BACKSLASH))
    out += [~F.contains(segments, F.lit(f"{BACKSLASH}{x.lower()}{BACKSLASH}")) for x in config.excluded_folders]
    return out


def matches(spec: QuerySpec) -> list[Column]:
    """The conditions of a spec, cheap ones first (Catalyst keeps their order within a filter)."""
    name, ext, out = F.col("name_lc"), F.col("ext_lc"), []
    if spec.kind:
        out.append(F.col("is_dir") == (spec.kind == FOLDERS))
    if not spec.text and not spec.patterns:
        out.append(~F.col("is_dir"))  # attributes alone never match folders
    if spec.size_over is not None:
        out.append(F.col("size") > spec.size_over)
    if spec.size_under is not None:
        out.append(F.col("size") < spec.size_under)
    if spec.since is not None:
        out.append(F.col("modified") >= F.lit(spec.since).cast("timestamp"))
    if spec.until is not None:  # an unknown date counts as the earliest
        out.append(F.col("modified").isNull() | (F.col("modified") < F.lit(spec.until).cast("timestamp")))
    if spec.extensions:
        out.append(ext.isin(*sorted(spec.extensions)))
    if spec.without_extensions:
        out.append(ext.isNull() | ~ext.isin(*sorted(spec.without_extensions)))
    out += [F.contains(name, F.lit(t)) for t in spec.text]
    out += [F.like(name, F.lit(like_pattern(p)), F.lit("!")) for p in spec.patterns]
    out += [~F.contains(name, F.lit(t)) for t in spec.without_text]
    fixed = {d for p in spec.paths if (d := drive_of(p))}
    if fixed:
        out.insert(0, F.upper("drive").isin(*sorted(fixed)) if len(fixed) == 1 else F.lit(False))
    return out + [_path(p) for p in spec.paths]


def predicate(spec: QuerySpec, config: EngineConfig) -> Column:
    if not spec.selects:
        return F.lit(False)
    return reduce(lambda a, b: a & b, visible(config) + matches(spec))
