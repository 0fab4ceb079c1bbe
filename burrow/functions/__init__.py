"""Scalar functions as column builders; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BACKSLASH = "\\"
REF_BITS = (1 << 48) - 1
#: Extensions of programs, and limits and attribute bits of the file system.
PROGRAMS = ("exe", "msi", "bat", "cmd", "com", "ps1")
SHELL_PATH_LIMIT = 250
HIDDEN_BIT, SYSTEM_BIT = 0x2, 0x4
FILETIME_UNIX = 11_644_473_600_000_000
_KB, _MB, _GB = 1 << 10, 1 << 20, 1 << 30


def either(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def fold(text: Column) -> Column:
    return F.lower(text)


def extension(name: Column) -> Column:
    """What follows the last dot, folded; null if there is no dot or nothing follows it."""
    return F.nullif(F.lower(F.regexp_extract(name, r"[.]([^.]+)$", 1)), F.lit(""))


def size_text(size: Column) -> Column:
    """Bytes, whole KB, MB with one place, GB with two; empty for a negative size."""
    places = lambda unit, n: F.format_string(f"%.{n}f", F.round(size / F.lit(float(unit)), n))
    return (
        F.when(size < 0, "")
        .when(size < _KB, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < _MB, F.concat(places(_KB, 0), F.lit(" KB")))
        .when(size < _GB, F.concat(places(_MB, 1), F.lit(" MB")))
        .otherwise(F.concat(places(_GB, 2), F.lit(" GB")))
    )


def date_text(moment: Column, zone: str = "UTC") -> Column:
    """Local short date and time; empty if unknown."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(moment, zone), "yy-MM-dd HH:mm"), F.lit(""))


def file_name(path: Column) -> Column:
    return F.substring_index(path, BACKSLASH, -1)


def parent_folder(path: Column) -> Column:
    """The folder of a path; empty without one."""
    cut = F.length(path) - F.length(file_name(path)) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut)).otherwise("")


def shorten(text: Column, most: int) -> Column:
    """Head, ellipsis and tail of equal length if the text is longer than ``most``."""
    half = most // 2 - 1
    if half < 1:
        return text
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit("…"), F.right(text, F.lit(half))))


def leaf(path: Column, most: int = 50) -> Column:
    """The shortened last segment, trailing separators aside."""
    name = file_name(F.regexp_replace(path, r"\\+$", ""))
    return shorten(F.when(name == "", path).otherwise(name), most)


#: System folders whose content must not be deleted, and folders that must not be deleted themselves.
GUARDED_TREES = ("C:\\Windows", "C:\\Program Files", "C:\\Program Files (x86)", "C:\\ProgramData")
GUARDED_FOLDERS = ("C:\\Users",)


def dangerous(path: Column, trees: Iterable[str] = GUARDED_TREES, folders: Iterable[str] = GUARDED_FOLDERS) -> Column:
    """A drive's root; at or under a guarded tree; exactly a guarded folder."""
    p = F.lower(F.regexp_replace(path, r"[\\/]+$", ""))
    under = [(p == t.lower()) | F.startswith(p, F.lit(t.lower() + BACKSLASH)) for t in trees]
    return p.rlike("^.?:$") | either(under) | p.isin(*(f.lower() for f in folders))


def shell_unsafe(path: Column) -> Column:
    """Too long for the shell, or a last segment that ends in a space or dot."""
    return (F.length(path) >= SHELL_PATH_LIMIT) | file_name(F.regexp_replace(path, r"\\+$", "")).rlike("[ .]$")


#: Causes of failed deletions by error code.
CAUSES: Mapping[int, str] = {2: "NotFound", 3: "NotFound", 5: "AccessDenied", 32: "Locked", 33: "Locked", 123: "BadName", 145: "NotEmpty", 161: "BadName", 206: "BadName"}


def cause(code: Column, causes: Mapping[int, str] = CAUSES) -> Column:
    named = F.create_map(*(F.lit(x) for k, v in causes.items() for x in (k, v)))
    return F.when(code == 0, "None").otherwise(F.coalesce(F.try_element_at(named, code), F.lit("Other")))


_LONG, _LONG_UNC = "\\\\?\\", "\\\\?\\UNC\\"


def long_path(path: Column) -> Column:
    """With the long-path prefix, once; network paths get theirs."""
    starts = lambda s: F.startswith(path, F.lit(s))
    return F.when(starts(_LONG), path).when(starts("\\\\"), F.concat(F.lit(_LONG_UNC), F.substring(path, 3, 1 << 20))).otherwise(F.concat(F.lit(_LONG), path))


def plain_path(path: Column) -> Column:
    """Without the long-path prefix."""
    starts = lambda s: F.startswith(path, F.lit(s))
    return F.when(starts(_LONG_UNC), F.concat(F.lit("\\\\"), F.substring(path, len(_LONG_UNC) + 1, 1 << 20))).when(starts(_LONG), F.substring(path, len(_LONG) + 1, 1 << 20)).otherwise(path)


def is_program(name: Column) -> Column:
    return F.coalesce(extension(name).isin(*PROGRAMS), F.lit(False))


def csv_field(text: Column) -> Column:
    """Quoted only if the field holds a quote, comma or line feed."""
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def kind_code(is_dir: Column) -> Column:
    """0 for files, 1 for folders: files sort first."""
    return is_dir.cast("int")


def kind_label(is_dir: Column, folder: str = "폴더", file: str = "파일") -> Column:
    return F.when(is_dir, folder).otherwise(file)


def has_hangul(text: Column) -> Column:
    return text.rlike("[가-힣]")


def mask_ref(ref: Column) -> Column:
    return ref.bitwiseAND(F.lit(REF_BITS))


def localized(texts: Mapping[str, Mapping[str, str]], key: str, language: str) -> str:
    """In the language, else in English, else the key itself."""
    return texts.get(language, {}).get(key) or texts.get("en", {}).get(key) or key


def join_words(high: Column, low: Column) -> Column:
    """A 64-bit value from its halves; the low one is unsigned."""
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def shown_size(size: Column, is_dir: Column, stat_size: Column) -> Column:
    """The stored size; a file stored as empty shows a larger live size."""
    return F.when((size == 0) & ~is_dir, F.greatest(F.coalesce(stat_size, F.lit(0)), F.lit(0))).otherwise(size)


def icon_key(is_dir: Column, name: Column) -> Column:
    return F.when(is_dir, "folder").otherwise(F.coalesce(extension(name), F.lit("")))


def hidden_and_system(attributes: Column) -> Column:
    return (attributes.bitwiseAND(F.lit(HIDDEN_BIT)) != 0) & (attributes.bitwiseAND(F.lit(SYSTEM_BIT)) != 0)


def from_filetime(ticks: Column) -> Column:
    """100 ns ticks since 1601 as a timestamp; null if not positive."""
    return F.when(ticks > 0, F.timestamp_micros(F.floor(ticks.cast("decimal(20,0)") / 10).cast("long") - FILETIME_UNIX))


def drive_letters(mask: Column) -> Column:
    """The letters of the set bits of a unit mask."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(25)), lambda i: F.getbit(mask.cast("long"), i) == 1)
    return F.transform(bits, lambda i: F.char(i + 65))
