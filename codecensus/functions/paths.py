"""Path columns.  Separators are ``/``; semantics follow POSIX path functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules


def basename(path: Column) -> Column:
    """Text after the last slash."""
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Text before the last slash without trailing slashes; '' if there is no slash."""
    head = F.left(path, F.length(path) - F.length(basename(path)))
    bare = F.rtrim(head, F.lit("/"))
    return F.when(bare == "", head).otherwise(bare)


def extension(path: Column) -> Column:
    """Last dot-suffix of the file name; leading dots never start one (``.env`` has none)."""
    name = F.ltrim(basename(path), F.lit("."))
    return F.when(
        name.contains("."), F.concat(F.lit("."), F.substring_index(name, ".", -1))
    ).otherwise("")


def ends_with_any(value: Column, suffixes) -> Column:
    return any_of(value.endswith(s) for s in suffixes)


def contains_any(value: Column, needles) -> Column:
    return any_of(value.contains(s) for s in needles)


def any_of(conditions) -> Column:
    conditions = list(conditions)
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def language(path: Column, by_extension=None, by_name=None) -> Column:
    """Language label by whole file name, then by extension, then ``text``."""
    by_extension = rules.LANGUAGE_BY_EXTENSION if by_extension is None else by_extension
    by_name = rules.LANGUAGE_BY_NAME if by_name is None else by_name
    return F.coalesce(
        lookup(by_name, basename(path)),
        lookup(by_extension, F.lower(extension(path))),
        F.lit(rules.DEFAULT_LANGUAGE),
    )


def lookup(table: dict, key: Column) -> Column:
    """Constant-map lookup that stays inside generated code; null if the key is unknown."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def safe_path(path: Column) -> Column:
    """Path without characters a shell would interpret; spaces become single underscores."""
    cleaned = F.translate(path, " " + rules.UNSAFE_PATH_CHARS, "_")
    return F.regexp_replace(F.regexp_replace(cleaned, "_{2,}", "_"), "/{2,}", "/")


def repo_key(url: Column) -> Column:
    """Repository key: 16 hex digits of the digest of the normalised URL."""
    normal = F.regexp_replace(strip(F.lower(url)), "/+$", "")
    return F.substring(F.md5(normal.cast("binary")), 1, 16)


# white space of Unicode and the four separators U+001C to U+001F
WHITE = r"[\s\x1C-\x1F]+"


def strip(value: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.regexp_replace(value, rf"(?U)\A{WHITE}|{WHITE}\z", "")


def rstrip(value: Column) -> Column:
    return F.regexp_replace(value, rf"(?U){WHITE}\z", "")
