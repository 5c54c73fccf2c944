"""Paths of shards: schemes, buckets and names, on the driver and as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemes that a path may have; the first go through a connector, `file` and none are local.
REMOTE, WEB = ("gs", "s3a", "abfs", "hdfs", "viewfs"), ("http", "https", "ftp")


def resolve(path: str) -> tuple[str, str]:
    """(kind, path for Spark's readers): connector paths stay, local ones get file://, web ones are for addFile."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?=/|[^\\])(.*)", path)
    if not m:
        return "local", path
    scheme = m[1].lower()
    if scheme == "file":
        return "local", "file://" + re.sub(r"^//", "", m[2])
    if scheme in REMOTE:
        if not re.match(r"//[^/]+/.+", m[2]):
            raise ValueError(f"{path} names no bucket and object")
        return "connector", path
    if scheme in WEB:
        return "web", path
    raise ValueError(f"{scheme} is no known scheme")


def scheme(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def bucket_and_name(path: Column) -> tuple[Column, Column]:
    """The part up to the first slash after the scheme, and the rest."""
    rest = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    parts = F.split(rest, "/", 2)
    return F.get(parts, 0), F.get(parts, 1)


def last_element(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def glob_pattern(glob: str) -> str:
    """A regular expression for whole names that match a glob of *, ? and character sets."""
    out = ""
    for part in re.findall(r"\*|\?|\[[^\]]*\]|[^*?\[]+|\[", glob):
        out += {"*": ".*", "?": "."}.get(part) or (part.replace("[!", "[^", 1) if part.endswith("]") and part[0] == "[" else re.escape(part))
    return f"^(?s:{out})$"


def any_glob(name: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | name.rlike(glob_pattern(g))
    return hit
