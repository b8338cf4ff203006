"""File paths as columns: POSIX semantics of joining, normalising and naming, and the keys by which a path may be listed."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonearm.functions.ids import basename


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fold(done: Column, part: Column, absolute: Column) -> Column:
    last = F.element_at(F.concat(F.array(F.lit("")), done), -1)
    shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    stays = (part != "..") | (last == "..") | ((last == "") & ~absolute)
    return F.when(stays, F.concat(done, F.array(part))).otherwise(shorter)


def normpath(c: Column | str) -> Column:
    """The path without empty and '.' segments and with '..' folded; '.' for nothing; null for null.

    Only paths that have something to fold go through the fold.
    """
    p = _c(c)
    absolute = F.startswith(p, F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: _fold(acc, x, absolute))
    body = F.array_join(folded, "/")
    slow = F.when(absolute, F.concat(F.lit("/"), body)).otherwise(F.when(body == "", ".").otherwise(body))
    return F.when(p.rlike(r"//|(^|/)\.{1,2}(/|$)|./$|^$"), slow).otherwise(p)


def abspath(c: Column | str, cwd: str = "/") -> Column:
    """The normalised path, relative ones taken from cwd."""
    p = _c(c)
    return normpath(F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit(cwd.rstrip("/") + "/"), p)))


def stem(c: Column | str) -> Column:
    """The last segment without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(basename(_c(c)), r"^(\.*[^.].*)\.[^.]*$", "$1")


def suffix(c: Column | str) -> Column:
    """The last suffix of the last segment with its dot, lower case; '' if there is none."""
    return F.lower(F.regexp_extract(basename(_c(c)), r"^\.*[^.].*(\.[^.]*)$", 1))


def strip_extension(c: Column | str) -> Column:
    """The path without its last suffix."""
    return F.regexp_replace(_c(c), r"(^|/)(\.*[^./][^/]*)\.[^./]*$", "$1$2")


def relpath(c: Column | str, root: Column | str) -> Column:
    """The path below root, or the normalised path itself where it isn't below root."""
    p, r = abspath(c), abspath(root)
    base = F.when(r == "/", r).otherwise(F.concat(r, F.lit("/")))
    return F.when(F.startswith(p, base), F.substr(p, F.length(base) + 1)).when(p == r, ".").otherwise(p)


def is_safe_member(c: Column | str) -> Column:
    """Whether an archive member stays below its root: relative, no '..'."""
    p = _c(c)
    return ~F.startswith(p, F.lit("/")) & ~F.array_contains(F.split(p, "/"), "..")


def candidate_keys(path: Column | str, rel: Column | str | None = None, cwd: str = "/") -> Column:
    """Keys of a path in order of priority: normalised, absolute, name, stem, then the same of the relative path; no repeats."""
    keys = []
    for v in (path, rel):
        if v is None:
            continue
        p = _c(v)
        given = F.array(normpath(p), abspath(p, cwd), basename(p), stem(p))
        keys.append(F.when(p.isNotNull() & (p != ""), given).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*keys))


def entry_keys(path: Column | str, roots: list[str] = (), cwd: str = "/") -> Column:
    """Keys under which a list of entries may name a file: absolute, as given, name, stem, and below each root with and without extension."""
    p = _c(path)
    below = [posixpath.normpath(posixpath.join(cwd, r)).rstrip("/") + "/" for r in roots]

    def of(whole: Column) -> Column:
        keys = [whole, normpath(p), basename(p), stem(p)]
        for r in below:
            rel = F.when(F.startswith(whole, F.lit(r)), F.substr(whole, F.lit(len(r) + 1))).otherwise(whole)
            keys += [rel, strip_extension(rel)]
        return F.array_distinct(F.array(*keys))

    return F.get(F.transform(F.array(abspath(p, cwd)), of), 0)
