"""Paths, pathspecs and glob rules as column expressions; patterns become regular expressions on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_spec(spec: str) -> str:
    """Without leading ``./`` and trailing ``/``."""
    while spec.startswith("./"):
        spec = spec[2:]
    return spec.rstrip("/")


def under(path: Column, top: str) -> Column:
    """Equal to ``top`` or below it, by whole components; an empty top holds everything."""
    top = normal_spec(top)
    if top in ("", "."):
        return F.lit(True)
    return (path == top) | path.startswith(top + "/")


def matches_specs(path: Column, specs: list[str]) -> Column:
    """Under any of the specs; no specs match everything."""
    out = F.lit(not specs)
    for s in specs:
        out = out | under(path, s)
    return out


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob: ``**`` crosses components, ``*`` and ``?`` don't.

    ``*.ext`` matches the extension at any depth without regard to case, ``dir/**`` also the directory itself,
    ``**/x/**`` the component x anywhere; a pattern without wildcards is a literal prefix by components.
    """
    if pattern in ("**", "*"):
        return "(?s)^.*$"
    if re.fullmatch(r"\*\.[^*?/]+", pattern):
        return f"(?is)^.*{re.escape(pattern[1:])}$"
    if not re.search(r"[*?]", pattern):
        return f"(?s)^{re.escape(pattern.strip('/'))}(/.*)?$"
    head, tail = "", ""
    body = pattern
    if body.startswith("**/"):
        head, body = "(.*/)?", body[3:]
    if body.endswith("/**"):
        tail, body = "(/.*)?", body[:-3]
    out = ""
    for token in re.findall(r"\*\*/?|\*|\?|[^*?]+", body):
        out += {"**": ".*", "**/": "(.*/)?", "*": "[^/]*", "?": "[^/]"}.get(token) or re.escape(token)
    return f"(?s)^{head}{out}{tail}$"


def matches_globs(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(glob_regex(p))
    return out


def expand_exclude(pattern: str) -> list[str]:
    """A directory's content and the directory, with and without a leading place."""
    out = [pattern]
    if pattern.endswith("/**"):
        top = pattern[:-3]
        out.append(top)
        if top.startswith("**/"):
            out += [top[3:], "/" + top[3:]]
    return list(dict.fromkeys(out))


def managed(path: Column, include: list[str], exclude: list[str], track: list[str] = (), untrack: list[str] = (), volatile: list[str] = ()) -> Column:
    """Explicit untrack, then explicit track, then include, volatile and exclude.

    An exclude wins over a broad include; an include that names a path below a directory wins over an exclude.
    """
    close = [p for p in include if p not in ("**", "*") and not re.fullmatch(r"\*\.[^*?/]+", p)]
    excluded = matches_globs(path, [e for p in exclude for e in expand_exclude(p)])
    listed = lambda ps: matches_specs(path, list(ps)) | matches_globs(path, list(ps)) if ps else F.lit(False)
    return (
        F.when(listed(untrack), False)
        .when(listed(track), True)
        .when(~matches_globs(path, include), False)
        .when(matches_globs(path, list(volatile)), False)
        .when(excluded & ~matches_globs(path, close), False)
        .otherwise(True)
    )


def deepest_root(roots: list[str], path: Column) -> Column:
    """The longest of ``roots`` that holds the path, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(set(roots), key=lambda x: (len(x), x)):
        out = F.when(under(path, r), F.lit(r)).otherwise(out)
    return out


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def valid_key(key: Column) -> Column:
    """Non-empty, relative, without backslash and without empty, ``.`` or ``..`` parts."""
    return F.coalesce((key != "") & ~key.contains("\\") & ~F.exists(F.split(key, "/"), lambda p: p.isin("", ".", "..")), F.lit(False))


def valid_branch(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[^\s/\\]+$") & ~name.contains("..") & ~name.isin(".", "HEAD", "current", "current-branch", "last-synced"), F.lit(False))
