"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a unit; plain letters are decimal, the i forms binary.
UNITS = {"": 1, "b": 1, "k": 10**3, "kb": 10**3, "m": 10**6, "mb": 10**6, "g": 10**9, "gb": 10**9, "t": 10**12, "tb": 10**12, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40}
#: Milliseconds of a unit; a bare number is milliseconds.
SPANS = {"": 1, "ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
#: Media types by extension.
MEDIA = {"txt": "text/plain", "md": "text/markdown", "html": "text/html", "css": "text/css", "csv": "text/csv", "js": "text/javascript", "json": "application/json", "xml": "application/xml", "pdf": "application/pdf", "zip": "application/zip", "gz": "application/gzip", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "mp3": "audio/mpeg", "mp4": "video/mp4", "wav": "audio/wav"}


def _lookup(values: dict, key: Column, default=None) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def _measure(text: Column, units: dict[str, int]) -> Column:
    t = F.lower(F.trim(text))
    number, unit = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)$", 1), F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)$", 2)
    return F.when(number != "", F.round(F.nullif(number, F.lit("")).cast("double") * _lookup(units, unit)).cast("bigint"))


def byte_size(text: Column) -> Column:
    """Bytes of ``1.5GiB``, ``20 mb``, ``512``; null if it isn't one."""
    return _measure(text, UNITS)


def duration_ms(text: Column) -> Column:
    return _measure(text, SPANS)


def show_bytes(n: Column) -> Column:
    """``512 B``, ``1.5 KiB`` and so on, one digit after the point."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, size in (("KiB", 2**10), ("MiB", 2**20), ("GiB", 2**30), ("TiB", 2**40)):
        out = F.when(n >= size, F.concat(F.round(n / size, 1).cast("decimal(20,1)").cast("string"), F.lit(" " + unit))).otherwise(out)
    return out


def backoff_seconds(attempts: Column) -> Column:
    """min(5 * 2^min(max(a - 1, 0), 6), 300)."""
    return F.least(F.lit(5) * F.pow(F.lit(2), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(6))), F.lit(300)).cast("bigint")


def host_label(name: Column) -> Column:
    """Other than letters, digits, ``-``, ``_`` and ``.`` becomes ``-``; outer ``.-_`` go; nothing left is unknown-host."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"[^A-Za-z0-9\-_.]", "-"), r"^[.\-_]+|[.\-_]+$", "")
    return F.when(clean == "", "unknown-host").otherwise(clean)


def media_type(path: Column) -> Column:
    return _lookup(MEDIA, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), "application/octet-stream")


def short_id(i: Column, n: int = 12) -> Column:
    return F.substring(i, 1, n)


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def xml_escape(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def percent(used: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(100)).otherwise(F.floor(used * 100 / F.nullif(total, F.lit(0)))).cast("bigint")


def relative_seconds(text: Column) -> Column:
    """Seconds back of ``10m``, ``2 hours ago``; null for words such as yesterday."""
    p = r"^([0-9]+)\s*(s|sec|secs|second|seconds|m|min|mins|minute|minutes|h|hr|hour|hours|d|day|days|w|week|weeks)(?:\s+ago)?$"
    t = F.lower(F.trim(text))
    unit = F.substring(F.regexp_extract(t, p, 2), 1, 1)
    return F.nullif(F.regexp_extract(t, p, 1), F.lit("")).cast("bigint") * _lookup({"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}, unit)


def absolute_time(text: Column) -> Column:
    """RFC 3339, ``yyyy-MM-dd HH:mm:ss`` or ``yyyy-MM-dd`` as a timestamp; null if none."""
    t = F.trim(text)
    return F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))


def canonical_alias(key: Column, host: str) -> Column:
    """Host-prefixed metadata keys; content-addressed keys are shared and stay."""
    shared = key.startswith("objects/") | key.startswith("packs/") | key.startswith("large/chunks/")
    return F.when(shared, key).otherwise(F.concat(F.lit(f"hosts/{host}/"), key))


def pick_large(size: Column, binary: Column, minimum: int, binary_minimum: int, always: Column, never: Column, enabled: bool = True) -> Column:
    """Disabled: no; never: no; always: yes; else by size, with a lower limit for binaries."""
    if not enabled:
        return F.lit(False)
    return F.when(never, False).when(always, True).otherwise((size >= minimum) | (binary & (size >= binary_minimum)))


def looks_binary(content: Column, head: int = 8192) -> Column:
    """A NUL among the first ``head`` characters or bytes."""
    return F.instr(F.substring(content, 1, head), "\x00") > 0


def payload_oid(payload: Column) -> Column:
    """The object id of a payload (struct of kind and oid); links, folders and special files have none."""
    return F.when(payload.kind.isin("blob", "object", "large", "large-object"), payload.oid)


def payload_key(payload: Column) -> Column:
    return F.when(payload.kind.isin("large", "large-object"), F.concat(F.lit("large/manifests/"), payload.oid)).when(payload.kind.isin("blob", "object"), F.concat(F.lit("objects/"), payload.oid))


def clock_time(text: Column, now: Column) -> Column:
    """The latest time at or before ``now`` with the clock time HH:MM or HH:MM:SS; null for other texts."""
    ok = text.rlike(r"^([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$")
    parts = F.transform(F.split(text, ":"), lambda x: x.cast("int"))
    seconds = F.when(ok, parts[0] * 3600 + parts[1] * 60 + F.coalesce(F.get(parts, 2), F.lit(0)))
    today = F.date_trunc("day", now)
    at = F.timestamp_seconds(F.unix_timestamp(today) + seconds)
    return F.when(at > now, F.timestamp_seconds(F.unix_timestamp(at) - 86400)).otherwise(at)


def loose_key(oid: Column) -> Column:
    return F.concat(F.lit("objects/"), F.substring(oid, 1, 2), F.lit("/"), oid)


def canonical_key(oid: Column) -> Column:
    return F.concat(F.lit("blobs/loose/"), F.substring(oid, 1, 2), F.lit("/"), oid)


def host_ref(host: Column, name: Column) -> Column:
    return F.concat(F.lit("hosts/"), host, F.lit("/refs/"), name)


def uri_escape(text: Column, keep_slash: bool = False) -> Column:
    """Percent-encoding of all bytes but letters, digits and ``-_.~``, and the slash if asked."""
    form = F.url_encode(text)  # the form encoding differs in three characters
    out = F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if keep_slash else out
