"""Scalar functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tidemark import constants as K


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and in whatever lambda it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_bool(text: Column) -> Column:
    """The two literals; null for anything else (an error for the caller to count)."""
    return F.when(text == "True", True).when(text == "False", False)


def parse_int(text: Column, positive: bool = False) -> Column:
    """Canonical integers only: no sign, no leading zero, no space."""
    return F.when(text.rlike(r"\A[1-9][0-9]*\z" if positive else r"\A(0|[1-9][0-9]*)\z"), text.try_cast("bigint"))


def parse_decimal(text: Column, positive: bool = False) -> Column:
    value = text.try_cast("decimal(18,6)")
    return F.when((value > 0) if positive else (value >= 0), value)


def interaction_label(hate: Column, value: Column, actions: list[Column]) -> Column:
    """First match wins: hate, then a value above 3 or any positive action, else passive."""
    acted = F.lit(False)
    for a in actions:
        acted = acted | F.coalesce(a, F.lit(False))
    return F.when(hate, K.NEGATIVE).when(F.coalesce(value > K.POSITIVE_VALUE, F.lit(False)) | acted, K.POSITIVE).otherwise(K.PASSIVE)


def canonical_json(**fields: Column) -> Column:
    """A JSON object with sorted keys, nulls kept, and the line feed that belongs to the hashed bytes."""
    record = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.concat(F.to_json(record, {"ignoreNullFields": "false"}), F.lit("\n"))


def stable_id(prefix: str, **fields: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(canonical_json(**fields), 256))


def hex_mod(digest: Column, start: int, limbs: int, divisor: Column) -> Column:
    """``limbs`` 32-bit words of a hex digest, big-endian, modulo a divisor below 2^31."""
    value = F.lit(0).cast("bigint")
    for i in range(limbs):
        word = F.conv(F.substring(digest, start + 8 * i, 8), 16, 10).cast("bigint")
        value = (value * F.lit(1 << 32) + word) % divisor
    return value


def calendar_pair(epoch_seconds: Column) -> Column:
    """(yyyyMMdd, HH) in fixed UTC+8, whatever the session's zone."""
    at = F.timestamp_seconds(epoch_seconds + 8 * 3600)
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))
    return F.struct(F.date_format(utc, "yyyyMMdd").alias("date"), F.date_format(utc, "HH").alias("hour"))


def clip_unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def track_strength(supports: Column, age_ms: Column) -> Column:
    age = F.greatest(age_ms, F.lit(0)) / F.lit(float(K.DAY_MS))
    return clip_unit((1 - F.exp(-supports / 3.0)) * F.pow(F.lit(2.0), -age / K.HALF_LIFE_DAYS))


def persistence(times: Column) -> Column:
    return F.least(times / K.SATURATION, F.lit(1.0))


def _hidden(token: Column) -> Column:
    """A token up to where a file path starts in it, then <path>; the token itself where none does."""
    # between slashes: a path starts at a slash that stands behind no word character, if a name, another slash and more follow
    parts = F.split(token, "/")
    head = lambda i: F.array_join(F.slice(parts, 1, i), "/")
    rest = lambda i: F.array_join(F.slice(parts, i + 2, F.size(parts)), "/")
    last = lambda text: F.substring(text, -1, 1)
    word = lambda c: (c == "_") | c.between("0", "9") | c.between("A", "Z") | c.between("a", "z")
    slashes = F.filter(F.sequence(F.lit(1), F.size(parts) - 2), lambda i: ~word(last(F.element_at(parts, i))) & (F.element_at(parts, i + 1) != "") & (rest(i) != ""))
    posix = F.when(F.size(parts) > 2, F.array_min(F.transform(slashes, lambda i: F.length(head(i)))))
    # between colons: a drive is the letter before one, if a slash of either kind and more follow
    fields = F.split(token, ":")
    letter = lambda c: c.between("A", "Z") | c.between("a", "z")
    behind = lambda i: F.array_join(F.slice(fields, i + 1, F.size(fields)), ":")
    colons = F.filter(F.sequence(F.lit(1), F.size(fields) - 1), lambda i: letter(last(F.element_at(fields, i))) & F.substring(behind(i), 1, 1).isin("/", "\\") & (F.length(behind(i)) > 1))
    drive = F.when(F.size(fields) > 1, F.array_min(F.transform(colons, lambda i: F.length(F.array_join(F.slice(fields, 1, i), ":")) - 1)))
    start = F.least(posix, drive)  # null only where both are
    return F.when(start.isNull(), token).otherwise(F.concat(F.substring(token, F.lit(1), start), F.lit("<path>")))


def sanitize_message(text: Column) -> Column:
    """Tokens between white space, file paths in them hidden, joined by one space, at most 500 characters."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.substring(F.array_join(F.transform(tokens, _hidden), " "), 1, 500)


def semantic_text(title: Column, tags: Column, categories: Column) -> Column:
    """Up to three labelled lines; absent parts are left out; null when none is there."""
    line = lambda label, col: F.when(F.length(F.coalesce(col, F.lit(""))) > 0, F.concat(F.lit(label), col))
    text = F.concat_ws("\n", line("标题：", title), line("标签：", F.array_join(tags, "、")), line("类目：", F.array_join(categories, "；")))
    return F.when(text != "", text)


def padded(history: Column, length: int = K.MAX_HISTORY) -> Column:
    """The last ``length`` entries, zeros in front."""
    recent = F.slice(history, F.greatest(F.size(history) - (length - 1), F.lit(1)), F.lit(length))
    return F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.lit(length) - F.size(recent)), recent)


def portable_path_problem(path: str) -> str | None:
    """Why a relative artifact path is not portable, or None."""
    import unicodedata

    reserved = {"con", "prn", "aux", "nul", *(f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10))}
    if not path or unicodedata.normalize("NFC", path) != path:
        return "empty or not NFC"
    if any(unicodedata.category(c) == "Cc" for c in path):
        return "a control character"
    if path.startswith("/") or "\\" in path or ":" in path:
        return "not a relative POSIX path"
    for part in path.split("/"):
        if part in ("", ".", ".."):
            return "empty or dot segment"
        if part.split(".")[0].lower() in reserved or part[-1] in " .":
            return "reserved name"
    return None
