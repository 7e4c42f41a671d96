"""Versions, capabilities and small string functions as Columns; no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One capability test per operator tag.
OPERATORS = ("NONE", "EQ", "LT", "LE", "GT", "GE")


def _token_key(t: Column) -> Column:
    # Digits are below ":", what else a token may begin with is above; no pattern is matched for each token.
    digits = F.ltrim(t, F.lit("0"))
    return (
        F.when(t == "~", F.lit("0"))
        .when(t == "^", F.lit("2"))
        .when(t < ":", F.concat(F.lit("4"), F.lpad(F.length(digits).cast("string"), 5, "0"), digits))
        .otherwise(F.concat(F.lit("3"), t, F.lit("!")))
    )


def version_key(v: Column) -> Column:
    """A string whose byte order is the segment-wise order of versions: tilde < end < caret < letters < digits."""
    tokens = F.regexp_extract_all(v, F.lit(r"(~|\^|[0-9]+|[A-Za-z]+)"), 1)
    return F.concat(F.array_join(F.transform(tokens, _token_key), ""), F.lit("1"))


def evr_order(epoch: Column, version: Column, release: Column) -> Column:
    """The strict, total order of EVRs as a struct: sort by it, take its maximum."""
    return F.struct(epoch.alias("epoch"), version_key(version).alias("v"), version_key(release).alias("r"))


def _sign(a: Column, b: Column, rest: Column) -> Column:
    return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(rest)


def evr_key(epoch: Column, version: Column, release: Column) -> Column:
    """What satisfaction tests need of an EVR, computed once a row: put it in a column before a join, and compare with compatible_sign after it."""
    return F.struct(
        epoch.alias("e"), version_key(version).alias("v"), F.when(release != "", version_key(release)).alias("r"), version.startswith("set:").alias("s")
    )


def compatible_sign(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two evr_keys: two `set:` versions are equal, and an empty release on either side is any release.

    Not transitive, so never an ordering.
    """
    release = F.when(a["r"].isNull() | b["r"].isNull(), F.lit(0)).otherwise(_sign(a["r"], b["r"], F.lit(0)))
    return F.when(a["s"] & b["s"], F.lit(0)).otherwise(_sign(a["e"], b["e"], _sign(a["v"], b["v"], release)))


def compatible_compare(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """compatible_sign of two EVRs of one row."""
    return compatible_sign(evr_key(*a), evr_key(*b))


def constraint_holds(op: Column, sign: Column) -> Column:
    """Whether a provider that compares to the constraint's EVR with `sign` meets `op`; a null sign (an unversioned provide) meets only NONE."""
    # Bits of the signs -1, 0 and 1 that meet op: sign, a long expression, stands in the test once.
    met = F.when(op == "EQ", F.lit(0b010)).when(op == "LT", F.lit(0b001)).when(op == "LE", F.lit(0b011)).when(op == "GT", F.lit(0b100)).when(op == "GE", F.lit(0b110))
    return F.when(op == "NONE", F.lit(True)).otherwise(F.coalesce(F.getbit(met, sign + 1) == 1, F.lit(False)))


def evr_parse(s: Column) -> Column:
    """struct(epoch, version, release) of `[E:]V-R`; null on any other shape, an epoch beyond 32 bits included."""
    m = r"^(?:\+?([0-9]+):)?(.+)-([^-]+)$"
    raw = F.regexp_extract(s, m, 1)
    epoch = F.when(raw == "", F.lit("0")).otherwise(raw).try_cast("bigint")
    version = F.regexp_extract(s, m, 2)
    fine = s.rlike(m) & epoch.between(0, 4294967295) & (F.when(raw == "", ~version.contains(":")).otherwise(True))
    return F.when(fine, F.struct(epoch.alias("epoch"), version.alias("version"), F.regexp_extract(s, m, 3).alias("release")))


def evr_text(epoch: Column, version: Column, release: Column) -> Column:
    """`[E:]V[-R]`, an epoch of 0 and an empty release left out."""
    head = F.when(epoch > 0, F.concat(epoch.cast("string"), F.lit(":"))).otherwise("")
    return F.concat(head, version, F.when(release == "", F.lit("")).otherwise(F.concat(F.lit("-"), release)))


def nevra_text(name: Column, epoch: Column, version: Column, release: Column, arch: Column) -> Column:
    return F.concat(name, F.lit("-"), evr_text(epoch, version, release), F.lit("."), arch)


def capability_text(name: Column, op: Column, epoch: Column, version: Column, release: Column) -> Column:
    """`name [op evr]`."""
    sign = F.create_map(*(F.lit(x) for pair in zip(OPERATORS[1:], ("=", "<", "<=", ">", ">="), strict=True) for x in pair))
    return F.when((op == "NONE") | version.isNull(), name).otherwise(
        F.concat_ws(" ", name, sign[op], evr_text(F.coalesce(epoch, F.lit(0)), version, F.coalesce(release, F.lit(""))))
    )


def source_rpm_name(s: Column) -> Column:
    """Name part of `name-version-release.src.rpm` (or .nosrc.rpm); null on other shapes or beyond 512 bytes."""
    m = r"^(.+)-[^-]+-[^-]+\.(?:no)?src\.rpm$"
    return F.when(s.rlike(m) & (F.octet_length(s) <= 512), F.regexp_extract(s, m, 1))


def like_escaped(text: str) -> str:
    """A LIKE pattern that matches text literally, with a backslash as the escape."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def byte_size_text(n: Column) -> Column:
    """Bytes in the largest unit that fits, one decimal from KiB on."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        size = float(1 << 10 * i)
        out = F.when(n >= size, F.concat(F.format_number(n / size, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def spdx_atoms(expression: Column) -> Column:
    """License identifiers of an expression: what stands between AND, OR, WITH and parentheses."""
    parts = F.split(F.regexp_replace(expression, r"[()]", " "), r"(?i)\s+(?:and|or|with)\s+|\s*[,;]\s*")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
