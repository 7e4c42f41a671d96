"""Macro references and expansion; references are found by a pattern, expansion is a join per level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: %name, %{name}, %{?name}, %{!?name}, with %% set apart.
REFERENCE = r"%%|%\{([!?]*)([A-Za-z_]\w*)\}|%([A-Za-z_]\w*)"
#: Depth and lengths beyond which an expansion is given up.
DEPTH, BODY, OUTPUT = 8, 4_096, 65_536


def references(text: Column) -> Column:
    """Names of the macros that a text refers to, with repetition, in order."""
    plain = F.regexp_replace(text, "%%", "")
    return F.regexp_extract_all(plain, F.lit(r"%\{?[!?]*([A-Za-z_]\w*)"), 1)


def expand(bodies: DataFrame, macros: DataFrame) -> DataFrame:
    """(key, value) of bodies (key, profile_id, body) with the plain references %name and %{name} replaced by the profile's literal and raw macros.

    One join a level, up to DEPTH levels. The value is null where a reference stays unknown or conditional, is a shell or expression form,
    goes deeper, or a body or the output is too long.
    """
    m = macros.where(f"kind in ('literal', 'raw') and length(value) <= {BODY}").select("profile_id", "name", F.col("value").alias("own"))
    odd = F.col("body").rlike(r"%\(|%\[|%\{[!?]|%\{[A-Za-z_]\w*[:\s]|%\{\w*:")
    cur = bodies.select("key", "profile_id", F.when(~odd, F.col("body")).alias("body"))
    for _ in range(DEPTH):
        refs = cur.where("body is not null").select("key", "profile_id", F.explode(F.array_distinct(references(F.col("body")))).alias("name"))
        if refs.isEmpty():
            break
        found = refs.join(m, ["profile_id", "name"], "left").groupBy("key", "profile_id").agg(
            F.map_from_entries(F.collect_list(F.when(F.col("own").isNotNull(), F.struct("name", "own")))).alias("known"), F.count_if(F.col("own").isNull()).alias("unknown")
        )
        j = cur.join(found, ["key", "profile_id"], "left")
        # The text falls into pieces at references; each piece after the first starts with a name.
        marked = F.regexp_replace(F.regexp_replace(F.regexp_replace("body", "%%", "\u0001"), r"%\{([A-Za-z_]\w*)\}", "\u0002$1\u0003"), r"%([A-Za-z_]\w*)", "\u0002$1\u0003")
        pieces = F.split(marked, "\u0002")
        done = F.array_join(
            F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.element_at("known", F.substring_index(p, "\u0003", 1)), F.substring_index(p, "\u0003", -1)))), ""
        )
        back = F.regexp_replace(done, "\u0001", "%%")
        nxt = F.when(F.col("known").isNull(), F.col("body")).when((F.col("unknown") == 0) & (F.length(back) <= OUTPUT), back)
        odd_now = nxt.rlike(r"%\(|%\[|%\{[!?]|%\{[A-Za-z_]\w*[:\s]|%\{\w*:")
        cur = stored(j.select("key", "profile_id", F.when(~F.coalesce(odd_now, F.lit(False)), nxt).alias("body")), "macro-expansion")
    rest = F.size(references(F.col("body"))) > 0
    return cur.select("key", "profile_id", F.when(~rest, F.regexp_replace("body", "%%", "%")).alias("value"))
