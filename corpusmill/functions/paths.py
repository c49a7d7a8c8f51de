"""Path columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A null separator would null the whole path, so every helper maps null to null and nothing else.


def normal_path(path: Column) -> Column:
    r"""Normal form: `\` read as `/`, no `.` and no empty segments, no trailing `/`; a leading `/` stays, null stays null."""
    slashed = F.translate(path, "\\", "/")
    body = F.array_join(F.filter(F.split(slashed, "/"), lambda s: (s != "") & (s != ".")), "/")
    return F.when(slashed.startswith("/"), F.concat(F.lit("/"), body)).otherwise(body)


def normal_hash(h: Column) -> Column:
    """Trimmed (any white space) and lower-cased; null where blank."""
    t = F.lower(F.regexp_replace(h, r"^\s+|\s+$", ""))
    return F.when(t != "", t)


def base_name(path: Column) -> Column:
    """Last `/` segment."""
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased suffix of the base name with its dot, '' where there is none (a leading dot is no suffix)."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))
