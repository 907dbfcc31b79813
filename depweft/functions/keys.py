"""Keys, paths and names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from depweft.functions import fixed


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def kind_of(key: Column) -> Column:
    return F.when(key.startswith("external:"), "external").when(key.startswith("iso:"), "iso").when(key.startswith("zip:"), "zip").otherwise("file")


def initial_status(key: Column) -> Column:
    return F.when(key.startswith("external:"), "external").otherwise("pending")


def relative(key: Column) -> Column:
    """Path below the root of a file: key; null for other keys."""
    return F.when(key.startswith("file:"), F.substring(key, F.lit(6), F.length(key)))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Folder of a path; '' at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def suffix(path: Column) -> Column:
    """Last ending in lower case; a name that only begins with a dot has none, nor one that ends in a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def normal_path(path: Column) -> Column:
    """Posix path without . and .. segments; null if it leads out of the root."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(
        steps,
        F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok")),
        lambda a, s: F.when(s != "..", F.struct(F.concat(a["p"], F.array(s)).alias("p"), a["ok"].alias("ok"))).otherwise(F.struct(F.slice(a["p"], 1, F.greatest(F.size(a["p"]) - 1, F.lit(0))).alias("p"), (a["ok"] & (F.size(a["p"]) > 0)).alias("ok"))),
    )
    return F.when(walked["ok"], F.array_join(walked["p"], "/"))


def likely_entrypoint(key: Column) -> Column:
    rel = relative(key)
    name = F.lower(base_name(rel))
    found = name.isin(fixed.ENTRY_FILES) | suffix(rel).isin(fixed.ENTRY_SUFFIXES) | any_of(*(rel.startswith(p) for p in fixed.ENTRY_PREFIXES))
    return F.coalesce(found, F.lit(False))


def like_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def section_name(key: Column) -> Column:
    """Heading under which a map shows a node."""
    parts = F.split(F.substring(key, F.lit(6), F.length(key)), "/")
    folder = F.substring(key, F.lit(5), F.length(key))
    deep = ((F.element_at(parts, 1) == "src") & F.get(parts, F.lit(1)).isin("assets", "content", "pages", "components")) | ((F.element_at(parts, 1) == "public") & (F.get(parts, F.lit(1)) == "images"))
    return (
        F.when(key.startswith("external:"), "external dependencies")
        .when(key.startswith("iso:") | key.startswith("zip:"), F.concat(F.left(F.substring_index(key, "!/", 1), F.lit(55)), F.lit(" / content")))
        .when(key == "dir:.", "project root")
        .when(key.startswith("dir:"), F.array_join(F.slice(F.split(folder, "/"), 1, 2), "/"))
        .when(~key.startswith("file:"), "other")
        .when(F.size(parts) < 2, "project root")
        .when(deep, F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(3), F.size(parts) - 1)), "/"))
        .otherwise(F.array_join(F.slice(parts, 1, 2), "/"))
    )


def note_name(key: Column) -> Column:
    """File name of a node's note: its last part, cleaned, and the start of its SHA-256."""
    short = F.translate(F.translate(base_name(key), "|\\:#", "----"), "[]", "")
    return F.concat(F.when(short == "", "unknown").otherwise(F.left(short, F.lit(65))), F.lit("-"), F.left(F.sha2(key, 256), F.lit(12)))


def rank_of(status: Column, order: list[str], unknown: int = 2) -> Column:
    out = F.lit(unknown)
    for i, s in enumerate(order):
        out = F.when(status == s, i).otherwise(out)
    return out


def status_of(rank: Column, order: list[str]) -> Column:
    """Status of a rank; a running one is shown as pending."""
    out = F.lit(None).cast("string")
    for i, s in enumerate(order):
        out = F.when(rank == i, "pending" if s == "running" else s).otherwise(out)
    return out
