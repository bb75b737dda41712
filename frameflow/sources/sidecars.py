"""Sidecar text as a column: reading owned fields, planning and rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P


NAMESPACES = {"x": "adobe:ns:meta/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
              "xmp": "http://ns.adobe.com/xap/1.0/"}


def empty_sidecar() -> str:
    """A sidecar with one description and no fields."""
    def name(prefix: str) -> str:
        return f'xmlns:{prefix}="{NAMESPACES[prefix]}"'
    inner = f'<rdf:Description rdf:about="" {name("xmp")}/>'
    return f'<x:xmpmeta {name("x")}><rdf:RDF {name("rdf")}>{inner}</rdf:RDF></x:xmpmeta>\n'


def _first(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def sidecar_state(text: Column) -> dict[str, Column]:
    return {
        "old_rating": _first(text, P.RATING_PATTERN).try_cast("int"),
        "old_label": _first(text, P.LABEL_PATTERN),
        "has_develop": F.coalesce(text.rlike(P.DEVELOP_PATTERN), F.lit(False)),
    }


def export_candidates(entries: DataFrame, photos: DataFrame, libraries: DataFrame, key: str = "photo_id") -> DataFrame:
    """(key, path, state) of picks and alternates with their full path.

    entries: key, state. photos: key, library_id, rel_path. libraries: library_id, root.
    """
    wanted = entries.where(F.col("state").isin(*P.STATE_RATING)).select(key, "state")
    placed = photos.select(key, "library_id", "rel_path").join(libraries.select("library_id", "root"), "library_id")
    path = F.concat(F.rtrim(F.col("root"), F.lit("/")), F.lit("/"), F.col("rel_path"))
    return wanted.join(placed, key).select(key, path.alias("path"), "state")


def plan_export(entries: DataFrame, sidecars: DataFrame, *, path: str = "path",
                pick_label: str = P.PICK_LABEL) -> DataFrame:
    """What writing each pick and alternate would do.

    entries: path, state. sidecars: sidecar_path, text. `action` is skipped_dng,
    new, unchanged, conflict (develop settings present) or update.
    """
    state = F.col("state")
    rows = entries.where(state.isin(*P.STATE_RATING)).withColumns({
        "sidecar_path": F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".xmp")),
        "new_rating": F.when(state == "pick", P.STATE_RATING["pick"]).otherwise(P.STATE_RATING["alt"]),
        "new_label": F.when(state == "pick", pick_label),
    })
    joined = rows.join(sidecars.select("sidecar_path", "text"), "sidecar_path", "left")
    joined = joined.withColumns(sidecar_state(F.col("text")))
    same = (F.col("old_rating").eqNullSafe(F.col("new_rating"))
            & F.col("old_label").eqNullSafe(F.col("new_label")))
    action = (F.when(F.lower(path).endswith(".dng"), "skipped_dng")
              .when(F.col("text").isNull(), "new").when(same, "unchanged")
              .when(F.col("has_develop"), "conflict").otherwise("update"))
    return joined.withColumn("action", action)


def writable(plan: DataFrame, confirm_conflicts: bool = False) -> DataFrame:
    """Rows to write; conflicts only when confirmed."""
    actions = ["new", "update"] + (["conflict"] if confirm_conflicts else [])
    return plan.where(F.col("action").isin(*actions))


def export_texts(plan: DataFrame, confirm_conflicts: bool = False) -> DataFrame:
    """Rows to write with `new_text`: the rewritten sidecar, or a filled empty one."""
    text = F.coalesce("text", F.lit(empty_sidecar()))
    rows = writable(plan, confirm_conflicts)
    return rows.withColumn("new_text", rewrite_sidecar(text, F.col("new_rating"), F.col("new_label")))


def _set_field(text: Column, pattern: str, attribute: Column) -> Column:
    """Replace the first match, else insert into the first description tag."""
    found = F.regexp_substr(text, F.lit(pattern))
    at = F.instr(text, found)
    replaced = F.concat(F.substr(text, F.lit(1), at - 1), attribute,
                        F.substr(text, at + F.length(found)))
    tag = F.regexp_substr(text, F.lit(P.DESCRIPTION_PATTERN))
    closing = F.when(tag.endswith("/>"), 2).otherwise(1)  # a tag may close itself
    end = F.instr(text, tag) + F.length(tag) - closing
    inserted = F.concat(F.substr(text, F.lit(1), end - 1), F.lit("\n    "), attribute,
                        F.substr(text, end))
    return F.when(found.isNotNull(), replaced).otherwise(inserted)


def rewrite_sidecar(text: Column, rating: Column, label: Column) -> Column:
    """Set the owned fields and keep every other character.

    NULL when a field must be inserted and there is no description tag.
    """
    attribute = F.concat(F.lit('xmp:Rating="'), rating.cast("string"), F.lit('"'))
    rated = F.when(rating.isNull(), text).otherwise(_set_field(text, P.RATING_PATTERN, attribute))
    safe = label
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        safe = F.replace(safe, F.lit(sign), F.lit(name))
    named = F.concat(F.lit('xmp:Label="'), safe, F.lit('"'))
    return F.when(label.isNull(), rated).otherwise(_set_field(rated, P.LABEL_PATTERN, named))
