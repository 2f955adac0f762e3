"""Vendor profiles: checking them and applying them to a source table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from girthline import vocab
from girthline.functions import units
from girthline.functions.clock import with_hh_mm
from girthline.functions.text import map_values, norm_plain
from girthline.operators.scan import chunk_of, numbered


def normalised_mappings(mappings: Mapping[str, str]) -> dict[str, str]:
    """Field aliases resolved; a name that is no field raises."""
    out = {}
    for field, source in mappings.items():
        canonical = vocab.PROFILE_ALIASES.get(field, field)
        if canonical not in vocab.PROFILE_FIELDS:
            raise ValueError(f"{field!r} is not a canonical field")
        out[canonical] = source
    return out


def mapping_rows(profiles: DataFrame) -> DataFrame:
    """(profile_id, canonical, source_column) of all profiles, aliases resolved."""
    aliases = F.create_map(*[F.lit(x) for pair in vocab.PROFILE_ALIASES.items() for x in pair])
    rows = profiles.select("profile_id", F.explode("column_mappings").alias("field", "source_column"))
    return rows.withColumn("canonical", F.coalesce(F.try_element_at(aliases, F.col("field")), F.col("field")))


def profile_problems(profiles: DataFrame) -> DataFrame:
    """One row per problem of a profile (profile_id, problem, detail)."""
    rows = mapping_rows(profiles)
    unknown = rows.where(~F.col("canonical").isin(*vocab.PROFILE_FIELDS)).select(
        "profile_id", F.lit("unknown_field").alias("problem"), F.col("field").alias("detail")
    )
    # A profile with an unknown field maps nothing, so all required fields are missing from it.
    sound = rows.join(unknown.select("profile_id").distinct(), "profile_id", "left_anti")
    have = sound.groupBy("profile_id").agg(F.collect_set("canonical").alias("_have"))
    named = profiles.join(have, "profile_id", "left").withColumn("_have", F.coalesce("_have", F.array().cast("array<string>")))
    has = lambda f: F.array_contains("_have", f)
    missing = F.array_except(F.array(*[F.lit(f) for f in vocab.PROFILE_REQUIRED]), F.col("_have"))
    no_depth = F.when(~has("depth_pct_wt") & ~has("depth_mm"), F.array(F.lit("depth_pct_wt | depth_mm")))
    keys = F.array_except(F.map_keys("unit_conventions"), F.array(*[F.lit(k) for k in vocab.PROFILE_UNIT_KEYS]))

    def problem(name: str, details) -> DataFrame:
        return named.select("profile_id", F.lit(name).alias("problem"), F.explode(details).alias("detail"))

    return (
        unknown
        .unionByName(problem("missing_field", F.concat(missing, F.coalesce(no_depth, F.array().cast("array<string>")))))
        .unionByName(problem("depth_needs_wall", F.when(has("depth_mm") & ~has("wt_mm"), F.array(F.lit("wt_mm")))))
        .unionByName(problem("vendor_name_empty", F.when(F.trim("vendor_name") == "", F.array(F.lit("")))))
        .unionByName(problem("header_row_negative", F.when(F.col("header_row") < 0, F.array(F.col("header_row").cast("string")))))
        .unionByName(problem("unknown_unit_key", keys))
    )


def with_units(df: DataFrame, fields: list[str], conventions: Mapping[str, str]) -> DataFrame:
    """Canonical units for the fields present; the columns already carry canonical names."""
    unit = {**vocab.DEFAULT_UNITS, **conventions}
    col = F.col
    steps = {}
    for field, key, factors in (
        ("abs_distance_m", "chainage", vocab.CHAINAGE_FACTORS), ("upstream_weld_dist_m", "upstream_weld_dist", vocab.CHAINAGE_FACTORS),
        ("joint_length_m", "joint_length", vocab.JOINT_LENGTH_FACTORS), ("wt_mm", "wall_thickness", vocab.WALL_FACTORS),
        ("length_mm", "length", vocab.SIZE_FACTORS), ("width_mm", "width", vocab.SIZE_FACTORS), ("altitude_m", "altitude", vocab.ALTITUDE_FACTORS),
    ):
        if field in fields:
            steps[field] = units.scaled(col(field), unit[key], factors)
    df = df.withColumns(steps) if steps else df
    wall = col("wt_mm") if "wt_mm" in fields else F.lit(None).cast("double")
    if "depth_pct_wt" in fields:
        df = df.withColumn("depth_pct_wt", units.depth_to_pct(col("depth_pct_wt"), unit["depth"], wall))
    elif "depth_mm" in fields:
        if "wt_mm" not in fields:
            raise ValueError("depth in millimetres needs a mapped wall thickness")
        df = df.withColumn("depth_pct_wt", units.depth_to_pct(col("depth_mm"), "mm", wall)).drop("depth_mm")
    if "clock_position" in fields:
        df = with_hh_mm(df, "clock_position", "clock_position", unit["clock"])
    return df


def apply_profile(
    df: DataFrame, mappings: Mapping[str, str], conventions: Mapping[str, str] | None = None,
    values: Mapping[str, Mapping[str, str]] | None = None, keep: tuple[str, ...] = (), rows_per_chunk: int = 65_536,
) -> DataFrame:
    """A vendor table under canonical output names, units and values, in output order.

    ``df`` has a ``file`` and a ``source_row`` beside the vendor columns. Rows without a mapped identifier get
    ``A-000001`` and so on in row order of their file.
    """
    fields = normalised_mappings(mappings)
    absent = [f"{f} -> {s!r}" for f, s in fields.items() if s not in df.columns]
    if absent:
        raise KeyError("profile names columns the file does not have: " + "; ".join(absent))
    base = ["file", "source_row", *keep]
    rows = df.select(*base, *[F.col(f"`{s}`").alias(f) for f, s in fields.items()])
    present = list(fields)
    rows = with_units(rows, present, conventions or {})
    for field, table in (values or {}).items():
        canonical = vocab.PROFILE_ALIASES.get(field, field)
        if canonical in rows.columns and table:
            keys = F.create_map(*[x for k, v in table.items() for x in (norm_plain(F.lit(k)), F.lit(v))])
            rows = rows.withColumn(canonical, map_values(F.col(canonical), keys))
    if "anomaly_id" not in present:
        rows = numbered(rows, ["file"], ["source_row"], chunk_of(F.col("source_row"), rows_per_chunk), "_n")
        rows = rows.withColumn("anomaly_id", F.format_string("A-%06d", F.col("_n")))
    return rows.select(*base, *[F.col(c).alias(title) for c, title in vocab.OUTPUT_COLUMNS if c in rows.columns])


def apply_registry_profile(df: DataFrame, mappings: Mapping[str, str], conventions: Mapping[str, str] | None = None) -> DataFrame:
    """A joint registry under canonical names; a feature type column is carried through."""
    fields = normalised_mappings(mappings)
    kind = next((c for c in df.columns if c.strip().lower() in ("feature type", "feature_type")), None)
    rows = df.select(
        "file", "source_row", *[F.col(f"`{s}`").alias(f) for f, s in fields.items()],
        *([F.col(f"`{kind}`").cast("string").alias("Feature Type")] if kind else []),
    )
    rows = with_units(rows, list(fields), conventions or {})
    titles = [F.col(c).alias(t) for c, t in vocab.OUTPUT_COLUMNS if c in rows.columns]
    return rows.select("file", "source_row", *titles, *(["Feature Type"] if kind else []))
