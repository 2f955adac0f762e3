"""Raw vendor text rows derived from the test tables, with the irregularities real tallies have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from girthline import vocab
from girthline.sources.tables import JOINTS_PER_LINE, base, table


def _tenths(n: Column) -> Column:
    n = n.cast("long")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def _lpad(n: Column, width: int) -> Column:
    return F.lpad(n.cast("long").cast("string"), width, "0")


def _wall(ok: Column) -> Column:
    return F.when(ok % 3 == 0, "6.4").when(ok % 3 == 1, "7.1").otherwise("8.7")


def _full(df: DataFrame, **columns: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    return df.select(
        F.floor(F.col("ok") / JOINTS_PER_LINE).cast("int").alias("line_id"),
        F.lit("run_2").alias("run_id"),
        columns["sheet_ord"].alias("sheet_ord"),
        columns["source_row"].alias("source_row"),
        *[columns.get(c, null).alias(c) for c in vocab.ALL_FIELDS],
    )


def raw_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One text column per canonical field; defect sheet with weld and blank rows, and a registry sheet.

    Every fourth line lists its anomalies in a block after the welds, so its rows are out of chainage order.
    """
    ok, ln, pk, sk = (F.col(c) for c in ("ok", "ln", "pk", "sk"))
    place, line = ok % JOINTS_PER_LINE, F.floor(ok / JOINTS_PER_LINE)
    block = F.when(line % 4 == 3, 10_000_000).otherwise(0)
    minutes, n16 = pk % 720, (F.col("q") * 16).cast("long")
    mm100 = F.floor(F.col("ep") * 100 / 180).cast("long")
    # Numbers written alike go through one expression: written out, the code of a row outgrows what the JVM compiles.
    pct, chainage, weld, twelfth = (F.get("_tenths", F.lit(i)) for i in range(4))
    depth = (
        F.when(pk % 107 == 0, "").when(pk % 103 == 0, "120")
        .when(ok % 3 == 0, F.concat(pct, F.lit("%")))
        .when(ok % 5 == 1, F.concat(F.lit("0."), _lpad(n16, 3)))
        .otherwise(pct)
    )
    time = F.concat(_lpad(F.floor(minutes / 60), 2), F.lit(":"), _lpad(minutes % 60, 2))
    sign = F.when(ok % 5 == 0, ",").otherwise(".")
    kind = sk % 20
    fid = (
        F.when(pk % 89 == 0, None).when(pk % 97 == 0, "weld blister")
        .when(kind == 0, F.when(ln % 2 == 0, "DENP").otherwise("Dent"))
        .when(kind == 1, "Crack").when(kind == 2, "Corrosion Cluster").when(kind == 3, "strange mark").otherwise("Corrosion")
    )
    dims = ("Circumferential Grooving", "CISL", "Axial grooving", "axsl", "Pitting", "PINH", "General", "n/a")
    north = F.concat((20 + line % 10).cast("string"), F.lit("."), _lpad(ok % 1000, 3))
    east = F.concat((F.when(line % 5 == 4, 120).otherwise(70) + line % 10).cast("string"), F.lit("."), _lpad((ok * 7) % 1000, 3))
    swapped = line % 5 == 2
    features = _full(
        base(spark, folder).withColumn("_tenths", F.transform(F.array(n16, (place * 120 + ln * 15).cast("long"), (ln * 15).cast("long"), (minutes * 5).cast("long")), _tenths)),
        sheet_ord=F.lit(0), source_row=ok * 10 + ln + block,
        abs_distance_m=chainage,
        joint_number=F.when(ok % 10 == 3, (place * 10 + 40).cast("string")),
        depth_pct_wt=depth,
        length_mm=F.concat(F.floor(mm100 / 100).cast("string"), sign, _lpad(mm100 % 100, 2)),
        width_mm=(5 + (sk * 13) % 300).cast("string"),
        surface=F.when(F.col("rf") == "A", "I").when(F.col("rf") == "R", "Ext.").otherwise(""),
        wt_mm=F.when(pk % 109 == 0, "-1").otherwise(_wall(ok)),
        clock_position=F.when(pk % 101 == 0, "13:75").when(ok % 2 == 0, time).otherwise(twelfth),
        feature_type=F.when(pk % 89 == 0, None).when(pk % 97 == 0, "").when(sk % 19 == 0, "Metal Loss").otherwise("Anomaly"),
        feature_identification=fid,
        dimension_class=F.array(*[F.lit(d) for d in dims])[(pk % 8).cast("int")],
        description=F.when(ln >= 5, "metal loss (grouped)").when(pk % 50 == 0, "circumferential groove").otherwise("metal loss"),
        anomaly_id=F.when(pk % 83 != 0, F.concat(F.lit("F"), ok.cast("string"), F.lit("-"), ln.cast("string"))),
        latitude=F.when(swapped, east).otherwise(north),
        longitude=F.when(swapped, north).otherwise(east),
        upstream_weld_dist_m=weld,
    )
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("ok"))
    mm = 11500 + (ok * 7919) % 1000
    joint = {
        "abs_distance_m": _tenths(place * 120), "joint_number": (place * 10 + 40).cast("string"), "wt_mm": _wall(ok),
        "joint_length_m": F.concat(F.floor(mm / 1000).cast("string"), F.lit("."), _lpad(mm % 1000, 3)),
    }
    welds = _full(orders, sheet_ord=F.lit(0), source_row=ok * 10, feature_type=F.lit("Girth Weld"), **joint)
    blanks = _full(orders.where(place == JOINTS_PER_LINE - 1), sheet_ord=F.lit(0), source_row=ok * 10 + 9)
    registry = _full(orders.where(ok % 2 == 0), sheet_ord=F.lit(1), source_row=ok, **joint)
    return features.unionByName(welds).unionByName(blanks).unionByName(registry)
