"""Texts are parsed by few expressions, with the results of the plain forms."""

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from girthline import vocab
from girthline.functions import clock, text
from girthline.operators import ingest as N

CELLS = (
    "", " ", "-", "--", "–", "—", "n/a", "N.A", "nA", "·", "?", "Not Defined", "not_-defined", "notdefined", "²", "x", "na x", " na ", " 5\n",
    "1,5", "1.2,3", "−3", "–4e2", "1d", "NaN", "Infinity", ".5", "5.", "12:30", "6.14", "12.5", "13:75", " 1:02:03 ", "180", "180.5", "6 o'clock", "6h", "5 ",
)


def test_cells_read_as_by_the_plain_forms(spark):
    rows = spark.createDataFrame([(c,) for c in (*CELLS, None)], "c string")
    c = F.col("c")
    folded = F.translate(c, "²³¹   ", "231   ")
    norm = F.trim(F.regexp_replace(F.lower(folded), text._SEPARATORS, " "))
    number = F.regexp_extract(F.translate(c, "−–,", "--."), text._NUMBER, 1).try_cast("double")
    same = rows.select(
        "c", text.norm(c).eqNullSafe(norm).alias("norm"), text.is_na(c).eqNullSafe(c.isNull() | norm.isin(*vocab.NOT_AVAILABLE)).alias("na"),
        text.to_float(c).eqNullSafe(number).alias("number"),
    )
    assert same.where("NOT (norm AND na AND number)").collect() == []
    hours = {r.c: (r.h, r.b) for r in clock.with_clock(rows, "c", "h", "b").collect()}
    assert hours["12:30"] == (0.5, False) and hours["13:75"] == (None, True) and hours["6.14"] == (6 + 14 / 60, False)
    assert hours["180"] == (6.0, False) and hours["6h"] == (6.0, False) and hours["x"] == (None, True) and hours[None] == (None, False)
    assert abs(hours[" 1:02:03 "][0] - (1 + 2 / 60 + 3 / 3600)) < 1e-12


def test_row_code_stays_small(spark):
    raw = spark.createDataFrame([], "line_id int, run_id string, sheet_ord int, source_row long, " + ", ".join(f"{c} string" for c in vocab.ALL_FIELDS))
    shown = io.StringIO()
    with redirect_stdout(shown):
        N.read_cells(spark.createDataFrame(raw.rdd, raw.schema)).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())]
    assert sizes and max(sizes) < 15_000
