"""Line metadata from the page texts of inspection reports.

Pages are taken apart into lines. A line that holds a label of the vocabulary says something about that label's field; a reader for the
field's kind (number, year, date, list, name) turns what follows into a value or nothing. Of all that is said about a field the best statement
stays, by kind, then priority page, then place in the report: a minimum, so no report is ever put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from girthline import vocab
from girthline.functions.text import lookup, parse_date, project_slug, strip

DIRECT, PATTERN, MONTH, INFERRED, DERIVED = 1.0, 0.6, 0.8, 0.5, 0.3

# The words that reports print before a value.
LABELS = {
    "client": ("client", "customer", "operator"),
    "pipeline_section_code": ("section code",),
    "outer_diameter_mm": ("outer diameter", "outside diameter", "nominal diameter", "pipe od", "od"),
    "length_km": ("total length", "pipeline length", "length of the pipeline", "approx length", "length"),
    "installation_year": (
        "year of construction of the pipeline", "year of construction", "construction year", "year built", "year of installation",
        "installation year", "built in",
    ),
    "material_grade": ("api 5l",),
    "smys_mpa": ("smys", "specified minimum yield strength"),
    "maop_kgcm2": ("maop", "maximum allowable operating pressure"),
    "design_factor": ("design factor", "fd", "f d"),
    "wall_thicknesses_mm": ("wall thicknesses", "wall thickness"),
    "medium": ("pipeline medium during inspection", "pipeline medium"),
    "service": ("service class", "service"),
    "inspected": ("inspection date", "date of inspection", "survey date", "conducted on"),
    "current": ("current inspection",),
    "year_of_report": ("inspection year", "survey year", "report year", "inspection of", "survey of", "report of"),
    "previous": ("previous inspections", "previous inspection", "previous ili", "baseline inspection"),
    "named": ("pipeline name", "pipeline section", "pipeline"),
    "tool": ("tool", "technology", "inspection"),
}
# Ranges that values must lie in, and the priority page of a field.
RANGES = {
    "outer_diameter_mm": (50, 2000), "length_km": (0.1, 5000), "installation_year": (1900, 2099), "smys_mpa": (100, 1000),
    "maop_kgcm2": (5, 250), "design_factor": (0.40, 0.90), "wall": (1.0, 50.0), "inspection_year": (1990, 2099),
}
PAGE_OF = {
    **dict.fromkeys(("outer_diameter_mm", "length_km", "installation_year", "wall_thicknesses_mm", "medium"), "data"),
    **dict.fromkeys(("material_grade", "smys_mpa", "maop_kgcm2", "design_factor"), "strength"),
}
SENSORS = ("MFL", "EGP", "UT", "IMU", "XYZ")
#: A name after a label without a separator that is longer may be a sentence; it counts if nothing else fits.
SENTENCE = 81


def report_lines(pages: DataFrame) -> DataFrame:
    """One row for each line: ``doc_id, page_no, line_no, line``, the ``after`` it on its page, and its words as ``tokens`` between spaces."""
    split = F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")
    clean = F.transform(split, lambda x: strip(F.regexp_replace(x, r"\s+", " ")))
    numbered = F.transform("_lines", lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), F.coalesce(F.get("_lines", i + 1), F.lit("")).alias("after")))
    rows = pages.select("doc_id", "page_no", clean.alias("_lines")).select("doc_id", "page_no", F.explode(numbered).alias("_l")).select("doc_id", "page_no", "_l.*")
    return rows.where(F.col("line") != "").withColumn("tokens", F.concat(F.lit(" "), strip(F.regexp_replace(F.lower("line"), "[^a-z0-9]+", " ")), F.lit(" ")))


def labelled_lines(lines: DataFrame) -> DataFrame:
    """One row for each label in each line: ``about`` (its field), ``label``, a ``remark`` in brackets behind it, whether it stands ``apart`` by a
    separator, and the ``said`` rest, or the next line where the rest is empty."""
    def mark(field: str, label: str) -> Column:
        words = r"[^A-Za-z0-9]+".join(label.split())
        rest = F.regexp_extract("line", rf"(?i)(?:^|[^A-Za-z0-9]){words}(?![A-Za-z0-9])(.*)$", 1)
        return F.when(F.col("tokens").contains(f" {label} "), F.struct(F.lit(field).alias("about"), F.lit(label).alias("label"), rest.alias("rest")))

    marks = F.array_compact(F.array(*[mark(field, label) for field, labels in LABELS.items() for label in labels]))
    rows = lines.select("*", F.explode(marks).alias("_m")).select(*lines.columns, "_m.*")
    rows = rows.withColumn("remark", F.regexp_extract("rest", r"^\s*\(([^)]*)\)", 1)).withColumn("_body", F.regexp_replace("rest", r"^\s*(?:\([^)]*\))?\s*", ""))
    rows = rows.withColumn("_value", F.regexp_replace("_body", r"^[:=\-]+\s*", ""))
    said = F.when(F.col("_value") != "", F.col("_value")).otherwise(F.col("after"))
    return rows.withColumn("apart", F.col("_body") != F.col("_value")).withColumn("said", said).drop("rest", "_body", "_value")


def _number(text: Column) -> Column:
    """A number at the start; commas part thousands."""
    return F.replace(F.regexp_extract(text, r"^\d{1,5}(?:[.,]\d+)?", 0), F.lit(","), F.lit("")).try_cast("double")


def _unit_after(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"^[\d.,\s]+", ""))


def _within(value: Column, name: str) -> Column:
    low, high = RANGES[name]
    return F.when(value.between(low, high), value)


def _pressure(unit: Column) -> Column:
    return F.regexp_replace(F.lower(unit), r"[\s/]", "").rlike(r"^kgf?cm")


def _year(text: Column, name: str = "inspection_year") -> Column:
    return _within(F.regexp_extract(text, r"^\d{4}(?!\d)", 0).try_cast("int"), name)


def _first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, r"[ ,]+"), 1, n), " ")


def _day(text: Column) -> Column:
    """A whole date in the first word or the first three, as ISO text."""
    return F.coalesce(parse_date(_first_words(text, 1)), parse_date(_first_words(text, 3))).cast("string")


def _walls(value: Column, line: Column) -> Column:
    """Sorted wall thicknesses: a list after the label, else all decimals of the line, else one value in mm."""
    lead = F.regexp_extract(value, r"^(?:[\d.,/&\s]|and)++", 0)
    numbers = F.regexp_extract_all(lead, F.lit(r"(\d+(?:\.\d+)?)"), 1)
    decimals = F.regexp_extract_all(line, F.lit(r"(\d{1,2}\.\d+)"), 1)
    single = F.when(F.lower(F.substr(value, F.length(lead) + 1)).startswith("mm"), numbers)
    chosen = F.when(F.size(numbers) > 1, numbers).when(F.size(decimals) > 0, decimals).otherwise(single)
    kept = F.sort_array(F.array_distinct(F.filter(F.transform(chosen, lambda v: v.try_cast("double")), lambda v: v.between(*RANGES["wall"]))))
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda v: v.cast("string")), ", "))


def _product(text: Column) -> Column:
    """The product a text begins with, the longest first."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.startswith(p), p) for p in sorted(vocab.PRODUCTS, key=len, reverse=True)])


def _sensors(line: Column) -> Column:
    """A tool of two magnetic sensors or more, as sensors joined by plus signs."""
    joined = F.split(F.regexp_replace(line, r"\s*\+\s*", "+"), r"[\s:]+")
    magnetic = lambda w: F.size(F.filter(F.split(w, r"\+"), lambda s: s.startswith("MFL-"))) >= 2
    return F.get(F.filter(joined, magnetic), F.lit(0))


def _tool(value: Column) -> Column:
    """Capital codes after a label, if a known sensor is among them."""
    codes = F.regexp_extract(F.regexp_replace(value, r"\s*\+\s*", "+"), r"^[A-Z][A-Z\-/+ ]+(?![a-z])", 0)
    plain = strip(F.regexp_replace(F.regexp_replace(codes, r"\s+", " "), r"^[+\- ]+|[+\- ]+$", ""))
    known = F.exists(F.split(plain, r"[+\-/ ]"), lambda w: w.isin(*SENSORS))
    return F.when(known, plain)


def _line_name(words: Column) -> Column:
    """From the size before ``IPS`` to the line's end; null without both."""
    at = F.array_position(F.transform(words, lambda w: F.regexp_replace(w, ",+$", "")), "IPS").cast("int")
    inch = F.get(words, at - 2)
    apart = inch.rlike("""^["“”′″'`]$""")
    first = F.when(inch.rlike("""^[0-9]{1,3}["“”′″'`]$"""), at - 1).when(apart & F.get(words, at - 3).rlike("^[0-9]{1,3}$"), at - 2)
    return F.when((at > 1) & first.isNotNull() & (F.size(words) > at), F.array_join(F.slice(words, first, F.size(words)), " "))


def _without_geometry(name: Column) -> Column:
    return F.substring_index(F.substring_index(name, ", OD ", 1), ", L ", 1)


def _letter_code(words: Column) -> Column:
    """A code of capitals, like ABU-IP2, before the word for what it names."""
    at = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: F.get(words, i + 1).isin("Pipeline", "Section", "Spool"))
    before = F.transform(at, lambda i: F.get(words, i))
    return F.get(F.filter(before, lambda w: w.rlike("^[A-Z]{2,6}-[A-Z0-9]{1,8}$")), F.lit(0))


class _Said:
    """Statements that a row may make, each an optional struct."""

    def __init__(self, data_page: int, strength_page: int) -> None:
        self.priority = {"data": F.col("page_no") == data_page, "strength": F.col("page_no") == strength_page}
        self.found: list[Column] = []

    def add(self, field: str, value: Column, confidence: float | Column | None = None, kind: int | Column = 0, page: str | None = None) -> None:
        on = self.priority.get(page, F.lit(True))
        sure = F.when(on, DIRECT).otherwise(PATTERN) if confidence is None else F.lit(confidence) if isinstance(confidence, float) else confidence
        value = value.cast("string")
        self.found.append(F.when(value.isNotNull() & (value != ""), F.struct(
            F.lit(field).alias("field"), (F.lit(kind) if isinstance(kind, int) else kind).cast("int").alias("kind"), (~on).alias("off_page"),
            value.alias("value"), sure.cast("double").alias("confidence"),
        )))

    def rows(self, lines: DataFrame) -> DataFrame:
        return lines.select("doc_id", "page_no", "line_no", F.explode(F.array_compact(F.array(*self.found))).alias("_s")).select("doc_id", "page_no", "line_no", "_s.*")


def _labelled(lines: DataFrame, said: _Said) -> DataFrame:
    """What stands behind labels."""
    value, remark, apart, label, tokens = (F.col(c) for c in ("said", "remark", "apart", "label", "tokens"))
    about = lambda field, found: F.when(F.col("about") == field, found)
    unit = _unit_after(value)

    def number(field: str, found: Column, fits: Column | None = None) -> None:
        kept = _within(found, field)
        said.add(field, about(field, kept if fits is None else F.when(fits, kept)), page=PAGE_OF[field])

    number("outer_diameter_mm", _number(value))
    number("length_km", _number(value), (F.lower(strip(remark)) == "km") | unit.rlike("^km(?![a-z])"))
    number("installation_year", _year(value, "installation_year").cast("double"))
    number("maop_kgcm2", _number(value), _pressure(remark) | _pressure(unit))
    number("design_factor", _number(value))
    number("smys_mpa", _number(F.regexp_extract(value, r"(?i)^[^\d]{0,40}?(\d[\d.,]*)\s*(?:MPa|N/mm)", 1)))

    alone = F.concat(F.lit(" "), label, F.lit(" "))
    sentence = ~apart & (F.length(value) > SENTENCE) & (tokens != alone)
    name = F.when(tokens.startswith(alone) & value.rlike("^[A-Za-z]") & (F.length(value) > 2), value)
    said.add("client", about("client", name), DIRECT, F.when(sentence, 1).otherwise(0))
    said.add("pipeline_section_code", about("pipeline_section_code", F.regexp_extract(value, r"^\d{6,10}(?!\d)", 0)), DIRECT)
    grade = F.nullif(F.upper(F.replace(F.regexp_extract(value, r"(?i)^(?:X ?\d{2,3}|A25|[AB])(?![a-z0-9])", 0), F.lit(" "), F.lit(""))), F.lit(""))
    said.add("material_grade", about("material_grade", F.concat(F.lit("API 5L "), grade)), page="strength")
    said.add("wall_thicknesses_mm", about("wall_thicknesses_mm", _walls(value, F.col("line"))), page="data")
    for field, place in (("product", 1), ("service_class", 0)):
        said.add(field, about("medium", lookup({k: v[place] for k, v in vocab.PRODUCTS.items()}, _product(value))), page="data")
    said.add("service_class", about("service", F.regexp_extract(F.lower(value), "^(?:liquid|gas|multiphase)(?![a-z])", 0)), PATTERN, 2)

    def run_date(field: str, found: Column, confidence: float, kind: int) -> None:
        said.add(f"{field}_inspection_date", found, confidence, kind)
        said.add(f"{field}_inspection_year", _within(F.regexp_extract(found, r"(\d{4})", 1).try_cast("int"), "inspection_year"), INFERRED, kind)

    month = F.nullif(F.regexp_extract(value, r"^[A-Za-z]{3,9}[\-/ ]\d{2,4}(?!\d)", 0), F.lit(""))
    run_date("run2", about("inspected", F.coalesce(_day(value), month)), DIRECT, 0)
    run_date("run2", about("current", F.concat(_year(value).cast("string"), F.lit("-01-01"))), INFERRED, 1)
    said.add("run2_inspection_year", about("year_of_report", _year(value)), PATTERN, 2)
    run_date("run1", about("previous", _day(value)), DIRECT, 0)
    run_date("run1", about("previous", parse_date(F.concat(F.lit("15 "), _first_words(value, 2))).cast("string")), MONTH, 1)
    run_date("run1", about("previous", F.concat(_year(value).cast("string"), F.lit("-07-01"))), INFERRED, 2)

    plain = label == "pipeline"
    titled = F.when(apart & (F.length(value) > 4) & (~plain | F.col("line").contains("PIPELINE")), _without_geometry(value))
    said.add("pipeline_name", about("named", titled), PATTERN, F.when(plain, 2).otherwise(3))
    said.add("inspection_technology", about("tool", _tool(value)), PATTERN, 1)
    return said.rows(labelled_lines(lines))


def _unlabelled(lines: DataFrame, said: _Said) -> DataFrame:
    """What lines show by their own form."""
    words, titled = F.col("_words"), F.col("_titled")
    rows = lines.withColumn("_words", F.split("line", " ")).withColumn("_titled", _line_name(words))
    capitals = titled.rlike("IPS,? +[A-Z]")
    said.add("pipeline_name", _without_geometry(titled), F.when(capitals, DIRECT).otherwise(PATTERN), F.when(capitals, 0).otherwise(1))
    said.add("pipeline_section_code", _letter_code(words), PATTERN, 1)
    said.add("inspection_technology", _sensors(F.col("line")), DIRECT)
    products = sorted(vocab.PRODUCTS, key=len, reverse=True)
    named = F.coalesce(*[F.when(F.col("tokens").contains(f" {p} {w} "), p) for p in products for w in ("pipeline", "line")])
    for field, place in (("product", 1), ("service_class", 0)):
        said.add(field, lookup({k: v[place] for k, v in vocab.PRODUCTS.items()}, named), kind=1, page="data")
    tag = F.get(F.filter(words, lambda w: w.rlike(r"^FFP[_\-][A-Za-z0-9_\-]{4,}")), F.lit(0))
    said.add("project_name", F.regexp_replace(tag, r"[^A-Za-z0-9_\-].*$", ""), PATTERN)
    return said.rows(rows)


def statements(pages: DataFrame, data_page: int = 6, strength_page: int = 20) -> DataFrame:
    """Everything lines say: ``doc_id, field, kind`` (0 is best), ``off_page``, ``page_no``, ``line_no``, ``value``, ``confidence``."""
    lines = report_lines(pages)
    return _labelled(lines, _Said(data_page, strength_page)).unionByName(_unlabelled(lines, _Said(data_page, strength_page)))


_RANK = ("kind", "off_page", "page_no", "line_no", "value")


def report_metadata(pages: DataFrame, data_page: int = 6, strength_page: int = 20) -> DataFrame:
    """(doc_id, field, value, confidence) of everything a report states."""
    best = statements(pages, data_page, strength_page).groupBy("doc_id", "field").agg(F.min(F.struct(*_RANK, "confidence")).alias("b"))
    best = best.select("doc_id", "field", "b.value", "b.confidence")

    def of(field: str) -> Column:
        return F.max(F.when(F.col("field") == field, F.col("value")))

    # A dozen rows for each report: what the tag is made of, if the report has none.
    parts = best.groupBy("doc_id").agg(of("project_name").alias("tag"), of("pipeline_name").alias("name"), of("outer_diameter_mm").try_cast("double").alias("od"))
    slug = project_slug(F.col("name"), F.col("od"))
    made = parts.where(F.col("tag").isNull() & slug.isNotNull()).select("doc_id", F.lit("project_name").alias("field"), slug.alias("value"), F.lit(DERIVED).alias("confidence"))
    return best.unionByName(made)


def report_notes(pages: DataFrame, data_page: int = 6, strength_page: int = 20) -> DataFrame:
    """(doc_id, field, note, kept, others): fields with other values than the one kept, and reports without text or without any label."""
    found = statements(pages, data_page, strength_page)
    unlike = found.groupBy("doc_id", "field").agg(F.min(F.struct(*_RANK)).alias("b"), F.min("value").alias("a"), F.max("value").alias("z"))
    single = ("outer_diameter_mm", "length_km", "installation_year", "material_grade", "smys_mpa", "maop_kgcm2", "design_factor", "pipeline_section_code")
    unlike = unlike.where((F.col("a") != F.col("z")) & F.col("field").isin(*single))
    conflicts = unlike.select("doc_id", "field", F.lit("conflicting_values").alias("note"), F.col("b.value").alias("kept"),
                              F.when(F.col("a") != F.col("b.value"), F.col("a")).otherwise(F.col("z")).alias("others"))
    nothing = F.lit(None).cast("string")
    blank = pages.groupBy("doc_id").agg(F.max(F.length(strip(F.coalesce("text", F.lit(""))))).alias("n"))
    silent = blank.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    return conflicts.unionByName(silent.select(
        "doc_id", nothing.alias("field"), F.when(F.col("n") > 0, "no_known_labels").otherwise("no_text").alias("note"), nothing.alias("kept"), nothing.alias("others")
    ))
