"""Long values in report texts."""

from girthline.operators import documents as D

WALLS = ["6.4", "7.1", "7.9", "8.7", "9.5", "10.3", "11.1", "12.7"]


def metadata(spark, texts):
    pages = spark.createDataFrame([(i, 6, t) for i, t in enumerate(texts)], "doc_id int, page_no int, text string")
    found = {}
    for r in D.report_metadata(pages).collect():
        found.setdefault(r.doc_id, {})[r.field] = r.value
    return [found.get(i, {}) for i in range(len(texts))]


def test_wall_lists_of_any_length(spark):
    many = [f"{i / 1000:.3f}" for i in range(1001, 9001)]
    far = "Pipe wall thickness " + " mm/".join(WALLS) + " mm " + "x" * 400 + " 14.2 mm\n15.5"
    got = metadata(spark, [
        "Wall thickness: " + ", ".join(WALLS) + " mm", "Wall Thicknesses (mm) " + " / ".join(WALLS[:7]) + " and " + WALLS[7], far,
        "Wall thickness: " + ", ".join(many), "Wall thickness: 12,14 mm", "Wall thickness: 10,12,14,16", "Wall thickness 6.4, 7.1, and others",
        "Wall thickness 7.1 mm",
    ])
    want = [WALLS, WALLS, [*WALLS, "14.2"], [str(float(x)) for x in many], ["12.0", "14.0"], ["10.0", "12.0", "14.0", "16.0"], ["6.4", "7.1"], ["7.1"]]
    assert [g["wall_thicknesses_mm"].split(", ") for g in got] == want


def test_names_of_any_length(spark):
    client, road = "Northern " + "Lines and " * 30 + "Sons", "ROAD " * 60 + "END"
    sentence = "Operator " + "shall keep the line free of deposits " * 5
    got = metadata(spark, [
        f"Client: {client}\n16\" IPS, {road}, OD 406 mm", f"{sentence}\nCustomer: {client}", f"Customer {client}", f"PIPELINE: {road}", f"Pipeline name: {road}",
        "Client\nShort Name\nCustomer: Other", f"16\" IPS {road.lower()}", "FFP_" + "A" * 100 + " x",
    ])
    assert [g.get("client") for g in got[:3]] == [client] * 3 and got[5]["client"] == "Short Name"
    assert [got[i]["pipeline_name"] for i in (0, 3, 4, 6)] == [f"16\" IPS, {road}", road, road, f"16\" IPS {road.lower()}"]
    assert got[7]["project_name"] == "FFP_" + "A" * 100


def test_report_in_the_usual_layout(spark):
    front = "Final Inspection Report\nClient : Northern Gas (West) Limited\n16\" IPS, HILL ROAD - IP-2 (VALE) Pipeline\nInspection Date: 15 March 2023\nTool: EGP + MFL-A + MFL-C + XYZ\n"
    data = "Pipeline Data\nOuter Diameter (mm) : 406\nPipeline Length (km) : 144.4\nWall Thickness (mm) : 7.1, 8.7, 9.5\nMaterial Grade : API 5L X65\nMAOP (kg/cm²) : 98\nPipeline Section : HILL-IP2 Pipeline\n"
    strength = "Strength Calculation Summary\nSMYS = 450 MPa\nDesign Factor (Fd) = 0.72\nMAOP = 98 kg/cm²\nMaterial: API 5L X65\n"
    pages = spark.createDataFrame([(1, 1, front), (1, 6, data), (1, 20, strength), (1, 7, None), (2, 1, data), (3, 1, "nothing to see"), (4, 1, " \n")], "doc_id int, page_no int, text string")
    got = {}
    for r in D.report_metadata(pages).collect():
        got.setdefault(r.doc_id, {})[r.field] = (r.value, r.confidence)
    assert got[1] == {
        "client": ("Northern Gas (West) Limited", 1.0), "pipeline_name": ("16\" IPS, HILL ROAD - IP-2 (VALE) Pipeline", 1.0), "pipeline_section_code": ("HILL-IP2", 0.6),
        "inspection_technology": ("EGP+MFL-A+MFL-C+XYZ", 1.0), "outer_diameter_mm": ("406.0", 1.0), "length_km": ("144.4", 1.0),
        "wall_thicknesses_mm": ("7.1, 8.7, 9.5", 1.0), "material_grade": ("API 5L X65", 1.0), "maop_kgcm2": ("98.0", 1.0), "smys_mpa": ("450.0", 1.0),
        "design_factor": ("0.72", 1.0), "run2_inspection_date": ("2023-03-15", 1.0), "run2_inspection_year": ("2023", 0.5),
        "project_name": ("FFP_Hill_Road_IP-2_16in", 0.3),
    }
    assert got[2]["outer_diameter_mm"] == ("406.0", 0.6) and got[2]["pipeline_name"] == ("HILL-IP2 Pipeline", 0.6)
    assert 3 not in got
    notes = {(r.doc_id, r.note) for r in D.report_notes(pages).collect()}
    assert notes == {(3, "no_known_labels"), (4, "no_text")}


def test_single_statements(spark):
    cases = [
        ("Pipeline medium : Crude Oil", "product", "Crude Oil"), ("Report on the natural gas pipeline of the north", "service_class", "gas"), ("Service class: multiphase", "service_class", "multiphase"),
        ("Year built: 1998", "installation_year", "1998.0"), ("Built in 1776", "installation_year", None), ("Nominal Diameter: 30 mm", "outer_diameter_mm", None),
        ("Technology: UT IMU", "inspection_technology", "UT IMU"), ("Tool: none was used", "inspection_technology", None), ("Length 12 km", "length_km", "12.0"), ("Length 12 m", "length_km", None),
        ("MAOP: 70 kg/cm2", "maop_kgcm2", "70.0"), ("MAOP 70 bar", "maop_kgcm2", None), ("Previous ILI: 3rd May 2016", "run1_inspection_date", "2016-05-03"),
        ("Baseline inspection 2011", "run1_inspection_date", "2011-07-01"), ("Previous inspection May 2019", "run1_inspection_date", "2019-05-15"), ("Inspection Year: 2020", "run2_inspection_year", "2020"),
        ("Survey Date: Mar-2021", "run2_inspection_date", "Mar-2021"), ("Pipeline Section code 22100104", "pipeline_section_code", "22100104"), ("AB-1 Spool", "pipeline_section_code", "AB-1"),
        ("Wall Thickness: 8.7, 7.1, 7.1, 9.5 mm", "wall_thicknesses_mm", "7.1, 8.7, 9.5"), ("Wall Thickness: 6.0 and 8.0 mm", "wall_thicknesses_mm", "6.0, 8.0"), ("API 5L X 70", "material_grade", "API 5L X70"),
        ("16″ IPS, A LINE, OD 406 mm", "pipeline_name", "16″ IPS, A LINE"), ("PIPELINE: Long Valley", "pipeline_name", "Long Valley"), ("SMYS of all pipes 415 MPa", "smys_mpa", "415.0"), ("see FFP_Hill-2, page 3", "project_name", "FFP_Hill-2"),
    ]
    got = metadata(spark, [text for text, _, _ in cases])
    assert [(text, g.get(field)) for (text, field, _), g in zip(cases, got)] == [(text, want) for text, _, want in cases]


def test_unlike_values_are_noted(spark):
    pages = spark.createDataFrame([(1, 1, "MAOP: 70 kg/cm²\nMAOP: 95 kg/cm²"), (2, 1, "MAOP: 70 kg/cm²\nMAOP: 70 kg/cm²")], "doc_id int, page_no int, text string")
    assert [tuple(r) for r in D.report_notes(pages).collect()] == [(1, "maop_kgcm2", "conflicting_values", "70.0", "95.0")]
