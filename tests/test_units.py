import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimloom.operators import units

SCHEMA = (
    "fact_id string, value_raw string, value_num double, unit string, currency string, scale string, "
    "evidence_ids array<string>, loaded_at timestamp_ntz, common_unit string"
)
T = dt.datetime(2024, 1, 1)

CASES = [
    # raw, num, unit, currency, scale -> unit, thousandths
    ("₹5 crore", None, None, None, None, "INR", 50_000_000_000),
    ("5 crore", None, None, "Rs.", "crores", "INR", 50_000_000_000),
    ("USD 5.5 billion", None, None, None, None, "USD", 5_500_000_000_000),
    ("US$1.893,39m", None, None, None, None, "USD", 1_893_390_000_000),
    ("79,88,984.1 rupees", None, None, None, None, "INR", 7_988_984_100),
    ("2.522,3 lakhs", None, "t", None, "Lacs", "tonne", 252_230_000_000),
    ("2 443.11 crores", None, None, "Rs.", "crore", "INR", 24_431_100_000_000),
    ("(53.36)", None, None, "INR", "crore", "INR", -533_600_000_000),
    ("−92.2", None, "%", None, None, "percent", -92_200),
    ("approximately (inr9,876.5)", None, None, None, None, "INR", -9_876_500),
    ("3922 bp", None, "bp", None, None, "percent", 39_220),
    ("43,250.5 meters", None, None, None, None, "km", 43_251),
    ("84,203.5 pounds (lb)", None, None, None, None, "tonne", 38_194),
    ("12 pounds", None, None, None, None, "GBP", 12_000),
    ("65 sq m", None, None, None, None, "sq_ft", 699_654),
    ("344", 344.0, "sq m", None, "lakhs", "sq_ft", 370_278_518_335),
    ("26 acre", None, None, None, None, "sq_ft", 1_132_560_000),
    ("146.77 million t", None, None, None, None, "tonne", 146_770_000_000),
    ("358 mmt", None, None, None, None, "tonne", 358_000_000_000),
    ("at least 347.29 thousand trucks", None, None, None, None, "count", 347_290_000),
    ("c. 14056 aircraft", None, None, None, None, "count", 14_056_000),
    ("93", 93.0, "centres", None, None, "count", 93_000),
    ("655", 655.0, "$ billion", None, None, "USD", 655_000_000_000_000),
    ("399.52", 399.52, "thousand people", None, None, "count", 399_520_000),
    ("9", 9.0, None, "INR lakhs", None, "INR", 900_000_000),
    ("9", 9.0, None, "£ '000", None, "GBP", 9_000_000),
    ("₹ 6", None, None, None, "'000", "INR", 6_000_000),
    ("0", 0.0, "km", None, None, "km", 0),
    # no quantity
    ("4.85", 4.85, None, None, None, None, None),
    ("statutory auditor", None, None, None, None, None, None),
    ("", None, None, None, None, None, None),
    (None, None, "km", None, None, None, None),
    # beyond 400 characters
    ("at least 7 " + "km " + " " * 500, None, None, None, None, "km", 7_000),
    ("7 " + "x" * 500, None, None, None, None, "count", 7_000),
    ("7" + ",000" * 1500 + "x", None, None, None, None, None, None),
]


def test_readings(spark):
    rows = [(str(i), r, n, u, c, s, [], T, "clash") for i, (r, n, u, c, s, _, _) in enumerate(CASES)]
    got = {
        r.fact_id: (r.common_unit, r.milli)
        for r in units.read_quantities(spark.createDataFrame(rows, SCHEMA))
        .select("fact_id", "common_unit", units.common_milli(F.col("common_value")).alias("milli"))
        .collect()
    }
    for i, (*given, unit, milli) in enumerate(CASES):
        assert got.get(str(i)) == (None if unit is None else (unit, milli)), given


def test_identity_decides_the_notation(spark):
    rows = [("a", "1,889", 1889.0, "km", None, None, [], T, ""), ("b", "1,889", 1.889, "km", None, None, [], T, ""), ("c", "1,889", None, "km", None, None, [], T, "")]
    got = {r.fact_id: r for r in units.read_quantities(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["a"].common_value == 1889.0 and not got["a"].ambiguous
    assert got["b"].common_value == pytest.approx(1.889) and not got["b"].ambiguous
    assert got["c"].common_value == 1889.0 and got["c"].ambiguous


CLAIM = SCHEMA.replace("common_unit", "subject_name string, predicate string, time_value string, common_unit")


def test_other_facts_of_the_claim_decide(spark):
    def fact(i, raw, unit=None, scale=None, num=None, predicate="tonnage", currency=None):
        return (i, raw, num, unit, currency, scale, [], T, "Acme ", predicate, "FY24", "clash")

    rows = [
        # restatements of one claim in several units
        *(fact(f"a{k}", raw, unit, scale, num) for k, (raw, unit, scale, num) in enumerate([("1.889", "t", None, 1.889), ("1889", "kg", None, 1889.0), ("18.89", "quintal", None, 18.89)])),
        fact("notation", "1,889", "t"),  # 1.889 or 1889 tonnes
        fact("unit", "4,164.6 pounds"),  # of mass, not of money
        *(fact(f"b{k}", "5 crore", None, None, None, "profit", "INR") for k in range(3)),
        fact("conflict", "5", None, "lakh", 5.0, "profit", "INR crore"),  # both scales are stated, one is wrong
        fact("alone", "12 pounds", predicate="other"),
        fact("missing", "5", None, None, 5.0, "profit", "INR"),  # states no scale; reported, not replaced
    ]
    df = spark.createDataFrame(rows, CLAIM)
    q = units.read_quantities(df)
    got = {r.fact_id: r for r in q.collect()}
    assert got["notation"].common_value == pytest.approx(1.889) and not got["notation"].ambiguous
    assert got["unit"].common_unit == "tonne" and got["unit"].common_value == pytest.approx(1.889, abs=1e-3)
    assert got["conflict"].common_value == 5e7 and got["conflict"].log_residual > 4
    assert got["alone"].common_unit == "GBP" and got["alone"].ambiguous
    assert got["missing"].common_value == 5.0
    assert [(r.fact_id, r.factor) for r in units.suspect_scales(q).collect()] == [("missing", 1e7)]


def test_caption_gives_the_unit_of_a_bare_number(spark):
    elements = spark.createDataFrame(
        [
            ("D:p1:e1", ["D:p1:b1"], "table", "Table 1: Summary (Rs. in Cr)", T),
            ("d:p1:e2", None, "table", "Table 2: Operating data", T),
            ("d:p1:e3", [], "paragraph", "$ thousands", T),
        ],
        "element_id string, evidence_ids array<string>, element_type string, caption string, ingested_at timestamp_ntz",
    )
    rows = [
        ("a", "(12.5)", None, None, None, None, ["d:p1:b1 ", None], T, ""),
        ("b", "12.5", 12.5, None, None, None, ["d:p1:e2"], T, ""),
        ("c", "12.5", 12.5, None, None, None, ["d:p1:e3"], T, ""),
        ("d", "12.5", 12.5, None, None, None, ["d:p1:e1", "d:p1:e2"], T, ""),
        ("e", "12.5", 12.5, "km", None, None, ["d:p1:e1"], T, ""),
        ("f", "1", 1.0, "km", None, None, None, T, ""),
        ("f", "2", 2.0, "km", None, None, None, T + dt.timedelta(1), ""),
    ]
    got = {r.fact_id: (r.common_unit, r.common_value) for r in units.read_quantities(spark.createDataFrame(rows, SCHEMA), units.table_captions(elements)).collect()}
    assert got == {"a": ("INR", -1.25e8), "e": ("km", 12.5), "f": ("km", 2.0)}


def test_mass_density_volume(spark):
    rows = [(1, 2000.0, 1.0, 2.0), (2, 1.0, 1.0, 1.0), (3, 0.0, 1.0, 1.0), (4, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, mass double, density double, volume double")
    got = {
        r.id: r
        for r in units.choose_readings(
            df,
            [
                ("m", F.col("mass"), [("kg", 1.0), ("t", 1000.0)], 1),
                ("d", F.col("density"), [("kg/m3", 1.0), ("kg/l", 1000.0)], -1),
                ("v", F.col("volume"), [("m3", 1.0), ("l", 0.001)], -1),
            ],
        ).collect()
    }
    assert (got[1].m_unit, got[1].d_unit, got[1].v_unit) == ("kg", "kg/l", "m3") and not got[1].ambiguous
    # 1 kg at 1 kg/m3 in 1 m3, or at 1 kg/l in 1 l, or 1 t at 1 kg/l in 1 m3
    assert got[2].log_residual == 0 and got[2].ambiguous
    assert got[3].ambiguous and got[3].m_unit is None and got[4].ambiguous


def test_empty(spark):
    assert units.read_quantities(spark.createDataFrame([], SCHEMA)).count() == 0
