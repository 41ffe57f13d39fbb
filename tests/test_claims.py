"""Scenarios of scalars, extraction, matching and reasoning."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimloom.functions import scalar as S
from claimloom.operators import block, chain, compare, extract, knowledge, reason, select, validate
from claimloom.streaming import incremental

T = dt.datetime(2024, 1, 1)
FACT = (
    "fact_id string, fact_type string, subject_name string, subject_type string, predicate string, value_type string, value_raw string, value_num double, "
    "unit string, currency string, scale string, value_qualifier string, time_type string, time_value string, time_start string, time_end string, scope string, "
    "qualifiers array<string>, confidence double, evidence_ids array<string>, document_id string, extracted_at timestamp_ntz, loaded_at timestamp_ntz, is_deleted boolean"
)
NAMES = [c.split()[0] for c in FACT.split(", ")]
BASE = dict(fact_type="numerical", subject_name="Acme", subject_type="company", predicate="revenue", value_type="currency", value_raw="500", value_num=500.0, currency="₹", scale="crore", time_type="fiscal_year", time_value="FY2024", qualifiers=[], confidence=0.95, evidence_ids=["e"], document_id="d1", extracted_at=T, loaded_at=T, is_deleted=False)


def facts(spark, *rows):
    return spark.createDataFrame([tuple({**BASE, "fact_id": f"f{i}", **r}.get(n) for n in NAMES) for i, r in enumerate(rows)], FACT)


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_normalize_text(spark):
    for text, want in [("•\x07 Sale of...", "• Sale of..."), ("Too   many spaces", "Too many spaces"), (None, ""), (" \t a\nb ", "a\nb")]:
        assert one(spark, text, S.normalize_text) == want


@pytest.mark.parametrize(("text", "noise"), [("Table of Contents", True), ("Page 12 of 150", True), ("- 45 -", True), ("All rights reserved", True), ("%%%%### ~~~", True), ("Growth was 15.4%", False)])
def test_noise(spark, text, noise):
    assert one(spark, text, S.is_noise) is noise


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("revenue of ₹5 crore.", [("5", None, "₹", "crore", None, "currency")]),
        ("USD 5.5 billion", [("5.5", None, "USD", "billion", None, "currency")]),
        ("by 6.4% while growth was 12.5 percent.", [("6.4", "%", None, None, None, "percentage"), ("12.5", "%", None, None, None, "percentage")]),
        ("1,607 guards", [("1607", "guards", None, None, None, "quantity")]),
        ("6.25 million sq ft", [("6.25", "sq ft", None, "million", None, "quantity")]),
        ("over 1,607", [("1607", None, None, None, "greater_than", "quantity")]),
        ("₹50,000,000", [("50000000", None, "₹", None, None, "currency")]),
        ("none", []),
    ],
)
def test_quantities(spark, text, want):
    assert [tuple(q)[:6] for q in one(spark, text, S.extract_quantities)] == want


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("In FY2022 it was", "fiscal_year", "FY2022"),
        ("During 2023, sales", "calendar_year", "during 2023"),
        ("Q3 FY2025", "quarter", "Q3 FY2025"),
        ("As of December 31, 2021", "as_of_date", "as of December 31, 2021"),
        ("For the year ended March 31, 2024", "date_range", "for the year ended March 31, 2024"),
        ("on March 31, 2024", "specific_date", "March 31, 2024"),
        ("Revenue was ₹500 million.", "unknown", None),
    ],
)
def test_times(spark, text, kind, value):
    assert tuple(one(spark, text, S.temporal_context)) == (kind, value)


def test_keys(spark):
    assert one(spark, "  Acme Limited \n", S.normalize_key) == "acme limited" and one(spark, None, S.normalize_key) == ""
    assert one(spark, "ﬁne", S.nfkc) == "fine"
    assert S.query_tokens("What was the revenue in fiscal year FY24?") == ["revenue", "fy24"]


def sentences(spark, text, title="Acme Report", header=""):
    df = spark.createDataFrame([(text, title, header)], "content string, title string, header string")
    return [(r.subject, r.predicate, r.value_raw, r.scale, r.time_value, r.confidence) for r in extract.build_facts(extract.sentence_facts(df)).orderBy("fact_no").collect()]


def test_sentences(spark):
    assert sentences(spark, "Rajesh Sharma was appointed director in 2021.") == [("Rajesh Sharma", "appointed_as", "director", None, "2021", 0.95)]
    assert sentences(spark, "The unit is located at Air Cargo Center, New Delhi.")[0][1:3] == ("located_at", "Air Cargo Center, New Delhi")
    assert sentences(spark, "Company operates 93 fulfilment centres covering 6.25 million square feet.") == [("Acme", "operates", "93", None, None, 0.95), ("Acme", "floor_area", "6.25", "million", None, 0.94)]
    assert sentences(spark, "It operates 50 facilities.", title="Filing") == []
    assert sentences(spark, "It operates 50 facilities.")[0][:3] == ("Acme", "operates", "50")
    # ungrouped runs of four digits are read in groups of three, as the grammar has it
    assert sentences(spark, "Revenue stood at ₹50 crore in 2022.") == [("Acme", "revenue", v, s, "2022", 0.92) for v, s in (("50", "crore"), ("202", None), ("2", None))]
    assert sentences(spark, "") == []


def test_tables_and_figures(spark):
    schema = "document_id string, element_id string, caption string, headers array<string>, table_rows array<array<string>>, text_fragments array<struct<text:string>>"
    rows = [
        ("d", "a", "Table (₹ in million)", ["Year", "Revenue", "Growth"], [["2022", "100", "5%"], ["2023", "1,200", "-"]], None),
        ("d", "b", None, ["Particulars", "FY2024", "FY2023"], [["Net profit", "10", "N/A"], ["Margin %", "3", ""]], None),
        ("d", "c", None, ["", "-", "Unnamed: 2"], [["1", "2", "3"]], None),
        ("d", "e", None, [], [], None),
        ("d", "f", None, None, None, None),
    ]
    got = {(r.element_id, r.row_no, r.col_no): (r.predicate, r.value_raw, r.value_type, r.time_value, r.scale) for r in extract.table_facts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        ("a", 0, 1): ("revenue", "100", "currency", "2022", "million"),
        ("a", 0, 2): ("growth", "5", "percentage", "2022", None),
        ("a", 1, 1): ("revenue", "1200", "currency", "2023", "million"),
        ("b", 0, 1): ("profit", "10", "number", "FY2024", None),
        ("b", 1, 1): ("margin", "3", "percentage", "FY2024", None),
    }
    figures = [("d", "g", "Figure 2: over 93 centres", None, None, [("Centres: 5",)]), ("d", "h", None, None, None, [("Centres: 93",), ("peraca Tralos, fs",), ("----",), (None,)]), ("d", "i", None, None, None, None)]
    got = [(r.element_id, r.predicate, r.value_raw) for r in extract.figure_facts(spark.createDataFrame(figures, schema)).orderBy("element_id", "fact_no").collect()]
    assert got == [("g", "metric_in_figure", "2"), ("g", "metric_in_figure", "93"), ("h", "centres", "93")]


def judged(spark, a, b):
    f = facts(spark, {"document_id": "d1", **a}, {"document_id": "d2", **b})
    pairs = spark.createDataFrame([("f0", "f1"), ("f1", "f0")], "fact_a_id string, fact_b_id string")
    rows = reason.relate(compare.classify(compare.compare(compare.pair_up(pairs, compare.prepare(f))))).collect()
    # values and times are symmetric
    assert {(r.sig_value, r.sig_time, r.sig_subject) for r in rows} == {(rows[0].sig_value, rows[0].sig_time, rows[0].sig_subject)}
    return next((r.classification, r.relationship, r.reason) for r in rows if r.fact_a_id == "f0")


@pytest.mark.parametrize(
    ("a", "b", "label", "relation", "why"),
    [
        ({"value_raw": "5", "value_num": 5.0}, {"value_raw": "50", "value_num": 50.0, "scale": "million"}, "SAME_CLAIM", "CORROBORATES", "numerically equivalent"),
        ({"value_raw": "5.0", "value_num": 5.0, "value_qualifier": "approximate"}, {"value_raw": "5.02", "value_num": 5.02}, "SAME_CLAIM", "CORROBORATES", "approximation tolerance"),
        ({}, {"value_raw": "600", "value_num": 600.0}, "SAME_CLAIM", "CONTRADICTS", "materially different values"),
        ({"time_value": "FY2023"}, {}, "RELATED_CLAIM", "CONTEXTUALLY_RECONCILED", "different reporting periods"),
        ({"scope": "consolidated"}, {"scope": "India segment"}, "RELATED_CLAIM", "CONTEXTUALLY_RECONCILED", "different reporting scopes"),
        ({"predicate": "appointed", "value_type": "text"}, {"predicate": "resigned", "value_type": "text"}, "RELATED_CLAIM", "CONTEXTUALLY_RECONCILED", "status transition"),
        ({}, {"subject_name": "Other"}, "NOT_MATCH", "UNRELATED", "different entities"),
        ({"subject_name": "It"}, {}, "UNCERTAIN", "UNRESOLVED", "unresolved"),
        ({"time_type": "unknown", "time_value": None}, {"value_raw": "600", "value_num": 600.0}, "SAME_CLAIM", "CONTRADICTS", "materially different values"),
        ({"value_raw": "1607", "value_num": 1607.0, "value_qualifier": "greater_than"}, {"value_raw": "2000", "value_num": 2000.0}, "SAME_CLAIM", "CORROBORATES", "bound"),
        ({"time_type": "quarter", "time_value": "Q4 FY24", "value_raw": "2", "value_num": 2.0}, {"time_value": "FY24"}, "RELATED_CLAIM", "CONTEXTUALLY_RECONCILED", "differing reporting durations"),
    ],
)
def test_pairs(spark, a, b, label, relation, why):
    got = judged(spark, a, b)
    assert got[:2] == (label, relation) and why in got[2]


def test_blocks_equal_nested_loops(spark):
    import itertools

    rows = [dict(subject_name=s, predicate=p, document_id=d, value_raw=v) for s in ("Acme", "Other", "It", "") for p in ("revenue", "total_revenue", "margin") for d in ("d1", "d2") for v in ("1", "2")]
    rows += rows[:5]
    f = facts(spark, *rows)
    ix = block.index_facts(f)
    classes = block.claim_classes(ix)
    plain = [(f"f{i}", r) for i, r in enumerate(rows)]
    general = lambda r: r["subject_name"] in ("It", "")
    cross = [(a, b) for a, b in itertools.combinations(plain, 2) if a[1]["document_id"] != b[1]["document_id"]]
    exact = sum(1 for (_, a), (_, b) in cross if not general(a) and a["subject_name"] == b["subject_name"] and a["predicate"] == b["predicate"])
    assert block.block_exact(classes).agg(F.sum("n_pairs")).first()[0] == exact
    near = sum(1 for (_, a), (_, b) in cross if not general(a) and a["subject_name"] == b["subject_name"] and {a["predicate"], b["predicate"]} == {"revenue", "total_revenue"})
    assert block.block_compatible(classes).agg(F.sum("n_pairs")).first()[0] == near
    known = sum(1 for (_, a), (_, b) in cross if a["predicate"] == b["predicate"] and general(a) != general(b))
    loose = sum(1 for (_, a), (_, b) in cross if a["predicate"] == b["predicate"] and general(a) and general(b))
    assert tuple(block.block_uncertain(classes).agg(F.sum("n_with_known"), F.sum("n_general")).first()) == (known, loose)
    assert block.class_members(ix).count() == len(rows)


def test_exact_block_without_document_limit(spark):
    f = facts(spark, *(dict(subject_name=s, document_id=d, value_raw=v) for s in ("Acme", "It", "we", "") for d in ("d1", "d2") for v in ("1", "2")))
    pairs = block.block_exact(block.claim_classes(block.index_facts(f)), cross_document=False)
    # four facts each of Acme, it and we: six pairs each; blank subjects are not indexed
    assert pairs.agg(F.sum("n_pairs")).first()[0] == 18
    assert incremental.new_pairs(f.limit(0), f, cross_document=False).count() == 18


def test_candidate_chain_equals_nested_loops(spark):
    import itertools

    rows = [dict(subject_name=s, predicate=p, document_id=d, value_raw=v, value_num=float(v)) for s in ("Acme", "Other", "It", "") for p in ("revenue", "total_revenue", "margin") for d in ("d1", "d2", "d3") for v in ("1", "2")]
    rows += rows[:5] + [dict(rows[0], fact_type="event", value_type="text", document_id=d) for d in ("d4", "d1")]
    f = facts(spark, *rows)
    classes = block.prepared_classes(compare.prepare(f)).cache()
    general = lambda r: r["subject_name"] in ("It", "")
    fits = lambda a, b: a.get("fact_type") == b.get("fact_type")
    cross = [(a, b) for a, b in itertools.combinations(rows, 2) if a["document_id"] != b["document_id"] and fits(a, b)]
    passes = {1: 0, 2: 0}
    for a, b in cross:
        if not general(a) and a["subject_name"] == b["subject_name"]:
            passes[1] += a["predicate"] == b["predicate"]
            passes[2] += {a["predicate"], b["predicate"]} == {"revenue", "total_revenue"}
    pairs = block.candidates(classes)
    assert {r.pass_no: r.n for r in pairs.groupBy("pass_no").agg(F.sum("n_pairs").alias("n")).collect()} == passes
    disputes = reason.relate(compare.classify(compare.compare(pairs))).where("relationship = 'CONTRADICTS'").agg(F.sum("n_pairs")).first()[0]
    assert disputes == sum(1 for a, b in cross if not general(a) and a["subject_name"] == b["subject_name"] and a["value_raw"] != b["value_raw"] and (a["predicate"] == b["predicate"] or "margin" not in (a["predicate"], b["predicate"])))
    assert block.prepared_members(compare.prepare(f)).join(classes, F.col("class_id") == classes["fact_id"]).count() == len(rows)


def test_disputes_form_only_pairs_that_can_contradict(spark):
    import itertools
    import random

    rnd = random.Random(5)
    periods = [("fiscal_year", "FY2024"), ("fiscal_year", "FY24"), ("fiscal_year", " FY2024 "), ("calendar_year", "2024"), ("specific_date", "2024-03-31"), ("as_of_date", "2024-03-31"), ("quarter", "Q1 FY2024"), (None, None), ("fiscal_year", " "), ("unknown", "FY2024"), ("calendar_year", "FY2024")]
    rows = []
    for (kind, at), p in itertools.product(periods, ("revenue", "total_revenue")):
        for _ in range(5):
            rows.append(dict(time_type=kind, time_value=at, predicate=p, document_id=rnd.choice("def"), value_raw=(v := rnd.choice("123")), value_num=float(v), scope=rnd.choice(["consolidated", None, "unknown"]), qualifiers=rnd.choice([[], ["audited"], ["unaudited"], None])))
    classes = block.prepared_classes(compare.prepare(facts(spark, *rows))).cache()

    def contradictions(pairs):
        r = reason.relate(compare.classify(compare.compare(pairs))).where("relationship = 'CONTRADICTS'")
        return sorted(tuple(x) for x in r.select("a.fact_id", "b.fact_id", "pass_no", "n_pairs").collect())

    every, few = block.candidates(classes), block.disputable(classes)
    want = contradictions(every)
    assert len(want) > 50 and contradictions(few) == want
    assert few.count() < every.count() / 3


def test_uncertain_members_hold_all_pairs(spark):
    import itertools

    kinds = [("numerical", "currency"), ("numerical", "number"), ("event", "text"), ("semantic", "quantity"), ("attribute", None), (None, "entity"), (None, None)]
    rows = [dict(subject_name=s, document_id=d, fact_type=t, value_type=v) for s in ("Acme", "It", "") for d in ("d1", "d2", "d3") for t, v in kinds]
    rows += [dict(r) for r in rows[7:20]]
    f = facts(spark, *rows)
    numeric, text, loose = ("number", "percentage", "currency", "quantity"), ("text", "entity"), ("attribute", "semantic")
    group = lambda r: ("numeric" if r["value_type"] in numeric else "text" if r["value_type"] in text else "other")

    def fits(a, b):
        ta, tb = a["fact_type"], b["fact_type"]
        return (ta is not None and ta == tb) or (group(a) == group(b) != "other") or (ta in loose and tb in loose)

    general = lambda r: r["subject_name"] != "Acme"
    wanted = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2) if a["document_id"] != b["document_id"] and fits(a, b) and (general(a) or general(b))}
    prepared = compare.prepare(f)
    members = block.uncertain_members(block.prepared_classes(prepared))
    got = block.uncertain_pairs(members).collect()
    assert [(r.n_with_known, r.n_general) for r in got] == [(sum(general(rows[i]) != general(rows[j]) for i, j in wanted), sum(general(rows[i]) and general(rows[j]) for i, j in wanted))]
    # the pairs come back out of the membership, and each is unresolved
    m = members.join(block.prepared_members(prepared), "class_id").collect()
    side = lambda r: dict(fact_type=r.fact_type, value_type={"numeric": "number", "text": "text"}.get(r.value_kind))
    back = [tuple(sorted((int(x.fact_id[1:]), int(y.fact_id[1:])))) for x, y in itertools.combinations(m, 2) if x.document_id != y.document_id and "general" in (x.side, y.side) and fits(side(x), side(y))]
    assert len(back) == len(set(back)) and set(back) == wanted
    pairs = spark.createDataFrame([(f"f{i}", f"f{j}") for i, j in wanted], "fact_a_id string, fact_b_id string")
    related = reason.relate(compare.classify(compare.compare(compare.pair_up(pairs, prepared))))
    assert {r.relationship for r in related.select("relationship").distinct().collect()} == {"UNRESOLVED"}


def test_validation_and_dedup(spark):
    elements = spark.createDataFrame([("e", ["b"])], "element_id string, evidence_ids array<string>")
    f = facts(spark, {}, {"evidence_ids": ["e", "x", "y"]}, {"evidence_ids": []}, {"evidence_ids": None}, {"subject_name": " "}, {"confidence": 1.5}, {"value_raw": "n.a.", "value_num": None}, {"evidence_ids": ["b"], "confidence": 0.99})
    got = {r.fact_id: r.reason for r in validate.validate_facts(f, elements).collect()}
    assert got == {"f0": None, "f1": "unknown evidence x", "f2": "missing evidence", "f3": "missing evidence", "f4": "missing subject", "f5": "confidence out of range", "f6": "value is no number", "f7": None}
    kept = validate.deduplicate_facts(f.where("fact_id in ('f0', 'f7', 'f6')")).orderBy("fact_id").collect()
    assert [(r.fact_id, r.n_facts, r.confidence, r.evidence) for r in kept] == [("f0", 2, 0.99, "b,e"), ("f6", 1, 0.95, "e")]


def test_candidates(spark):
    schema = "document_id string, page_no int, canonical_order int, raw_order int, element_id string, element_type string, content string, caption string, table_rows array<array<string>>, text_fragments array<struct<text:string>>, ingested_at timestamp_ntz"
    rows = [("d", 1, i, i, f"e{i}", kind, text, cap, table, frag, T) for i, (kind, text, cap, table, frag) in enumerate([("paragraph", "Revenue was 5", None, None, None), ("page_header", "Revenue 5", None, None, None), ("table", "", None, [["a", "1"]], None), ("table", "", None, [], None), ("figure", "", "Growth chart", None, None), ("figure", "", None, None, [("--",)]), ("caption", "Some words", None, None, None), ("text", "Plain words here", None, None, None)])]
    got = {r.element_id: r.priority for r in select.select_candidates(spark.createDataFrame(rows + rows[:1], schema)).collect()}
    assert got == {"e0": 2, "e2": 1, "e4": 6, "e6": 5}


def test_search(spark):
    f = facts(spark, {"predicate": "net_profit", "subject_name": "Acme"}, {"predicate": "margin", "subject_name": "Other"})
    got = {r.fact_id: r.score for r in knowledge.score_facts(f, "net profit of acme in FY2024").collect()}
    assert got == {"f0": 40 + 15 + 15, "f1": 15}
    assert knowledge.score_facts(f, "").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [dict(document_id=f"d{i % 3}", subject_name=["Acme", "Other"][i % 2]) for i in range(12)]
    f = facts(spark, *rows)
    whole = {tuple(r) for r in incremental.new_pairs(f.limit(0), f).collect()}
    for k in range(3):
        f.where(F.pmod(F.xxhash64("fact_id"), F.lit(3)) == k).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.match_stream(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {(r.fact_a, r.fact_b) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == whole and len(whole) > 10


def various(spark):
    """Facts of one subject that differ in all that comparisons read."""
    import random

    rnd = random.Random(11)
    periods = [("fiscal_year", "FY2024"), ("fiscal_year", "FY24"), ("fiscal_year", "FY2023"), ("calendar_year", "2024"), ("calendar_year", "2022"), ("specific_date", "2024-03-31"), ("as_of_date", "2024-03-31"), ("quarter", "Q1 FY2024"), ("fiscal_year", "Q1 FY2024"), (None, None), ("fiscal_year", " "), ("date_range", "some time")]
    values = [("5", 5.0), ("5", None), ("5.1", 5.1), ("500", 500.0), ("0.05", 0.05), ("0", 0.0), ("n.a.", None), ("", None), ("5", float("nan"))]
    kinds = [("numerical", "currency"), ("numerical", "percentage"), ("numerical", "number"), ("event", "text"), ("attribute", "entity"), ("semantic", None), (None, "quantity")]
    rows = []
    for _ in range(600):
        (kind, at), (raw, num), (ft, vt) = rnd.choice(periods), rnd.choice(values), rnd.choice(kinds)
        row = dict(time_type=kind, time_value=at, time_start=rnd.choice([None, None, "2024-03-31"]), value_raw=raw, value_num=num, fact_type=ft, value_type=vt, document_id=rnd.choice("def"), confidence=rnd.choice([0.95, 0.8, 0.123456, 1.7, -0.2, None, float("nan")]))
        row |= dict(predicate=rnd.choice(["revenue", "total_revenue", "operates", "facilities", "fulfilment_centres", "appointed", "resigned"]), scope=rnd.choice(["consolidated", "India", None, "unknown"]), qualifiers=rnd.choice([[], ["audited"], ["unaudited"], ["estimated", "audited"], ["approximately"], None]))
        row |= dict(currency=rnd.choice([None, "₹", "INR", "USD"]), unit=rnd.choice([None, None, "%", "kg"]), scale=rnd.choice([None, "crore", "million"]), value_qualifier=rnd.choice([None, None, "greater_than", "less_than", "approximate"]), subject_name=rnd.choice(["Acme", "Acme", "Other", "It"]))
        rows.append(row)
    return facts(spark, *rows, *rows[:9])


def test_one_step_chain_equals_its_steps(spark):
    classes = block.prepared_classes(compare.prepare(various(spark))).cache()
    r = reason.relate(compare.classify(compare.compare(block.candidates(classes))))
    want = r.select(F.col("a.fact_id").alias("class_a"), F.col("b.fact_id").alias("class_b"), "pass_no", "n_pairs", "classification", "relationship", "rel_confidence", "reason")
    got = chain.relations(chain.pairs(classes))
    assert got.dtypes == want.dtypes
    rows = lambda df: sorted(map(repr, df.collect()))
    have = rows(got)
    assert have == rows(want) and len(have) > 3000
    # every branch that such pairs can reach was there
    assert {x.reason for x in want.select("reason").distinct().collect()} >= {o[4] for o in reason.OUTCOMES[2:]} - {"status transition"}
    assert {x.pass_no for x in got.select("pass_no").distinct().collect()} == {1, 2}


def test_comparable_predicates_are_their_own_keys(spark):
    # the one-step chain looks transitions up by plain predicates, reasoning by their keys
    names = spark.createDataFrame([(p,) for p in compare.compatible_predicates()], "p string")
    assert names.where(S.underscore_key(F.col("p")) != F.col("p")).count() == 0


def test_candidate_pairs_are_compiled(spark, tmp_path):
    """The virtual machine compiles no method of more than 8,000 bytes; candidate_relationships ran many minutes for that."""
    import re

    from claimloom.plans import claim_queries

    various(spark).write.parquet(str(tmp_path / "facts.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = claim_queries.QUERIES["candidate_relationships"](spark, str(tmp_path))
        code = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" in plan and plan.count("ReusedExchange") == 1
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_staged_table_releases_its_shuffles(spark):
    from claimloom import session

    live = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = live()
    assert session.Staged(df, "kept").df.count() == 7 and live() > before
    spark.sparkContext._jvm.System.gc()
    kept = live()
    held = session.Staged(df, "released", release=True)
    assert live() <= kept
    assert held.df.count() == 7 and spark.conf.get(session._CLEAN_UP) == "false"
