import pytest
from pyspark.sql import functions as F

from claimloom.llm import pages as p

SCHEMA = (
    "document_id string, page_no int, canonical_order int, raw_order int, element_type string, content string, "
    "raw_content string, element_id string, is_deleted boolean, repair string"
)
PLAIN = "The committee reviewed the financial schedule of the distribution network during 2021. The cross-border business completed a deferred network schedule."


def element(page, order, text, kind="paragraph", doc="acme-widget-report-fy23-a1b2c3", raw=None):
    return (doc, page, order, order, kind, text, raw, f"{doc}:p{page}:e{order}", False, "clash")


def corpus():
    e = [element(1, 10 + k, PLAIN, doc=f"other-{k}") for k in range(40)]
    e += [element(k, 0, "Beta header FY23", doc="beta") for k in range(1, 12)]
    e += [
        element(1, 0, "Acme Widget report FY23", "page_header"),
        element(1, 1, "The cornrnittee revievved the flnancial\nACME WIDGET REPORT FY23\nsched-\nule of the distributi0n netw­\nork during 2o21."),
        element(1, 2, "It cost l,591.47 for the cross-\nborder busmess and the dcferred con­tract"),
        element(1, 3, "Page 1 of 9", "page_footer"),
        element(2, 0, "Acme Widget report FY23 | 2", "text"),
        element(2, 1, "of 2021. The committee completed the sche-"),
        element(2, 2, "- 2 -", "footnote"),
        element(3, 0, "", "text", raw="dule during 2021.\n3\n[3]\nThe network."),
        element(3, 1, None, "text"),
        element(3, 2, "\x07 \t ", "text"),
        element(5, 0, "The committee"),
        element(7, 0, "network."),
    ]
    return e


WANT = {
    (1, 1, "restored", w) for w in ("committee", "reviewed", "financial", "schedule", "distribution", "network", "2021")
} | {
    (1, 1, "removed", "ACME WIDGET REPORT FY23"),
    (1, 2, "restored", "1,591.47"),
    (1, 2, "restored", "cross-border"),
    (1, 2, "restored", "business"),
    (1, 2, "restored", "deferred"),
    (1, 2, "joined", "acme-widget-report-fy23-a1b2c3:p2:e1"),
    (2, 0, "removed", "Acme Widget report FY23 | 2"),
    (2, 2, "removed", "- 2 -"),
    (2, 1, "joined", "acme-widget-report-fy23-a1b2c3:p3:e0"),
    (2, 1, "restored", "schedule"),
    (3, 0, "removed", "3"),
    (3, 0, "removed", "[3]"),
}


@pytest.mark.parametrize("max_shared", [p.MAX_SHARED, 0])
def test_all_repairs(spark, max_shared):
    rows = [tuple(r) for r in p.repair_pages(spark.createDataFrame(corpus(), SCHEMA), max_shared).collect()]
    assert len(rows) == len(set(rows))
    want = {(f"acme-widget-report-fy23-a1b2c3:p{a}:e{b}", kind, piece) for a, b, kind, piece in WANT}
    want |= {(f"beta:p{k}:e0", "removed", "Beta header FY23") for k in range(1, 12)}
    assert set(rows) == want


def test_long_and_short_headers(spark):
    long_ = "Northern Consolidated Shipping and Warehousing Corporation Limited annual report and accounts for the financial year 2023 to 2024"
    assert len(long_) > 120
    e = [element(k, 0, f"The committee reviewed schedule {k}.\n{long_}\nIt completed the schedule.", doc="long") for k in range(1, 6)]
    e += [element(k, 1, "FY", "page_header", doc="long") for k in range(1, 3)] + [element(4, 2, "FY\nThe network.", doc="long")]
    e += [element(1, 0, "Some Annual Review\nThe network.", doc="titled")]
    titles = spark.createDataFrame([("titled", "Some annual review"), ("long", None), ("titled", "Some annual review")], "document_id string, title string")
    rows = p.repair_pages(spark.createDataFrame(e, SCHEMA), titles=titles).where("repair = 'removed'").collect()
    assert {(r.element_id, r.piece) for r in rows} == {(f"long:p{k}:e0", long_) for k in range(1, 6)} | {("long:p4:e2", "FY"), ("titled:p1:e0", "Some Annual Review")}


def test_paragraphs(spark):
    df = spark.createDataFrame(corpus(), SCHEMA).withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    deleted = df.where("element_id LIKE '%p7:e0'").withColumn("is_deleted", F.lit(True)).withColumn("ingested_at", F.lit("2024-02-01").cast("timestamp_ntz"))
    got = {r.element_id.removeprefix("acme-widget-report-fy23-a1b2c3:"): (r.n_elements, r.text) for r in p.paragraphs(df.unionByName(deleted)).collect()}
    assert got["p1:e1"] == (1, "The committee reviewed the financial schedule of the distribution network during 2021.")
    # over two page ends, with a cut word
    assert got["p1:e2"] == (3, "It cost 1,591.47 for the cross-border business and the deferred contract of 2021. The committee completed the schedule during 2021. The network.")
    assert got["p5:e0"] == (1, "The committee") and "p7:e0" not in got and not {"p1:e0", "p2:e0", "p2:e2", "p3:e2"} & got.keys()


def test_empty(spark):
    assert p.repair_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_skeletons():
    for noisy, word in [("cornpleted", "completed"), ("netvvork", "network"), ("termmals", "terminals"), ("flnancial", "financial"), ("conﬁrmation", "confirmation"), ("5ub5idiary", "subsidiary"), ("comprebensive", "comprehensive")]:
        assert p.skeleton(noisy) == p.skeleton(word)
    assert p.as_number("l,59o.4") == "1,590.4" and p.as_number("oil") is None and p.as_number("2021") is None


def test_reflow():
    assert p.reflow(["a year-", "on-year in-", "crease of", "5"], {"year-on-year"}) == "a year-on-year increase of 5"
