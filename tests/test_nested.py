import json

from claimloom.operators import nested


def doc(**more):
    return {"document_id": "d", **more}


ELEMENTS = [{"element_id": "e0", "rows": [["a"], None, ["b"]]}, None, {"element_id": "e1"}]

SHAPES = [
    doc(pages=[{"pdf_page_number": 1, "elements": ELEMENTS}]),
    doc(pages={"1": {"elements": ELEMENTS}}),
    doc(pages={"pdf_page_number": "1", "elements": ELEMENTS}),
    doc(pages=json.dumps([{"pdf_page_number": 1.0, "elements": json.dumps(ELEMENTS)}])),
    {"schema": 2, "data": doc(pages=[{"pdf_page_number": 1, "elements": ELEMENTS}])},
    json.dumps(doc(pages=[{"pdf_page_number": 1, "elements": ELEMENTS}])),
    {"metadata": {"document_id": "d"}, "pages": [{"pdf_page_number": 1, "elements": ELEMENTS}]},
]
WANT = {("page", "d", "1"), ("element", "1", "e0"), ("element", "1", "e1"), ("table_row", "e0", "0"), ("table_row", "e0", "2")}


def frame(spark, payloads):
    return spark.createDataFrame([(i, p, "clash") for i, p in enumerate(payloads)], "record_id long, payload string, entity string")


def links(spark, payloads):
    out = {}
    for r in nested.flat_links(frame(spark, payloads)).collect():
        out.setdefault(r.record_id, set()).add((r.child_kind, r.parent_key, r.child_key))
    return out


def test_every_shape_gives_the_same_tables(spark):
    got = links(spark, [json.dumps(s) for s in SHAPES])
    for i, shape in enumerate(SHAPES):
        assert got[i] == WANT, shape


def test_single_element_and_empty_page(spark):
    got = links(spark, [json.dumps(doc(pages=[{"pdf_page_number": 3}, {"pdf_page_number": 4, "elements": {"element_id": "x", "rows": []}}]))])
    assert got[0] == {("page", "d", "3"), ("page", "d", "4"), ("element", "4", "x")}


def test_signals(spark):
    pairs = {"subject": "exact", "value": None, "unit": "same"}
    want = {("signal", "r", "subject=exact"), ("signal", "r", "unit=same")}
    shapes = [pairs, [{"name": k, "value": v} for k, v in pairs.items()], json.dumps(pairs)]
    got = links(spark, [json.dumps({"relationship_id": "r", "comparison": s}) for s in shapes])
    assert [got[i] for i in range(3)] == [want] * 3
    assert links(spark, [json.dumps({"relationship_id": "r", "comparison": None})]) == {}


def test_unreadable(spark):
    bad = [None, "", "{", "[1", json.dumps({"a": 1}), "null", "[" * 3000]
    assert links(spark, bad) == {}
    assert {r.record_id for r in nested.unreadable_records(frame(spark, bad)).collect()} >= {0, 1, 2, 3}
    assert links(spark, []) == {}


def test_intervals_nest_like_the_tree(spark):
    nodes = nested.label_payload(json.dumps(SHAPES[0]), (nested.DOCUMENT,))
    assert [n[1] for n in nodes] == list(range(len(nodes)))
    assert sorted(n[2] for n in nodes) == list(range(len(nodes)))
    for a in nodes:
        for b in nodes:
            inside = b[1] < a[1] and a[2] < b[2]
            assert not (inside and a[3] <= b[3])
    assert sum(1 for n in nodes if nodes[0][1] < n[1] and n[2] < nodes[0][2]) == len(nodes) - 1


def test_repeated_delivery_counts_once(spark):
    p = json.dumps(SHAPES[0])
    df = spark.createDataFrame([(1, p), (1, p)], "record_id long, payload string")
    assert nested.flat_links(df).count() == len(WANT)
