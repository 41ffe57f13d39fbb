import json

from claimloom.sources import files


def test_pdf_files(spark, tmp_path):
    (tmp_path / "Acme-Annual Report__FY24.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "no.pdf").write_bytes(b"hello")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.pdf_files(spark, str(tmp_path), "*.pdf").collect()}
    good = next(r for k, r in rows.items() if k.startswith("Acme"))
    assert good.error is None and good.document_id == f"acme-annual-report-fy24-{good.sha256[:6]}"
    assert rows["empty.pdf"].error == "File is empty" and rows["no.pdf"].error == "File signature is not PDF"

    def parse(path, content):
        if b"1.4" not in content:
            raise ValueError("old")
        return [{"page_no": 1, "pos": 0, "element_id": "e0", "element_type": "text", "content": content.decode()}]

    parsed = files.parse_with(files.pdf_files(spark, str(tmp_path), "*.pdf"), parse).collect()
    assert [(r.element_id, r.content, r.error) for r in parsed] == [("e0", "%PDF-1.4 x", None)]


def test_fact_json_round_trip(spark, tmp_path):
    fact = {"fact_id": "f1", "fact_type": "numerical", "subject": {"name": "Acme", "type": "company"}, "predicate": "revenue", "object": {"value_type": "currency", "value": 5, "currency": "₹", "scale": "crore"}, "time": {"time_type": "fiscal_year", "value": "FY24"}, "qualifiers": ["over"], "confidence": 0.9, "evidence_ids": ["e"]}
    (tmp_path / "a.json").write_text(json.dumps({"document_id": "a", "facts": [fact]}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"document_id": "b", "facts": [fact, {**fact, "fact_id": "f2"}]}))
    (tmp_path / "c.json").write_text("{ not json")
    rows = {r.fact_id: r for r in files.read_facts(spark, str(tmp_path)).collect()}
    assert set(rows) == {"f1", "f2"} and rows["f1"].document_id == "b" and rows["f1"].value_raw == "5" and rows["f1"].currency == "₹"
    out = str(tmp_path / "out")
    files.write_json(files.facts_as_json(files.read_facts(spark, str(tmp_path))), out)
    again = {r.fact_id: r for r in files.read_facts(spark, out).collect()}
    assert {k: r.asDict() | {"fact_seq": 0} for k, r in again.items()} == {k: r.asDict() | {"fact_seq": 0} for k, r in rows.items()}


def test_matches(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"matches": [{"match_id": "m", "fact_a_id": "a", "fact_b_id": "b", "classification": "SAME_CLAIM", "confidence": 0.9}]}))
    assert [tuple(r) for r in files.read_matches(spark, str(tmp_path / "m.json")).collect()] == [("m", "a", "b", "SAME_CLAIM", 0.9)]
