import datetime as dt
import random

from pyspark.sql import functions as F

from claimloom.operators import orphans as o


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(n)


def refs(spark, rows):
    return spark.createDataFrame([("t", "c", a, "p", b, c) for a, b, c in rows], o.REF_SCHEMA)


def events(spark, rows):
    return spark.createDataFrame([("p", a, b, c) for a, b, c in rows], o.EVENT_SCHEMA)


def brute(rs, es):
    out = {}
    for row, key, at in rs:
        live = [b for a, b, d in es if a == key and not d and b is not None]
        latest = max(((b, not d) for a, b, d in es if a == key and b is not None), default=None)
        in_time = at is not None and any(b <= at for b in live)
        status = "orphan" if not live else "reopened" if not latest[1] else "linked" if in_time else "resolved"
        out[row, key, at] = (in_time, status)
    return out


def test_batches_equal_one_pass_and_brute_force(spark, tmp_path):
    rnd = random.Random(1)
    rs = list({(f"r{i}", f"k{0 if rnd.random() < 0.3 else rnd.randrange(25)}", day(rnd.randrange(40))) for i in range(150)})
    es = [(f"k{rnd.randrange(20)}", day(rnd.randrange(40)), rnd.random() < 0.3) for _ in range(60)]
    store = o.OrphanStore(spark, str(tmp_path / "s"), 7, 2)
    for i in range(5):
        store.advance(i, refs(spark, rs[i::5]), events(spark, es[i::5]))
    want = brute(rs, es)
    monthly = o.fold_by_month(refs(spark, rs), events(spark, es), str(tmp_path / "m")).state()
    for s in (store.state(), monthly, o.first_state(refs(spark, rs), events(spark, es))):
        got = {(r.row_id, r.ref_id, r.ref_at): (r.in_time, r.status) for r in s.refs.collect()}
        assert got == want
        assert {(r.row_id, r.ref_id) for r in s.unmet().collect()} == {k[:2] for k, v in want.items() if not v[0]}
    assert sum(r.n_refs for r in store.state().snapshot().collect()) == len(rs)


def test_life_of_one_reference(spark, tmp_path):
    store = o.OrphanStore(spark, str(tmp_path / "s"), 4, 3)
    one = lambda: store.state().refs.first()
    store.advance(0, refs(spark, [("r", "k", day(5))]), events(spark, []))
    assert one().status == "orphan"
    store.advance(1, refs(spark, []), events(spark, [("k", day(9), False)]))
    assert (one().status, one().resolved_at) == ("resolved", day(9))
    # a new process goes on from the disk
    store = o.OrphanStore(spark, str(tmp_path / "s"), 4, 3)
    store.advance(2, refs(spark, []), events(spark, [("k", day(11), True)]))
    assert one().status == "reopened" and store.last_batch() == 2
    store.advance(3, refs(spark, [("r", "k", day(5))]), events(spark, [("k", day(12), False), ("k", day(2), False)]))
    assert (one().status, one().in_time, one().n) == ("linked", True, 2)


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    store = o.OrphanStore(spark, str(tmp_path / "s"), 4, 2)
    store.advance(0, refs(spark, [("r", "k", day(5))]), events(spark, [("k", day(1), False)]))
    for key in ("x", "k", "k"):  # the first attempts are followed by another one with the same number, a merge among them
        store.advance(1, refs(spark, [("q", "k", day(6))]), events(spark, [(key, day(7), True)]))
    assert {(r.row_id, r.n, r.status) for r in store.state().refs.collect()} == {("r", 1, "reopened"), ("q", 1, "reopened")}


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    from claimloom.streaming.incremental import orphan_stream

    schema, seen = "kind string, row_id string, key string, at timestamp_ntz", []
    plain = lambda df, kind: df.where(F.col("kind") == kind)
    to_refs = lambda df: plain(df, "ref").selectExpr("'t' ref_table", "'c' ref_column", "row_id", "'p' target", "key ref_id", "at ref_at")
    to_events = lambda df: plain(df, "row").selectExpr("'p' target", "key ref_id", "at", "false is_deleted")
    for number, rows in enumerate([[("ref", "r", "k", day(5)), ("ref", "q", "j", day(5))], [("row", None, "k", day(3)), ("ref", "z", "k", day(1))]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        store = o.OrphanStore(spark, str(tmp_path / "s"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        orphan_stream(stream, to_refs, to_events, store, str(tmp_path / "c"), lambda s, n: seen.append(n)).awaitTermination()
        assert store.last_batch() == number
    assert {(r.row_id, r.status) for r in store.state().refs.collect()} == {("r", "linked"), ("q", "orphan"), ("z", "resolved")} and seen == [0, 1]


def test_a_later_batch_reads_only_what_waits(spark, tmp_path):
    import shutil

    path = str(tmp_path / "s")
    store = o.OrphanStore(spark, path, 4, 2)
    store.advance(0, refs(spark, [(f"r{i}", "k", day(5)) for i in range(9)] + [("w", "j", day(5))] * 2), events(spark, [("k", day(1), False)]))
    shutil.move(f"{path}/refs/batch-0/late=0", f"{tmp_path}/aside")
    store.advance(1, refs(spark, []), events(spark, [("j", day(6), False), ("k", day(8), True)]))
    store.advance(2, refs(spark, []), events(spark, [("j", day(4), False)]))
    shutil.move(f"{tmp_path}/aside", f"{path}/refs/batch-0/late=0")
    assert sum(r.n for r in store._waiting(3).collect()) == 2  # the settled nine are not among them
    got = {(r.row_id, r.n, r.status, r.in_time) for r in store.state().refs.collect()}
    assert got == {(f"r{i}", 1, "reopened", True) for i in range(9)} | {("w", 2, "linked", True)}
    assert {(r.row_id, r.n, r.status) for r in store.state(1).refs.where("row_id = 'w'").collect()} == {("w", 2, "resolved")}


def test_index_shared_or_shuffled_alike(spark, tmp_path, monkeypatch):
    got = []
    for most in (o.MAX_ASKED, 0):
        monkeypatch.setattr(o, "MAX_ASKED", most)
        store = o.OrphanStore(spark, str(tmp_path / str(most)), 4)
        store.advance(0, refs(spark, [("r", "k", day(5)), ("q", "j", day(5)), (None, "j", None)]), events(spark, [("k", day(1), False)]))
        store.advance(1, refs(spark, [("p", "k", day(6))]), events(spark, [("j", day(7), False)]))
        got.append(sorted(map(str, store.state().refs.collect())))
    assert got[0] == got[1] and len(got[0]) == 4


def test_odd_keys(spark):
    facts = spark.createDataFrame(
        [("F1", ["\tA ", None, "a", "b"], day(1), "x"), ("F1", ["a"], day(1), "x"), ("F2", None, day(1), "x"), ("F3", ["a"], None, "x")],
        "fact_id string, evidence_ids array<string>, extracted_at timestamp_ntz, ref_id string",
    )
    elements = spark.createDataFrame(
        [(" A", None, day(0), None), (None, ["B", None], day(3), False), ("c", [], None, False)],
        "element_id string, evidence_ids array<string>, ingested_at timestamp_ntz, is_deleted boolean",
    )
    s = o.first_state(
        o.references(facts, "facts", "evidence_ids", "elements", "fact_id", "extracted_at"),
        o.parent_events(elements, "elements", ["element_id", "evidence_ids"], "ingested_at", "is_deleted"),
    )
    assert sorted((r.row_id, r.ref_id, r.ref_month) for r in s.unmet().collect()) == [("F1", "b", "2024-01"), ("F3", "a", None)]
