from collections import Counter, defaultdict

from claimloom.llm import packing

CAPACITIES = {"small": 16, "large": 50, "none": 0}


def check(texts, rows, capacities, encode):
    """Every token in exactly one window, none overfull, cut only where needed."""
    per_doc, fill = defaultdict(list), Counter()
    for r in rows:
        if r.window_id is not None:
            per_doc[r.container, r.doc_id].append((r.start_token, r.n_tokens))
            fill[r.container, r.window_id] += r.n_tokens
    for name, capacity in capacities.items():
        for i, t in enumerate(texts):
            size, at = len(encode(t or "")), 0
            pieces = sorted(per_doc[name, i])
            for start, n in pieces:
                assert start == at and n > 0
                at += n
            assert at == size and len(pieces) == -(-size // capacity)
        assert all(n <= capacity for (c, _), n in fill.items() if c == name)
    return fill


def test_invariants(spark):
    encode = packing.tokenizer().encode_ordinary
    texts = ["word " * (i * 7 % 45) for i in range(300)] + ["", None, "x" * 3000, "<|endoftext|>", "word word"] * 2
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, container string").repartition(20)
    rows = packing.pack(df, CAPACITIES, open_windows=8).collect()
    fill = check(texts, rows, {"small": 16, "large": 50}, encode)
    assert sum(1 for r in rows if r.window_id is None) == 2 * sum(not encode(t or "") for t in texts)
    for name, capacity in (("small", 16), ("large", 50)):
        used = [n for (c, _), n in fill.items() if c == name]
        assert sum(used) / (len(used) * capacity) > 0.85


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(df, CAPACITIES).count() == 0


def test_best_fit_takes_the_tightest_window():
    p = packing.Packer(10, 0, 3)
    for size in (4, 7, 8):
        assert p.add(size, [(size,)]) is None
    assert p.add(2, [(2,)]) == (3, [(8,), (2,)])
    assert p.add(3, [(3,)]) == (2, [(7,), (3,)])
    assert p.add(7, [(7,)]) is None and p.add(9, [(9,)]) is None
    # three are open and none has room: the fullest goes
    assert p.add(8, [(8,)]) == (5, [(9,)])
