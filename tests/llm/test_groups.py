import random

from claimloom.llm import groups as g

SCHEMA = "fact_a_id string, fact_b_id string, classification string, group_id string"


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in list(parent)}


def found(spark, pairs):
    df = spark.createDataFrame([(a, b, "SAME_CLAIM", "clash") for a, b in pairs], SCHEMA)
    rows = [tuple(r) for r in g.same_claim_groups(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_chain_star_and_random(spark):
    rnd = random.Random(7)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    star = [("z-hub", f"s{i:03}") for i in range(60)]
    noise = [(f"r{rnd.randrange(60)}", f"r{rnd.randrange(60)}") for _ in range(40)]
    pairs = chain + star + noise + [(b, a) for a, b in noise] + [("x", "x"), (None, "x"), ("y", None), (None, None), ("É", "é")]
    rnd.shuffle(pairs)
    assert found(spark, pairs) == brute(pairs)


def test_spellings_of_the_label(spark):
    labels = ["SAME_CLAIM", " same-claim", "Same Claim ", "MatchClassification.SAME_CLAIM", "NOT_MATCH", None, "", "RELATED_CLAIM"]
    df = spark.createDataFrame([(f"a{i}", f"b{i}", x, "") for i, x in enumerate(labels)], SCHEMA)
    assert {r.fact_id for r in g.same_claim_groups(df).collect()} == {f"{s}{i}" for i in range(4) for s in "ab"}


def test_empty(spark):
    assert found(spark, []) == set()


def test_numbered_vertices(spark, monkeypatch):
    monkeypatch.setattr(g, "MAX_SEEDS", 0)
    pairs = [("a", "b"), ("b", "c"), ("d", "d")]
    assert found(spark, pairs) == brute(pairs)
