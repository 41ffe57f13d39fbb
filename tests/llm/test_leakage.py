import random

import numpy as np

from claimloom.llm import leakage as lk


def brute(docs, items, share=1 / 3):
    out = set()
    for i, text in items:
        w = lk.words_of(text)
        for d, t in docs:
            v = lk.words_of(t)
            grams = {tuple(v[k : k + 5]) for k in range(len(v) - 4)}
            marked = set()
            for k in range(len(w) - 4):
                if tuple(w[k : k + 5]) in grams:
                    marked |= set(range(k, k + 5))
            if marked and len(marked) >= len(w) * share - 1e-9:
                out.add((d, i))
    return out


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string").repartition(5)
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    rows = [(r.doc_id, r.item_id) for r in lk.find_leaks(d, i, **more).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(150)] + ["half-finished", "Vibasir's", "3.5"]
    stock = " ".join(rnd.choices(vocabulary, k=12)) + ". "

    def text(n):
        return " ".join(rnd.choices(vocabulary, k=n))

    items = [(i, text(rnd.randrange(20, 70)) + (stock if i % 3 == 0 else "")) for i in range(25)]
    docs = []
    for d in range(160):
        t = text(rnd.randrange(5, 120)) + " " + (stock if rnd.random() < 0.5 else "")
        if rnd.random() < 0.5:
            w = rnd.choice(items)[1].split()
            pieces = [w[k : k + rnd.randrange(3, 25)] for k in range(0, len(w), 20)]
            rnd.shuffle(pieces)
            t += " ... ".join(" ".join(p) for p in pieces)
        if rnd.random() < 0.3:
            t = t.upper().replace(" ", "\n")
        docs.append((d, t))
    return docs, items


def test_equals_brute_force(spark):
    docs, items = corpus()
    want = brute(docs, items)
    assert len(want) > 20
    assert found(spark, docs, items) == want


def test_only_what_reaches_the_share_is_aligned(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    every, few = (sorted(tuple(r) for r in lk.align_items(d, i, shared_only=x).collect()) for x in (False, True))
    leaks = sorted(tuple(r) for r in lk.find_leaks(d, i).collect())
    assert leaks == few == [r for r in every if r[3] >= lk.needed_words(r[2], 1 / 3)]
    assert len(few) < len(every)


def test_a_repetitive_item(spark):
    # one n-gram covers all words of an item that repeats it
    phrase, other = "seven grey herons left early ", " ".join(f"v{i}" for i in range(60))
    items = [(1, phrase * 12), (2, other)]
    docs = [(1, "x y z " + phrase + "x y z"), (2, phrase * 2), (3, "nothing of it")]
    assert found(spark, docs, items) == brute(docs, items) == {(1, 1), (2, 1)}


def test_edited_copies(spark):
    words = [f"w{i}" for i in range(60)]
    item = " ".join(words)
    # every fifth word is another one: no five words in a row are the item's
    edited = " ".join(f"e{i}" if i % 5 == 4 else w for i, w in enumerate(words))
    docs = spark.createDataFrame([(1, "a b c " * 50 + edited), (2, " ".join(words[:12])), (3, "a b c " * 9), (4, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.alignment, r.copied_words) for r in lk.edited_copies(docs, items).collect()}
    assert set(got) == {1, 4} and got[4] == (1.0, 60) and got[1][1] == 0 and 0.6 < got[1][0] < 0.8


def test_seeds_leave_no_leak_without_one():
    rnd = np.random.default_rng(7)
    for _ in range(200):
        ids = rnd.integers(1, rnd.integers(3, 60), rnd.integers(5, 60)).astype(np.int64)
        grams = lk.grams_of(ids, lk.SEED)
        by_gram = {g: rnd.integers(0, 6) for g in set(grams.tolist())}
        seeds = set(lk.choose_seeds(grams, np.array([by_gram[g] for g in grams.tolist()]), 1 / 3).tolist())
        at = np.array([g not in seeds and by_gram[g] > 0 for g in grams.tolist()])
        bare = [k for k in range(len(ids) - 4) if at[k] and at[k + 1]]
        assert lk.covered(np.array(bare, int), len(ids)).sum() < lk.needed_words(len(ids), 1 / 3)


def test_forms_of_a_copy(spark):
    item = "Before the half-finished canal of Vibasir's county opened, nineteen clerks counted every barge that passed the lock."
    forms = [
        item,
        item.upper().replace(",", " ").replace(".", ""),
        item.replace("counted", "coun-\nted").replace("opened", "ope\u00ad\nned"),
        item.replace(" ", "\n"),
        item.replace("half-finished", "half-\nfinished"),
        "nineteen clerks counted every barge " + "x " * 30 + "before the half-finished canal of",
        "nineteen clerks counted every dog",
        "",
        None,
    ]
    docs = list(enumerate(forms)) + [(0, item)]
    assert found(spark, docs, [(1, item), (2, "too short for it"), (3, None), (4, "")]) == {(i, 1) for i in range(6)}


def test_empty(spark):
    assert found(spark, [], [(1, "a b c d e f g")]) == set()
    assert found(spark, [(1, "a b c d e f g")], []) == set()


def test_alignment_equals_the_recurrence():
    rnd = np.random.default_rng(5)
    pairs = [(rnd.integers(1, 5, rnd.integers(1, 12)).astype(np.int32), rnd.integers(0, 5, rnd.integers(1, 30)).astype(np.int32)) for _ in range(60)]
    for (a, b), got in zip(pairs, lk.smith_waterman(pairs), strict=True):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert got == h.max()
