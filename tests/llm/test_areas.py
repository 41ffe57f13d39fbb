import random

from claimloom.llm import areas as a

WORDS = {
    "law": ["verdict", "plaintiff", "arbitration", "statute", "injunction", "Schiedsklausel"],
    "sport": ["striker", "marathon", "penalty shootout", "relay team", "goalkeeper", "Torschützen"],
    "energy": ["turbine", "pipeline", "substation", "grid frequency", "refinery", "Stromnetze"],
}
PLAIN = ["The second meeting put off the remaining questions.", "A new review repeated the earlier view.", "In 2019 the summary said little."]


def sentence(rnd, area):
    x, y = rnd.choices(WORDS[area], k=2)
    return rnd.choice([f"The {x} was measured against the {y}.", f"Few had expected the {x} this year!", f"Near Paris the {y} and the {x} grew by 3.5%."])


def corpus(n, seed):
    rnd = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        chosen = rnd.sample(list(WORDS), rnd.choice([0, 1, 1, 2]))
        text = [sentence(rnd, x) for x in chosen for _ in range(rnd.randrange(3, 7))] + rnd.choices(PLAIN, k=rnd.randrange(4))
        rest = [x for x in WORDS if x not in chosen]
        text += [sentence(rnd, rnd.choice(rest))]  # a passing sentence
        rnd.shuffle(text)
        docs.append((i, " ".join(text)))
        truth[i] = set(chosen)
    return docs, truth


def frames(spark, docs, labels):
    return (
        spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, area string"),
        spark.createDataFrame(labels, "doc_id long, area string"),
        spark.createDataFrame([(x, "") for x in WORDS], "area string, description string"),
    )


def found(spark, docs, labels):
    rows = [tuple(r) for r in a.document_areas(*frames(spark, docs, labels)).collect()]
    assert len(rows) == len(set(rows))
    out = {}
    for i, area in rows:
        out.setdefault(i, set()).add(area)
    return out


def test_held_out_accuracy(spark):
    docs, truth = corpus(400, 1)
    extra = [(900, ""), (901, None), (902, "12 %!"), (903, "The verdict and the statute."), (904, "The verdict. Some statute."), (905, "The verdict. Nothing else here."), (3, docs[3][1])]
    extra.append((906, (PLAIN[0] + " ") * 3000 + "The marathon relay team. The goalkeeper. The striker. "))
    labels = [(i, x) for i in range(200) for x in truth[i]] + [(5, "unknown area"), (None, "law"), (123456, "law")]
    got = found(spark, docs + extra, labels)
    right = wrong = missed = 0
    for i in range(200, 400):
        right += len(got.get(i, set()) & truth[i])
        wrong += len(got.get(i, set()) - truth[i])
        missed += len(truth[i] - got.get(i, set()))
    assert wrong + missed <= 0.08 * right
    assert not {900, 901, 902} & got.keys()
    assert got[903] == got[904] == {"law"} and got[906] == {"sport"} and 905 not in got


def test_no_labels_and_empty(spark):
    assert found(spark, [(1, "The verdict.")], []) == {}
    assert found(spark, [], [(1, "law")]) == {}


def test_sentences():
    assert a.sentences_of("One two. Three!\n\nfour five") == [["one", "two"], ["three"], ["four", "five"]]
    assert a.sentences_of("It cost Rs. 5 crore. \"Yes.\" 3.5 units") == [["it", "cost", "rs", "crore"], ["yes"], ["units"]]
    assert a.sentences_of(None) == a.sentences_of("  \n\n ") == []
