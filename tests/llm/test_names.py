import itertools
import random

import pytest

from claimloom.llm import names as n

COMPANIES = [
    ["Keturi Tumidram Pharmaceuticals Incorporated", "Keturi T Pharmaceuticals Incorporated", "M/s. Tumidram Keturi Pharma Inc.", "PHARMACRUTICALS INC, KETURI TUMIDRAM", "KeturiTumidram Pharmaceuticals", "The Keturi & Tumidram Phramaceuticals"],
    ["Keturi Tumidram Logistics Limited", "Keturi-Tumidram Lgstcs Ltd", "keturi  tumdram logis."],
    ["Fopekox Lelibu Agro Foods (P) Ltd", "Fpoekox Lelibu Agor Foods Private Limited", "fopekoxlelibu agr foods", "agrof oods pvt. ltd., Fopekox L."],
    ["Gapikes Bobasux Engineering Company Limited", "gapikes bobasux eng'g co. ltd."],
    ["Vadrupun Dodranon Energy Systems Holdings Limited", "Vadruppun Dodranon Energy Sys Hldgs"],
    # names without a line differ in their fourth word too
    ["Blue Orchid Kestrel Falcon Ltd", "Falcon Kestrel Blue Orchid Limited"],
    ["Blue Orchid Kestrel Marigold Ltd"],
    # beyond 200 characters
    ["Zed Quartz " + "Quillibrant Ostrevane Mundelkop " * 8 + x for x in ("Ltd", "Limited")],
]
PERSONS = [
    ["Elizabeth Drebul Biliseoku", "Beth Biliseoku", "Biliseoku, Elizabeth Drebul", "Dr. E Drebul Biliseoku", "ELIZABETH D. BILISEOKU", "Elizabeth Drbeul Biliseoku"],
    ["Robert Tibato Tuvupeholm", "Capt. Bob Tibato Tuvupeholm", "Tuvupeholm Robert Tibato"],
    ["William Kuradr Rasubiley", "Bill Kuradr Rasubiley"],
    ["Patricia Malahu Rasubiley"],
    # turned around and misspelt in the first letters
    ["Arjun Thomas Mehta", "Mehta Thomas Rajun", "Thomas Mehta Arujn"],
]
GENERAL = ["It", "The Company", "our company", "the group", "They", "", None, "12 %", "Limited"]


def grouped(spark, groups, kind, **more):
    rows = [(s, kind) for g in groups for s in g]
    random.Random(2).shuffle(rows)
    out = {}
    for r in n.link_names(spark.createDataFrame(rows, "s string, kind string"), **more).collect():
        out.setdefault(r.group_id, set()).add(r.s)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("max_shard", [n.MAX_SHARD, 1])
def test_companies_and_general_words(spark, max_shard):
    assert grouped(spark, [*COMPANIES, GENERAL], "company", max_shard=max_shard) == sorted(map(sorted, COMPANIES))


def test_persons(spark):
    assert grouped(spark, PERSONS, "person") == sorted(map(sorted, PERSONS))


def test_a_partial_form_that_fits_two_is_left_alone(spark):
    names = [["Keturi Tumidram Shipping Ltd"], ["Keturi Tosobal Shipping Ltd"], ["Keturi T. Shipping Ltd", "M/s Keturi T Shipping Limited"]]
    assert grouped(spark, names, "company") == sorted(map(sorted, names))


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def in_any_order(a, b):
    x, y = a.split(" "), b.split(" ")
    return min(sum(map(lev, x, p)) for p in itertools.permutations(y)) if len(x) == len(y) else 99


def misspelt(rnd, w):
    k = rnd.randrange(len(w))
    return w[:k] + rnd.choice(["", "x", w[k] + "y"]) + w[k + 1 :] or "z"


@pytest.mark.parametrize(("scope", "most_words", "max_shard"), [("z|full", 1, n.MAX_SHARD), ("z|full", 5, 1), ("z", 5, n.MAX_SHARD)])
def test_trie_join_equals_all_pairs(spark, scope, most_words, max_shard):
    rnd, keys = random.Random(4), set()
    for _ in range(60):
        words = ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 15 // most_words + 3))) for _ in range(rnd.randint(1, most_words))]
        for _ in range(3):
            keys.add(" ".join(words))
            rnd.shuffle(words)
            i = rnd.randrange(len(words))
            words[i] = misspelt(rnd, words[i])
    df = spark.createDataFrame([("s", scope, w, True, True, True) for w in keys], "s string, scope string, key string, indexed boolean, query boolean, full boolean")
    want = {(a, b) for a in keys for b in keys if a != b and (d := in_any_order(a, b)) <= n.bound(b, scope) and d <= n.bound(a, scope) + 1}
    got = {(r.query_key, r.key) for r in n.trie_join(df, max_shard).collect() if r.query_key != r.key}
    assert got == want and len(want) > 40


def test_lines_are_learned(spark):
    rnd = random.Random(3)
    made = ["".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(4)).title() for _ in range(120)]
    names = [(f"{a} {b} {line} Ltd", "company") for a, b in zip(made[::2], made[1::2], strict=True) for line in ("Glazing", "Orchards")]
    names += [(f"{misspelt(rnd, made[0].lower())} {misspelt(rnd, made[1].lower())} Glazing", "company") for _ in range(60)]
    known = n.learn_lines(spark.createDataFrame(names, "s string, kind string"), n.Words({}, {}))
    assert set(known.lines) == {"glazing", "orchards"} and known.line("glazng") == "glazing"
    groups = {r.s: r.group_id for r in n.link_names(spark.createDataFrame(names, "s string, kind string"), n.Words({}, {})).collect()}
    assert len({groups[s] for s, _ in names[:120]}) == 120


PREDICATES = [
    ["depreciation_and_amortisation", "D&A", "depn_and_amortisation", "Amortisation & Depreciation"],
    ["capital_expenditure", "capex", "cap_expenditure", "capital expnditure"],
    ["capacity_utilisation", "cap_utilisation", "utilization of capacity"],
    ["operating_expenses", "opex", "Expenses - Operating"],
    ["operating_margin", "op_margin", "Margin, Operating"],
    ["fulfilment_centres", "fulfillment_centers", "FCs fulfilment"],
    ["debt_equity_ratio", "d_e_ratio", "debt-to-equity"],
    ["headquartered_at", "hq_at"],
    ["warehouse_space", "w/h space"],
    ["net_profit", "nt_profit"],
    ["gross_profit", "Gr. Profit"],
    ["earnings_per_share", "EPS"],
    # seven words, the first letter misspelt
    ["alpha_beta_gamma_delta_epsilon_zeta_theta", "zeta alpha beta gamma delta epsilon yheta"],
    ["turn_over " * 30 + "count", "turn over " * 30 + "cuont"],
]


def test_predicates(spark):
    rows = [(s, 100 if k == 0 else 5) for g in PREDICATES for k, s in enumerate(g)] + [("", 3)]
    out = {}
    for r in n.link_predicates(spark.createDataFrame(rows, "s string, n long")).collect():
        out.setdefault(r.group_id, set()).add(r.s)
    assert sorted(map(sorted, out.values())) == sorted(map(sorted, PREDICATES))


def test_pairs_and_empty(spark):
    schema = "subject_name string, subject_type string, predicate string, name_a string"
    rows = [(s, "company", p, "clash") for s, p in zip(COMPANIES[1], ["capex", "capital_expenditure", None], strict=True)] * 2
    got = {tuple(r) for r in n.linked_spellings(spark.createDataFrame(rows, schema)).collect()}
    names = sorted(COMPANIES[1])
    assert got == {("subject_name", a, b) for i, a in enumerate(names) for b in names[i + 1 :]} | {("predicate", "capex", "capital_expenditure")}
    assert n.linked_spellings(spark.createDataFrame([], schema)).count() == 0


def test_no_step_plans_more_than_the_driver_holds(spark, monkeypatch):
    """Steps of one plan are planned anew after every stage of it; the largest had 28 joins and aggregations."""
    from claimloom import session

    most, write = [], session.Staged.__init__

    def counted(self, df, *args, **more):
        most.append(df._jdf.queryExecution().sparkPlan().toString().count("Join") + df._jdf.queryExecution().sparkPlan().toString().count("HashAggregate"))
        write(self, df, *args, **more)

    monkeypatch.setattr(session.Staged, "__init__", counted)
    rows = [(s, "company", p) for g in COMPANIES for s in g for p in ("net profit", "profit net", "revenue")]
    assert n.spellings(spark.createDataFrame(rows, "subject_name string, subject_type string, predicate string")).count() > 0
    assert max(most) <= 12, most
