"""The same questions in SQL, for DuckDB."""

from __future__ import annotations

from claimloom.functions import vocab as V
from claimloom.operators.compare import compatible_predicates


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(map(_q, words)) + ")"


def _map(words: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {_q(k)} THEN {_q(v) if isinstance(v, str) else v}" for k, v in words.items()) + " END"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _first(text: str, rules: list[tuple[str, str]], prefix: str = "(?i)") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {_q(prefix + p)}) THEN {_q(name)}" for p, name in rules) + " END"


EL = """el AS (SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY ingested_at DESC,
  coalesce(is_deleted, false), content DESC NULLS LAST) AS _n FROM elements WHERE element_id IS NOT NULL) WHERE _n = 1)"""
FA = """fa AS (SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY loaded_at DESC, value_raw DESC) AS _n
  FROM facts WHERE fact_id IS NOT NULL) WHERE _n = 1)"""

_T = "coalesce(content, '')"
_ST = _strip(_T)
_NOISE = f"(length({_ST}) < 3 OR regexp_matches({_ST}, {_q(V.BOILERPLATE)}) OR (length({_ST}) > 8 AND length(regexp_replace({_ST}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length({_ST}) < 0.35))"
_NUM = f"regexp_matches({_T}, '\\d')"
_TIME = f"regexp_matches({_T}, {_q(V.TEMPORAL_SIGNAL)})"
_WORD = f"regexp_matches(lower({_T}), {_q('|'.join(V.FACT_WORDS))})"
_PRIORITY = f"CASE WHEN element_type = 'table' THEN 1 WHEN element_type IN ('figure', 'image') THEN 6 WHEN element_type = 'caption' THEN 5 WHEN {_NUM} THEN 2 WHEN {_TIME} THEN 3 WHEN {_WORD} THEN 4 ELSE 10 END"


def _noise_of(x: str) -> str:
    return _NOISE.replace(_T, f"coalesce({x}, '')")


def _part(k: int) -> str:
    return f"regexp_extract_all({_T}, {_q(V.QUANTITY)}, {k})"


def _null(x: str) -> str:
    return f"nullif({x}, '')"


_TIMES = [
    ("as_of_date", V.AS_OF, 1, "as of "), ("date_range", V.YEAR_ENDED, 1, "for the year ended "), ("specific_date", V.DATE, 1, ""),
    ("quarter", V.QUARTER, 0, ""), ("fiscal_year", V.FISCAL, 1, ""), ("calendar_year", V.DURING, 1, "during "), ("calendar_year", V.YEAR, 1, ""),
]


def _time_case(what) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({_T}, {_q(p)}) THEN {what(kind, p, g, lead)}" for kind, p, g, lead in _TIMES)


def _currency(x: str) -> str:
    return f"CASE WHEN length({x}) > 0 THEN coalesce({_map(V.CURRENCY, f'lower({_strip(x)})')}, upper({_strip(x)})) END"


def _unit(x: str) -> str:
    k = f"lower({_strip(x)})"
    return f"CASE WHEN length({x}) > 0 THEN coalesce({_map(V.UNIT, k)}, {k}) END"


def _mult(x: str) -> str:
    return f"coalesce({_map(V.SCALE, f'lower({_strip(x)})')}, 1.0)::DOUBLE"


def _number(x: str) -> str:
    t = f"regexp_replace({x}, '[^\\d.-]', '', 'g')"
    return f"CASE WHEN regexp_matches({t}, '^-?(?:\\d+\\.?\\d*|\\.\\d+)$') THEN try_cast({t} AS DOUBLE) END"


def _fy(x: str) -> str:
    t = f"upper({_strip(x)})"
    end = f"nullif(regexp_extract({t}, '(\\d{{4}})\\s*-\\s*(\\d{{2,4}})', 2), '')"
    return (
        f"coalesce(try_cast(nullif(regexp_extract({t}, 'FY\\s*(\\d{{4}})', 1), '') AS INT), try_cast(nullif(regexp_extract({t}, 'FY\\s*(\\d{{2}})\\b', 1), '') AS INT) + 2000, "
        f"CASE WHEN length({end}) = 2 THEN try_cast({end} AS INT) + 2000 ELSE try_cast({end} AS INT) END)"
    )


def _cy(x: str) -> str:
    return f"try_cast(nullif(regexp_extract({x}, {_q(V.YEAR)}, 1), '') AS INT)"


def _quarter(x: str) -> str:
    t = f"upper({_strip(x)})"
    word = f"regexp_extract({t}, '\\b(FIRST|SECOND|THIRD|FOURTH)\\s+QUARTER\\b', 1)"
    return f"coalesce(try_cast(nullif(regexp_extract({t}, '\\bQ([1-4])\\b', 1), '') AS INT), {_map({'FIRST': 1, 'SECOND': 2, 'THIRD': 3, 'FOURTH': 4}, word)})"


def _day(x: str) -> str:
    t = f"lower({_strip(x)})"

    def read(p: str, y: int, m: int, d: int, named: bool) -> str:
        part = lambda k: f"regexp_extract({t}, {_q(p)}, {k})"
        month = f"({_map(V.MONTHS, part(m))})" if named else f"try_cast(nullif({part(m)}, '') AS INT)"
        return f"(try_cast(nullif({part(y)}, '') AS INT) * 10000 + {month} * 100 + try_cast(nullif({part(d)}, '') AS INT))"

    return f"coalesce({read(r'(\d{4})-(\d{1,2})-(\d{1,2})', 1, 2, 3, False)}, {read(r'([a-z]+)\s+(\d{1,2}),?\s+(\d{4})', 3, 1, 2, True)}, {read(r'(\d{1,2})\s+([a-z]+)\s+(\d{4})', 3, 2, 1, True)})"


def _key(x: str) -> str:
    return f"lower({_strip(f'coalesce({x}, {_q('')})')})"


_GENERAL = _in(V.GENERIC_SUBJECTS)
_NUMERIC = "('number', 'percentage', 'currency', 'quantity')"


def _types(fa: str, fb: str, va: str, vb: str) -> str:
    return f"({fa} = {fb} OR ({va} IN {_NUMERIC} AND {vb} IN {_NUMERIC}) OR ({va} IN ('text', 'entity') AND {vb} IN ('text', 'entity')) OR ({fa} IN ('attribute', 'semantic') AND {fb} IN ('attribute', 'semantic')))"


def _compat(p: str, q: str) -> str:
    return "(" + " OR ".join(f"({p} = {_q(k)} AND {q} IN {_in(v)})" for k, v in compatible_predicates().items()) + ")"


def _turn(p: str, q: str, pairs: list[tuple[str, str]]) -> str:
    return "(" + " OR ".join(f"({p} = {_q(x)} AND {q} = {_q(y)}) OR ({p} = {_q(y)} AND {q} = {_q(x)})" for x, y in pairs) + ")"


_QUAL_SYN = {
    **dict.fromkeys(["approximate", "approximately", "around", "about"], "approximate"),
    **dict.fromkeys(["greater_than", "over", "more_than", "at_least", "above"], "greater_than"),
    **dict.fromkeys(["less_than", "under", "below", "at_most"], "less_than"),
}
_OWN_Q = f"lower({_strip('value_qualifier')})"
_FACT_Q = f"list_filter(list_transform(qualifiers, lambda q: {_map(_QUAL_SYN, f'lower({_strip('q')})')}), lambda q: q IS NOT NULL)[1]"

PREPARED = f"""{FA}, pr AS (SELECT fact_id, document_id, fact_type, value_type, confidence, {_key('subject_name')} AS subject, {_key('predicate')} AS predicate,
  {_key('value_raw')} AS txt, coalesce(value_num, {_number('value_raw')}) AS v, {_mult('scale')} AS mult, {_unit('unit')} AS unit, {_currency('currency')} AS cur,
  coalesce(currency, '') AS cur_raw, CASE WHEN length(value_qualifier) > 0 THEN coalesce({_map(_QUAL_SYN, _OWN_Q)}, {_OWN_Q}) ELSE {_FACT_Q} END AS bnd,
  coalesce(time_type, 'unknown') AS tt, coalesce(upper(time_value), '') AS tx, {_day('coalesce(time_start, time_value)')} AS dy, {_fy('time_value')} AS fy, {_cy('time_value')} AS cy,
  {_quarter('time_value')} AS qu, {_key('scope')} AS scope,
  list_sort(list_distinct(list_transform(coalesce(qualifiers, []), lambda x: {_key('x')}))) AS quals FROM fa),
pairs AS (SELECT DISTINCT match_id, fact_a_id, fact_b_id FROM match_results WHERE fact_a_id <> fact_b_id),
p AS (SELECT match_id, a, b FROM pairs JOIN pr a ON a.fact_id = fact_a_id JOIN pr b ON b.fact_id = fact_b_id)"""


def _close(x: str, y: str) -> str:
    return f"(abs({x} - {y}) <= greatest(1e-5 * greatest(abs({x}), abs({y})), 1e-7))"


_NN = f"(a.value_type IN {_NUMERIC} AND b.value_type IN {_NUMERIC})"
_NOTNUM = f"(NOT coalesce({_NN}, false))"
_BA, _BB = "(a.v * a.mult)", "(b.v * b.mult)"
_CLASH = "((a.cur IS NOT NULL AND b.cur IS NOT NULL AND a.cur <> b.cur) OR (a.unit IS NOT NULL AND b.unit IS NOT NULL AND a.unit <> b.unit))"
_PA, _PB = "(a.value_type = 'percentage')", "(b.value_type = 'percentage')"
_SHARE = f"(({_PA} AND NOT {_PB} AND {_close('a.v / 100', _BB)}) OR ({_PB} AND NOT {_PA} AND {_close('b.v / 100', _BA)}))"
_UNIT0 = "CASE WHEN a.unit IS NULL AND b.unit IS NULL THEN 'not_applicable' WHEN a.unit IS NULL OR b.unit IS NULL THEN 'missing' ELSE 'same' END"


def _bound(q: str) -> str:
    return f"(coalesce(a.bnd, '') = '{q}' OR coalesce(b.bnd, '') = '{q}')"


def _agree(c: str) -> str:
    return f"CASE WHEN {c} THEN 'compatible' ELSE 'different' END"


_IDENTICAL = "(a.v = b.v AND a.mult = b.mult AND a.cur_raw = b.cur_raw)"
_QYEAR = lambda x: f"(CASE WHEN {x}.tt = 'fiscal_year' THEN {x}.fy ELSE {x}.cy END)"
_QU = lambda x: f"(CASE WHEN {x}.tt IN ('quarter', 'fiscal_year') THEN {x}.qu END)"
_SAME = lambda c: f"CASE WHEN {c} THEN 'same' ELSE 'different' END"
_ALIAS = lambda x: _strip(f"replace(replace({x}, ' limited', ''), ' ltd', '')")

SIGNALS = f"""{PREPARED}, s0 AS (SELECT match_id, a, b,
  CASE WHEN a.subject = b.subject AND a.document_id = b.document_id THEN 'exact'
    WHEN a.subject = b.subject AND NOT (a.subject = '' OR a.subject IN {_GENERAL}) THEN 'exact'
    WHEN a.subject = '' OR a.subject IN {_GENERAL} OR b.subject = '' OR b.subject IN {_GENERAL} THEN 'unknown'
    WHEN {_ALIAS('a.subject')} = {_ALIAS('b.subject')} THEN 'alias' ELSE 'different' END AS sig_subject,
  CASE WHEN a.predicate = '' OR b.predicate = '' THEN 'unknown' WHEN a.predicate = b.predicate THEN 'exact'
    WHEN {_compat('a.predicate', 'b.predicate')} OR {_turn('a.predicate', 'b.predicate', V.TRANSITIONS)} THEN 'compatible' ELSE 'different' END AS sig_predicate,
  CASE WHEN {_types('a.fact_type', 'b.fact_type', 'a.value_type', 'b.value_type')} THEN 'compatible' ELSE 'incompatible' END AS sig_fact_type,
  CASE WHEN a.tt = 'unknown' OR b.tt = 'unknown' OR a.tx = '' OR b.tx = '' THEN 'unknown'
    WHEN {_strip('a.tx')} = {_strip('b.tx')} THEN 'same'
    WHEN a.tt IN ('specific_date', 'as_of_date') AND b.tt IN ('specific_date', 'as_of_date') AND a.dy IS NOT NULL AND b.dy IS NOT NULL THEN {_SAME('a.dy = b.dy')}
    WHEN a.tt = 'fiscal_year' AND b.tt = 'fiscal_year' AND a.fy IS NOT NULL AND b.fy IS NOT NULL THEN {_SAME('a.fy = b.fy')}
    WHEN a.tt = 'calendar_year' AND b.tt = 'calendar_year' AND a.cy IS NOT NULL AND b.cy IS NOT NULL THEN {_SAME('a.cy = b.cy')}
    WHEN ({_QU('a')} IS NULL) <> ({_QU('b')} IS NULL) AND coalesce(a.fy = b.fy, false) THEN 'contained'
    WHEN ((a.tt = 'fiscal_year' AND b.tt = 'calendar_year') OR (a.tt = 'calendar_year' AND b.tt = 'fiscal_year')) AND {_QYEAR('a')} IS NOT NULL AND {_QYEAR('b')} IS NOT NULL
      THEN CASE WHEN abs({_QYEAR('a')} - {_QYEAR('b')}) <= 1 THEN 'overlapping' ELSE 'different' END
    ELSE 'different' END AS sig_time,
  CASE WHEN a.scope = 'unknown' OR b.scope = 'unknown' THEN 'unknown' WHEN a.scope = b.scope THEN 'same' ELSE 'different' END AS sig_scope,
  CASE WHEN {_NOTNUM} AND (a.txt = '' OR b.txt = '') THEN 'unknown' WHEN {_NOTNUM} THEN CASE WHEN a.txt = b.txt THEN 'equal' ELSE 'different' END
    WHEN a.v IS NULL OR b.v IS NULL THEN 'unknown' WHEN {_CLASH} THEN 'different' WHEN {_SHARE} THEN 'equivalent'
    WHEN {_bound('greater_than')} THEN {_agree(f"CASE WHEN coalesce(a.bnd, '') = 'greater_than' THEN {_BB} > {_BA} ELSE {_BA} > {_BB} END")}
    WHEN {_bound('less_than')} THEN {_agree(f"CASE WHEN coalesce(a.bnd, '') = 'less_than' THEN {_BB} < {_BA} ELSE {_BA} < {_BB} END")}
    WHEN {_bound('approximate')} THEN {_agree(f"coalesce(abs({_BA} - {_BB}) / nullif(greatest(abs({_BA}), abs({_BB})), 0), 0) <= 0.05")}
    WHEN {_close(_BA, _BB)} THEN CASE WHEN {_IDENTICAL} THEN 'equal' ELSE 'equivalent' END ELSE 'different' END AS sig_value,
  CASE WHEN {_NOTNUM} THEN 'not_applicable' WHEN a.v IS NULL OR b.v IS NULL THEN 'unknown' WHEN {_CLASH} THEN 'different' WHEN {_SHARE} THEN 'converted'
    WHEN {_bound('greater_than')} OR {_bound('less_than')} OR {_bound('approximate')} THEN {_UNIT0}
    WHEN {_close(_BA, _BB)} THEN CASE WHEN {_IDENTICAL} THEN 'same' ELSE 'converted' END
    WHEN a.mult <> b.mult OR (a.cur IS NOT NULL AND a.cur = b.cur AND a.cur_raw <> b.cur_raw) THEN 'converted' ELSE {_UNIT0} END AS sig_unit
  FROM p),
s AS (SELECT *, CASE WHEN a.quals = b.quals THEN 'exact'
    WHEN (list_contains(a.quals, 'audited') AND list_contains(b.quals, 'unaudited')) OR (list_contains(a.quals, 'unaudited') AND list_contains(b.quals, 'audited'))
      OR (list_contains(a.quals, 'estimated') AND list_contains(b.quals, 'audited')) OR (list_contains(a.quals, 'audited') AND list_contains(b.quals, 'estimated')) THEN 'different'
    WHEN list_has_any(list_concat(a.quals, b.quals), ['approximately', 'approximate']) AND sig_value IN ('equal', 'equivalent', 'compatible') THEN 'compatible'
    ELSE 'different' END AS sig_qualifiers,
  (sig_subject = 'different' OR sig_predicate = 'different' OR sig_fact_type = 'incompatible') AS apart,
  (sig_subject = 'unknown' OR sig_predicate = 'unknown') AS unk, {_turn('a.predicate', 'b.predicate', V.TRANSITIONS)} AS turned,
  (sig_time IN ('different', 'contained', 'overlapping') OR sig_scope = 'different') AS rel,
  least(coalesce(a.confidence, 0.0), coalesce(b.confidence, 0.0)) AS c FROM s0),
m AS (SELECT *, CASE WHEN apart THEN 'NOT_MATCH' WHEN unk THEN 'UNCERTAIN' WHEN turned OR rel THEN 'RELATED_CLAIM' ELSE 'SAME_CLAIM' END AS classification,
  CASE WHEN apart THEN 1.0 WHEN unk THEN 0.5 ELSE round(c * CASE WHEN turned THEN 0.90 WHEN rel THEN 0.88 WHEN sig_value IN ('equal', 'equivalent') THEN 0.98
    WHEN sig_value = 'compatible' THEN 0.92 WHEN sig_value = 'different' THEN 0.90 ELSE 0.75 END, 4)::DOUBLE END AS confidence FROM s)"""


def _clamp(f: float, hi: float) -> str:
    return f"least({hi}, greatest(0.5, c * {f}))"


_UK = lambda x: f"regexp_replace({x}, '[\\s_-]+', '_', 'g')"
_PCT = lambda x: f"({x}.value_type = 'percentage' OR coalesce({x}.unit, '') = '%')"
_CTX = [
    ("turned2", 0.90, 0.92, "status transition"), ("sig_time = 'different'", 0.92, 0.94, "different reporting periods"),
    ("sig_time IN ('overlapping', 'contained')", 0.85, 0.88, "differing reporting durations"), ("sig_scope = 'different'", 0.90, 0.92, "different reporting scopes"),
    ("sig_qualifiers = 'different'", 0.82, 0.85, "different qualifiers"), ("dim", 0.82, 0.86, "different metric dimensions"),
]


def _rel_case(*x: str) -> str:
    return (
        f"CASE WHEN classification = 'NOT_MATCH' THEN {x[0]} WHEN sig_subject = 'unknown' OR classification = 'UNCERTAIN' THEN {x[1]} "
        f"WHEN claim AND NOT turned2 AND sig_time <> 'different' AND sig_scope <> 'different' AND sig_value IN ('equal', 'equivalent', 'compatible') THEN {x[2]} "
        f"WHEN ent AND (pred OR turned2) AND sig_fact_type = 'compatible' AND ({' OR '.join(k for k, *_ in _CTX)}) THEN {x[3]} "
        f"WHEN claim AND sig_scope = 'same' AND sig_time NOT IN ('different', 'overlapping', 'contained') AND sig_value = 'different' AND NOT dim THEN {x[4]} "
        f"WHEN ent AND pred AND sig_value = 'different' THEN {x[5]} ELSE {x[6]} END"
    )


_CONV = "(sig_value = 'equivalent' OR sig_unit = 'converted')"
RELATED = f"""{SIGNALS}, r0 AS (SELECT *, {_turn(_UK('a.predicate'), _UK('b.predicate'), V.TRANSITIONS_REASONING)} AS turned2, sig_subject IN ('exact', 'alias') AS ent,
  sig_predicate IN ('exact', 'compatible') AS pred, coalesce({_PCT('a')}, false) <> coalesce({_PCT('b')}, false) AS dim,
  sig_subject IN ('exact', 'alias') AND sig_predicate IN ('exact', 'compatible') AND sig_fact_type = 'compatible' AS claim FROM m),
r AS (SELECT *, {_rel_case("'UNRELATED'", "'UNRESOLVED'", "'CORROBORATES'", "'CONTEXTUALLY_RECONCILED'", "'CONTRADICTS'", "'UNRESOLVED'", "'UNRESOLVED'")} AS relationship,
  round({_rel_case('0.98', '0.50', f"CASE WHEN {_CONV} THEN {_clamp(0.96, 0.98)} WHEN sig_value = 'compatible' THEN {_clamp(0.90, 0.95)} ELSE {_clamp(0.98, 0.99)} END",
    'CASE ' + ' '.join(f'WHEN {k} THEN {_clamp(f, hi)}' for k, f, hi, _ in _CTX) + ' END', f"CASE WHEN sig_time = 'same' THEN {_clamp(0.94, 0.96)} ELSE {_clamp(0.82, 0.88)} END", '0.55', '0.50')}, 4)::DOUBLE AS rel_confidence,
  {_rel_case("'different entities'", "'unresolved entity'", f"CASE WHEN {_CONV} THEN 'numerically equivalent' WHEN sig_value = 'compatible' THEN 'within the approximation tolerance or bound' ELSE 'same value' END",
    'CASE ' + ' '.join(f"WHEN {k} THEN '{why}'" for k, _, _, why in _CTX) + ' END', "'materially different values'", "'context does not establish a conflict'", "'insufficient context'")} AS reason,
  CASE WHEN coalesce(a.document_id = b.document_id, false) THEN 'same_document' ELSE 'cross_document' END AS source_independence FROM r0)"""

_CLASS = "document_id, norm_subject, norm_predicate, fact_type, value_type, value_raw, unit, currency, scale, time_value, scope"
CLASSES = f"""{FA}, ix AS (SELECT *, {_key('subject_name')} AS norm_subject, {_key('predicate')} AS norm_predicate FROM fa),
cl AS (SELECT {_CLASS}, min(fact_id) AS class_id, count(DISTINCT fact_id) AS n FROM ix GROUP BY ALL)"""
_KNOWN = f"norm_subject <> '' AND norm_subject NOT IN {_GENERAL}"
_BT = _types("a.fact_type", "b.fact_type", "a.value_type", "b.value_type")

_GA, _GB = (f"({x}.subject = '' OR {x}.subject IN {_GENERAL})" for x in "ab")
#: all pairs of the three passes, written out
PASSED = f"""SELECT CASE WHEN {_GA} OR {_GB} THEN 3 WHEN a.predicate = b.predicate THEN 1 ELSE 2 END AS pass_no, a.fact_id AS fact_a_id, b.fact_id AS fact_b_id
FROM pr a JOIN pr b ON a.fact_id < b.fact_id AND a.document_id <> b.document_id AND a.predicate <> '' AND b.predicate <> '' AND {_BT}
AND ((a.predicate = b.predicate AND (a.subject = b.subject OR {_GA} OR {_GB})) OR (a.subject = b.subject AND NOT {_GA} AND {_compat('a.predicate', 'b.predicate')}))"""
_GIVEN = "SELECT DISTINCT match_id, fact_a_id, fact_b_id FROM match_results WHERE fact_a_id <> fact_b_id"
CHAIN = RELATED.replace(_GIVEN, f"SELECT pass_no AS match_id, fact_a_id, fact_b_id FROM ({PASSED})")


def _block(cross: bool) -> str:
    return f"""WITH {CLASSES}, k AS (SELECT * FROM cl WHERE {_KNOWN} AND norm_predicate <> '')
SELECT a.norm_predicate AS predicate_a, count(*) AS n_class_pairs, sum(a.n * b.n)::BIGINT AS n_pairs FROM k a JOIN k b
ON a.norm_subject = b.norm_subject AND a.norm_predicate = b.norm_predicate AND a.class_id < b.class_id {'AND a.document_id <> b.document_id' if cross else ''} AND {_BT} GROUP BY 1"""


_EDGES = "(VALUES " + ", ".join(f"({_q(p)}, {_q(q)})" for p, qs in compatible_predicates().items() for q in qs) + ") e(p, q)"
_NUMBERISH = "(value_num IS NOT NULL OR coalesce(regexp_matches(replace(value_raw, ',', ''), '^\\s*[-+]?(\\d+\\.?\\d*|\\.\\d+)\\s*$'), false))"
_BLANK = lambda c: f"coalesce({_strip(c)}, '') = ''"
_DKEYS = ["document_id", "coalesce(subject_type, '')", "coalesce(value_type, '')", "coalesce(time_type, '')", *(_key(c) for c in ("subject_name", "predicate", "value_raw", "unit", "currency", "scale", "value_qualifier", "time_value", "scope"))]
_DEDUP = ", ".join(f"{k} AS k{i}" for i, k in enumerate(_DKEYS)) + f", array_to_string(list_sort(list_transform(coalesce(qualifiers, []), lambda x: {_key('x')})), '|') AS k13"
_KS = ", ".join(f"k{i}" for i in range(14))

_TOKENS = ["net", "profit", "satabrin", "2024"]
_SCORED = f"""sc AS (SELECT fact_id, (CASE WHEN NOT regexp_matches(lower(predicate), '^\\d+$') AND length(predicate) >= 3 AND contains('what was the net profit of satabrin in fiscal 2024?', replace(lower(predicate), '_', ' ')) THEN 40
  WHEN lower(predicate) IN {_in(_TOKENS)} THEN 35 WHEN length(predicate) >= 4 AND list_has_any(regexp_split_to_array(replace(lower(predicate), '_', ' '), '\\s+'), ['profit', 'satabrin', '2024']) THEN 15 ELSE 0 END)
  + CASE WHEN lower(subject_name) IN {_in(_TOKENS)} THEN 15 WHEN length(subject_name) >= 4 AND (contains(lower(subject_name), 'profit') OR contains(lower(subject_name), 'satabrin') OR contains(lower(subject_name), '2024')) THEN 8 ELSE 0 END
  + 15 * len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(time_value, '')), '\\b[a-z0-9]+\\b')), {str(_TOKENS)}))
  + CASE WHEN lower(scope) IN {_in(_TOKENS)} THEN 8 ELSE 0 END + CASE WHEN length(value_raw) >= 2 AND lower(value_raw) IN {_in(_TOKENS)} THEN 10 ELSE 0 END AS score FROM fa),
top AS (SELECT fact_id, score FROM sc WHERE score >= 15 ORDER BY score DESC, fact_id LIMIT 10)"""

ORACLE = {
    "normalize_text": f"WITH {EL} SELECT element_id, {_strip(f"regexp_replace(regexp_replace({_T}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', '', 'g'), '[ \\t]+', ' ', 'g')")} AS text FROM el",
    "text_signals": f"WITH {EL} SELECT element_id, {_NOISE} AS noise, {_NUM} AS number, {_TIME} AS time, {_WORD} AS fact_word, {_PRIORITY} AS priority FROM el",
    "select_candidates": f"""WITH {EL} SELECT element_id, element_type, {_PRIORITY} AS priority FROM el WHERE CASE
  WHEN element_type = 'table' THEN coalesce(len(table_rows) > 0 AND NOT (len(table_rows) = 1 AND len(table_rows[1]) <= 1) AND len(list_filter(flatten(table_rows), lambda c: {_strip('c')} <> '')) > 0, false)
  WHEN element_type IN ('figure', 'image') THEN coalesce(length(caption) > 0 AND NOT {_noise_of('caption')}, false) OR coalesce(len(list_filter(text_fragments, lambda f: NOT {_noise_of('f.text')})) > 0, false)
  ELSE element_type IN ('paragraph', 'text', 'list_item', 'section_header', 'footnote', 'caption') AND NOT {_NOISE} AND ({_WORD} OR {_NUM} OR element_type = 'caption') END""",
    "reading_order": f"""WITH {EL} SELECT element_id, row_number() OVER (PARTITION BY document_id, page_no ORDER BY round_even(coalesce(bbox.left, 0) / 250, 0) * 250,
  coalesce(bbox.top, 0), raw_order, element_id) - 1 AS place FROM el""",
    "page_numbers": f"""WITH {EL} SELECT document_id, page_no, arg_min(n, (raw_order, element_id)) AS printed_number FROM
  (SELECT *, nullif(regexp_extract(content, '\\b(\\d+)\\b', 1), '') AS n FROM el WHERE element_type IN ('page_header', 'page_footer')) WHERE n IS NOT NULL GROUP BY ALL""",
    "page_assembly": f"WITH {EL} SELECT document_id, coalesce(page_no, 1) AS page_no, count(*) AS n_elements FROM el GROUP BY ALL",
    "table_parts": f"""WITH {EL}, t AS (SELECT *, '^(Table [\\w.]+: [^.]+)\\.(.+)$' AS pat, list_filter(coalesce(table_rows, []), lambda r: regexp_matches(array_to_string(list_filter(list_transform(r, lambda c: {_strip('c')}), lambda c: c <> ''), ' '), '(?i)^source:')) AS src FROM el WHERE element_type = 'table')
SELECT element_id, CASE WHEN coalesce(regexp_matches(headers[1], '^(Table [\\w.]+: [^.]+)\\.(.+)$'), false) THEN regexp_extract(headers[1], '^(Table [\\w.]+: [^.]+)\\.(.+)$', 1) ELSE caption END AS caption,
  array_to_string(CASE WHEN coalesce(regexp_matches(headers[1], '^(Table [\\w.]+: [^.]+)\\.(.+)$'), false) THEN list_concat([{_strip("regexp_extract(headers[1], '^(Table [\\w.]+: [^.]+)\\.(.+)$', 2)")}], headers[2:]) ELSE headers END, '|') AS headers,
  coalesce(len(table_rows), 0) - len(src) AS n_rows,
  coalesce(array_to_string(list_filter(list_transform(src[len(src)], lambda c: {_strip('c')}), lambda c: c <> ''), ' '), source) AS source FROM t""",
    "section_hierarchy": f"""WITH {EL}, f AS (SELECT document_id, canonical_order, min((page_no, canonical_order, raw_order, element_id)) AS place FROM el GROUP BY ALL),
st AS (SELECT document_id, canonical_order, min(place) OVER (PARTITION BY document_id ORDER BY canonical_order ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM f),
h AS (SELECT st.document_id, st.canonical_order, (e.page_no, e.canonical_order, e.raw_order, e.element_id) AS place, e.content FROM st JOIN el e ON e.document_id = st.document_id AND e.element_type = 'section_header' AND trim(e.content) <> ''
  AND (e.page_no, e.canonical_order, e.raw_order, e.element_id) < st.stop),
k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY document_id, canonical_order ORDER BY place DESC) <= 3)
SELECT st.document_id, st.canonical_order, coalesce(string_agg(k.content, '|' ORDER BY k.place), '') AS headers FROM st LEFT JOIN k ON k.document_id = st.document_id AND k.canonical_order = st.canonical_order GROUP BY ALL""",
    "neighbour_counts": f"""WITH {EL}, o AS (SELECT DISTINCT document_id, canonical_order FROM el) SELECT o.document_id, o.canonical_order,
  count(e.element_id) AS n_neighbours FROM o LEFT JOIN el e ON e.document_id = o.document_id AND abs(e.canonical_order - o.canonical_order) BETWEEN 1 AND 2
  AND e.element_type IN ('paragraph', 'text', 'list_item', 'section_header', 'caption') GROUP BY ALL""",
    "quantities": f"""WITH {EL}, m AS (SELECT element_id, unnest({_part(1)}) AS q, unnest({_part(2)}) AS c, unnest({_part(3)}) AS n, unnest({_part(4)}) AS s, unnest({_part(5)}) AS u FROM el),
x AS (SELECT element_id, replace(n, ',', '') AS value_raw, n, {_null('q')} AS q, {_null('c')} AS c, {_null('s')} AS s, {_null('u')} AS u FROM m)
SELECT element_id, value_raw, CASE WHEN lower(u) IN ('%', 'percent') THEN '%' ELSE regexp_replace(u, '\\.+$', '') END AS unit, {_map(V.TEXT_CURRENCY, 'lower(c)')} AS currency,
  regexp_replace(lower(s), 's$', '') AS scale, {_first('lower(q)', V.COMPARISON, '')} AS qualifier,
  CASE WHEN lower(u) IN ('%', 'percent') THEN 'percentage' WHEN u IS NOT NULL THEN 'quantity' WHEN c IS NOT NULL THEN 'currency' WHEN s IS NOT NULL THEN 'number'
    WHEN {_first('lower(q)', V.COMPARISON, '')} IS NOT NULL THEN 'quantity' ELSE 'number' END AS value_type
FROM x WHERE NOT (coalesce(q, c, s, u) IS NULL AND regexp_matches(n, '^(19|20)..$'))""",
    "temporal_contexts": f"WITH {EL} SELECT element_id, {_time_case(lambda k, p, g, lead: _q(k))} ELSE 'unknown' END AS time_type, {_time_case(lambda k, p, g, lead: f"{_q(lead)} || {_strip(f'regexp_extract({_T}, {_q(p)}, {g})')}")} END AS time_value FROM el",
    "text_qualifiers": f"""WITH {EL} SELECT element_id, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches({_T}, {_q('(?i)' + p)}) THEN {_q(n)} END" for p, n in V.QUALIFIERS)}], lambda x: x IS NOT NULL), '|') AS qualifiers,
  {_first(f'lower({_T})', V.COMPARISON, '')} AS comparison, {_first(_T, V.VERBS)} AS verb FROM el""",
    "metric_predicates": f"""SELECT DISTINCT predicate, coalesce({_first(f'lower({_strip("predicate")})', V.METRICS, '')},
  nullif(regexp_replace(regexp_replace(lower(lower({_strip("predicate")})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'metric') AS metric FROM facts""",
    "value_norms": f"SELECT DISTINCT currency, unit, scale, value_raw, {_currency('currency')} AS currency_norm, {_unit('unit')} AS unit_norm, {_mult('scale')} AS mult, {_number('value_raw')} AS value FROM facts",
    "time_norms": f"SELECT DISTINCT time_value, {_fy('time_value')} AS fy, {_cy('time_value')} AS cy, {_quarter('time_value')} AS quarter, {_day('time_value')} AS day FROM facts WHERE time_value IS NOT NULL",
    "validate_facts": f"""WITH {FA}, ev AS (SELECT element_id AS e FROM elements UNION SELECT unnest(evidence_ids) FROM elements),
n AS (SELECT fact_id, unnest(evidence_ids) AS e, generate_subscripts(evidence_ids, 1) AS pos FROM fa),
mi AS (SELECT fact_id, arg_min(n.e, pos) AS miss FROM n LEFT JOIN ev ON ev.e = n.e WHERE ev.e IS NULL AND n.e IS NOT NULL GROUP BY 1)
SELECT fa.fact_id, CASE WHEN {_BLANK('subject_name')} THEN 'missing subject' WHEN {_BLANK('predicate')} THEN 'missing predicate' WHEN value_raw IS NULL THEN 'missing object'
  WHEN coalesce(confidence < 0 OR confidence > 1, true) THEN 'confidence out of range' WHEN coalesce(len(evidence_ids), 0) <= 0 THEN 'missing evidence'
  WHEN miss IS NOT NULL THEN 'unknown evidence ' || miss WHEN value_type IN {_NUMERIC} AND NOT {_NUMBERISH} THEN 'value is no number' END AS reason
FROM fa LEFT JOIN mi USING (fact_id)""",
    "dedup_facts": f"""WITH {FA}, d AS (SELECT fact_id, confidence, extracted_at, evidence_ids, {_DEDUP} FROM fa),
h AS (SELECT {_KS}, arg_min(fact_id, (extracted_at, fact_id)) AS fact_id, max(confidence) AS confidence, count(*) AS n_facts, list_sort(list_distinct(flatten(list(coalesce(evidence_ids, []))))) AS ev FROM d GROUP BY ALL)
SELECT k0 AS document_id, fact_id, confidence, n_facts, coalesce(array_to_string(list_filter(ev, lambda x: x IS NOT NULL), ','), '') AS evidence FROM h""",
    "index_keys": f"WITH {CLASSES} SELECT norm_subject, norm_predicate, count(DISTINCT fact_id) AS n_facts, count(DISTINCT document_id) AS n_documents FROM ix GROUP BY ALL",
    "block_exact": _block(True),
    "block_intra_doc": _block(False),
    "block_intra_all": _block(False).replace(_KNOWN, "norm_subject <> ''"),
    "block_compatible": f"""WITH {CLASSES} SELECT a.class_id AS class_a, b.class_id AS class_b, a.n * b.n AS n_pairs, a.norm_predicate AS predicate_a, b.norm_predicate AS predicate_b
FROM cl a JOIN {_EDGES} ON a.norm_predicate = e.p JOIN cl b ON b.norm_predicate = e.q AND a.norm_subject = b.norm_subject AND a.class_id < b.class_id AND a.document_id <> b.document_id AND {_BT}
WHERE a.norm_subject <> '' AND a.norm_subject NOT IN {_GENERAL}""",
    "block_uncertain": f"""WITH {CLASSES}, f AS (SELECT norm_predicate, document_id, fact_id, norm_subject = '' OR norm_subject IN {_GENERAL} AS g FROM ix WHERE norm_predicate <> ''),
d AS (SELECT norm_predicate, document_id, count(*) FILTER (g) AS ge, count(*) FILTER (NOT g) AS kn FROM f GROUP BY ALL)
SELECT norm_predicate, (sum(ge) * sum(kn) - sum(ge * kn))::BIGINT AS n_with_known, ((sum(ge) * sum(ge) - sum(ge * ge)) // 2)::BIGINT AS n_general FROM d GROUP BY 1""",
    "class_members": f"WITH {CLASSES} SELECT min(fact_id) OVER (PARTITION BY {_CLASS}) AS class_id, fact_id FROM ix",
    "compare_pairs": f"WITH {SIGNALS} SELECT match_id, sig_subject, sig_predicate, sig_fact_type, sig_time, sig_scope, sig_value, sig_unit, sig_qualifiers, classification, confidence FROM m",
    "match_stats": f"WITH {SIGNALS} SELECT classification, count(*) AS n FROM m GROUP BY 1",
    "match_reasons": f"""WITH {SIGNALS} SELECT match_id, concat('subject: ', sig_subject, '; predicate: ', sig_predicate, '; fact type: ', sig_fact_type, '; time: ', sig_time, '; scope: ', sig_scope, '; value: ', sig_value, '; qualifiers: ', sig_qualifiers) AS reasons FROM m""",
    "relationships_all": f"WITH {RELATED} SELECT match_id, relationship, rel_confidence, reason, source_independence FROM r",
    "relationship_stats": f"WITH {RELATED} SELECT relationship, source_independence, count(*) AS n FROM r GROUP BY ALL",
    "disputed_claims": f"WITH {RELATED} SELECT a.subject AS subject, a.predicate AS predicate, a.tx AS period, count(*) AS n_disputes FROM r WHERE relationship = 'CONTRADICTS' AND source_independence = 'cross_document' GROUP BY ALL",
    "block_all": f"WITH {CHAIN} SELECT match_id AS pass_no, count(*) AS n_pairs FROM pairs GROUP BY 1",
    "uncertain_members": f"""WITH {PREPARED} SELECT predicate, fact_type, CASE WHEN value_type IN {_NUMERIC} THEN 'numeric' WHEN value_type IN ('text', 'entity') THEN 'text' ELSE 'other' END AS value_kind,
  CASE WHEN subject = '' OR subject IN {_GENERAL} THEN 'general' ELSE 'known' END AS side, document_id, min(fact_id) AS class_id, count(*) AS n_members FROM pr WHERE predicate <> ''
  GROUP BY document_id, fact_type, value_type, confidence, subject, predicate, txt, v, mult, unit, cur, cur_raw, bnd, tt, tx, dy, fy, cy, qu, scope, quals""",
    "uncertain_pairs": f"""WITH {PREPARED}, c AS ({PASSED}) SELECT a.predicate, count(*) FILTER ({_GA} <> {_GB}) AS n_with_known, count(*) FILTER ({_GA} AND {_GB}) AS n_general
FROM c JOIN pr a ON a.fact_id = fact_a_id JOIN pr b ON b.fact_id = fact_b_id WHERE pass_no = 3 GROUP BY 1""",
    "candidate_stats": f"WITH {CHAIN} SELECT relationship, count(*) AS n FROM r GROUP BY 1",
    "candidate_disputes": f"WITH {CHAIN} SELECT a.subject AS subject, least(a.predicate, b.predicate) AS predicate, greatest(a.tx, b.tx) AS period, count(*) AS n_disputes FROM r WHERE relationship = 'CONTRADICTS' GROUP BY ALL",
    "pair_checks": f"""SELECT array_to_string(list_filter([CASE WHEN fact_a_id IS NULL OR fact_b_id IS NULL THEN 'missing id' END, CASE WHEN fact_a_id = fact_b_id THEN 'fact compared with itself' END,
  CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence out of range' END, CASE WHEN regexp_replace(upper({_strip('classification')}), '[\\s-]+', '_', 'g') NOT IN ('SAME_CLAIM', 'RELATED_CLAIM', 'NOT_MATCH', 'UNCERTAIN') THEN 'unknown classification' END],
  lambda x: x IS NOT NULL), '; ') AS errors, count(*) AS n FROM match_results GROUP BY 1""",
    "relationship_checks": f"""WITH {FA} SELECT DISTINCT relationship_id, fact_a_id, len(list_filter(list_distinct(coalesce(c, [])), lambda x: NOT list_contains(coalesce(f.evidence_ids, []), x))) AS n_foreign
FROM (SELECT relationship_id, fact_a_id, evidence.fact_a_evidence AS c FROM relationship_results) r LEFT JOIN fa f ON f.fact_id = r.fact_a_id""",
    "facts_page": f"WITH {FA} SELECT fact_id, document_id, value_raw FROM fa WHERE lower(predicate) = 'net_profit' ORDER BY fact_id LIMIT 100 OFFSET 50",
    "relationships_page": "SELECT DISTINCT relationship_id, confidence FROM relationship_results WHERE relationship = 'CONTRADICTS' ORDER BY relationship_id LIMIT 100",
    "document_results": f"""WITH {FA}, f AS (SELECT document_id, count(DISTINCT fact_id) AS n_facts FROM fa GROUP BY 1),
r AS (SELECT document_id, count(DISTINCT relationship_id) AS n FROM (SELECT relationship_id, document_a_id AS document_id FROM relationship_results UNION SELECT relationship_id, document_b_id FROM relationship_results) WHERE document_id IS NOT NULL GROUP BY 1)
SELECT coalesce(f.document_id, r.document_id) AS document_id, coalesce(n_facts, 0) AS n_facts, coalesce(n, 0) AS n_relationships FROM f FULL JOIN r ON f.document_id = r.document_id""",
    "evidence_lookup": f"""WITH {FA}, i AS (SELECT e, arg_max(page_no, (ingested_at, page_no)) AS page_no FROM (SELECT element_id AS e, page_no, ingested_at FROM elements UNION ALL SELECT unnest(evidence_ids), page_no, ingested_at FROM elements) WHERE e IS NOT NULL GROUP BY 1),
n AS (SELECT fact_id, unnest(evidence_ids) AS e, generate_subscripts(evidence_ids, 1) AS pos FROM fa),
k AS (SELECT fact_id, arg_min(n.e, pos) AS evidence_id, arg_min(i.page_no, pos) AS page_no FROM n JOIN i ON i.e = n.e GROUP BY 1),
z AS (SELECT fact_id, try_cast(nullif(regexp_extract(arg_min(e, pos), ':p(\\d{{1,6}}):', 1), '') AS INT) AS spelt FROM n WHERE e IS NOT NULL GROUP BY 1)
SELECT fa.fact_id, k.evidence_id, coalesce(k.page_no, z.spelt) AS page_no FROM fa LEFT JOIN k USING (fact_id) LEFT JOIN z USING (fact_id)""",
    "kb_query": f"WITH {FA}, {_SCORED} SELECT fact_id, score FROM top",
    "kb_status": f"""WITH {FA}, {_SCORED}, rr AS (SELECT r.*, a.fact_id IS NOT NULL AS ia, b.fact_id IS NOT NULL AS ib FROM relationship_results r LEFT JOIN top a ON a.fact_id = r.fact_a_id LEFT JOIN top b ON b.fact_id = r.fact_b_id),
k AS (SELECT * FROM rr WHERE (ia AND ib) OR ((ia OR ib) AND relationship IN ('CONTRADICTS', 'CORROBORATES', 'CONTEXTUALLY_RECONCILED')))
SELECT 'What was the net profit of Satabrin in fiscal 2024?' AS query, CASE WHEN (SELECT count(*) FROM top) = 0 THEN 'no_results' WHEN (SELECT count(*) FROM k WHERE relationship = 'CONTRADICTS') > 0 THEN 'contradiction_found' ELSE 'answered' END AS status,
  (SELECT count(*) FROM top) AS n_facts, (SELECT count(*) FROM k) AS n_related, (SELECT count(*) FROM k WHERE relationship = 'CONTRADICTS') AS n_contradicting""",
    "kb_conflict_query": "SELECT 'Any discrepancy?' AS query, CASE WHEN count(*) > 0 THEN 'contradiction_found' ELSE 'no_results' END AS status, 0::BIGINT AS n_facts, 0::BIGINT AS n_related, 0::BIGINT AS n_contradicting FROM relationship_results WHERE relationship = 'CONTRADICTS'",
    "relationship_distribution": "SELECT relationship, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM relationship_results GROUP BY 1",
    "systematic_sample": """WITH r AS (SELECT relationship_id, max(relationship) AS relationship FROM relationship_results WHERE relationship_id IS NOT NULL GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY relationship_id) - 1 AS sample_place, greatest(1, (count(*) OVER ()) // 20) AS step FROM r)
SELECT relationship_id, relationship, sample_place FROM n WHERE sample_place % step = 0 AND sample_place < step * 20""",
    "first_per_relationship": "SELECT relationship, arg_min(relationship_id, relationship_id) AS relationship_id, arg_min(confidence, relationship_id) AS confidence FROM relationship_results GROUP BY 1",
    "reconciliation_validity": """SELECT count(*) AS n, count(*) FILTER (coalesce(comparison.time IN ('different', 'overlapping', 'contained') OR comparison.scope = 'different' OR contains(lower(reason), 'dimension') OR comparison.status = 'status_transition', false)) AS n_valid
FROM relationship_results WHERE relationship = 'CONTEXTUALLY_RECONCILED'""",
    "unresolved_validity": f"""WITH {FA}, v AS (SELECT coalesce(comparison.subject = 'unknown', false) OR coalesce({_key('fa.subject_name')} IN {_GENERAL}, false) AS ok FROM relationship_results r LEFT JOIN fa ON fa.fact_id = r.fact_a_id WHERE relationship = 'UNRESOLVED')
SELECT count(*) AS n, count(*) FILTER (ok) AS n_valid, round(avg(ok::INT), 6)::DOUBLE AS share_valid FROM v""",
    "contradiction_taxonomy": f"""WITH {FA} SELECT CASE WHEN regexp_matches(lower(predicate), '^[1-7]$') THEN 'footnote number' WHEN lower(predicate) IN ('of_revenue', 'fy24', 'fy23') OR contains(lower(predicate), 'as_of_end_of') THEN 'header fragment'
  WHEN lower(predicate) IN ('acquired', 'provides') THEN 'generic predicate' WHEN regexp_matches(lower(predicate), '^i{{1,3}}_') THEN 'roman numeral' ELSE 'other' END AS kind, count(*) AS n
FROM relationship_results r JOIN fa ON fa.fact_id = r.fact_a_id WHERE relationship = 'CONTRADICTS' GROUP BY 1""",
    "element_summary": f"WITH {EL} SELECT document_id, element_type, count(*) AS n FROM el GROUP BY ALL",
}
