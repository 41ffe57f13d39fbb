"""Variant spellings of names typed by people: a trie join.

Every distinct string is parsed into a *key* (its identifying words) and a *scope*
in which keys are compared:

* companies: words for legal forms go; words for a line of business, in any
  spelling or abbreviation, become the scope; the other words are the key;
* persons: titles go, nicknames are expanded, "Last, First Middle" is turned;
* names with initials or a missing part get keys of a *partial* form, and every
  full name is also entered under the partial forms it could be written as.

A key is entered twice: its words run together, which forgives wrong blanks
(and is looked up with its last words first as well), and its words apart, which
may be matched in any order.

Keys of a scope are joined within a bounded Levenshtein distance.  Scopes are
sharded: a key with bound k is cut into k + 1 pieces, no piece crossing a word, so
one of its words has fewer edits than pieces and hence one whole piece, at a place
shifted by no more than the edits before and after it.  Each piece, with the
length of its word, names a shard; which of the words it comes from does not
matter.  In a shard the keys form a trie; a Levenshtein automaton walks it word by
word, trying the words of the looked-up key in every order under one shared bound,
and prunes every branch beyond it.  Shards above ``MAX_SHARD`` keys are split by a
salt, each query visiting all splits.

Full names within the bound are one entity, directly or through others (see
``groups``).  A partial form joins the one group it fits, and none if it fits
several.  Predicates go through tries as well, sharded by the initials of their
words; their automaton takes a word for another if it is a misspelling or a short
form of it, in any order of the words; initials of the whole name and blends of
beginnings have shards of their own.  Each claim name joins the best match among
the more frequent ones only, so that a rare spelling between two names does not
make them one.

Words for lines of business and nicknames are parameters (``Words``); words that
stand beside many different words are learned as further lines (``learn_lines``).

Defined results: null, empty and letterless strings, pronouns and general words
for a company are no names; equal strings are one string; a string typed with
several subject types takes the most frequent one; strings may be of any length;
empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.groups import connected_groups
from claimloom.session import Staged

MAX_SHARD = 20_000
#: Words for lines of business that may be learned; the size of what the workers get.
MAX_LEARNED = 5_000
#: Pieces are cut from words of at least so many letters if there are any.
LEAST_PIECE = 3

# --- fixed values ------------------------------------------------------------

#: Pronouns and general words for a company.
GENERAL = {
    "it", "its", "they", "their", "them", "we", "us", "our", "he", "she", "his", "her", "i", "you", "this", "that", "which we",
    "company", "group", "firm", "issuer", "management", "board", "entity", "parent", "subsidiary", "subsidiaries", "business",
    "following table", "holding company", "parent company", "corporation", "organisation", "organization", "bank", "the",
}

#: Words for legal forms.
LEGAL = (
    "limited ltd private pvt incorporated inc corporation corp corpn company co holdings holding hldg hldgs plc llp llc lp gmbh ag "
    "sa sas nv bv spa pty public group ms"
).split()

#: Words for lines of business: the scope, and its words with usual short forms.
LINES = {
    "agro": "agro foods food agri agrofoods",
    "energy": "energy energies power",
    "systems": "systems system sys",
    "engineering": "engineering engineers engg eng engr engrs",
    "financial": "financial finance financials fin finserv",
    "services": "services service svc svcs serv",
    "industries": "industries industry industrial inds ind",
    "infrastructure": "infrastructure infrastructures infra infrastr",
    "international": "international intl internatl",
    "logistics": "logistics logistic logis lgstcs",
    "pharmaceuticals": "pharmaceuticals pharmaceutical pharma pharm",
    "shipping": "shipping ship shipg shpg",
    "technologies": "technologies technology tech techs technol",
    "warehousing": "warehousing warehouse warehouses whsg whse",
    "textiles": "textiles textile tex",
    "chemicals": "chemicals chemical chem",
    "steel": "steel steels",
    "motors": "motors motor automotive auto",
    "retail": "retail retailers stores",
    "media": "media entertainment",
    "telecom": "telecom telecommunications communications comm",
    "insurance": "insurance assurance ins",
    "construction": "construction constructions constr",
    "consulting": "consulting consultants consultancy",
    "software": "software infotech",
    "healthcare": "healthcare hospitals medical",
    "mining": "mining mines minerals",
    "cement": "cement cements",
    "airlines": "airlines airways aviation",
    "electronics": "electronics electricals electrical electric",
}

#: Titles before a person's name.
TITLES = set("dr mr mrs ms miss prof professor capt captain shri smt sri sir dame adv er rev hon col maj gen lt ca cs".split())

#: Nicknames and the names they stand for.
NICKNAMES = {
    "alexander": "alex alec sandy sasha lex", "alexandra": "alex sandra sasha", "anastasia": "ana stasia nastya stacy annie anna",
    "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny benji", "catherine": "cathy kate katie cath", "charles": "charlie chuck",
    "christopher": "chris kit topher", "christina": "chris tina", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby",
    "edward": "ed eddie ted ned", "elizabeth": "liz beth betty lizzie eliza libby bess betsy", "francesca": "fran frankie cesca franny chesca",
    "francis": "frank fran", "frederick": "fred freddie freddy fredrick", "gabriela": "gaby gabi gabby gabriella ella", "gregory": "greg",
    "james": "jim jimmy jamie", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon john jonny nathan", "joseph": "joe joey",
    "josephine": "jo josie jojo posy", "katherine": "kate kathy katie kat kath kitty", "kenneth": "ken kenny", "krishnan": "krish kris krishna",
    "lakshmi": "lakshmy laxmi lakshmee", "leonardo": "leo leon lenny", "margaret": "peg peggy maggie meg marge margie", "matthew": "matt",
    "maximilian": "max maxi", "michael": "mike mick mickey mikey", "mohammed": "mohd mo mohammad muhammad mohamed md",
    "nicholas": "nick nicky", "nikolai": "nik nick kolya niko nicky", "patricia": "pat patty tricia trish patti", "patrick": "pat paddy",
    "peter": "pete", "philip": "phil", "priyanka": "priya pri pinky", "rajendra": "raj rajen raju rajinder", "rajesh": "raj raju",
    "richard": "rick dick rich", "robert": "bob rob bobby robbie bert", "samuel": "sam sammy", "siddharth": "sid siddhu sidd siddhartha",
    "stephen": "steve", "steven": "steve", "subramaniam": "subbu mani subra subramanian subramanyam", "susan": "sue susie",
    "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim timmy", "venkatesh": "venkat venky venkatesan", "victoria": "vicky tori",
    "william": "bill will billy willy liam",
}

#: Words that leave a predicate's meaning alone.
STOP = set("of in from the to as at and for by on with a an".split())
#: Words a predicate may lack.
OPTIONAL = set("ratio rate value amount total".split())

_LONG_LEGAL = [w for w in LEGAL if len(w) >= 6]


@dataclass
class Words:
    """What is known of words: lines of business (name -> words) and nicknames (name -> short names)."""

    lines: dict[str, str] = field(default_factory=lambda: LINES)
    nicknames: dict[str, str] = field(default_factory=lambda: NICKNAMES)

    def __post_init__(self) -> None:
        self.line_of = {w: line for line, words in self.lines.items() for w in words.split()}
        self.long_lines = [w for w in self.line_of if len(w) >= 4]
        self.order = {line: k for k, line in enumerate(self.lines)}
        self.full: dict[str, list[str]] = {}
        for name, short in self.nicknames.items():
            for x in short.split():
                self.full.setdefault(x, []).append(name)
        self._seen: dict[str, str | None] = {}

    def line(self, word: str) -> str | None:
        """The line of business a word stands for: itself, misspelt, or cut short."""
        if word in self.line_of:
            return self.line_of[word]
        if word not in self._seen:
            if len(self._seen) > 300_000:
                self._seen.clear()
            near = _near_word(word, self.long_lines) or next((w for w in self.line_of if 3 <= len(word) < len(w) and w.startswith(word)), None)
            self._seen[word] = self.line_of[near] if near else None
        return self._seen[word]


# --- distances ---------------------------------------------------------------


def distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if greater; a swap of neighbours counts as one."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            v = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
    return row[-1]


def bound(key: str, scope: str) -> int:
    """The distance allowed for a key of this length; partial forms have less to go by."""
    return _bound_of(len(key) - key.count("~") - key.count(" "), scope)


def _bound_of(n: int, scope: str) -> int:
    return 0 if n < 4 else 1 if n < 8 else 2 if n < 12 or not scope.endswith("full") else 3


def _near_ends(node: dict, word: str, most: int) -> Iterator[tuple[dict, int]]:
    """Nodes below at which a word within the distance may end, with it; ``~`` never takes part in an edit."""
    if most == 0:
        for ch in word:
            node = node.get(ch)
            if node is None:
                return
        yield node, 0
        return
    # a band of the table: place t of the row at a depth stands for the first depth - most + t letters
    n, far, width = len(word), most + 1, 2 * most + 1
    free = word.find("~")
    first = [far] * most + [j if free < 0 or j <= free else far for j in range(most + 1)]
    stack = [(node, 0, first)]
    while stack:
        node, depth, row = stack.pop()
        end = n - depth + most
        if end < 0:
            continue
        if end < width and row[end] <= most and ("" in node or " " in node):
            yield node, row[end]
        low = depth - most
        for ch, child in node.items():
            if ch == "" or ch == " ":
                continue
            new, left, best = [], far, far
            for t in range(width):
                j = low + t  # the letter matched by place t of the new row
                q = word[j] if 0 <= j < n else ""
                if not q:
                    v = row[t + 1] + 1 if j == -1 and t + 1 < width and ch != "~" else far
                elif q == "~" or ch == "~":
                    v = row[t] if q == ch else far
                else:
                    v = row[t] if q == ch else row[t] + 1
                    if t + 1 < width and row[t + 1] + 1 < v:
                        v = row[t + 1] + 1
                    if left + 1 < v:
                        v = left + 1
                new.append(v)
                left = v
                if v < best:
                    best = v
            if best <= most:
                stack.append((child, depth + 1, new))


class Trie:
    """Keys with automata over them."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: str, value: object) -> None:
        node = self.root
        for ch in key:
            node = node.setdefault(ch, {})
        node.setdefault("", []).append(value)

    def values(self) -> Iterator[object]:
        stack = [self.root]
        while stack:
            for ch, child in stack.pop().items():
                if ch:
                    stack.append(child)
                else:
                    yield from child

    def near(self, query: str, most: int) -> Iterator[tuple[object, int]]:
        """Values of keys within the distance, with it, the words of the query taken in any order."""
        return self.walk(query, lambda node, word, spent: _near_ends(node, word, most - spent))

    def walk(self, query: str, ends: Callable[[dict, str, int], Iterator[tuple[dict, int]]]) -> Iterator[tuple[object, int]]:
        """Values of keys whose words match those of the query one to one, with the sum of costs."""
        words = query.split(" ")
        every = (1 << len(words)) - 1
        starts = [(self.root, 0, 0)]
        while starts:
            node, used, spent = starts.pop()
            tried = set()
            for i, word in enumerate(words):
                if used >> i & 1 or word in tried:
                    continue
                tried.add(word)
                now = used | 1 << i
                for end, cost in ends(node, word, spent):
                    if now == every:
                        for value in end.get("", ()):
                            yield value, spent + cost
                    elif (after := end.get(" ")) is not None:
                        starts.append((after, now, spent + cost))


# --- parsing -----------------------------------------------------------------


def is_short_form(short: str, word: str) -> bool:
    """An abbreviation: same first letter, letters in order, clearly shorter."""
    if not short or len(short) >= len(word) or short[0] != word[0]:
        return False
    it = iter(word)
    return all(ch in it for ch in short)


def _words(s: str) -> list[str]:
    s = unicodedata.normalize("NFKC", s)
    if not s.isupper():  # a word run into the next
        s = re.sub(r"(?<=[a-z]{3})(?=[A-Z][a-z]{2})", " ", s)
    s = re.sub(r"(?i)\bm/s\b\.?", " ", s).lower()
    s = re.sub(r"\(?\bp\b\)?\.? (?=ltd|limited)", " private ", s)
    s = re.sub(r"['’.]", "", re.sub(r"\.(?=\w)", " ", s))
    return re.findall(r"[^\W_]+", s)


def _near_word(word: str, words: list[str]) -> str | None:
    if len(word) < 4:
        return None
    best, most = None, 1 if len(word) < 8 else 2
    for w in words:
        if abs(len(w) - len(word)) <= most and (d := distance(word, w, most)) <= most:
            best, most = w, d - 1
            if most < 0:
                break
    return best


def company_words(s: str, known: Words) -> tuple[list[str], list[str], bool]:
    """(identifying words, lines of business, whether a legal form or a line was named)."""
    core, lines, formal = [], [], False
    for w in _words(s):
        if w in ("the", "and", "of"):
            continue
        if w in LEGAL or (len(w) >= 5 and _near_word(w, _LONG_LEGAL)):
            formal = True
        elif line := known.line(w):
            lines.append(line)
        else:
            core.append(w)
    return core, lines, formal or bool(lines)


Row = tuple[str, str, bool, bool]  # scope, key, entered in the index, looked up


def _forms(scope: str, words: list[str], initials: str, indexed: bool, query: bool) -> list[Row]:
    """A key run together and, of several words, apart; initials stay behind a ``~``.

    Run together it is also looked up with its last words first, as a turned name may lack its blanks too.
    """
    tail = f"~{initials}" if initials else ""
    rows = [(scope, "".join(words) + tail, indexed, query)]
    if query:
        rows += [(scope, "".join(words[k:] + words[:k]) + tail, False, True) for k in range(1, len(words))]
    if len(words) > 1:
        rows.append((scope, " ".join([*words, tail] if tail else words), indexed, query))
    return rows


def company_rows(s: str, known: Words) -> list[Row]:
    core, lines, _ = company_words(s, known)
    if not core or "".join(core) in GENERAL or all(w in GENERAL for w in core):
        return []
    # one line of business; two-word lines are named by the first in the table
    line = min(set(lines), key=lambda x: known.order[x]) if lines else ""
    whole = [w for w in core if len(w) > 1]
    initials = "".join(w for w in core if len(w) == 1)
    if initials and whole:
        return _forms(f"c|{line}|initial" if line else "c||initial", whole, initials, True, True)
    if not line:
        # no line named: fits any company of that name
        return _forms("c|*|noline", core, "", True, True)
    rows = _forms(f"c|{line}|full", core, "", True, True) + _forms("c|*|noline", core, "", True, False)
    if len(core) > 1:
        for k, w in enumerate(core):
            rows += _forms(f"c|{line}|initial", core[:k] + core[k + 1 :], w[0], True, False)
    return rows


def person_rows(s: str, known: Words) -> list[Row]:
    turned = s
    if s.count(",") == 1 and all(re.search(r"\w", p) for p in s.split(",")):
        last, first = s.split(",")
        turned = f"{first} {last}"
    words = [w for w in _words(turned)]
    while words and words[0] in TITLES and len(words) > 1:
        words = words[1:]
    words = [w for w in words if w not in TITLES or len(w) == 1]
    if len(words) < 2 or all(len(w) == 1 for w in words):
        return [("p|single", "".join(words), True, True)] if words and len(words[0]) > 2 and words[0] not in GENERAL else []
    *given, last = words
    if len(last) == 1:  # initials typed after the name
        return [("p|loose", f"{last}~{''.join(given)}", True, True)]
    first, middle = given[0], "".join(given[1:])
    names = [*known.full.get(first, []), first]
    rows: list[Row] = []
    if len(first) > 1 and len(middle) > 1:
        for f in names:
            rows += [r for r in _forms("p|full", [f, *given[1:], last], "", True, True) if r[2]]
            rows.append(("p|f~ml", f"{f[0]}~{middle}{last}", True, False))
            rows.append(("p|fl~m", f"{f}{last}~{middle[0]}", True, False))
            rows += _forms("p|fl", [f, last], "", True, False)
            rows.append(("p|f~l~m", f"{f[0]}~{last}~{middle[0]}", True, False))
            rows.append(("p|f~l", f"{f[0]}~{last}", True, False))
    elif len(first) > 1 and len(middle) == 1:
        for f in names:
            rows.append(("p|fl~m", f"{f}{last}~{middle}", True, True))
    elif len(first) > 1:
        for f in names:
            rows += _forms("p|fl", [f, last], "", True, True)
    elif len(middle) > 1:
        rows.append(("p|f~ml", f"{first}~{middle}{last}", True, True))
    elif len(middle) == 1:
        rows.append(("p|f~l~m", f"{first}~{last}~{middle}", True, True))
    else:
        rows.append(("p|f~l", f"{first}~{last}", True, True))
    return rows


def name_rows(s: str | None, kind: str | None, known: Words) -> list[Row]:
    """The keys of a string."""
    if not s:
        return []
    plain = " ".join(w for w in _words(s) if w not in ("the", "our", "this", "which"))
    if not plain or plain in GENERAL or not re.search(r"[^\W\d_]", plain):
        return []
    if kind is None:
        kind = "company" if company_words(s, known)[2] else "person"
    return person_rows(s, known) if kind == "person" else company_rows(s, known)


def learn_lines(names: DataFrame, known: Words | None = None, least: int = 20, most_of_a_letter: float = 0.5, most: int = MAX_LEARNED) -> Words:
    """``known`` with further lines of business read off company names.  names: (s, kind).

    A word of a line stands beside the words of many companies, an identifying word
    beside spellings of the same few.  A word is a line if it has ``least`` different
    neighbours and no letter starts more than ``most_of_a_letter`` of them; that
    share tells neighbours apart from misspellings of one word, whose number grows
    with the data.  The ``most`` words with most neighbours are taken.  Short forms
    and misspellings of a more usual line are that line.
    """
    known = known or Words()

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for s in batch.column(0).to_pylist():
                words = [w for w in _words(s) if len(w) > 2 and w not in ("the", "and") and w not in LEGAL and not _near_word(w, _LONG_LEGAL)]
                for a, b in itertools.pairwise(words):
                    out |= {(a, b), (b, a)}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["word", "other"])

    rows = names.where("kind = 'company' AND s IS NOT NULL").select("s").mapInArrow(beside, "word string, other string").distinct()
    letters = rows.groupBy("word", F.substring("other", 1, 1).alias("c")).agg(F.count(F.lit(1)).alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    found = letters.where((F.col("n") >= least) & (F.col("top") <= most_of_a_letter * F.col("n"))).orderBy(F.desc("n"), "word").limit(most)
    lines = dict(known.lines)
    learned: dict[str, list[str]] = {}
    for r in found.collect():  # at most ``most`` words
        if known.line(r.word):
            continue
        hub = next((w for w in learned if is_short_form(r.word, w) or is_short_form(w, r.word) or _near_word(r.word, [w])), r.word)
        learned.setdefault(hub, []).append(r.word)
    lines |= {hub: " ".join(words) for hub, words in learned.items() if hub not in lines}
    return Words(lines, known.nicknames)


# --- the join ----------------------------------------------------------------


def _cut(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of pieces of nearly equal length."""
    edges = [i * length // parts for i in range(parts + 1)]
    return [(edges[i], edges[i + 1] - edges[i]) for i in range(parts)]


def _parts(words: list[str], k: int) -> list[int]:
    """How many of the k + 1 pieces each word is cut into."""
    able = [i for i, w in enumerate(words) if len(w) >= LEAST_PIECE] or list(range(len(words)))
    able = sorted(able, key=lambda i: -len(words[i]))[: k + 1]
    parts = [0] * len(words)
    for i in able:
        parts[i] = 1
    for _ in range(k + 1 - len(able)):
        parts[max(able, key=lambda i: len(words[i]) / (parts[i] + 1))] += 1
    return parts


def _shards(scope: str, key: str, index: bool) -> Iterator[str]:
    """The shards a key is entered in, or looked up in."""
    words = key.split(" ")
    head = f"{scope}\x1f{len(words)}"
    if index:
        for w, p in zip(words, _parts(words, bound(key, scope)), strict=True):
            for i, (at, n) in enumerate(_cut(len(w), p) if p else ()):
                yield f"{head}\x1f{len(w)}\x1f{p}\x1f{i}\x1f{w[at : at + n]}"
        return
    letters, most = len(key) - key.count("~") - key.count(" "), bound(key, scope) + 1
    bounds = {k for n in range(max(1, letters - most), letters + most + 1) if (k := _bound_of(n, scope)) >= abs(letters - n)}
    wanted: set[int] = set()
    for k in bounds:
        # of the entered words at least so many can take a piece each
        able = min(max(1, sum(len(w) >= LEAST_PIECE + k for w in words)), k + 1)
        wanted |= {k + 1} if len(words) == 1 else set(range(1, k + 2 - able + 1))
    for w in set(words):
        for p in wanted:
            # the word has fewer edits than pieces; i pieces lie before a whole one and p - 1 - i after it, and
            # if all of them differ, at most so many edits lie on either side, which bounds where it can stand
            for length in range(max(p, len(w) - p + 1), len(w) + p):
                shift = len(w) - length
                for i, (start, n) in enumerate(_cut(length, p)):
                    low, high = max(start - i, start + shift - (p - 1 - i)), min(start + i, start + shift + (p - 1 - i))
                    for text in {w[at : at + n] for at in range(max(0, low), min(high, len(w) - n) + 1)}:
                        yield f"{head}\x1f{length}\x1f{p}\x1f{i}\x1f{text}"


def _tasks(df: DataFrame, rows: int) -> int:
    """Tasks for work in Python: few bytes may be much work, so they are not left to be coalesced."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, rows // 20_000)


def _keys(names: DataFrame, known: Words) -> DataFrame:
    """(s, scope, key, indexed, query, full) of every string."""
    schema = "s string, scope string, key string, indexed boolean, query boolean, full boolean"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for scope, key, indexed, query in dict.fromkeys(name_rows(s, kind, known)):
                    out.append((s, scope, key, indexed, query, scope.endswith("full")))
            types = [pa.string()] * 3 + [pa.bool_()] * 3
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["s", "scope", "key", "indexed", "query", "full"])

    return names.select("s", "kind").mapInArrow(parse, schema)


_SHARDED = "shard string, key string, value string"


def _sharded_walk(index: DataFrame, queries: DataFrame, search: Callable[[Trie, str, str, str], Iterator[tuple[str, int]]], tasks: int, max_shard: int) -> Staged:
    """(scope, query, value, d) of what ``search(trie, shard, key, value)`` finds for each query in its shards.

    index, queries: (shard, key, value); the scope is the shard's name up to the first separator.
    Both are read several times, so they are written, as is what is found: the driver never
    plans more than one step at once.
    """
    shards = [Staged(x, "shards") for x in (index, queries)]
    index, queries = (x.df for x in shards)
    # a value found alone in its shard by itself needs no walk; queries go to shards that hold something
    sizes = index.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("only"), F.max("value").alias("last"))
    queries = queries.join(sizes, "shard").where((F.col("only") != F.col("value")) | (F.col("last") != F.col("value")))
    # shards with too many keys are split; each query visits all splits
    splits = F.ceil(F.col("n") / max_shard).cast("int")
    index = index.join(sizes.select("shard", "n"), "shard").select("shard", F.pmod(F.xxhash64("key", "value"), splits).cast("int").alias("salt"), F.lit(0).alias("side"), "key", "value")
    queries = queries.select("shard", F.explode(F.sequence(F.lit(0), splits - 1)).alias("salt"), F.lit(1).alias("side"), "key", "value")
    # a shard without queries is never read
    both = index.join(queries.select("shard").distinct(), "shard", "left_semi").unionByName(queries)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, trie = None, Trie()
        for batch in batches:
            out = []
            for name, salt, side, key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (name, salt) != current:
                    current, trie = (name, salt), Trie()
                if side == 0:
                    trie.add(key, value)
                else:
                    scope = name.split("\x1f", 1)[0]
                    out += [(scope, value, other, d) for other, d in search(trie, name, key, value)]
            out = list(dict.fromkeys(out))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x[i] for x in out], pa.string()) for i in range(3)), pa.array([x[3] for x in out], pa.int32())], names=["scope", "query", "value", "d"]
            )

    walked = both.repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", "side").mapInArrow(walk, "scope string, query string, value string, d int")
    found = Staged(walked, "shards-found")
    for x in shards:
        x.drop()
    return found


def trie_join(keys: DataFrame, max_shard: int = MAX_SHARD, tasks: int = 8) -> DataFrame:
    """(scope, query_key, key, d): looked-up keys with the entered keys within their bound."""
    return _near_keys(keys, max_shard, tasks).df


def _near_keys(keys: DataFrame, max_shard: int, tasks: int) -> Staged:
    entered = keys.where("indexed").select("scope", "key").distinct()
    looked_up = keys.where("query").select("scope", "key").distinct()

    def shard(index: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(x, key) for scope, key in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in set(_shards(scope, key, index))]
                shards, names = ([x[i] for x in out] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (shards, names, names)], names=["shard", "key", "value"])

        return run

    def search(trie: Trie, shard_: str, key: str, _: str) -> Iterator[tuple[str, int]]:
        # the bound of the entered key decides, as it chose the pieces
        scope = shard_.split("\x1f", 1)[0]
        return ((other, d) for other, d in trie.near(key, bound(key, scope) + 1) if d <= bound(other, scope))

    index, queries = (x.repartition(tasks).mapInArrow(shard(side), _SHARDED) for x, side in ((entered, True), (looked_up, False)))
    found = _sharded_walk(index, queries, search, tasks, max_shard)
    near = Staged(found.df.groupBy("scope", F.col("query").alias("query_key"), F.col("value").alias("key")).agg(F.min("d").alias("d")), "name-near")
    found.drop()
    return near


def link_names(names: DataFrame, known: Words | None = None, max_shard: int = MAX_SHARD) -> DataFrame:
    """(s, group_id) of every string that is a name.  names: (s, kind) with distinct s."""
    edges, staged = name_edges(names, known, max_shard)
    groups = Staged(connected_groups(edges, "a", "b").toDF("s", "group_id"), "names")
    for x in staged:
        x.drop()
    return groups.df


def name_edges(names: DataFrame, known: Words | None = None, max_shard: int = MAX_SHARD) -> tuple[DataFrame, list[Staged]]:
    """(a, b): strings of one entity, with every string that is a name beside itself or another; and what to drop after use."""
    names = Staged(names.select("s", "kind"), "name-strings")
    known = learn_lines(names.df, known)
    n = names.df.count()
    staged = Staged(_keys(names.df.repartition(_tasks(names.df, n)), known), "name-keys")
    keys = staged.df
    near_staged = _near_keys(keys, max_shard, _tasks(keys, keys.count()))
    near = near_staged.df
    queries = keys.where("query").select("scope", F.col("key").alias("query_key"), F.col("s").alias("a"), F.col("full").alias("full_a"))
    entered = keys.where("indexed").select("scope", "key", F.col("s").alias("b"))
    # names of one key meet at one of them, not each other
    hub = entered.groupBy("scope", "key").agg(F.min("b").alias("hub"))
    # full names: queries to the hub of a near key, which may be their own; every full name is entered under the keys it is looked up by
    full_scope = F.col("scope").endswith("full")
    own = queries.where(full_scope).select("scope", "query_key", F.col("query_key").alias("key")).distinct()
    reached = near.where(full_scope).select("scope", "query_key", "key").unionByName(own).join(hub, ["scope", "key"]).select("scope", "query_key", "hub").distinct()
    strong = Staged(queries.where(full_scope).join(reached, ["scope", "query_key"]).select("a", F.col("hub").alias("b")).distinct(), "name-strong")
    groups = Staged(connected_groups(strong.df, "a", "b").toDF("b", "group_b"), "name-groups")
    # partial forms: all groups of full names they fit
    exact = queries.where(~full_scope).select("scope", "query_key").distinct().select("scope", "query_key", F.col("query_key").alias("key"), F.lit(0).alias("d"))
    reach_staged = Staged(near.where(~full_scope).unionByName(exact).groupBy("scope", "query_key", "key").agg(F.min("d").alias("d")), "name-reach")
    reach = reach_staged.df
    fits = entered.join(groups.df, "b").groupBy("scope", "key").agg(F.min("group_b").alias("g0"), F.max("group_b").alias("g1"))
    # of the groups in reach only the nearest count
    fit = queries.where(~full_scope).join(reach, ["scope", "query_key"]).join(fits, ["scope", "key"])
    fit = fit.groupBy("a", "d").agg(F.min("g0").alias("g0"), F.max("g1").alias("g1"))
    fit = Staged(fit.groupBy("a").agg(F.min_by(F.struct("g0", "g1"), "d").alias("g")).select("a", "g.*"), "name-fits")
    attached = fit.df.where(F.col("g0") == F.col("g1")).select("a", F.col("g0").alias("b"))
    # partial forms that fit no full name meet among themselves
    lonely = queries.where(~full_scope).join(fit.df.select("a"), "a", "left_anti")
    lonely_hub = lonely.groupBy("scope", "query_key").agg(F.min("a").alias("hub"))
    among = lonely.join(reach, ["scope", "query_key"]).join(lonely_hub.withColumnRenamed("query_key", "key"), ["scope", "key"]).select("a", F.col("hub").alias("b"))
    # a partial form that fits several groups still is the same as another typed with its very key
    unsure = queries.where(~full_scope).join(fit.df.where(F.col("g0") != F.col("g1")).select("a"), "a")
    unsure_hub = unsure.groupBy("scope", "query_key").agg(F.min("a").alias("b"))
    unsure = unsure.join(unsure_hub, ["scope", "query_key"]).select("a", "b")
    # each written by itself: a plan of all of them at once, made anew after every stage, is what the driver had no room for
    rest = [Staged(among, "name-among"), Staged(unsure, "name-unsure")]
    edges = attached
    for x in (strong, *rest):
        edges = edges.unionByName(x.df)
    return edges, [names, staged, near_staged, strong, groups, reach_staged, fit, *rest]


# --- predicates --------------------------------------------------------------


def predicate_words(s: str) -> list[str]:
    """The words of a claim name that carry meaning."""
    s = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", unicodedata.normalize("NFKC", s)).lower()
    s = re.sub(r"(?<=\b\w)/(?=\w\b)", "", s)  # w/h
    words = re.findall(r"[^\W_]+", s.replace(".", " "))
    if all(len(w) == 1 for w in words):  # d&a
        return words
    return [w for w in words if w not in STOP] or words


def _word_match(a: str, b: str) -> float:
    """How well one word stands for another."""
    if a == b:
        return 1.0
    short, long_ = sorted((a, b), key=len)
    if short[0] == long_[0] and is_short_form(short, long_) and (len(short) > 1 or len(long_) > 1):
        return 0.9 if long_.startswith(short) and len(short) > 2 else 0.8 if len(short) > 1 else 0.5
    most = 0 if len(short) < 4 else 1 if len(short) < 7 else 2
    return 0.9 if most and distance(a, b, most) <= most else 0.0


def _blend(word: str, parts: list[str]) -> bool:
    """A word made of beginnings of the parts, each at least two letters long: capex."""
    if not parts:
        return not word
    return any(parts[0].startswith(word[:k]) and _blend(word[k:], parts[1:]) for k in range(2, min(len(word), len(parts[0])) + 1))


def predicate_match(a: str, b: str) -> float:
    """The mean match of the words of two claim names; 0 if they are not the same."""
    return words_match(predicate_words(a), predicate_words(b))


def words_match(x: list[str], y: list[str]) -> float:
    if len(x) > len(y):
        x, y = y, x
    if not x:
        return 0.0
    if "".join(x) == "".join(y):
        return 1.0
    if len(x) == 1 and len(y) > 1 and (_blend(x[0], y)):
        return 0.8
    if len(x) == 1 and len(y) > 2 and x[0] == "".join(w[0] for w in y):
        return 0.5
    if len(x) != len(y):
        # two words written as one
        for merged in _merged(y):
            # a word for a whole name of two is a misspelling of both, not a short form: that would fit too much
            if len(merged) == len(x) and (m := _assigned(x, merged)) and (len(x) > 1 or distance(x[0], merged[0], 2) <= 2):
                return m
        rest = [w for w in y if w not in OPTIONAL]
        if len(rest) == len(x) and len(rest) > 1 and (m := _assigned(x, rest)):
            return m - 0.1
        return 0.0
    return _assigned(x, y)


def _merged(words: list[str]) -> Iterator[list[str]]:
    """The words with two neighbours written as one."""
    return (words[:k] + [words[k] + words[k + 1]] + words[k + 2 :] for k in range(len(words) - 1))


def _spelt(word: str) -> str:
    """The letters of a short word that may be initials of a whole name."""
    return "".join(sorted(word.removesuffix("s") if len(word) > 2 else word)) if len(word) <= 4 else ""


def _initials(words: list[str]) -> str:
    return "".join(sorted(w[0] for w in words))


def _assigned(x: list[str], y: list[str]) -> float:
    """The best one-to-one match of words in any order, or 0; one word may be the initials of the other name."""
    best = _assignment(x, y)
    if len(x) > 1:
        names = (_initials(x), _initials(y))
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                if (_spelt(a) in names or _spelt(b) in names) and not _word_match(a, b):
                    rest = _assignment(x[:i] + x[i + 1 :], y[:j] + y[j + 1 :])
                    if rest:
                        best = max(best, (rest * (len(x) - 1) + 0.5) / len(x))
    return best


def _assignment(x: list[str], y: list[str]) -> float:
    """The greatest mean over one-to-one matches of all words, or 0: shortest augmenting paths."""
    n, none = len(x), 1000.0
    cost = [[1.0 - m if (m := _word_match(a, b)) else none for b in y] for a in x]
    u, v, of = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        of[0], j = i, 0
        least, way, used = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while True:
            used[j] = True
            row, step, at = of[j], float("inf"), 0
            for k in range(1, n + 1):
                if not used[k]:
                    c = cost[row - 1][k - 1] - u[row] - v[k]
                    if c < least[k]:
                        least[k], way[k] = c, j
                    if least[k] < step:
                        step, at = least[k], k
            for k in range(n + 1):
                if used[k]:
                    u[of[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
            j = at
            if not of[j]:
                break
        while j:
            of[j], j = of[way[j]], way[j]
    total = sum(cost[of[k] - 1][k - 1] for k in range(1, n + 1))
    return 1.0 - total / n if total < none else 0.0


def _predicate_shards(words: list[str], index: bool) -> Iterator[tuple[str, str]]:
    """(shard, key): where a claim name is entered, or looked up.

    ``w``: its words, by their initials; looked up also with two words as one or without optional words.
    ``t``: its words, by their pieces, for misspelt initials.
    ``i``: of a whole name all words but one, by its initials; looked up by a short word beside others.
    ``a``: whole names by their initials in order, looked up by one word.
    ``b``: whole names by the start of their first word, looked up by one word that may be a blend.
    """
    key = " ".join(words)
    # few letters in every word leave short forms no room, so a shard is named by all initials
    yield f"w\x1f{_initials(words)}", key
    yield from ((shard, key) for shard in _shards("t", key, index))
    if index:
        if len(words) > 1:
            yield f"b\x1f{words[0][:2]}", key
            for k in range(len(words)):
                yield f"i\x1f{_initials(words)}", " ".join(words[:k] + words[k + 1 :])
        if len(words) > 2:
            yield f"a\x1f{''.join(w[0] for w in words)}", key
        return
    for other in _merged(words):
        yield f"w\x1f{_initials(other)}", " ".join(other)
    rest = [w for w in words if w not in OPTIONAL]
    if 1 < len(rest) < len(words):
        yield f"w\x1f{_initials(rest)}", " ".join(rest)
    if len(words) == 1:
        yield f"a\x1f{words[0]}", key
        yield f"b\x1f{words[0][:2]}", key
    else:
        for k, w in enumerate(words):
            if spelt := _spelt(w):
                yield f"i\x1f{spelt}", " ".join(words[:k] + words[k + 1 :])


def _loose_ends(node: dict, word: str, _: int) -> Iterator[tuple[dict, int]]:
    """Nodes below at which a word may end that is a misspelling or a short form of the given one, or has it as one."""
    most = 0 if len(word) < 4 else 2 if len(word) < 7 else 4  # a swap of neighbours is two edits here
    found = {id(end): end for end, _ in _near_ends(node, word, most)}
    stack = [(child, 1, 1) for ch, child in node.items() if ch and ch == word[0]]
    while stack:
        # letters of the word met so far; place after the letters of the entry found in the word, or -1
        node, met, at = stack.pop()
        if met == len(word) or at >= 0:
            if "" in node or " " in node:
                found[id(node)] = node
        for ch, child in node.items():
            if ch and ch != " ":
                place = word.find(ch, at) + 1 or -1 if at >= 0 else -1
                more = met + (met < len(word) and word[met] == ch)
                stack.append((child, more, place))
    return ((end, 0) for end in found.values())


def _blends(trie: Trie, word: str) -> Iterator[tuple[str, int]]:
    """Values of keys of whose words the word is made: beginnings of at least two letters."""
    stack = [(trie.root, 0, 0, True)]
    while stack:
        # letters used up, letters taken of this word, whether more may be taken
        node, at, taken, taking = stack.pop()
        for ch, child in node.items():
            if ch == "":
                if at == len(word) and taken > 1:
                    yield from ((value, 0) for value in child)
            elif ch == " ":
                if taken > 1:
                    stack.append((child, at, 0, True))
            else:
                if taking and at < len(word) and word[at] == ch:
                    stack.append((child, at + 1, taken + 1, True))
                if taken > 1:
                    stack.append((child, at, taken, False))


def _predicate_search(trie: Trie, shard: str, key: str, value: str) -> Iterator[tuple[str, int]]:
    """Claim names the shard's automaton takes for the one looked up."""
    if shard[0] == "t":
        found = ((v, 0) for v, d in trie.near(key, bound(key, "t") + 1) if d <= bound(v, "t"))
    elif shard[0] == "b":
        found = _blends(trie, key)
    else:
        found = ((v, 0) for v in trie.values()) if shard[0] == "a" else trie.walk(key, _loose_ends)
    return ((other, d) for other, d in dict.fromkeys(found) if other != value)


def predicate_edges(names: DataFrame, max_shard: int = MAX_SHARD) -> DataFrame:
    """(a, b): claim names and what they are another spelling of.  names: (s, n) with distinct s."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, n, " ".join(predicate_words(s))) for s, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) if s]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["s", "n", "key"])

    spelt = Staged(names.select("s", "n").mapInArrow(words, "s string, n long, key string"), "predicate-words")
    # claim names of the same words meet at the most frequent one
    hubs = Staged(spelt.df.where("key <> ''").groupBy("key").agg(F.max_by("s", F.struct("n", "s")).alias("hub"), F.max("n").alias("n")), "predicate-hubs")

    def shard(index: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(*x, key) for key in batch.column(0).to_pylist() for x in set(_predicate_shards(key.split(" "), index))]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(3)], names=["shard", "key", "value"])

        return run

    tasks = _tasks(names, hubs.df.count())
    index, queries = (hubs.df.select("key").repartition(tasks).mapInArrow(shard(side), _SHARDED) for side in (True, False))
    found = _sharded_walk(index, queries, _predicate_search, tasks, max_shard)
    pairs = found.df.select(F.least("query", "value").alias("x"), F.greatest("query", "value").alias("y")).distinct()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(x, y, m) for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (m := words_match(x.split(" "), y.split(" ")))]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], pa.string()) for i in (0, 1)), pa.array([r[2] for r in out], pa.float64())], names=["x", "y", "m"])

    matched = pairs.mapInArrow(match, "x string, y string, m double")
    x, y = (hubs.df.select(F.col("key").alias(c), F.struct("n", "hub").alias(f"of_{c}")) for c in "xy")
    matched = matched.join(x, "x").join(y, "y")
    # each looks for more frequent ones
    rarer = F.col("of_x") < F.col("of_y")
    low, high = F.when(rarer, F.col("of_x")).otherwise(F.col("of_y")), F.when(rarer, F.col("of_y")).otherwise(F.col("of_x"))
    best = Staged(matched.select(low["hub"].alias("a"), high.alias("of"), "m").groupBy("a").agg(F.max_by("of.hub", F.struct("m", "of")).alias("b")), "predicate-best")
    found.drop()
    same = spelt.df.join(hubs.df.select("key", "hub"), "key", "left").select(F.col("s").alias("a"), F.coalesce("hub", "s").alias("b"))
    return best.df.unionByName(same)


def link_predicates(names: DataFrame, max_shard: int = MAX_SHARD) -> DataFrame:
    """(s, group_id) of every predicate.  names: (s, n) with distinct s."""
    return connected_groups(predicate_edges(names, max_shard), "a", "b").toDF("s", "group_id")


def subject_names(facts: DataFrame) -> DataFrame:
    """(s, kind): distinct subject names with their most frequent subject type."""
    counts = facts.where(F.col("subject_name").isNotNull()).groupBy(F.col("subject_name").alias("s"), F.col("subject_type").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    known: Column = F.when(F.lower("t").isin("person", "company"), F.lower("t"))
    return counts.groupBy("s").agg(F.max_by(known, F.struct(known.isNotNull(), "n", "t")).alias("kind"))


def spellings(facts: DataFrame, known: Words | None = None) -> DataFrame:
    """(name_field, s, group_id) of every name: membership, without pairs.

    Names and predicates are grouped in one run, told apart by a mark before each string.
    """
    marked = lambda edges, mark: edges.select(*(F.concat(F.lit(mark), c).alias(c) for c in ("a", "b")))
    subjects, staged = name_edges(subject_names(facts), known)
    predicates = facts.where(F.col("predicate").isNotNull()).groupBy(F.col("predicate").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    # read twice by the groups
    edges = Staged(marked(subjects, "s").unionByName(marked(predicate_edges(predicates), "p")), "edges")
    for x in staged:
        x.drop()
    groups = Staged(connected_groups(edges.df, "a", "b"), "spellings")
    edges.drop()
    field_ = F.when(F.startswith("id", F.lit("s")), "subject_name").otherwise("predicate")
    return groups.df.select(field_.alias("name_field"), F.substring("id", 2, 2**31 - 1).alias("s"), F.substring("group_id", 2, 2**31 - 1).alias("group_id"))


def linked_spellings(facts: DataFrame, known: Words | None = None) -> DataFrame:
    """(name_field, name_a, name_b): all pairs of spellings of one company, person or predicate."""
    groups = spellings(facts, known)
    a, b = groups.withColumnRenamed("s", "name_a"), groups.withColumnRenamed("s", "name_b")
    return a.join(b, ["name_field", "group_id"]).where(F.col("name_a") < F.col("name_b")).select("name_field", "name_a", "name_b")
