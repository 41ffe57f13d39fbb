"""Noise in text from scanned pages: repair into continuous paragraphs.

1. *Headers.*  Lines are masked (digits become ``#``, page-number decorations go).
   A masked line is a running header of its document if it is the text of a typed
   header or footer, repeats on many pages of the document, or spells the
   document's own name (its title, where one is given, or its id).  Lines that are
   only a page number need no vote.  Candidate lines meet the header rows by
   (document, masked line); the text itself is not moved for that.
2. *Vocabulary.*  All words of all elements are counted with the shape of the word
   before them.  Words are grouped by a skeleton in which confusable glyphs are
   one (rn and m, vv and w, 1, l and i, 0 and o, 5 and s, c and e, b and h, in and
   m, ligatures).  The most frequent form of a group replaces a rarer one if it is
   far more frequent, or more frequent and seen after the same words.  A number
   misread with letters is told by its other digits.
3. *Reflow.*  Header lines are dropped, lines joined, words cut at line ends
   joined with or without the hyphen, whichever form the corpus has.
4. *Page ends.*  A window over each page finds its first and last body element; an
   unfinished last one goes on in the first of the next page.
5. *Paragraphs.*  ``paragraphs`` gives the text itself: every element's, its words
   repaired in their own case, and one row for all elements a paragraph runs over.

The lines of an element are one row already, so they are joined where they are; a
window over lines would send every line of the corpus through a shuffle.

The corrections are small beside the corpus.  If they are fewer than
``MAX_SHARED`` they are broadcast; beyond that each element gets just its own by a
join on words.

Defined results: deleted elements are repaired like others; a redelivered element
is repaired in each of its versions and results are made distinct; null and empty
texts give nothing; a header as whole element is removed and never takes part in
a join of pages; of elements at the same place the least or greatest element_id
counts; texts may be of any length; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.groups import connected_groups
from claimloom.session import Staged

BODY = ("paragraph", "text", "list_item", "footnote")
RUNNING = ("page_header", "page_footer", "page_number")
MAX_SHARED = 1_000_000

WORD = re.compile(r"[^\W_]+(?:[-'.,][^\W_]+)*")
_HYPHENS = "-‐‑­"
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_LIGATURE = re.compile("[" + "".join(_LIGATURES) + "]")
_ONE = str.maketrans("1i|05eh", "llloscb")
_TWO = re.compile(r"vv|rn|[i1l|]n")
_NUMBER_LIKE = re.compile(r"[\dlio|sb][\dlio|sb.,]*")

# the same rules in the JVM's dialect
_JVM_BLANKS = r"[ \t ]+"
_JVM_CONTROL = r"[\p{Cc}&&[^\n]]"
_PAGE_NUMBER = r"(?i)^[\[\(|–—\- ]*(?:page|p\.|pg\.?)? ?\d{1,5}(?: ?(?:of|/) ?\d{1,5})?[\]\)|–—\- ]*$"


def skeleton(word: str) -> str:
    """The word with confusable glyphs made one."""
    if not word.isascii():
        word = _LIGATURE.sub(lambda m: _LIGATURES[m[0]], word)
    return _TWO.sub(lambda m: "w" if m[0] == "vv" else "m", word).translate(_ONE)


def as_number(word: str) -> str | None:
    """A number misread with letters, if most of it is digits."""
    if _NUMBER_LIKE.fullmatch(word) and sum(c.isdigit() for c in word) * 2 >= sum(c not in ".," for c in word) and sum(c.isdigit() for c in word) > 1:
        fixed = word.translate(str.maketrans("lio|sb", "110158"))
        return fixed if fixed != word else None
    return None


def stored_text(c: Column) -> Column:
    """Control characters other than line feed dropped, blanks collapsed."""
    return F.regexp_replace(F.regexp_replace(c, _JVM_CONTROL.replace("[^\\n]", "[^\\n\\t]"), ""), _JVM_BLANKS, " ")


def line_core(line: Column) -> Column:
    """A line without page-number decorations, digits masked; empty for a page number."""
    core = F.regexp_replace(line, r"(?i)^\d{1,5}\s+|\s*[|·–—-]\s*(?:page )?\d{1,5}(?: of \d{1,5})?$|^page \d{1,5}(?: of \d{1,5})?\s*[|·–—-]\s*", "")
    return F.when(line.rlike(_PAGE_NUMBER), "").otherwise(F.regexp_replace(F.btrim(core), r"\d", "#"))


def _no_sentence(line: Column) -> Column:
    """Whether a line can be a header or page number: it does not end as a sentence does."""
    return (F.length(line) > 0) & ~line.rlike(r"[.;:,!?­‐]$")


def _slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\d", "#"), "[^a-z0-9#]+", "-"), F.lit("-"))


def _lines(rows: DataFrame, text: Column, *columns: str) -> DataFrame:
    """Lines that can be headers, with their core."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x)), _no_sentence)
    return rows.select(*columns, F.explode(F.array_distinct(lines)).alias("line")).withColumn("core", line_core(F.col("line")))


def running_headers(elements: DataFrame, titles: DataFrame | None = None, least_pages: int = 3, least_share: float = 0.1) -> DataFrame:
    """(document_id, core): the masked running headers of every document.  titles: (document_id, title)."""
    text = F.coalesce(F.nullif("content", F.lit("")), F.col("raw_content"))
    rows = elements.where(F.col("element_type").isin(*BODY, *RUNNING) & text.isNotNull()).withColumn("typed", F.col("element_type").isin(*RUNNING))
    # a word cut at the line's end is text
    lines = _lines(rows, stored_text(text), "document_id", "page_no", "typed").where((F.col("core") != "") & ~F.endswith("line", F.lit("-")))
    lines = lines.groupBy("document_id", "core", "page_no").agg(F.max("typed").alias("typed"))
    pages = elements.groupBy("document_id", "page_no").agg(F.lit(1).alias("one")).groupBy("document_id").agg(F.count("one").alias("n_pages"))
    # a document's id is its name and a hash
    names = pages.select("document_id", _slug(F.regexp_replace(F.lower("document_id"), "-[0-9a-f]{6}$", "")).alias("name"))
    if titles is not None:
        names = names.unionByName(titles.where("title IS NOT NULL").select("document_id", _slug(F.col("title")).alias("name"))).distinct()
    own = names.where(F.length("name") >= 10).groupBy("document_id").agg(F.collect_set("name").alias("names"))
    # digits are masked in the core, so they are in the name
    spelt = F.coalesce(F.array_contains("names", _slug(F.col("core"))), F.lit(False))
    votes = lines.groupBy("document_id", "core").agg(F.count(F.lit(1)).alias("n"), F.max("typed").alias("typed"))
    # a core of few letters repeats by chance (list marks, units); only typed headers may be so short
    many = (F.length("core") >= 4) & (F.col("n") >= F.greatest(F.lit(least_pages), F.ceil(F.col("n_pages") * least_share)))
    return votes.join(pages, "document_id").join(own, "document_id", "left").where(F.col("typed") | spelt | many).select("document_id", "core")


def body_elements(elements: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Stored text of body elements, and the lines that are headers or page numbers."""
    text = F.coalesce(F.nullif("content", F.lit("")), F.col("raw_content"))
    body = elements.where(F.col("element_type").isin(*BODY) & (F.length(text) > 0)).select(
        "document_id", "page_no", "element_id", "canonical_order", "raw_order", stored_text(text).alias("stored")
    )
    # a row is told by a hash beside its id, as redelivered elements share the id
    body = body.withColumn("row", F.xxhash64("document_id", "page_no", "stored"))
    lines = _lines(body, F.col("stored"), "document_id", "element_id", "row")
    numbers = lines.where("core = ''").select("element_id", "row", "line")
    # a hot document has as many keys as different lines, so its rows spread
    headers = lines.where("core <> ''").join(running_headers(elements, titles), ["document_id", "core"], "left_semi").select("element_id", "row", "line")
    removed = numbers.unionByName(headers).groupBy("element_id", "row").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    return body.join(removed, ["element_id", "row"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<string>"))).drop("row")


def kept_lines(stored: str, removed: list[str] | None) -> list[str]:
    gone = set(removed or ())
    return [x for line in stored.split("\n") if (x := line.strip()) and x not in gone]


def _cuts(lines: list[str]) -> Iterator[tuple[str, str | None]]:
    """Lines, each with the first word of the next if a word is cut between them."""
    for k, line in enumerate(lines):
        if line[-1] in _HYPHENS and len(line) > 1 and line[-2].isalnum() and k + 1 < len(lines) and (m := WORD.match(lines[k + 1])):
            yield line, m[0]
        else:
            yield line, None


def _last_word(line: str) -> str:
    """The word before the hyphen at the end of a line."""
    parts = WORD.findall(line[:-1].rsplit(" ", 1)[-1])
    return parts[-1] if parts else ""


def reflow(lines: list[str], keeps: set[str] | dict) -> str:
    """One paragraph; keeps: lower-cased words whose hyphen at a line end belongs to them."""
    out = ""
    for line, head in _cuts(lines):
        if head is None:
            out += line + " "
        elif f"{_last_word(line)}-{head}".lower() in keeps:
            out += line[:-1] + "-"
        else:
            out += line[:-1]
    return out.rstrip()


_COUNTS = "kind string, skeleton string, word string, before string, n long"


def _count_words(rows: DataFrame) -> DataFrame:
    """Counts of words with the skeleton of the word before, and of words cut at line ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict[str, str] = {}

        def shape(w: str) -> str:
            s = shapes.get(w)
            if s is None:
                s = shapes[w] = "#" if w[0].isdigit() and not any(c.isalpha() for c in w) else skeleton(w)
            return s

        words: Counter[tuple[str, str]] = Counter()
        cuts: Counter[tuple[str, str]] = Counter()

        def rows_out() -> pa.RecordBatch:
            out = [("word", shape(w), w, before, n) for (w, before), n in words.items()]
            out += [("joined", skeleton(a + b), f"{a}-{b}", "", n) for (a, b), n in cuts.items()]
            out += [("hyphened", skeleton(f"{a}-{b}"), f"{a}-{b}", "", n) for (a, b), n in cuts.items()]
            columns = list(zip(*out, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int64()], strict=True)], names=["kind", "skeleton", "word", "before", "n"])

        for batch in batches:
            for stored, removed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cut = False
                for line, head in _cuts(kept_lines(stored, removed)):
                    found = WORD.findall(line.lower())
                    start = 1 if cut else 0  # the rest of a cut word is no word
                    cut = head is not None
                    if cut:
                        tail = _last_word(line).lower()
                        if tail:
                            cuts[tail, head.lower()] += 1
                            found = found[:-1]
                    before = "^"
                    for w in found[start:]:
                        s = shape(w)
                        if s != "#":
                            words[w, before] += 1
                        before = s
            if len(words) > 300_000:
                yield rows_out()
                words.clear(), cuts.clear()
            if len(shapes) > 300_000:
                shapes.clear()
        yield rows_out()

    return rows.select("stored", "removed").mapInArrow(count, _COUNTS).groupBy("kind", "skeleton", "word", "before").agg(F.sum("n").alias("n"))


def vocabulary(rows: DataFrame, sure_ratio: float = 30.0, ratio: float = 3.0, support: float = 0.25) -> tuple[Staged, Staged, Staged]:
    """(corrections (word, better), keeps (word), counts) of the whole corpus."""
    counts = Staged(_count_words(rows), "page-words")
    contexts = counts.df.where(F.col("kind") == "word").select("skeleton", "word", "before", "n")
    words = contexts.groupBy("skeleton", "word").agg(F.sum("n").alias("n"))
    best = words.groupBy("skeleton").agg(F.max_by("word", F.struct("n", "word")).alias("better"), F.max("n").alias("most"), F.count(F.lit(1)).alias("forms"))
    rivals = words.join(best.where(F.col("forms") > 1), "skeleton").where((F.col("word") != F.col("better")) & (F.col("most") >= ratio * F.col("n")))
    rivals = Staged(rivals.select("skeleton", "word", "better", "n", "most"), "page-rivals")
    # how often the rarer form stands where the better one is seen too
    of = contexts.join(rivals.df.select("skeleton", "word", "better"), ["skeleton", "word"])
    seen = contexts.select("skeleton", F.col("word").alias("better"), "before")
    backed = of.join(seen, ["skeleton", "better", "before"]).groupBy("skeleton", "word").agg(F.sum("n").alias("backed"))
    mixed = F.col("word").rlike(r"\d") & ~F.col("better").rlike(r"\d") | F.col("word").rlike("[ﬀ-ﬆ]")
    corrections = (
        rivals.df.join(backed, ["skeleton", "word"], "left")
        .where((F.col("most") >= sure_ratio * F.col("n")) | (F.coalesce("backed", F.lit(0)) >= support * F.col("n")) | mixed)
        .select("word", "better")
    )
    corrections = Staged(corrections, "page-corrections")
    rivals.drop()
    # a hyphen at a line end stays if the corpus writes the word with it more often than without
    totals = words.groupBy("skeleton").agg(F.sum("n").alias("n"))
    cut = counts.df.where(F.col("kind") != "word").select("kind", "skeleton", "word").join(totals, "skeleton", "left")
    as_one = F.sum(F.when(F.col("kind") == "joined", F.col("n")))
    apart = F.sum(F.when(F.col("kind") == "hyphened", F.col("n")))
    keeps = cut.groupBy("word").agg(F.coalesce(apart, F.lit(0)).alias("a"), F.coalesce(as_one, F.lit(0)).alias("b")).where(F.col("a") > F.col("b"))
    keeps = Staged(keeps.select("word"), "page-keeps")
    return corrections, keeps, counts


def _fixed(word: str, corrections: dict[str, str]) -> str:
    """The better form of a lower-cased word."""
    if any(c.isdigit() for c in word):
        number = as_number(word)
        if number:
            return number
    better = corrections.get(word)
    if better is not None:
        return better
    return word if word.isascii() else _LIGATURE.sub(lambda m: _LIGATURES[m[0]], word)


def repaired_words(stored: str, removed: list[str] | None, corrections: dict[str, str], keeps: dict | set) -> list[str]:
    """Lower-cased words of the repaired paragraph; words cut by the page's ends left out."""
    lines = kept_lines(stored, removed)
    if not lines:
        return []
    text = reflow(lines, keeps)
    words = WORD.findall(text.lower())
    if text[-1:] in _HYPHENS and words:
        words = words[:-1]
    return [_fixed(w, corrections) for w in words]


def restored_pieces(stored: str, removed: list[str] | None, corrections: dict[str, str], keeps: dict | set) -> list[str]:
    """Words of the repaired paragraph that are no words of the stored text."""
    have = set(WORD.findall(stored.lower()))
    return sorted({w for w in repaired_words(stored, removed, corrections, keeps)} - have)


def _in_case(word: str, like: str) -> str:
    """A lower-cased word in the case of another."""
    if like.isupper() and len(like) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def repaired_text(stored: str, removed: list[str] | None, corrections: dict[str, str], keeps: dict | set) -> str:
    """The paragraph itself: header lines gone, lines joined, words corrected in their own case."""

    def fixed(m: re.Match) -> str:
        low = m[0].lower()
        better = _fixed(low, corrections)
        return m[0] if better == low else _in_case(better, m[0])

    text = reflow(kept_lines(stored, removed), keeps)
    end = "\u00ad" if text.endswith("\u00ad") else ""  # a word cut by the page end
    return WORD.sub(fixed, text.replace("\u00ad", "") + end)


def _per_element(rows: DataFrame, corrections: Staged, keeps: Staged, max_shared: int, repair: Callable[..., list[str]]) -> DataFrame:
    """(element_id, piece) of what ``repair(stored, removed, corrections, keeps)`` makes of every element."""
    spark = rows.sparkSession
    schema = "element_id string, piece string"
    names = ["element_id", "piece"]

    def out_rows(found: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=names)

    if corrections.df.count() + keeps.df.count() <= max_shared:
        shared = spark.sparkContext.broadcast(({r.word: r.better for r in corrections.df.toLocalIterator()}, {r.word for r in keeps.df.toLocalIterator()}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            better, kept = shared.value
            for batch in batches:
                found = []
                for eid, stored, removed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found += [(eid, w) for w in repair(stored, removed, better, kept)]
                yield out_rows(found)

        return rows.select("element_id", "stored", "removed").mapInArrow(run, schema)

    # each element with just the entries its words may need
    keyed = rows.withColumn("key", F.xxhash64("element_id", "stored"))

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, stored, removed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = kept_lines(stored, removed)
                words = set(WORD.findall(" ".join(lines).lower()))
                for line, head in _cuts(lines):
                    if head:
                        tail = _last_word(line)
                        words |= {f"{tail}-{head}".lower(), (tail + head).lower()}
                found += [(key, w) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], names=["key", "word"])

    entries = corrections.df.unionByName(keeps.df.withColumn("better", F.lit(None).cast("string")))
    wanted = keyed.select("key", "stored", "removed").mapInArrow(needs, "key long, word string").distinct().join(entries, "word")
    own = wanted.groupBy("key").agg(F.collect_list(F.struct("word", "better")).alias("own"))

    def run_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for eid, stored, removed, mine in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                better = {e["word"]: e["better"] for e in mine or () if e["better"] is not None}
                kept = {e["word"] for e in mine or () if e["better"] is None}
                found += [(eid, w) for w in repair(stored, removed, better, kept)]
            yield out_rows(found)

    return keyed.join(own, "key", "left").select("element_id", "stored", "removed", "own").mapInArrow(run_own, schema)


def page_joins(rows: DataFrame) -> DataFrame:
    """Unfinished last body elements of pages with the element they go on in.

    Columns: first, second, first_stored, second_stored, tail, head; tail and head
    are the parts of a word cut by the page end, else null.
    """
    kept = F.filter(F.transform(F.split("stored", "\n"), lambda x: F.btrim(x)), lambda x: (x != "") & ~F.array_contains("removed", x))
    light = (
        rows.select("document_id", "page_no", "element_id", "canonical_order", "raw_order", "stored", kept.alias("kept"))
        .where(F.size("kept") > 0)
        .select("document_id", "page_no", "element_id", "canonical_order", "raw_order", "stored", F.element_at("kept", -1).alias("end"), F.element_at("kept", 1).alias("start"))
    )
    place = [F.col("canonical_order"), F.col("raw_order"), F.col("element_id")]
    page = Window.partitionBy("document_id", "page_no")
    ranked = light.select("*", F.dense_rank().over(page.orderBy(*place)).alias("from_start"), F.dense_rank().over(page.orderBy(*(x.desc() for x in place))).alias("from_end"))
    unfinished = ~F.col("end").rlike(r"[.!?:;][\"'”’)\]]*$")
    last = ranked.where((F.col("from_end") == 1) & unfinished).select("document_id", (F.col("page_no") + 1).alias("page_no"), F.col("element_id").alias("first"), F.col("stored").alias("first_stored"), "end")
    goes_on = F.col("start").rlike(r"^[\p{Ll}\d(₹$€£]") | F.col("end").rlike(r"[\p{L}\d,]$") | (F.col("end").rlike("[­‐-]$") & ~F.col("start").rlike(r"^\p{Lu}"))
    first = ranked.where(F.col("from_start") == 1).select("document_id", "page_no", F.col("element_id").alias("second"), F.col("stored").alias("second_stored"), "start")
    cut = F.col("end").rlike(r"[\p{L}\d][­‐‑-]$") & F.col("start").rlike(r"^[\p{L}\d]")
    word = r"[\p{L}\p{N}]+(?:[-'.,][\p{L}\p{N}]+)*"
    return (
        last.join(first, ["document_id", "page_no"])
        .where(goes_on)
        .select(
            "first",
            "second",
            "first_stored",
            "second_stored",
            F.when(cut, F.lower(F.regexp_extract("end", rf"({word})[­‐‑-]$", 1))).alias("tail"),
            F.when(cut, F.lower(F.regexp_extract("start", rf"^({word})", 1))).alias("head"),
        )
    )


@dataclass
class Repairs:
    """The tables repairs are read from; ``drop`` them after use."""

    body: Staged
    corrections: Staged
    keeps: Staged
    counts: Staged
    pairs: Staged
    cut_words: Staged

    def drop(self) -> None:
        for staged in (self.body, self.corrections, self.keeps, self.counts, self.pairs, self.cut_words):
            staged.drop()


def find_repairs(elements: DataFrame, titles: DataFrame | None = None) -> Repairs:
    body = Staged(body_elements(elements, titles), "page-body")
    corrections, keeps, counts = vocabulary(body.df)
    pairs = Staged(page_joins(body.df), "page-joins")
    # words cut by a page end: without the hyphen, unless the corpus writes it
    cut = pairs.df.where(F.col("tail").isNotNull() & F.col("head").isNotNull())
    whole = cut.select("first", "second", "first_stored", "second_stored", F.concat("tail", "head").alias("word"), F.concat_ws("-", "tail", "head").alias("hyphened"))
    whole = whole.join(_written(counts.df, whole), "hyphened", "left").withColumn("word", F.when(F.coalesce("apart", F.lit(0)) > F.coalesce("as_one", F.lit(0)), F.col("hyphened")).otherwise(F.col("word")))
    whole = whole.join(corrections.df, "word", "left").select("first", "second", "first_stored", "second_stored", F.coalesce("better", "word").alias("piece"))
    return Repairs(body, corrections, keeps, counts, pairs, Staged(whole, "page-cut-words"))


def repair_pages(elements: DataFrame, max_shared: int = MAX_SHARED, titles: DataFrame | None = None) -> DataFrame:
    """(element_id, repair, piece): every repair of every body element."""
    r = find_repairs(elements, titles)
    kind = lambda name: F.lit(name).alias("repair")
    removed = r.body.df.select("element_id", kind("removed"), F.explode("removed").alias("piece"))
    restored = _per_element(r.body.df, r.corrections, r.keeps, max_shared, restored_pieces).select("element_id", kind("restored"), "piece")
    joined = r.pairs.df.select(F.col("first").alias("element_id"), kind("joined"), F.col("second").alias("piece"))
    words = F.regexp_extract_all(F.lower(F.concat_ws("\n", "first_stored", "second_stored")), F.lit(r"([\p{L}\p{N}]+(?:[-'.,][\p{L}\p{N}]+)*)"))
    cut_words = r.cut_words.df.where(~F.array_contains(words, F.col("piece"))).select(F.col("first").alias("element_id"), kind("restored"), "piece")
    out = Staged(removed.unionByName(restored).unionByName(joined).unionByName(cut_words).distinct(), "page-repairs")
    r.drop()
    return out.df


def paragraphs(elements: DataFrame, max_shared: int = MAX_SHARED, titles: DataFrame | None = None) -> DataFrame:
    """(element_id, n_elements, text): continuous readable paragraphs, under their first element.

    Of a redelivered element the last delivery counts; deleted elements, and those that
    are headers only, make no paragraph.  Elements are chained over page ends; each
    chain is one paragraph, a word cut by a page end put together again.
    """
    last = F.struct("ingested_at", ~F.coalesce("is_deleted", F.lit(False)), F.coalesce("content", "raw_content", F.lit("")))
    kept = [c for c in ("document_id", "page_no", "canonical_order", "raw_order", "element_type", "content", "raw_content", "is_deleted") if c in elements.columns]
    latest = elements.where("element_id IS NOT NULL").groupBy("element_id").agg(F.max_by(F.struct(*kept), last).alias("e")).select("element_id", "e.*")
    # a deleted element still tells where its page's text goes on
    live = Staged(latest.where(~F.coalesce("is_deleted", F.lit(False))).select("element_id"), "page-live")
    r = find_repairs(latest, titles)
    texts = _per_element(r.body.df, r.corrections, r.keeps, max_shared, lambda *x: [t] if (t := repaired_text(*x)) else [])
    texts = Staged(texts.select("element_id", F.col("piece").alias("text")).join(live.df, "element_id"), "page-texts")
    # most chains are one pair; longer ones are told by an element that both goes on and is gone on with
    pairs = r.pairs.df.select("first", "second").distinct().join(live.df.toDF("first"), "first").join(live.df.toDF("second"), "second").select("first", "second")
    inner = pairs.select(F.col("first").alias("e")).intersect(pairs.select(F.col("second").alias("e")))
    long_ = pairs.join(inner, pairs["first"] == inner["e"], "left_semi").unionByName(pairs.join(inner, pairs["second"] == inner["e"], "left_semi")).distinct()
    long_ = Staged(long_, "page-long-chains")
    groups = connected_groups(long_.df, "first", "second").toDF("element_id", "chain")
    short = pairs.join(long_.df, ["first", "second"], "left_anti").select(F.explode(F.array("first", "second")).alias("element_id"), F.col("first").alias("chain"))
    chains = groups.unionByName(short)
    cut = r.cut_words.df.join(pairs, ["first", "second"], "left_semi").select(F.col("second").alias("element_id"), F.col("piece").alias("cut")).distinct()
    pages = r.body.df.select("element_id", "page_no").distinct()
    rows = texts.df.join(chains, "element_id", "left").join(cut, "element_id", "left").join(pages, "element_id")
    # the elements of one paragraph, in order of their pages
    parts = rows.groupBy(F.coalesce("chain", "element_id").alias("chain")).agg(F.array_sort(F.collect_list(F.struct("page_no", "element_id", "text", "cut"))).alias("p"))
    glued = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.element_at("p", 1)["text"], _glue)
    out = Staged(parts.select(F.element_at("p", 1)["element_id"].alias("element_id"), F.size("p").alias("n_elements"), glued.alias("text")), "page-paragraphs")
    for staged in (texts, long_, live):
        staged.drop()
    r.drop()
    return out.df


_JVM_WORD = r"[\p{L}\p{N}]+(?:[-'.,][\p{L}\p{N}]+)*"


def _glue(text: Column, part: Column) -> Column:
    """A paragraph with its next part; the word cut between them whole, its first letter as it was."""
    tail = F.regexp_extract(text, rf"({_JVM_WORD})[­‐‑-]$", 1)
    capital = F.when(F.substring(tail, 1, 1) != F.lower(F.substring(tail, 1, 1)), F.concat(F.upper(F.substring(part["cut"], 1, 1)), F.substring(part["cut"], 2, 2**31 - 1))).otherwise(part["cut"])
    whole = F.concat(F.regexp_replace(text, rf"{_JVM_WORD}[­‐‑-]$", ""), capital, F.regexp_replace(part["text"], rf"^{_JVM_WORD}", ""))
    return F.when(part["cut"].isNotNull(), whole).otherwise(F.concat(text, F.lit(" "), part["text"]))


def _written(counts: DataFrame, whole: DataFrame) -> DataFrame:
    """How often the corpus writes words cut by page ends as one word and hyphened."""
    forms = whole.select("hyphened", F.explode(F.array(F.struct(F.col("word").alias("w"), F.lit(True).alias("one")), F.struct(F.col("hyphened").alias("w"), F.lit(False).alias("one")))).alias("f")).select("hyphened", "f.*").distinct()
    words = counts.where(F.col("kind") == "word").select(F.col("word").alias("w"), "n")
    n = words.join(forms.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.sum("n").alias("n"))
    return forms.join(n, "w").groupBy("hyphened").agg(F.sum(F.when(F.col("one"), F.col("n"))).alias("as_one"), F.sum(F.when(~F.col("one"), F.col("n"))).alias("apart"))
