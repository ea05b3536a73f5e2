"""Bibliographies: the section, its entries, and what each entry names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .documents import let

# Headings of a bibliography, the marker of an entry, an author's name at its start, and its parts.
HEADINGS = ("references", "bibliography", "works cited", "literature cited")
HEADING = r"(?i)^\s*(?:references|bibliography|works cited|literature cited)\s*$"
MARKER, CUT = r"^(?:\[\d+\]|\d{1,3}[.)])\s+", r"(?<!\S)(?=(?:\[\d+\]|\d{1,3}[.)])\s)"
AUTHOR_START = r"^[A-Z][A-Za-z'’\-]+,\s+(?:[A-Z](?:\.|\b)|[A-Z][a-z]+)"
YEAR, URL = r"(?<!\d)(?:\(|\b)(19\d{2}|20\d{2})(?:\)|\b)", r"(?i)https?://[^\s<>]+"
QUOTED, IDENTIFIED = r"[\"“](.+?)[\"”]", r"(?i)(?:doi\s*:|https?://|arXiv\s*:)"
#: Of years that control characters mark: one in parentheses, one that ends a sentence, any.
YEAR_IN_PARENTHESES, YEAR_ENDING, YEAR_ANYWHERE = "(?<=\\()\1\\d{4}\2(?=\\))", "\1\\d{4}\2(?=\\.(?:\\s|$)|\\s*$)", "\1\\d{4}\2"
AND = r"\s+(?:and|&)\s+|\s*;\s*"
SHORT_LINE = 80


def _words(c: Column) -> Column:
    squeezed = T.squeezed(c)
    return F.when(squeezed == "", F.lit(0)).otherwise(F.size(F.split(squeezed, " ")))


def _plain(c: Column | str) -> Column:
    """ASCII words only, case-folded, single-spaced."""
    return F.trim(F.regexp_replace(T.fold(F.coalesce(T._col(c), F.lit(""))), "[^a-z0-9]+", " "))


def section_of_text(c: Column | str) -> Column:
    """What follows the first heading of a bibliography, as lines; empty without a heading, as papers are not searched at random."""
    lines = F.split(F.coalesce(T._col(c), F.lit("")), T.LINE_END)
    at = F.try_element_at(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(HEADING), i)), lambda i: i.isNotNull()), F.lit(1))
    return F.coalesce(F.array_join(F.slice(lines, at + 2, F.size(lines)), "\n"), F.lit(""))


def section_of_map(sections: Column | str) -> Column:
    """The first section of a map that is named as a bibliography; empty if none is."""
    named = F.filter(F.map_entries(T._col(sections)), lambda e: F.trim(F.regexp_replace(F.lower(e["key"]), "[_-]+", " ")).isin(*HEADINGS))
    return F.coalesce(F.try_element_at(named, F.lit(1))["value"], F.lit(""))


def lines(c: Column | str) -> Column:
    """A bibliography's lines without blank ones, headings and page numbers; short ones, which may be page headers, only where they come first."""
    text = F.replace(F.coalesce(T._col(c), F.lit("")), F.lit("\0"), F.lit(" "))
    clean = F.filter(F.transform(F.split(text, T.LINE_END), T.squeezed), lambda x: (x != "") & ~x.rlike(HEADING) & ~x.rlike(r"^\d+$"))

    def firsts(found: Column) -> Column:
        low = F.transform(found, lambda x: F.when(F.length(x) < SHORT_LINE, T.fold(x)))
        return F.filter(found, lambda x, i: (F.length(x) >= SHORT_LINE) | (F.array_position(low, T.fold(x)) == i + 1))

    return let(clean, firsts)


def is_substantive(entry: Column) -> Column:
    """Whether an entry has three words or more behind its marker."""
    return _words(F.regexp_replace(entry, MARKER, "")) >= 3


def is_complete(entry: Column) -> Column:
    """Whether an entry has a year, and ends or names an identity or address."""
    return entry.rlike(YEAR) & (F.rtrim(entry).endswith(".") | entry.rlike(T.DOI) | entry.rlike(URL))


def entries(c: Column | str) -> Column:
    """The entries of a bibliography that have three words or more.

    Numbered ones are cut before each marker. Others begin where a line starts
    with an author and the entry so far is complete: a fold over the lines.
    """
    def numbered(combined: Column) -> Column:
        return F.filter(F.transform(F.split(combined, CUT), lambda x: F.trim(x)), lambda x: x.rlike(MARKER))

    def unnumbered(found: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

        def step(state: Column, line: Column) -> Column:
            begins = (state["open"] != "") & line.rlike(AUTHOR_START) & is_complete(state["open"])
            longer = F.when(state["open"] == "", line).otherwise(F.concat(state["open"], F.lit(" "), line))
            return F.struct(F.when(begins, F.array_append(state["done"], state["open"])).otherwise(state["done"]).alias("done"), F.when(begins, line).otherwise(longer).alias("open"))

        return F.aggregate(found, start, step, lambda s: F.filter(F.array_append(s["done"], s["open"]), lambda x: x != ""))

    def cut(found: Column) -> Column:
        combined = F.concat(F.array_join(found, " "), F.lit(" "))
        return F.when(combined.rlike(r"(?<!\S)(?:\[\d+\]|\d{1,3}[.)])\s"), numbered(combined)).otherwise(unnumbered(found))

    return F.filter(let(lines(c), cut), is_substantive)


def _year_marked(body: Column) -> Column:
    """A body with control characters around each year that is no part of a DOI, an arXiv id or an address."""
    return F.replace(F.regexp_replace(body, rf"((?i:{T.DOI}|{T.ARXIV}|{URL}))|(?<!\d)\b((?:19|20)\d{{2}})\b", "$1\1$4\2"), F.lit("\1\2"), F.lit(""))


def _around_year(marked: Column) -> Column:
    """What stands before and behind the year of an entry; one text if there is none.

    A year in parentheses counts first, then one that ends a sentence, then any.
    """
    cut = F.split(marked, YEAR_ANYWHERE, 2)
    for better in (YEAR_ENDING, YEAR_IN_PARENTHESES):
        cut = F.when(marked.rlike(better), F.split(marked, better, 2)).otherwise(cut)
    return F.transform(cut, lambda x: F.translate(x, "\1\2", ""))


def parse(c: Column | str) -> Column:
    """One entry as a struct: what it names, guesses of title, authors and venue, and a confidence by how much it names.

    Digits of a DOI, an arXiv id or an address are no year.
    """
    def of(raw: Column) -> Column:
        return let(F.translate(F.regexp_replace(raw, MARKER, ""), "\1\2", ""), lambda body: let(_around_year(_year_marked(body)), lambda around: let(_title(body), lambda title: _parsed(raw, body, around, title))))

    return let(T.squeezed(F.coalesce(T._col(c), F.lit(""))), of)


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _title(body: Column) -> Column:
    def of(quoted: Column) -> Column:
        parts = F.filter(F.transform(F.split(body, r"\.\s+"), lambda x: F.trim(x)), lambda x: x != "")
        named = F.transform(F.slice(parts, 2, 2), lambda x: F.btrim(F.regexp_replace(x, YEAR, ""), F.lit(" ,()")))
        named = F.filter(named, lambda x: _words(x).between(3, 40) & ~F.lower(x).rlike("^(?:doi|http|arxiv)"))
        return F.when(_words(quoted).between(2, 40), F.trim(quoted)).otherwise(F.try_element_at(named, F.lit(1)))

    return let(_found(body, QUOTED, 1), of)


def _parsed(raw: Column, body: Column, around: Column, title: Column) -> Column:
    number = F.coalesce(_found(raw, r"^\[(\d+)\]\s", 1), _found(raw, r"^(\d{1,3})[.)]\s", 1)).cast("int")
    doi, arxiv = F.rtrim(_found(body, T.DOI, 1), F.lit(".,;)")), _found(body, T.ARXIV, 1)
    url = F.rtrim(_found(body, URL, 0), F.lit(".,;)"))
    dated, head = F.size(around) > 1, F.element_at(around, 1)
    year = F.when(dated, F.substring(body, F.length(head) + 1, F.lit(4)))
    at = F.coalesce(F.instr(body, title), F.lit(0))

    def people(before: Column) -> Column:
        listed = F.filter(F.split(before, AND), lambda x: _words(x).between(1, 10))
        none = F.array().cast("array<string>")
        return F.when((before != "") & (_words(before) <= 35), F.slice(F.transform(listed, lambda x: F.btrim(x, F.lit(" ,."))), 1, 20)).otherwise(none)

    before = F.when(at > 0, F.substring(body, F.lit(1), at - 1)).otherwise(F.regexp_replace(head, r"\($", ""))
    authors = let(F.btrim(before, F.lit(" .,;:")), people)
    behind = at + F.length(title)
    tail = F.when(dated & (F.length(head) >= behind - 1), F.concat(F.substring(head, behind, F.length(head)), F.element_at(around, -1))).otherwise(F.substring(body, behind, F.length(body)))
    venue = let(F.btrim(F.element_at(F.split(tail, IDENTIFIED), 1), F.lit(" .,:;()")), lambda x: F.when((at > 0) & _words(x).between(1, 20), x))

    def whole(f: Column) -> Column:
        signals = sum((f[x].isNotNull().cast("int") for x in ("title", "year", "doi", "arxiv", "url")), (F.size(f["authors"]) > 0).cast("int"))
        confidence = F.least(F.lit(0.95), 0.25 + 0.1 * signals + F.when(f["number"].isNotNull(), 0.1).otherwise(0.0))
        identity = F.coalesce(f["doi"], f["arxiv"], _plain(F.coalesce(f["title"], raw)))
        return F.struct(
            F.substring(F.sha1(identity.cast("binary")), 1, 16).alias("citation_id"), raw.alias("raw"), f["title"].alias("title"), f["authors"].alias("authors"), f["year"].alias("year"), f["doi"].alias("doi"),
            f["arxiv"].alias("arxiv_id"), f["url"].alias("url"), f["venue"].alias("venue"), f["number"].alias("reference_number"), F.round(confidence, 4).alias("confidence"),
        )

    parts = F.struct(number.alias("number"), doi.alias("doi"), arxiv.alias("arxiv"), url.alias("url"), year.cast("int").alias("year"), title.alias("title"), authors.alias("authors"), venue.alias("venue"))
    return let(parts, whole)


def of_documents(docs: DataFrame, key: str, bibliography: Column) -> DataFrame:
    """(key, pos, citation fields...) of each document's bibliography, repeats of an identity left out."""
    rows = docs.select(key, F.posexplode(entries(bibliography)).alias("pos", "entry")).select(key, "pos", parse("entry").alias("c")).select(key, "pos", "c.*")
    return distinct(rows, key)


def distinct(refs: DataFrame, doc: str = "doc_id", order: str = "pos") -> DataFrame:
    """References of a document once each: by DOI, else arXiv id without version, else title, else text."""
    title = _plain("title")
    identity = (
        F.when(F.col("doi").isNotNull(), F.concat(F.lit("doi:"), T.fold("doi")))
        .when(F.col("arxiv_id").isNotNull(), F.concat(F.lit("arxiv:"), F.regexp_replace(F.lower("arxiv_id"), r"v\d+$", "")))
        .when(F.length(title) >= 12, F.concat(F.lit("title:"), title))
        .otherwise(F.concat(F.lit("raw:"), _plain("raw")))
    )
    w = Window.partitionBy(doc, "_key").orderBy(order)
    return refs.withColumn("_key", identity).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n")
