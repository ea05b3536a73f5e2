"""Papers that questions name: mentions of known and quoted titles, and queries about one of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Known titles that are broadcast to the questions; more are dealt out with them, which finds the same.
MAX_BROADCAST_TITLES = 100_000
#: First characters of a title without ASCII words, by which questions meet it.
BEGINNING = 8


def known_titles(papers: DataFrame, *names: str) -> DataFrame:
    """Distinct titles, one spelling of each normal form, from the first given of several columns."""
    title = F.coalesce(*[F.nullif(T.stripped(n), F.lit("")) for n in names])
    rows = papers.select(title.alias("title")).where("title IS NOT NULL").withColumn("norm", T.fold(T.squeezed("title")))
    return rows.groupBy("norm").agg(F.min("title").alias("title"))


def _beginnings(low: Column) -> Column:
    """The parts of a text, of up to BEGINNING characters, where a title without ASCII words can begin: they have no ASCII word either."""
    # Any place of such a title lies in one stretch.
    stretches = F.regexp_extract_all(low, F.lit("[^a-z0-9]+"), F.lit(0))
    sizes = F.sequence(F.lit(1), F.lit(BEGINNING))
    parts = F.transform(stretches, lambda s: F.flatten(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.transform(sizes, lambda n: F.substring(s, i, n)))))
    return F.array_distinct(F.filter(F.flatten(parts), lambda x: ~x.startswith(" ")))


def _candidates(questions: DataFrame, titles: DataFrame, key: str, text: str, broadcast: int | None) -> DataFrame:
    """(key, start, size, quoted, title): where titles begin in the folded question, and how long they are."""
    asked = questions.select(key, F.col(text).alias("q"), T.fold(T.squeezed(text)).alias("low"))
    quoted = asked.select(key, F.explode(T.quoted_titles("q")).alias("x")).select(key, F.col("x.start").alias("start"), (-F.col("x.size")).alias("size"), F.lit(1).alias("quoted"), F.col("x.title").alias("title"))
    # A title can only occur in a question that has all of its words; its longest is what both are joined on.
    word = lambda c: F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0))
    rare = titles.withColumn("w", F.try_element_at(F.array_sort(F.transform(word(F.col("norm")), lambda x: F.struct(F.length(x).alias("n"), x.alias("w")))), F.lit(-1))["w"])
    spoken = asked.select(key, "low", F.explode(F.array_distinct(word(F.col("low")))).alias("w"))
    bound = MAX_BROADCAST_TITLES if broadcast is None else broadcast
    small = titles.limit(bound + 1).count() <= bound
    sent = F.broadcast if small else lambda rows: rows
    joined = spoken.join(sent(rare), "w")
    if broadcast is None or small:  # titles without ASCII words are joined on how they begin
        bare = titles.where(F.size(word(F.col("norm"))) == 0).withColumn("w", F.substring("norm", 1, BEGINNING))
        begun = asked.select(key, "low", F.explode(_beginnings(F.col("low"))).alias("w"))
        joined = joined.unionByName(begun.join(sent(bare), "w").select(*joined.columns))
    # The first place where the title stands apart from letters and digits around it.
    apart = F.concat(F.lit(" "), F.col("low"), F.lit(" "))
    rest = F.split(apart, F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.replace("norm", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![a-z0-9])")), 2)
    found = joined.withColumn("rest", rest).where(F.size("rest") > 1)
    known = found.select(key, F.length(F.element_at("rest", 1)).alias("start"), F.length("norm").alias("size"), F.lit(0).alias("quoted"), "title")
    return known.unionByName(quoted)


def named_papers(questions: DataFrame, titles: DataFrame, key: str = "query_id", text: str = "text", broadcast: int | None = None) -> DataFrame:
    """(key, titles): the papers each question names, in the order of mention; questions that name none have no row.

    Known titles count as whole words, quoted ones wherever they are. Of titles
    that overlap the first counts, of those that begin together the longest, and
    a known one before a quoted one. Which count depends on those before, so a
    question's few candidates are folded in order. titles: norm, title. However many
    there are, all are looked for; only a bound that is given as ``broadcast`` leaves out, of more
    titles, those without ASCII words.
    """
    spots = _candidates(questions, titles, key, text, broadcast)
    listed = spots.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("start", F.negative("size").alias("size"), "quoted", "title"))).alias("spots"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("titles"), F.array().cast("array<string>").alias("norms"))

    def step(state: Column, x: Column) -> Column:
        norm = T.fold(T.squeezed(x["title"]))
        taken = (x["start"] >= state["end"]) & ~F.array_contains(state["norms"], norm)
        more = F.struct((x["start"] - x["size"]).alias("end"), F.array_append(state["titles"], x["title"]).alias("titles"), F.array_append(state["norms"], norm).alias("norms"))
        return F.when(taken, more).otherwise(state)

    return listed.select(key, F.aggregate("spots", start, step, lambda s: s["titles"]).alias("titles")).where(F.size("titles") > 0)


def without_titles(text: Column, titles: Column) -> Column:
    """A text with all occurrences of titles, in whatever case, made spaces."""
    def step(t: Column, title: Column) -> Column:
        return F.regexp_replace(t, F.concat(F.lit(r"(?iu)\Q"), F.replace(title, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), F.lit(" "))

    return F.aggregate(titles, text, step)


def entity_queries(questions: DataFrame, named: DataFrame, key: str = "query_id", text: str = "text", least: int = 2) -> DataFrame:
    """(key, entity, title, text) for questions that name several papers: one query a paper, without the others' titles, its own in front."""
    rows = questions.join(named, key).where(F.size("titles") >= least)
    rows = rows.select(key, F.col(text).alias("q"), "titles", F.posexplode("titles").alias("entity", "title"))
    focus = without_titles(F.col("q"), F.array_remove("titles", F.col("title")))
    focus = F.btrim(T.squeezed(focus), F.lit(" ,;:"))
    return rows.select(key, "entity", "title", T.stripped(F.concat(F.lit('"'), F.col("title"), F.lit('" '), focus)).alias("text"))


def title_key(c: Column | str) -> Column:
    """ASCII words of a title, case-folded, single-spaced."""
    return F.array_join(F.regexp_extract_all(T.fold(F.coalesce(T._col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def title_matches(expected: Column | str, actual: Column | str) -> Column:
    """Whether titles are equal, or one is inside the other, by their keys; a blank one matches nothing."""
    a, b = title_key(expected), title_key(actual)
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def mentions(question: str, titles: list[str]) -> list[str]:
    """As named_papers, for one question in plain Python."""
    def norm(t: str) -> str:
        return " ".join(t.casefold().split())

    low, spots = norm(question), []
    for t in {norm(t): t.strip() for t in titles if t.strip()}.values():
        if m := re.search(rf"(?<![a-z0-9]){re.escape(norm(t))}(?![a-z0-9])", low):
            spots.append((m.start(), -len(norm(t)), 0, t))
    for m in re.finditer(T.QUOTED, question):
        t = " ".join(m[1].split()).strip(" ,;:.")
        if t and norm(t) in low:
            spots.append((low.find(norm(t)), -len(norm(t)), 1, t))
    out: list[str] = []
    end = 0
    for start, size, _, t in sorted(spots):
        if start >= end and norm(t) not in map(norm, out):
            out.append(t)
            end = start - size
    return out


def round_robin_entities(per_entity: DataFrame, general: DataFrame, key: str = "query_id", chunk: str = "chunk_id") -> DataFrame:
    """(key, chunk, position): entities' rankings dealt in turn, then the general ranking; each chunk at its first place.

    per_entity: key, entity, chunk, rank; general: key, chunk, rank.
    """
    dealt = per_entity.select(key, chunk, F.lit(0).alias("tier"), F.col("rank").alias("a"), F.col("entity").alias("b"))
    rest = general.join(per_entity.select(key).distinct(), key, "left_semi").select(key, chunk, F.lit(1).alias("tier"), F.col("rank").alias("a"), F.lit(0).alias("b"))
    first = Window.partitionBy(key, chunk).orderBy("tier", "a", "b")
    rows = dealt.unionByName(rest).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return rows.select(key, chunk, F.row_number().over(Window.partitionBy(key).orderBy("tier", "a", "b")).alias("position"))
