"""Papers and chunks: metadata, selection, look-ups, and sets of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Sections worth showing first.
SECTION_PRIORITY = ("abstract", "methodology", "experiments", "results", "limitations", "conclusion", "discussion", "introduction", "analysis")


def first_given(*candidates: Column) -> Column:
    """The first candidate that is not null, blank or empty."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c) for c in candidates])


def paper_from_json(payload: Column | str) -> Column:
    """One paper from a provider's JSON, whatever names it gives its fields."""
    def at(*names: str) -> Column:
        return first_given(*[F.get_json_object(T._col(payload), f"$.{n}") for n in names])

    return F.struct(
        at("paper_id", "arxiv_id", "arxivId", "id").alias("paper_id"), at("title", "name").alias("title"), at("abstract", "summary", "description").alias("summary"),
        at("published", "published_at", "publication_date", "date").alias("published"), at("doi", "DOI").alias("doi"), at("pdf_url", "pdf", "url").alias("pdf_url"),
        F.coalesce(at("citation_count", "citations", "citationCount").try_cast("int"), F.lit(0)).alias("citation_count"),
    )


def metadata(papers: DataFrame) -> DataFrame:
    """papers with title and summary squeezed, the year that the date begins with, and a DOI: as given, else from any field that holds one."""
    def given(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in papers.columns else F.lit("")

    told = F.concat_ws(" ", *[given(c) for c in ("doi", "journal_ref", "comment", "summary")])
    found = F.nullif(F.rtrim(F.regexp_extract(told, r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+", 0), F.lit(".,;) ")), F.lit(""))
    year = F.nullif(F.regexp_extract(given("published"), r"^(\d{4})", 1), F.lit("")).cast("int")
    return papers.withColumns({"title": T.squeezed(given("title")), "summary": F.nullif(T.squeezed(given("summary")), F.lit("")), "year": year, "doi": F.coalesce(F.nullif(given("doi"), F.lit("")), found)})


def tag(chunks: DataFrame, papers: DataFrame, key: str = "paper_id") -> DataFrame:
    """chunks with their paper's metadata under their own, and section slug, family and year as columns.

    Input: key, section, metadata (map) on both sides. A chunk's entry wins.
    """
    joined = chunks.join(papers.select(key, F.col("metadata").alias("_paper")), key, "left")
    mine, theirs = F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.coalesce("_paper", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.map_contains_key(mine, k)), mine)
    out = joined.withColumn("metadata", merged).drop("_paper").withColumn("section", T.slug("section"))
    return out.withColumn("section_family", T.section_family("section")).withColumn("year", T.year_of(F.coalesce(F.try_element_at("metadata", F.lit("year")), F.try_element_at("metadata", F.lit("published")))))


def title_matches(title: Column, wanted: Column) -> Column:
    """Equal, or one inside the other, by letters and digits only."""
    a, b = F.replace(T.phrase(title), F.lit(" "), F.lit("")), F.replace(T.phrase(wanted), F.lit(" "), F.lit(""))
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def showcase(chunks: DataFrame, n: int, paper: str = "paper_id", key: str = "chunk_id", size: Column | None = None) -> DataFrame:
    """n chunks of each paper: the first of its abstract and the longest of other sections, by the sections' priority; then by position."""
    size = F.length("text") if size is None else size
    place = F.array_position(F.array(*map(F.lit, SECTION_PRIORITY)), F.col("section"))
    rows = chunks.where(~F.col("section").isin(*T.EXCLUDED_SECTIONS)).withColumn("_p", F.when(place > 0, place))
    order = F.when(F.col("section") == "abstract", F.col("start_char")).otherwise(-size)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(paper, "section").orderBy(order, key)))
    first = F.col("_p").isNotNull() & (F.col("_n") == 1)
    w = Window.partitionBy(paper).orderBy(~first, F.when(first, F.col("_p")), "start_char", key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(paper, key, "section", "rank")


# Sections whose chunks fill a pool first, in order, and the place of all others.
POOL_SECTIONS = {"abstract": 0, "conclusion": 1, "results": 2, "limitations": 3, "methodology": 4}
OTHER_SECTION = 9


def pool_candidates(questions: DataFrame, chunks: DataFrame, group: str = "question_id", key: str = "chunk_id", paper: str = "paper_id") -> DataFrame:
    """(group, key, place, shared): the chunks of each question's paper, by their section's place and the tokens they share with it.

    questions: group, paper, text. Papers are matched without their versions.
    """
    bare = lambda c: F.regexp_replace(T.fold(T.squeezed(c)), r"v\d+$", "")
    place = F.lit(OTHER_SECTION)
    for name, at in POOL_SECTIONS.items():
        place = F.when(T.fold(F.coalesce("section", F.lit(""))) == name, at).otherwise(place)
    asked = questions.select(group, bare(F.col(paper)).alias("_p"), F.array_distinct(T.technical_tokens("text")).alias("_q"))
    held = chunks.select(key, bare(F.col(paper)).alias("_p"), place.alias("place"), F.array_distinct(T.technical_tokens("text")).alias("_t"))
    return asked.join(held, "_p").select(group, key, "place", F.size(F.array_intersect("_q", "_t")).alias("shared"))


def context_pool(questions: DataFrame, fixed: DataFrame, chunks: DataFrame, n: int, group: str = "question_id", key: str = "chunk_id") -> DataFrame:
    """(group, key, position): n chunks of each question: its fixed ones, then those of its paper by section and shared tokens.

    A question that cannot be filled is an error.
    """
    others = pool_candidates(questions, chunks, group, key)
    pool = fill_pool(fixed, others, n, group, key, ["place", F.desc("shared"), key])
    counted = questions.select(group).join(pool.groupBy(group).agg(F.count("*").alias("_n")), group, "left")
    short = F.concat(F.lit("too few chunks for question "), F.col(group).cast("string"))
    full = counted.select(group, F.when(F.coalesce("_n", F.lit(0)) < n, F.raise_error(short)).otherwise(F.lit(True)).alias("_ok"))
    return pool.join(full, group).where("_ok").drop("_ok")


def result_of_payload(payload: Column | str, score: Column, source: str, fallback_id: Column | None = None) -> Column:
    """A stored payload (JSON) as a retrieval result: its own fields, else those of its metadata; odd ones are null.

    Authors may be a list or one name; a year that is no number is null. The payload stays beside it.
    """
    text = T._col(payload)

    def value(name: str) -> Column:
        own, nested = F.get_json_object(text, f"$.{name}"), F.get_json_object(text, f"$.metadata.{name}")
        return F.coalesce(F.nullif(own, F.lit("")), nested)

    def optional(name: str) -> Column:
        return F.nullif(T.stripped(value(name)), F.lit(""))

    authors = value("authors")
    listed = F.when(authors.startswith("["), F.transform(F.from_json(authors, "array<string>"), T.stripped)).when(T.stripped(authors) != "", F.array(authors))
    return F.struct(
        F.coalesce(value("chunk_id"), fallback_id if fallback_id is not None else F.lit(""), F.lit("")).alias("chunk_id"), F.coalesce(value("text"), F.lit("")).alias("text"), score.alias("score"), F.lit(source).alias("source"),
        optional("paper_id").alias("paper_id"), optional("title").alias("title"), F.coalesce(F.filter(listed, lambda a: a != ""), F.array().cast("array<string>")).alias("authors"),
        value("year").try_cast("int").alias("year"), optional("section").alias("section"), optional("url").alias("url"), text.alias("metadata"),
    )


def fill_pool(fixed: DataFrame, others: DataFrame, n: int, group: str = "question_id", key: str = "chunk_id", order: list[Column | str] | None = None) -> DataFrame:
    """A question's fixed chunks, then others in the given order, each once, until there are n."""
    columns = [group, key, "_tier", "_order"]
    a = fixed.select(group, key, F.lit(0).alias("_tier"), F.struct(F.col("pos").cast("double").alias("a"), F.lit("").alias("b")).alias("_order"))
    b = others.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(*(order or [key])))).select(group, key, F.lit(1).alias("_tier"), F.struct(F.col("_i").cast("double").alias("a"), F.lit("").alias("b")).alias("_order"))
    rows = a.unionByName(b).select(*columns)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group, key).orderBy("_tier", "_order"))).where("_n = 1")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy("_tier", "_order"))).where(F.col("position") <= n).select(group, key, "position")


def ordered_lookup(lists: DataFrame, store: DataFrame, key: str = "chunk_id", ids: str = "ids") -> DataFrame:
    """The stored rows of each list's ids in their order; an id that is not stored is an error."""
    rows = lists.select(*[c for c in lists.columns if c != ids], F.posexplode(ids).alias("pos", key)).join(store.withColumn("_stored", F.lit(True)), key, "left")
    return rows.withColumn("_ok", F.when(F.col("_stored").isNull(), F.raise_error(F.concat(F.lit("not stored: "), F.col(key).cast("string")))).otherwise(F.lit(True))).where("_ok").drop("_stored", "_ok")


def missing(lists: DataFrame, store: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key) of references to rows that are not stored."""
    return lists.select(group, key).distinct().join(store.select(key), key, "left_anti").select(group, key)


def lookup_with_fallback(rows: DataFrame, store: DataFrame, key: str, other: str, value: str) -> DataFrame:
    """rows with value by key, or by the fallback key where the first finds none."""
    by_key = store.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("_a"))
    by_other = store.where(F.col(other).isNotNull()).groupBy(other).agg(F.min(value).alias("_b"))
    return rows.join(by_key, key, "left").join(by_other, other, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def right_paper_wrong_chunk(ranked: DataFrame, gold: DataFrame, chunks: DataFrame, k: int = 4, query: str = "query_id", key: str = "chunk_id", paper: str = "paper_id") -> DataFrame:
    """(query, n): queries whose first k hold chunks of a gold chunk's paper, but no gold chunk."""
    top = ranked.where(F.col("rank") <= k).select(query, key).join(chunks.select(key, paper), key)
    papers = gold.join(chunks.select(key, paper), key).select(query, paper).distinct()
    found = top.join(gold.select(query, key), [query, key], "left_semi").select(query).distinct()
    return top.join(papers, [query, paper]).join(found, query, "left_anti").groupBy(query).agg(F.count("*").alias("n"))


def seeded_order(key: Column, seed: int) -> Column:
    """A pseudo-random order that is the same everywhere: by a hash of seed and key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)


def keywords(query: Column | str, phrases: tuple[str, ...], stops: tuple[str, ...], limit: int = 4, whole: bool = False) -> Column:
    """Known phrases of a query, then its words that are no stop words, at most limit; with ``whole`` a short query itself in front."""
    text = T._col(query)
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    first = F.when(F.lit(whole) & (F.size(F.split(T.squeezed(text), " ")) <= 8), T.stripped(text))
    known = [F.when(low.contains(p), F.lit(p)) for p in phrases]
    seismic = F.when(low.contains("earthquake"), F.lit("seismic"))
    out = F.array_distinct(F.concat(F.array_compact(F.array(first, *known, seismic)), F.filter(words, lambda w: ~w.isin(*stops))))
    return F.slice(F.when(F.size(out) > 0, out).when(F.size(words) > 0, words).otherwise(F.array(text)), 1, limit)
