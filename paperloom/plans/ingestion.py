"""From discovered papers to searchable chunks: each run is one plan over tables, with errors as rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..hooks import embed_column
from ..operators import corpus, documents, lexical, references, state
from ..sources import stores

#: Columns of a processed document.
PROCESSED = ("canonical_id", "paper_id", "metadata", "pages", "sections", "section_details", "citations")


def identified(papers: DataFrame) -> DataFrame:
    """papers with canonical_id, source_version and version (its number), the newest version of each identity only."""
    rows = papers.withColumns({"canonical_id": T.canonical_id("paper_id"), "source_version": T.paper_version("paper_id")}).where("canonical_id IS NOT NULL")
    order = "pos" if "pos" in papers.columns else "paper_id"
    kept = documents.newest_versions(rows, "canonical_id", "source_version", order)
    return kept.withColumn("version", F.coalesce(F.regexp_extract("source_version", r"(\d+)", 1).try_cast("int"), F.lit(0)))


def lines_of(pages: DataFrame, doc: str = "canonical_id") -> DataFrame:
    """(doc, page_number, line_no, line) of pages (doc, page_number, text)."""
    cut = F.split(F.coalesce("text", F.lit("")), T.LINE_END)
    return pages.select(doc, "page_number", F.posexplode(cut).alias("line_no", "line"))


def sectioned(pages: DataFrame, doc: str = "canonical_id") -> DataFrame:
    """(doc, sections, section_details): each document's sections as a map in order of appearance, and its headings.

    A heading's own line is not part of its section. Sections that come again go on
    where they were. A document without a word has the map without entries.
    """
    rows = documents.sections(lines_of(pages, doc), doc)
    at = F.struct("page_number", "line_no")
    text = rows.where("heading IS NULL").groupBy(doc, "section").agg(F.min(at).alias("first"), F.array_sort(F.collect_list(F.struct("page_number", "line_no", "line"))).alias("l"))
    joined = text.select(doc, "first", "section", T.stripped(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))
    entries = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("first", "section", "text"))))
    maps = joined.groupBy(doc).agg(F.map_from_entries(F.transform(entries, lambda x: F.struct(x["section"], x["text"]))).alias("sections"))
    heads = rows.where("heading IS NOT NULL").groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page_number", "line_no", "section", F.col("heading.raw_heading"), F.col("heading.confidence"), F.col("heading.matched_rule")))).alias("section_details"))
    return maps.join(heads, doc, "left")


@dataclass(frozen=True)
class Ingested:
    """What a run made: processed documents, and one outcome (canonical_id, paper_id, status, stage, error) for each paper."""

    documents: DataFrame
    outcomes: DataFrame

    def summary(self) -> DataFrame:
        """One row: how many papers there were, and how many of each outcome."""
        named = {"skipped": "skipped", "processed": "processed", "failed": "failed"}
        return self.outcomes.agg(F.count("*").alias("discovered"), *[F.count_if(F.col("status") == s).alias(n) for n, s in named.items()])

    def events(self, seq: Column) -> DataFrame:
        """Registry events of the run, for fold_registry."""
        return self.outcomes.where("status <> 'skipped'").select("canonical_id", seq.alias("seq"), "version", "status", F.lit(None).cast("string").alias("path"), "error")


def ingest(papers: DataFrame, pages: DataFrame, registry: DataFrame | None = None, downloads: DataFrame | None = None) -> Ingested:
    """Discovered papers and their pages made processed documents.

    papers: paper_id, title and what ``corpus.metadata`` uses; pages: canonical_id,
    page_number, text, error (rows with an error have no text); registry: canonical_id
    and status of papers known before, whose done ones are skipped; downloads:
    paper_id and error of fetches. A paper whose download or parsing failed, or
    that has no pages, is an outcome with its stage and error; the others go on.
    """
    known = identified(papers)
    todo = known if registry is None else state.pending(known, registry)
    failed = todo.select("canonical_id", "paper_id", "version").join(downloads.where("error IS NOT NULL").select("paper_id", F.col("error").alias("lost")), "paper_id", "left") if downloads is not None else todo.select("canonical_id", "paper_id", "version").withColumn("lost", F.lit(None).cast("string"))
    broken = pages.groupBy("canonical_id").agg(F.max("error").alias("broken"), F.count("text").alias("n_pages"))
    outcome = failed.join(broken, "canonical_id", "left")
    status = F.when(F.col("lost").isNotNull() | F.col("broken").isNotNull() | (F.coalesce("n_pages", F.lit(0)) == 0), "failed").otherwise("processed")
    stage = F.when(F.col("lost").isNotNull(), "download").when(status == "failed", "process")
    outcome = outcome.select("canonical_id", "paper_id", "version", status.alias("status"), stage.alias("stage"), F.when(status == "failed", F.coalesce("lost", "broken", F.lit("no pages"))).alias("error"))

    good = outcome.where("status = 'processed'").select("canonical_id")
    mine = pages.join(good, "canonical_id", "left_semi").where("text IS NOT NULL").select("canonical_id", "page_number", "text")
    parts = documents.clean_sections(sectioned(mine))
    whole = mine.groupBy("canonical_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text", F.length("text").alias("char_count")))).alias("pages"))
    bibliography = references.section_of_map(F.coalesce("sections", F.create_map().cast("map<string,string>")))
    cited = references.of_documents(parts.select("canonical_id", bibliography.alias("b")), "canonical_id", F.col("b"))
    fields = [c for c in cited.columns if c not in ("canonical_id", "pos")]
    cited = cited.groupBy("canonical_id").agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("citations"))
    meta = corpus.metadata(known.join(good, "canonical_id", "left_semi"))
    made = meta.join(whole, "canonical_id").join(parts, "canonical_id", "left").join(cited, "canonical_id", "left")
    named = [c for c in meta.columns if c not in ("paper_id", "canonical_id", "pos")]
    docs = made.select("canonical_id", "paper_id", F.struct(*named).alias("metadata"), "pages", "sections", "section_details", "citations")
    if registry is not None:
        skipped = known.join(state.pending(known, registry).select("canonical_id"), "canonical_id", "left_anti")
        none = F.lit(None).cast("string")
        outcome = outcome.unionByName(skipped.select("canonical_id", "paper_id", "version", F.lit("skipped").alias("status"), none.alias("stage"), none.alias("error")))
    return Ingested(docs, outcome)


def write_documents(docs: DataFrame, path: str) -> int:
    """Processed documents as a new batch, each as JSON; a document that is written again replaces itself.

    A batch counts once it is whole, so a reader never sees half of one.
    """
    rows = docs.select("canonical_id", F.to_json(F.struct(*[c for c in docs.columns if c != "canonical_id"]), {"ignoreNullFields": "false"}).alias("document"))
    return stores.upsert(rows, path, "canonical_id")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents that write_documents wrote, the newest of each identity."""
    return stores.latest(spark, path, "canonical_id").select("canonical_id", F.from_json("document", schema).alias("d")).select("canonical_id", "d.*")


@dataclass(frozen=True)
class Index:
    """Tagged chunks, their postings and term statistics, and their vectors."""

    chunks: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    vectors: DataFrame | None

    def counts(self) -> dict[str, int]:
        """Chunks, chunks with text, and vectors: what a health check compares."""
        made = {"chunks": self.chunks.count(), "bm25_documents": self.postings.select("chunk_id").distinct().count()}
        return made | ({} if self.vectors is None else {"vectors": self.vectors.count()})


def process(docs: DataFrame, papers: DataFrame | None = None, dense: bool = True, embed: Callable[[Column | str], Column] | None = None, **windows) -> Index:
    """Processed documents made an index: section-aware chunks, tagged with their paper's metadata, postings, and vectors.

    docs: paper_id and sections (a map); a document without sections has one, "unknown",
    of its pages' text. papers: paper_id, metadata (a map), if chunks are to be tagged.
    """
    some = F.exists(F.map_values("sections"), lambda t: F.coalesce(F.trim(t) != "", F.lit(False)))
    pages = F.array_join(F.transform("pages", lambda p: p["text"]), "\n") if "pages" in docs.columns else F.lit("")
    sections = F.when(F.coalesce(some, F.lit(False)), F.col("sections")).otherwise(F.create_map(F.lit("unknown"), pages))
    rows = docs.select("paper_id", F.explode(sections).alias("section", "text"))
    chunks = documents.chunks(rows.withColumn("section", F.coalesce(F.nullif(F.trim("section"), F.lit("")), F.lit("unknown"))), doc="paper_id", section="section", **windows)
    tagged = chunks.withColumn("metadata", F.create_map().cast("map<string,string>"))
    if papers is not None:
        tagged = corpus.tag(tagged, papers)
    searchable = tagged.where(lexical.has_text("text"))
    vectors = searchable.select("chunk_id", (embed or embed_column())("text").alias("embedding")) if dense else None
    return Index(tagged, lexical.postings(searchable, "chunk_id"), lexical.vocabulary(searchable), vectors)


def run_checkpoint(papers: DataFrame, path: str, provider: str, query: str, most: int) -> str:
    """Replace the checkpoint of a discovery run (its papers, ordered by pos) as a whole; returns the run's key."""
    spark = papers.sparkSession
    key = spark.range(1).select(T.run_key(F.lit(provider), F.lit(query), F.lit(most))).first()[0]
    others = [c for c in papers.columns if c != "pos"]
    listed = papers.agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", *others)))).alias("papers"))
    stores.upsert(listed.select(F.lit(key).alias("run_key"), F.coalesce("papers", F.lit("[]")).alias("papers")), path, "run_key")
    return key


def load_checkpoint(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The papers of a run, in the order they were found; none if the run has no checkpoint."""
    rows = stores.latest(spark, path, "run_key")
    if rows is None:
        return spark.createDataFrame([], schema)
    return rows.where(F.col("run_key") == key).select(F.explode(F.from_json("papers", f"array<struct<{schema}>>")).alias("p")).select("p.*")
