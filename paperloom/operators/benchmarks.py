"""Question sets of other benchmarks: records brought to one form, evidence aligned with chunks, coverage audited."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import stores
from .documents import let

# How much of a paragraph a chunk must hold, how near a competitor may be, and what an unanswerable question is answered with.
THRESHOLD, AMBIGUITY, TITLE_SHARE = 0.55, 0.05, 0.8
UNANSWERABLE = "The question is unanswerable from the paper."
FIGURES = r"(?i)\b(?:table|figure|fig\.|caption)\b"
#: Wrappers around an annotation that are opened: lists, and objects with an answer.
DEPTH = 6
#: Of a paragraph's rarest words, those whose first chunks are compared before others.
SEEDS = 3
#: Keys that are broadcast, as hashes, to leave rows without them out before a join; where there are more, all rows go to it, with equal results.
MAX_BROADCAST_KEYS = 4_000_000
#: Rows of paragraphs' rare words, some 500 bytes each, that are broadcast to the chunks at once; more go in several turns.
MAX_WANTED = 100_000


def _at(row: Column | str, *names: str) -> Column:
    """The first of several members of a JSON object that says something, as text."""
    return F.coalesce(*[F.nullif(T.squeezed(F.get_json_object(T._col(row), f"$.{n}")), F.lit("")) for n in names], F.lit(""))


def _strings(c: Column) -> Column:
    """A JSON list's distinct texts, or a text alone; blank ones left out."""
    many = F.when(c.startswith("["), F.transform(F.from_json(c, "array<string>"), T.squeezed)).when(c.isNotNull(), F.array(T.stripped(c)))
    return F.array_distinct(F.filter(F.coalesce(many, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))


def _lists(row: Column | str, *names: str) -> Column:
    """The texts of the first of several lists of a JSON object that is not empty."""
    found = [_strings(F.get_json_object(T._col(row), f"$.{n}")) for n in names]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in found], F.array().cast("array<string>"))


def canonical_paper(c: Column | str) -> Column:
    """The last part of a paper's identity or URL, case-folded, without version."""
    text = F.rtrim(T.squeezed(F.coalesce(T._col(c), F.lit(""))), F.lit("/"))
    return F.regexp_replace(T.fold(F.element_at(F.split(text, "/"), -1)), r"v\d+$", "")


def title_key(c: Column | str) -> Column:
    return F.array_join(F.regexp_extract_all(T.fold(F.coalesce(T._col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def title_overlap(expected: Column | str, candidate: Column | str) -> Column:
    """Share of a title's distinct words that another has; 0 if it has none."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(T.fold(F.coalesce(T._col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    return T.overlap(words(expected), words(candidate))


def looks_like_arxiv(c: Column | str) -> Column:
    return T._col(c).rlike(r"^(?:\d{4}\.\d{4,5}|[a-z.-]+/\d{7})$")


EXAMPLE = ("source_dataset", "source_id", "question", "reference_answer", "evidence", "paper_id", "title", "answer_type", "metadata")


def _examples(rows: DataFrame, **columns: Column) -> DataFrame:
    made = rows.select(*[columns[name].alias(name) for name in EXAMPLE])
    return made.where((F.col("source_id") != "") & (F.col("question") != "") & (F.col("reference_answer") != ""))


def _no_metadata() -> Column:
    return F.create_map().cast("map<string,string>")


def from_qasa(rows: DataFrame, row: str = "row") -> DataFrame:
    """Examples of QASA records (JSON): question, composed answer, and the contexts of its evidence."""
    contexts = F.transform(F.from_json(F.get_json_object(row, "$.evidential_info"), "array<string>"), lambda x: T.squeezed(F.get_json_object(x, "$.context")))
    evidence = F.coalesce(F.filter(contexts, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))
    paper, identity = canonical_paper(_at(row, "arxiv_id", "paper_id")), _at(row, "question_id", "id")
    return _examples(
        rows, source_dataset=F.lit("qasa"), source_id=F.when(identity != "", F.concat(paper, F.lit("-"), identity)).otherwise(F.lit("")), question=_at(row, "question"), reference_answer=_at(row, "composition", "answer"),
        evidence=evidence, paper_id=paper, title=_at(row, "title"), answer_type=F.lit(None).cast("string"),
        metadata=F.create_map(F.lit("question_type"), _at(row, "question_type"), F.lit("sampling_id"), identity),
    )


def _annotation(c: Column) -> Column:
    """The first annotation inside lists and objects with an answer, as JSON; null if there is none."""
    def opened(x: Column) -> Column:
        member = F.try_element_at(F.filter(F.from_json(x, "array<string>"), lambda m: m.startswith("{") | m.startswith("[")), F.lit(1))
        inner = F.get_json_object(x, "$.answer")
        return F.when(x.startswith("["), member).when(inner.startswith("{") | inner.startswith("["), inner).otherwise(x)

    # One step at a time over a list of steps: the expression stays as small as one of them.
    found = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), c, lambda x, _: opened(x))
    return let(found, lambda x: F.when(x.startswith("{"), x))


def from_qasper(rows: DataFrame, row: str = "row") -> DataFrame:
    """Examples of QASPER documents (JSON): a row a question, by its first annotation.

    An answer is unanswerable, else its spans, else yes or no, else free. Questions
    come as lists side by side or as a list of objects.
    """
    qas = F.get_json_object(row, "$.qas")
    side = F.from_json(qas, "question array<string>, question_id array<string>, answers array<string>")
    listed = F.transform(F.from_json(qas, "array<string>"), lambda x: F.struct(F.get_json_object(x, "$.question").alias("q"), F.get_json_object(x, "$.question_id").alias("id"), F.get_json_object(x, "$.answers").alias("a")))
    zipped = F.transform(side["question"], lambda q, i: F.struct(q.alias("q"), F.get(side["question_id"], i).alias("id"), F.get(side["answers"], i).alias("a")))
    asked = rows.select(row, F.posexplode(F.when(qas.startswith("{"), zipped).otherwise(listed)).alias("pos", "x"))
    asked = asked.withColumn("ann", _annotation(F.col("x.a"))).where("ann IS NOT NULL")
    spans, yes_no = _strings(F.get_json_object("ann", "$.extractive_spans")), F.get_json_object("ann", "$.yes_no")
    kind = F.when(F.get_json_object("ann", "$.unanswerable") == "true", "unanswerable").when(F.size(spans) > 0, "extractive").when(yes_no.isin("true", "false"), "yes_no").otherwise("free_form")
    answer = F.when(kind == "unanswerable", UNANSWERABLE).when(kind == "extractive", F.array_join(spans, " ")).when(kind == "yes_no", F.when(yes_no == "true", "Yes.").otherwise("No.")).otherwise(_at("ann", "free_form_answer"))
    identity = F.coalesce(F.nullif(T.squeezed(F.col("x.id")), F.lit("")), F.col("pos").cast("string"))
    return _examples(
        asked, source_dataset=F.lit("qasper"), source_id=identity, question=T.squeezed(F.coalesce("x.q", F.lit(""))), reference_answer=answer, evidence=_lists("ann", "highlighted_evidence", "evidence"),
        paper_id=canonical_paper(_at(row, "arxiv_id", "paper_id", "id")), title=_at(row, "title"), answer_type=kind, metadata=_no_metadata(),
    )


def from_scidqa(rows: DataFrame, row: str = "row") -> DataFrame:
    """Examples of SciDQA records (JSON); evidence only where an export has it."""
    answer = T.stripped(F.regexp_replace(_at(row, "ans", "answer"), r"^A:\s*", ""))
    return _examples(
        rows, source_dataset=F.lit("scidqa"), source_id=_at(row, "id", "qid"), question=_at(row, "que", "question"), reference_answer=answer,
        evidence=_lists(row, "evidence", "evidence_text", "supporting_passages", "source_evidence"), paper_id=canonical_paper(_at(row, "arxiv_id", "paper_id", "pid")), title=_at(row, "title"),
        answer_type=F.lit(None).cast("string"), metadata=F.create_map(F.lit("version"), _at(row, "version"), F.lit("rid"), _at(row, "rid")),
    )


def skip_reason() -> Column:
    """Why an example cannot be sampled: no evidence, figures and tables, or other papers; null if it can."""
    text = F.concat_ws(" ", "question", "reference_answer", F.array_join("evidence", " "))
    return F.when(F.size("evidence") == 0, "missing_evidence").when(text.rlike(T.MULTIMODAL), "multimodal").when(text.rlike(T.MULTI_DOCUMENT), "multidocument")


# ---- alignment ----------------------------------------------------------


def papers_of(examples: DataFrame, chunks: DataFrame) -> DataFrame:
    """examples with ``paper``, the key of the paper in chunks: by canonical identity, else by title; null if neither is there."""
    papers = chunks.select(canonical_paper("paper_id").alias("_key"), F.col("paper_id").alias("_paper"), title_key("title").alias("_title")).distinct()
    by_id = papers.groupBy("_key").agg(F.min("_paper").alias("_by_id"))
    by_title = papers.where("_title <> ''").groupBy("_title").agg(F.min("_paper").alias("_by_title"))
    keyed = examples.withColumns({"_key": canonical_paper("paper_id"), "_title": F.nullif(title_key("title"), F.lit(""))})
    return keyed.join(by_id, "_key", "left").join(by_title, "_title", "left").withColumn("paper", F.coalesce("_by_id", "_by_title")).drop("_key", "_title", "_by_id", "_by_title")


def _beside(best: Column, other: Column) -> Column:
    """Whether two chunks are of one section, and touch or overlap."""
    gap = F.least(F.abs(best["end_char"] - other["start_char"]), F.abs(other["end_char"] - best["start_char"]))
    overlap = (best["end_char"] >= other["start_char"]) & (other["end_char"] >= best["start_char"])
    return F.coalesce((F.coalesce(best["section"], F.lit("")) == F.coalesce(other["section"], F.lit(""))) & ((gap <= 1) | overlap), F.lit(False))


def align(examples: DataFrame, chunks: DataFrame, key: str = "source_id", threshold: float = THRESHOLD, margin: float = AMBIGUITY) -> DataFrame:
    """(key, chunk_ids, reviewed, reason, best_scores): where each example's evidence stands in its paper's chunks.

    examples: key, paper (null if it has no chunks), evidence; chunks: chunk_id,
    paper_id, section, start_char, end_char, text. A paragraph belongs to the chunk
    that holds most of its content words. Competitors within the margin are
    accepted beside it, and make it ambiguous elsewhere. Paragraphs after the
    first that fails are not looked at. Only chunks of one paper are compared.
    """
    paragraphs = examples.select(key, "paper", F.posexplode("evidence").alias("pos", "paragraph")).withColumn("words", T.content_tokens("paragraph"))
    held = chunks.where((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.trim(F.coalesce("chunk_id", F.lit(""))) != "")).select(
        F.col("paper_id").alias("paper"), F.struct("chunk_id", "section", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char")).alias("chunk"), T.content_tokens("text").alias("has")
    )
    pairs = paragraphs.join(held, "paper", "left").withColumn("score", T.overlap(F.col("words"), F.col("has")))
    w = Window.partitionBy(key, "pos")
    best = F.min(F.when(F.col("chunk").isNotNull(), F.struct((-F.col("score")).alias("s"), F.col("chunk.chunk_id").alias("id"), F.col("chunk").alias("c")))).over(w)
    near = pairs.withColumn("best", best).where(F.col("best").isNull() | (-F.col("best.s") - F.col("score") <= margin))
    near = near.withColumn("beside", (F.col("chunk.chunk_id") == F.col("best.id")) | _beside(F.col("best.c"), F.col("chunk")))
    mine = F.when(F.col("beside"), F.struct(F.col("score") * -1, F.col("chunk.chunk_id").alias("id")))
    told = near.groupBy(key, "pos").agg(
        F.first("words").alias("words"), (-F.first("best.s")).alias("score"), F.first("best.id").alias("best"), F.max(~F.coalesce("beside", F.lit(True))).alias("elsewhere"),
        F.transform(F.array_sort(F.collect_list(mine)), lambda x: x["id"]).alias("ids"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("beside"), F.col("has"))))).alias("has"),
    )
    weak = F.col("score").isNull() | (F.col("score") < threshold)
    reason = F.when(weak, "below_threshold").when(F.col("elsewhere"), "ambiguous").when(T.overlap(F.col("words"), F.col("has")) < threshold, "below_threshold")
    ids = F.concat(F.array("best"), F.array_remove("ids", F.col("best")))
    told = told.select(key, F.struct("pos", reason.alias("reason"), "score", ids.alias("ids")).alias("p"))
    listed = told.groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    failed = F.try_element_at(F.filter("ps", lambda p: p["reason"].isNotNull()), F.lit(1))
    good = F.filter("ps", lambda p: failed["pos"].isNull() | (p["pos"] < failed["pos"]))
    scores = F.transform(F.filter("ps", lambda p: failed["pos"].isNull() | (p["pos"] < failed["pos"]) | ((p["pos"] == failed["pos"]) & (p["reason"] == "ambiguous"))), lambda p: F.round(p["score"], 6))
    found = listed.select(key, F.array_distinct(F.flatten(F.transform(good, lambda p: p["ids"]))).alias("chunk_ids"), failed["reason"].alias("reason"), scores.alias("best_scores"))
    rows = examples.select(key, "paper", F.size("evidence").alias("_n")).join(found, key, "left")
    why = F.when(F.col("paper").isNull(), "no_chunks").when(F.col("_n") <= 0, "missing_evidence").otherwise(F.col("reason"))
    none = F.array().cast("array<string>")
    return rows.select(
        key, F.when(F.col("paper").isNotNull(), F.coalesce("chunk_ids", none)).otherwise(none).alias("chunk_ids"), why.isNull().alias("reviewed"), why.alias("reason"), F.coalesce("best_scores", F.array().cast("array<double>")).alias("best_scores")
    )


def tier(examples: DataFrame, chunks: DataFrame, failures: DataFrame | None = None, **options) -> DataFrame:
    """Records of a benchmark tier: id, question, reference_answer, reference_context_ids, reviewed, reason, source_dataset.

    failures (source_dataset, source_id): papers that could not be brought in.
    """
    placed = papers_of(examples, chunks)
    aligned = align(placed, chunks, "source_id", **options)
    rows = examples.join(aligned, "source_id")
    if failures is not None:
        rows = rows.join(failures.select("source_dataset", "source_id", F.lit(True).alias("_failed")), ["source_dataset", "source_id"], "left")
        rows = rows.withColumn("reason", F.when(F.col("_failed") & (F.col("reason") == "no_chunks"), "ingestion_failure").otherwise(F.col("reason")))
    return rows.select(
        F.concat_ws("-", "source_dataset", "source_id").alias("id"), "question", "reference_answer", F.col("chunk_ids").alias("reference_context_ids"), "reviewed", "reason", "source_dataset"
    )


def union_tiers(tiers: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """The tiers' questions in one table, each with its tier; a key that occurs twice is an error."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("tier", F.lit(name)) for name, df in tiers.items()])
    times = F.count("*").over(Window.partitionBy(key))
    checked = rows.withColumn("_n", times)
    once = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("question in several tiers: "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return checked.where(once).drop("_n")


# ---- coverage -----------------------------------------------------------


def _best(rows: DataFrame) -> DataFrame:
    return rows.groupBy("e").agg(F.min(F.when(F.col("shared") > 0, F.struct((-F.col("shared")).alias("s"), F.col("chunk_id").alias("id")))).alias("b"), F.max("exact").alias("exact"))


def _only(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose column is not among wanted's, for a join with these: what is left out is not shuffled."""
    keys = stores.kept(wanted.select(F.xxhash64(column).alias("_key")).distinct(), "keys")
    if keys.count() > MAX_BROADCAST_KEYS:
        return rows
    return rows.withColumn("_key", F.xxhash64(column)).join(F.broadcast(keys), "_key", "left_semi").drop("_key")


def _bits(words: Column) -> Column:
    """A number of 64 bits, of which each word has one by its hash."""
    mark = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda bits, w: bits.bitwiseOR(mark(w)))


def _wanted(known: DataFrame, tried: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(e, w, before, words, need): words whose chunks are to be compared with a paragraph, before which chunk, and of what words how many they must share. First for chunks that may be nearer, second for those it may stand in.

    One of the m - b rarest of a paragraph's m words is in chunks that share more than b; those that share b, as much as the
    best that was tried, may have only the next.
    """
    m, b = F.size("known"), -F.col("b.s")
    word = lambda before, need: lambda x: F.struct(x["w"].alias("w"), before.alias("before"), need.cast("int").alias("need"))
    names = lambda words: F.transform(words, lambda x: x["w"]).alias("words")
    anywhere, within = F.lit(None).cast(kind), F.filter("known", lambda x: x["inner"])
    more = F.transform(F.slice("known", F.lit(1), F.greatest(m - b, F.lit(0))), word(anywhere, b + 1))
    equal = F.transform(F.slice("known", m - b + 1, F.when(b > 1, 1).otherwise(0)), word(F.col("b.id"), b))
    found = stores.kept(known.join(_best(tried), "e"), "known-best")
    nearer = found.select("e", F.explode(F.concat(more, equal)).alias("x"), names(F.col("known"))).select("e", "x.w", "x.before", "words", "x.need")
    spelled = found.where(~F.col("exact") & (F.size(within) > 0) & (F.size(within) == F.col("n_inner")))
    spelled = spelled.select("e", F.get(within, F.lit(0))["w"].alias("w"), anywhere.alias("before"), names(within), F.size(within).alias("need"))
    return stores.kept(nearer, "nearer"), stores.kept(spelled, "spelled")


def _rivals(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(e, chunk_id, words, has, need): the pairs that are compared, where chunks lie: those that hold a wanted word, and may hold as many as wanted."""
    sent = wanted.withColumn("bits", _bits(F.col("words"))).withColumn("spare", F.size("words") - F.bit_count("bits"))
    posts = texts.select("chunk_id", "has", _bits(F.col("has")).alias("held"), F.explode("has").alias("w"))
    # Bits tell of most chunks that they have too few of the words.
    may = F.bit_count(F.col("bits").bitwiseAND(F.col("held"))) + F.col("spare") >= F.col("need")
    near = posts.join(F.broadcast(sent), "w").where(F.col("before").isNull() | (F.col("chunk_id") < F.col("before"))).where(may)
    return near.select("e", "chunk_id", "words", "has", "need")


def _sharing(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(e, shared, chunk_id) of the chunks that share as many words as wanted."""
    return _rivals(wanted, texts).select("e", F.size(F.array_intersect("words", "has")).alias("shared"), "chunk_id", "need").where("shared >= need").drop("need")


def _turns(wanted: DataFrame) -> list[DataFrame]:
    """wanted in parts of about MAX_WANTED rows; none, if it is empty."""
    n = -(-wanted.count() // MAX_WANTED)
    return [wanted if n == 1 else wanted.where(F.pmod(F.xxhash64("e"), F.lit(n)) == i) for i in range(n)]


def closest(paragraphs: DataFrame, chunks: DataFrame, seeds: DataFrame) -> DataFrame:
    """(e, n, shared, chunk_id, exact): of each paragraph, the first chunk that shares most of its content words, how many, and whether it stands in any chunk. shared and chunk_id are null if no word is shared.

    paragraphs: e, paragraph; seeds (e, chunk_id): chunks that are likely to be near, such as those
    that are labelled. They and the first chunks with the rarest words are compared first; a chunk that
    shares b of the m words that any chunk has, has one of the m - b + 1 rarest of them, so after that only
    chunks are compared that can beat these. Only texts that are compared are shuffled.
    """
    # Text that stands in a chunk shares all its words with it, but for the two at its ends, which may be cut.
    flat = lambda c: T.fold(T.squeezed(F.coalesce(c, F.lit(""))))
    tokens = F.regexp_extract_all(F.lower("paragraph"), F.lit(T.CONTENT_TOKEN), F.lit(0))
    inner = T.content_tokens(F.array_join(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0))), " "))
    said = paragraphs.select("e", flat(F.col("paragraph")).alias("flat"), T.content_tokens("paragraph").alias("words"), inner.alias("inner"))
    said = stores.kept(said.where("flat <> ''"), "paragraphs")
    texts = stores.kept(chunks.select("chunk_id", T.content_tokens("text").alias("has")), "words")

    vocabulary = texts.select("chunk_id", F.explode("has").alias("w")).groupBy("w").agg(F.count("*").alias("df"), F.min("chunk_id").alias("first"))
    spoken = said.select("e", F.explode("words").alias("w"), "inner").select("e", "w", F.array_contains("inner", F.col("w")).alias("inner"), F.size("inner").alias("n_inner"))
    known = spoken.join(vocabulary, "w").groupBy("e").agg(F.array_sort(F.collect_list(F.struct("df", "w", "inner", "first"))).alias("known"), F.first("n_inner").alias("n_inner"))
    known = stores.kept(known, "known")

    def compared(pairs: DataFrame) -> DataFrame:
        """pairs (e, chunk_id) with the number of words that both share, and whether the paragraph stands in the chunk."""
        rows = _only(chunks.select("chunk_id", "text"), "chunk_id", pairs).join(pairs, "chunk_id").join(said.select("e", "flat", "words"), "e")
        return rows.select("e", F.size(F.array_intersect("words", T.content_tokens("text"))).alias("shared"), "chunk_id", flat(F.col("text")).contains(F.col("flat")).alias("exact"))

    likely = seeds.unionByName(known.select("e", F.explode(F.transform(F.slice("known", 1, SEEDS), lambda x: x["first"])).alias("chunk_id"))).distinct()
    tried = stores.kept(compared(stores.kept(likely, "likely")), "tried")
    # Chunks that share one word are told by the vocabulary.
    one = known.select("e", F.lit(1).alias("shared"), F.array_min(F.transform("known", lambda x: x["first"])).alias("chunk_id"), F.lit(False).alias("exact"))
    rows = tried.unionByName(one)
    nearer, spelled = _wanted(known, tried, texts.schema["chunk_id"].dataType.simpleString())
    for part in _turns(nearer):
        # Of each paragraph, a task passes on one chunk.
        best = _sharing(part, texts).groupBy("e").agg(F.min(F.struct((-F.col("shared")).alias("s"), F.col("chunk_id").alias("id"))).alias("b"))
        rows = rows.unionByName(stores.kept(best.select("e", (-F.col("b.s")).alias("shared"), F.col("b.id").alias("chunk_id"), F.lit(False).alias("exact")), "nearest"))
    for part in _turns(spelled):
        rows = rows.unionByName(compared(stores.kept(_sharing(part, texts).select("e", "chunk_id").distinct(), "standing")))
    # Paragraphs without a word inside, few, are looked for in all texts.
    odd = said.where(F.size("inner") == 0).join(tried.where("exact").select("e").distinct(), "e", "left_anti").select("e", "flat")
    if not odd.isEmpty():
        rows = rows.unionByName(odd.join(chunks.select("chunk_id", flat(F.col("text")).alias("held")), F.col("held").contains(F.col("flat"))).select("e", F.lit(0).alias("shared"), "chunk_id", F.lit(True).alias("exact")))
    return _best(rows).join(said.select("e", F.size("words").alias("n")), "e").select("e", "n", (-F.col("b.s")).alias("shared"), F.col("b.id").alias("chunk_id"), "exact")


def audit(misses: DataFrame, chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Why each missed question was missed: its evidence is not indexed, or it is and was ranked too low.

    misses: question_id, paper_id, evidence, gold_ids; chunks: chunk_id, paper_id, section,
    text. Evidence is compared with the chunks of all papers; equal paragraphs once. Gives
    bucket, cause, the counts behind them, and the best chunk.
    """
    evidence = misses.select("question_id", "gold_ids", F.posexplode("evidence").alias("pos", "paragraph")).select("*", F.md5(F.col("paragraph").cast("binary")).alias("e"), T.content_tokens("paragraph").alias("words"))
    seeds = evidence.select("e", F.explode("gold_ids").alias("chunk_id"))
    near = stores.kept(closest(evidence.select("e", "paragraph").distinct(), chunks, seeds), "closest")
    found = evidence.select("question_id", "pos", "e").join(near, "e")
    best = found.groupBy("question_id").agg(F.min(F.when(F.col("shared") > 0, F.struct((-F.col("shared") / F.col("n")).alias("s"), F.col("pos").alias("p"), F.col("chunk_id").alias("id")))).alias("b"), F.max("exact").alias("exact_substring"))
    best = best.select("question_id", F.round(-F.col("b.s"), 6).alias("best_overlap"), F.col("b.id").alias("best_chunk_id"), "exact_substring")

    labelled = misses.select("question_id", F.explode_outer("gold_ids").alias("chunk_id"))
    gold = labelled.join(_only(chunks.select("chunk_id", "section", "text"), "chunk_id", labelled), "chunk_id").withColumn("has", T.content_tokens("text"))
    gold = gold.groupBy("question_id").agg(F.count("*").alias("gold_chunks_in_index"), F.array_sort(F.collect_set(F.nullif(F.trim("section"), F.lit("")))).alias("sections"), F.array_distinct(F.flatten(F.collect_list("has"))).alias("has"))
    combined = evidence.join(gold.select("question_id", "has"), "question_id").groupBy("question_id").agg(F.max(T.overlap(F.col("words"), F.col("has"))).alias("combined"))
    papers = chunks.groupBy("paper_id").agg(F.count("*").alias("paper_chunks_in_index"))

    rows = misses.join(best, "question_id", "left").join(gold.drop("has"), "question_id", "left").join(combined, "question_id", "left").join(papers, "paper_id", "left")
    rows = rows.join(chunks.select(F.col("chunk_id").alias("best_chunk_id"), F.coalesce("section", F.lit("")).alias("best_section")), "best_chunk_id", "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("gold_chunks_in_index", "paper_chunks_in_index")}
    rows = rows.withColumns(counts | {"best_overlap": F.coalesce("best_overlap", F.lit(0.0)), "exact_substring": F.coalesce("exact_substring", F.lit(False)), "best_section": F.coalesce("best_section", F.lit(""))})
    present = (F.col("gold_chunks_in_index") > 0) & (F.col("exact_substring") | (F.col("best_overlap") >= threshold) | (F.coalesce("combined", F.lit(0.0)) >= threshold))
    where = F.coalesce(F.nullif(F.array_join("sections", ", "), F.lit("")), F.lit("labeled chunks"))
    nearest = F.when(F.trim("best_section") != "", F.concat(F.lit("; nearest text is in "), F.trim("best_section"), F.lit("."))).otherwise(F.lit("."))
    cause = (
        F.when(present, F.concat(F.lit("Reviewed evidence is indexed in "), where, F.lit("; this is a top-4 ranking miss."))).when(F.col("paper_chunks_in_index") == 0, "Source paper has no chunks in the benchmark BM25 index.")
        .when(F.array_join("evidence", " ").rlike(FIGURES), "Source paper is indexed, but labeled evidence appears table/figure-related and is absent.")
        .otherwise(F.concat(F.lit("Source paper is indexed, but no chunk reaches the evidence-overlap threshold"), nearest))
    )
    bucket = F.when(present, "(b) Evidence present, not retrieved").otherwise("(a) Evidence absent")
    return rows.select(
        "question_id", bucket.alias("bucket"), F.size("evidence").alias("evidence_count"), F.size("gold_ids").alias("gold_chunk_count"), "gold_chunks_in_index", "paper_chunks_in_index", "exact_substring", "best_overlap",
        F.coalesce("best_chunk_id", F.lit("")).alias("best_chunk_id"), "best_section", cause.alias("cause"),
    )
