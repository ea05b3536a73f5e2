"""Text as columns: tokens, overlap, normal forms, citations, question types.

Everything here is built-in expressions, so that Catalyst can fold, prune and
generate code for it. Character classes are spelled out, since engines differ on \\w.
"""

import unicodedata
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and word lists that results depend on.
TECHNICAL_TOKEN = r"(?:[\p{L}\p{N}]+(?:[._#-][\p{L}\p{N}]+)*(?:\+\+)?)"
WORD_TOKEN = r"[\p{L}\p{N}_]+"
CONTENT_TOKEN = r"[A-Za-z0-9]+(?:[._+#-][A-Za-z0-9]+)*"
SPAN_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "their",
    "this", "to", "was", "were", "with",
)
EXPANSIONS = {
    "rag": ("retrieval augmented generation",),
    "llm": ("large language model",),
    "bm25": ("best matching 25", "lexical retrieval"),
    "evaluation": ("assessment", "benchmarking"),
}
EVIDENCE_SUFFIXES = (
    "method approach retrieval selection filtering reranking",
    "experiment evaluation dataset benchmark metric results improvement",
    "limitations drawbacks failure cases computational cost future work",
)
QUESTION_STEMS = "what|which|who|when|where|why|how|compare|contrast|describe|explain|identify|list|report|evaluate|summarize"
EXCLUDED_SECTIONS = ("references", "bibliography", "front_matter", "acknowledgements", "acknowledgments")
TRUNCATION_REASONS = ("length", "max_tokens", "max_output_tokens", "model_length")
SECTION_FAMILIES = {
    "front": ("front_matter", "abstract", "acknowledgements"),
    "context": ("introduction", "related_work", "background"),
    "method": ("method", "methodology", "architecture", "approach", "proposed_method", "proposed_approach"),
    "evidence": ("experiments", "results", "analysis", "evaluation", "discussion"),
    "closing": ("limitations", "conclusion", "future_work"),
    "back": ("references", "appendix", "supplementary_material"),
}
EXPLICIT_RAG = r"(?i)\bretrieval[\s-]*augmented[\s-]*generation\b|\bRAG\b"
MULTIMODAL = r"(?i)\b(?:figure|fig\.?|table|equation|eq\.?|appendix|supplement(?:ary)?|image|plot|chart)\b"
MULTI_DOCUMENT = r"(?i)\b(?:cited paper|reference \[|prior work|other paper|second paper|bibliograph)\w*"
REASONING = r"(?i)\b(?:how|why|compare|comparison|differ|difference|reason|rationale|explain|implication)\b"
NATIVE_CITATION = r"【[^】\r\n]*†[^】\r\n]*】"
DOI = r"(?i)(?:https?://(?:dx\.)?doi\.org/|doi\s*:\s*)?(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"
ARXIV = r"(?i)(?:arXiv\s*:\s*|arxiv\.org/(?:abs|pdf)/)?(\d{4}\.\d{4,5}(?:v\d+)?)"
YEAR = r"((?:19|20)\d{2})"
#: What Python and Unicode count as white space, and what ends a line.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Titles in quotation marks, what attributes a question to one, and question words at its start.
QUOTED = r"['\"‘“]([^'\"’”\n]{2,200})['\"’”]"
ATTRIBUTION = r"""^[^?\n]*?(?:'[^']+'|"[^"]+"|‘[^’]+’|“[^”]+”)\s*,\s*"""
#: Kinds of questions in order: a pattern of the folded question, and what it makes it.
QUESTION_KINDS = (
    (r"\bcompare\b|\bcontrast\b|\bversus\b|\bvs\.?\b|\bdiffer", "comparison"),
    (r"\blimitations?\b|\bfuture work\b|\bimprovements?\b", "limitations_future_work"),
    (r"^why |\b(?:better|advantage|outperform|improv(?:e|es|ed|ement))\b", "causes_evidence"),
    (r"^how\s+(?:much|many|long|fast|often)\b", "direct_fact"),
    (r"^how |\b(?:mechanisms?|work|operate|achieve)\b", "mechanism"),
)
GROUPED_CITATION, MOJIBAKE_CITATION = r"\[(\s*\d+(?:\s*[,;]\s*\d+)*\s*)\]", r"ã€\x90[^\r\n]*?(?:†|â€\xa0)[^\r\n]*?ã€‘"
CLAIM_END = r"(?<=[.!?])\s+|\n+"
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Case-folded text; ß is the only letter for which lower-casing is not enough here."""
    return F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss"))


def squeeze(c: Column | str) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def stripped(c: Column | str) -> Column:
    """No white space of any kind at the ends."""
    return F.regexp_replace(_col(c), f"^[{WHITE}]+|[{WHITE}]+$", "")


def squeezed(c: Column | str) -> Column:
    """White space of any kind collapsed to single spaces, none at the ends."""
    return F.btrim(F.regexp_replace(_col(c), f"[{WHITE}]+", " "), F.lit(" "))


def quoted_titles(c: Column | str) -> Column:
    """Titles in quotation marks: (start, end, title) in the folded question, in the order of the question, longest first."""
    text = _col(c)
    low = fold(squeezed(text))
    names = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(QUOTED), F.lit(1)), lambda x: F.btrim(squeezed(x), F.lit(" ,;:.")))
    spots = F.transform(F.filter(F.array_distinct(names), lambda x: x != ""), lambda x: F.struct(F.instr(low, fold(x)).alias("start"), F.negative(F.length(fold(x))).alias("size"), x.alias("title")))
    return F.array_sort(F.filter(spots, lambda x: x["start"] > 0))


def is_multi_paper(c: Column | str) -> Column:
    """Whether a question names two papers or more in quotation marks: two titles that stand apart."""
    spots = quoted_titles(c)
    first = F.try_element_at(spots, F.lit(1))
    return F.coalesce(F.exists(spots, lambda x: x["start"] >= first["start"] - first["size"]), F.lit(False))


def technical_tokens(c: Column | str) -> Column:
    """Tokens that keep inner ``._#-`` and a trailing ``++``; null text has none."""
    return F.regexp_extract_all(fold(F.coalesce(_col(c), F.lit(""))), F.lit(TECHNICAL_TOKEN), F.lit(0))


def word_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(_col(c), F.lit(""))), F.lit(WORD_TOKEN), F.lit(0))


def content_tokens(c: Column | str) -> Column:
    """Distinct ASCII tokens of two characters or more that are no stop words, in order of occurrence."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(CONTENT_TOKEN), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS)))


def span_count(c: Column | str) -> Column:
    return F.regexp_count(F.coalesce(_col(c), F.lit("")), F.lit(SPAN_TOKEN)).cast("int")


def overlap(a: Column, b: Column) -> Column:
    """Share of a's members in b; 0 if a has none."""
    n = F.size(a)
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))


def slug(c: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(_col(c).cast("string"), F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))


def section_family(c: Column | str) -> Column:
    name, out = slug(c), F.lit("other")
    for family, members in SECTION_FAMILIES.items():
        out = F.when(name.isin(*members), F.lit(family)).otherwise(out)
    return out


def year_of(c: Column | str) -> Column:
    return F.expr("nullif(1, 1)").cast("int") if c is None else F.nullif(F.regexp_extract(_col(c).cast("string"), YEAR, 1), F.lit("")).cast("int")


def string_list(c: Column | str) -> Column:
    """Comma- or semicolon-separated values, stripped, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def phrase(c: Column | str) -> Column:
    """Words only, case-folded, single-spaced."""
    return F.trim(F.regexp_replace(fold(F.coalesce(_col(c), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def finite(c: Column | str) -> Column:
    """The number, or null if it is NaN or infinite."""
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def citation_numbers(c: Column | str) -> Column:
    """Numbers in brackets, singly or in groups, in the order of the text."""
    groups = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(GROUPED_CITATION), F.lit(1))
    return F.transform(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"\d+"), F.lit(0)))), lambda x: x.cast("int"))


def native_citations(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(f"{NATIVE_CITATION}|{MOJIBAKE_CITATION}"), F.lit(0)))


def claims(c: Column | str) -> Column:
    """Sentences and lines, untrimmed; a claim's number counts blank ones too."""
    return F.split(F.coalesce(_col(c), F.lit("")), CLAIM_END)


def expanded_query(c: Column | str, expansions: dict[str, tuple[str, ...]] = EXPANSIONS) -> Column:
    """The query with the expansions of its terms that it doesn't hold yet."""
    text = squeeze(c)
    low, extra = fold(text), []
    for term, words in expansions.items():
        hit = low.rlike(rf"(?<![\p{{L}}\p{{N}}_]){term}(?![\p{{L}}\p{{N}}_])")
        extra += [F.when(hit & ~low.contains(w.lower()), F.lit(w)) for w in words]
    return F.array_join(F.concat(F.array(text), F.array_distinct(F.filter(F.array(*extra), lambda x: x.isNotNull()))), " ")


def checked_expansions(values: Mapping[str, str | Sequence[str]]) -> dict[str, tuple[str, ...]]:
    """Expansions in the form that expanded_query takes; blank terms, blank words and other types are errors."""
    if not isinstance(values, Mapping):
        raise TypeError("expansions must be a mapping")
    out = {}
    for term, given in values.items():
        if not isinstance(term, str) or not term.strip():
            raise ValueError("terms must be non-blank strings")
        words = (given,) if isinstance(given, str) else given
        if not isinstance(words, Sequence) or isinstance(words, (bytes, bytearray)):
            raise TypeError(f"the expansions of {term!r} must be a string or a sequence")
        if not words or not all(isinstance(w, str) and w.strip() for w in words):
            raise ValueError(f"the expansions of {term!r} must be non-blank strings")
        out[term.strip()] = tuple(w.strip() for w in words)
    return out


def tokenizer_of(config: Mapping[str, object] | None = None) -> Callable[[Column | str], Column]:
    """The tokenizer that an index was built with; unknown ones and the removal of stop words are errors."""
    given = {"tokenizer": "technical_terms_v2", "lowercase": True, "stop_words_removed": False} | dict(config or {})
    known = {"technical_terms_v2": technical_tokens, "word_v1": word_tokens}
    if given["tokenizer"] not in known:
        raise ValueError(f"unknown tokenizer {given['tokenizer']!r}; known: {sorted(known)}")
    if not all(isinstance(given[k], bool) for k in ("lowercase", "stop_words_removed")):
        raise ValueError("lowercase and stop_words_removed must be booleans")
    if given["stop_words_removed"]:
        raise ValueError("stop words are never removed from an index")
    return known[given["tokenizer"]]


def evidence_queries(c: Column | str, suffixes: tuple[str, ...] = EVIDENCE_SUFFIXES) -> Column:
    """The question, and its base (its first sentence, if long) with each facet's suffix."""
    text = squeeze(c)
    base = F.when(F.size(F.split(text, " ")) >= 16, F.element_at(F.split(text, r"(?<=[.!?])\s+"), 1)).otherwise(text)
    return F.array(text, *[F.concat_ws(" ", base, F.lit(s)) for s in suffixes])


def without_attribution(c: Column | str) -> Column:
    """A question without a leading clause that says which quoted paper it is about."""
    text = stripped(c)
    return F.when(text.rlike(rf"(?i)^(?:{QUESTION_STEMS})\b"), text).otherwise(F.regexp_replace(text, ATTRIBUTION, ""))


def question_type(c: Column | str) -> Column:
    """comparison, limitations_future_work, causes_evidence, direct_fact or mechanism; the first rule that fits."""
    q = fold(squeezed(without_attribution(c)))
    out = F.lit("direct_fact")
    for pattern, kind in reversed(QUESTION_KINDS):
        out = F.when(q.rlike(pattern), kind).otherwise(out)
    return F.when(is_multi_paper(c), QUESTION_KINDS[0][1]).otherwise(out)


def marked_parts(c: Column | str) -> Column:
    """The parts of a question that end in question marks; the whole question if there is one part."""
    text = squeeze(c)
    parts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^?]+\?"), F.lit(0)), lambda p: F.btrim(p, F.lit(" ,;?"))), lambda p: p != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(F.btrim(text, F.lit("?"))))


def question_parts(c: Column | str) -> Column:
    """Marked parts; else the two sides of the first "and" or "as well as" that both hold a question word; else the whole.

    A question that names several papers is one.
    """
    marked = marked_parts(c)
    text = squeeze(c)
    pattern = rf"(?i)^(.*?\b(?:{QUESTION_STEMS})\b.*?)\s+(?:and|as well as)\s+(.*\b(?:{QUESTION_STEMS})\b.*)$"
    sides = F.array(*[F.btrim(F.regexp_extract(text, pattern, k), F.lit(" ,;?")) for k in (1, 2)])
    return F.when((F.size(marked) == 1) & ~is_multi_paper(c) & text.rlike(pattern) & ~F.exists(sides, lambda x: x == ""), sides).otherwise(marked)


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    """NFC, for which there is no built-in function."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t) if isinstance(t, str) else None)


def normalised_query(c: Column | str) -> Column:
    """A query in NFC, without control characters, its white space collapsed; null if nothing is left.

    Only texts that are not ASCII, a part of all, leave the JVM to be composed.
    """
    text = _col(c)
    whole = F.when(text.rlike(r"[^\x00-\x7f]"), _composed(F.when(text.rlike(r"[^\x00-\x7f]"), text))).otherwise(text)
    kept = F.regexp_replace(F.regexp_replace(whole, r"[\r\n\t]", " "), r"\p{C}", "")
    return F.nullif(squeezed(kept), F.lit(""))


def paper_version(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(F.lower(F.regexp_replace(_col(c), r"(?i)\.pdf$", "")), r"(v\d+)$", 1), F.lit(""))


def canonical_id(c: Column | str) -> Column:
    """A paper's identity without URL, label, file suffix and version; null if nothing is left."""
    text = F.trim(F.coalesce(_col(c), F.lit("")))
    is_url = text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")
    path = F.btrim(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1), F.lit("/"))
    from_url = F.when(path.rlike("(?i)^(?:abs|pdf)/"), F.regexp_replace(path, "(?i)^(?:abs|pdf)/", "")).otherwise(F.element_at(F.split(path, "/"), -1))
    bare = F.btrim(F.trim(F.element_at(F.split(text, "[#?]"), 1)), F.lit("/"))
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)^arxiv\s*:\s*", ""), "(?i)^(?:abs|pdf)/", "")
    out = F.regexp_replace(F.rtrim(F.when(is_url, from_url).otherwise(bare), F.lit("/")), r"(?i)\.pdf$", "")
    out = F.regexp_replace(F.regexp_replace(F.trim(out), r"(?i)v\d+$", ""), r"[/\\]", "_")
    return F.nullif(F.btrim(F.regexp_replace(out, "[^A-Za-z0-9._-]+", "_"), F.lit("._")), F.lit(""))


def diversity_key(paper: Column | str, title: Column | str, chunk: Column | str) -> Column:
    """A paper's key without its version; a chunk of no paper is its own."""
    raw = F.coalesce(F.nullif(_col(paper), F.lit("")), F.nullif(_col(title), F.lit("")))
    return F.coalesce(F.regexp_replace(fold(squeeze(raw)), r"v\d+$", ""), F.concat(F.lit("chunk:"), _col(chunk).cast("string")))


def run_key(provider: Column, query: Column, n: Column) -> Column:
    parts = F.concat_ws("\0", provider, fold(squeeze(query)), n.cast("string"))
    return F.substring(F.sha2(parts, 256), 1, 24)


def chunk_id(paper: Column, section: Column, start: Column, end: Column, text: Column) -> Column:
    """A version-5 UUID in the URL namespace, byte for byte."""
    name = F.concat_ws(":", F.lit("rag-paper"), paper.cast("string"), section, start.cast("string"), end.cast("string"), text)
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
    )


def is_truncated(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(_col(c))).isin(*TRUNCATION_REASONS), F.lit(False))


def is_absent(c: Column | str) -> Column:
    low = F.lower(F.trim(F.coalesce(_col(c), F.lit(""))))
    return low.startswith("not reported") | low.startswith("not provided") | low.startswith("no evidence retrieved")


def citation_id(doi: Column, arxiv: Column, other: Column) -> Column:
    identity = F.coalesce(F.nullif(doi, F.lit("")), F.nullif(arxiv, F.lit("")), phrase(other))
    return F.substring(F.sha1(identity.cast("binary")), 1, 16)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if either is zero."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))
