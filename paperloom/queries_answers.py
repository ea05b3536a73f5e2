"""Queries over structured answers and generation metrics, each with SQL that follows the rule from the JSON up."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import answers, generation, state, structured
from .queries import fold_sql, overlap_sql, phrase_sql, query, table

# Drafts of a model; @ stands for a number of the row, ~ for a word of it.
NARRATIVES = (
    '{"answer_status":"answered","summary":"","claims":[{"text":"~ beats beta.","citations":[1]},{"text":" Beta is fast ","citations":[2,@,2]}]}',
    '```json\n{"answer_status":" Answered ","summary":"","claims":[{"text":"~","citations":[1, @] [2]}]}\n```',
    '{"answer_status":"answered","summary":"~","claims":[{"text":"","citations":[@]},{"text":"y","citations":[]},"z",{"text":"w","citations":[true]},{"text":"v"}]}',
    '{"answer_status":"insufficient_evidence","summary":" ","claims":[{"text":"~","citations":[@]}]}',
    '{"answer_status":"insufficient_evidence","summary":"Nothing about ~ was found.","claims":[]}',
    "no json at all, @", "[@, 2]", '{"answer_status":"maybe"}', '{"answer_status":"answered","summary":"","claims":[]}',
    '{"answer_status":"answered","claims":{"text":"~"}}',
    '{"answer_status":"answered","summary":"","claims":[{"text":"a","citations":[1]},{"text":"~","citations":["2"]},{"text":"c","citations":[@]},{"text":"d","citations":[1.5]},{"text":"e","citations":[@,1]}]}',
)
LONG_CELL = " ".join(f"w{i}" for i in range(19))
TABLES = (
    '{"items":[{"paper":{"text":"~"},"method":{"text":"uses @ heads","citations":[1]}},{"paper":{"text":"Other"},"method":{"text":"a wholly different design","citations":[2]}}]}',
    '{"answer_status":"answered","summary":"","items":[{"paper":{"text":"~","citations":[]},"method":{"text":"same words","citations":[@]}},{"paper":{"text":"~"},"method":{"text":"Same  words","citations":[1]}}]}',
    '{"items":[{"paper":{"text":"Not reported in the supplied passages."},"method":{"text":"No evidence retrieved for this paper.","citations":[]}},{"paper":"~"}]}',
    f'{{"items":[{{"paper":{{"text":""}},"method":{{"text":"{LONG_CELL}","citations":[@]}}}}, 7]}}',
    '{"answer_status":"insufficient_evidence","items":[]}', '{"answer_status":"insufficient_evidence","summary":"~ is missing","items":[]}', '{"answer_status":"no","items":[{"paper":{"text":"~"},"method":{"text":"m","citations":"1"}}]}',
    '{"items":{"paper":{"text":"~"}}}', "nothing, @", '{"answer_status":"answered","summary":"x","items":[]}',
    '{"items":[{"paper":{"text":"A|B"},"method":{"text":"alpha","citations":[1,2]}},{"paper":{"text":"C"},"method":{"text":"beta gamma","citations":[1]}},{"paper":{"text":"~"},"method":{"text":"quite another thing","citations":[2]}}]}',
)
PICK = "(conv_id * 7 + turn)"


def _rows(spark, sf, drafts):
    """conv_id, turn, and a draft with the row's number and word in it."""
    at = F.col("conv_id") * 7 + F.col("turn")
    picked = F.element_at(F.array(*map(F.lit, drafts)), (at % len(drafts) + 1).cast("int"))
    word = F.concat(F.lit("word"), F.col("conv_id").cast("string"))
    filled = F.replace(F.replace(picked, F.lit("@"), (at % 4).cast("string")), F.lit("~"), word)
    return table(spark, sf, "conversations").select("conv_id", "turn", filled.alias("draft"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _drafts_sql(drafts) -> str:
    """d(conv_id, turn, draft, j): the draft, and its JSON without fence and with merged citations; null if it is none."""
    merged = "draft"
    for _ in range(2):
        merged = rf"""regexp_replace({merged}, '("citations"\s*:\s*)\[([0-9\s,]*)\]\s*\[([0-9\s,]*)\]', '\1[\2, \3]', 'g')"""
    bare = r"regexp_replace(regexp_replace(draft, '^```(?:json)?\s*', ''), '\s*```$', '')"
    listed = ", ".join(map(_sql_text, drafts))
    return (
        f"d0 AS (SELECT conv_id, turn, replace(replace([{listed}][{PICK} % {len(drafts)} + 1], '@', ({PICK} % 4)::VARCHAR), '~', 'word' || conv_id) AS draft FROM conversations), "
        f"d AS (SELECT conv_id, turn, draft, TRY_CAST({merged.replace('draft', bare, 1)} AS JSON) AS j FROM d0)"
    )


def _ints(c: str) -> str:
    return f"json_type({c}) IS DISTINCT FROM 'ARRAY' OR len(list_filter(json_extract({c}, '$[*]'), lambda x: json_type(x) NOT IN ('UBIGINT', 'BIGINT'))) > 0"


F34_SQL = f"""
WITH {_drafts_sql(NARRATIVES)},
s AS (SELECT conv_id, turn, j, json_type(j) AS kind, lower(trim(coalesce(json_extract_string(j, '$.answer_status'), ''))) AS status, trim(coalesce(json_extract_string(j, '$.summary'), '')) AS summary,
      json_type(j, '$.claims') = 'ARRAY' AS listed, CASE WHEN json_type(j, '$.claims') = 'ARRAY' THEN json_array_length(j, '$.claims')::INT ELSE 0 END AS n FROM d),
c AS (SELECT conv_id, turn, i, json_extract(j, '$.claims[' || (i - 1) || ']') AS c FROM (SELECT conv_id, turn, j, unnest(range(1, n + 1)) AS i FROM s WHERE n > 0)),
x AS (SELECT conv_id, turn, i, json_type(c) = 'OBJECT' AS is_object, trim(coalesce(json_extract_string(c, '$.text'), '')) AS t, {_ints("json_extract(c, '$.citations')")} AS bad, json_extract(c, '$.citations[*]') AS raw FROM c),
y AS (SELECT *, CASE WHEN bad THEN [] ELSE list_transform(raw, lambda r: r::INT) END AS nums FROM x),
z AS (SELECT conv_id, turn, i, CASE WHEN NOT is_object THEN ['structured_claim_invalid:' || i] ELSE list_filter([CASE WHEN t = '' THEN 'structured_claim_empty:' || i END, CASE WHEN bad THEN 'structured_citations_invalid:' || i END,
      CASE WHEN t <> '' AND len(nums) = 0 THEN 'structured_claim_uncited:' || i END, CASE WHEN len(list_filter(nums, lambda k: k NOT IN (1, 2))) > 0 THEN 'structured_citation_out_of_range:' || i END], lambda q: q IS NOT NULL) END AS codes FROM y),
g AS (SELECT conv_id, turn, flatten(list(codes ORDER BY i)) AS codes FROM z GROUP BY ALL)
SELECT s.conv_id, s.turn, CASE WHEN j IS NULL THEN ['structured_output_invalid_json'] WHEN kind <> 'OBJECT' THEN ['structured_output_invalid_object'] ELSE list_concat(list_filter([
  CASE WHEN status NOT IN ('answered', 'insufficient_evidence') THEN 'structured_answer_status_invalid' END, CASE WHEN listed IS NOT TRUE THEN 'structured_claims_missing' END, CASE WHEN status = 'answered' AND n = 0 THEN 'structured_answer_empty' END,
  CASE WHEN status = 'answered' AND summary <> '' THEN 'structured_answer_summary_not_empty' END, CASE WHEN n > 4 THEN 'too_many_claims' END, CASE WHEN status = 'insufficient_evidence' AND n > 0 THEN 'structured_abstention_has_claims' END,
  CASE WHEN status = 'insufficient_evidence' AND summary = '' THEN 'structured_abstention_missing_summary' END], lambda q: q IS NOT NULL), coalesce(codes, [])) END AS failures
FROM s LEFT JOIN g USING (conv_id, turn)"""


@query("f34_structured_failures", F34_SQL)
def _(spark, sf):
    known = F.array(F.lit(1), F.lit(2))
    return _rows(spark, sf, NARRATIVES).select("conv_id", "turn", structured.narrative_failures("draft", known).alias("failures"))


@query("f34_narrative_markdown", f"""
WITH {_drafts_sql(NARRATIVES)}, c AS (SELECT conv_id, turn, i, json_extract(j, '$.claims[' || (i - 1) || ']') AS c FROM (SELECT conv_id, turn, j, unnest(range(1, json_array_length(j, '$.claims')::INT + 1)) AS i FROM d WHERE {PICK} % {len(NARRATIVES)} IN (0, 1))),
n AS (SELECT conv_id, turn, i, trim(json_extract_string(c, '$.text')) AS t, list_transform(json_extract(c, '$.citations[*]'), lambda r: r::INT) AS raw FROM c),
u AS (SELECT conv_id, turn, i, t, list_filter(raw, lambda x, k: list_position(raw, x) = k) AS nums FROM n)
SELECT conv_id, turn, string_agg(t || ' ' || array_to_string(list_transform(nums, lambda x: '[' || x || ']'), ''), chr(10) || chr(10) ORDER BY i) AS markdown FROM u GROUP BY ALL
UNION ALL SELECT conv_id, turn, 'Nothing about word' || conv_id || ' was found.' FROM conversations WHERE {PICK} % {len(NARRATIVES)} = 4""")
def _(spark, sf):
    rows = _rows(spark, sf, NARRATIVES).where(f"(conv_id * 7 + turn) % {len(NARRATIVES)} IN (0, 1, 4)")
    return rows.select("conv_id", "turn", structured.narrative_markdown("draft").alias("markdown"))


@query("f33_clean_drafts", rf"""
WITH b AS (SELECT conv_id, turn, '{{"citations": [' || conv_id || '] [' || turn || ', ' || conv_id || ']' || chr(10) || '[7], "b": [1] [2], "citations":[3][]}}' AS t FROM conversations)
SELECT conv_id, turn, '{{"citations": [' || array_to_string(list_filter([conv_id, turn, 7], lambda x, i: list_position([conv_id, turn, 7], x) = i), ', ') || '], "b": [1] [2], "citations":[3]}}' AS draft FROM b""")
def _(spark, sf):
    n, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    text = F.concat(F.lit('```JSON\n{"citations": ['), n, F.lit("] ["), t, F.lit(", "), n, F.lit(']\n[7], "b": [1] [2], "citations":[3][]}\n``` '))
    return table(spark, sf, "conversations").select("conv_id", "turn", structured.draft(text).alias("draft"))


def _cell_sql(field: str) -> str:
    c = f"json_extract(c, '$.{field}')"
    cited = f"coalesce(json_extract({c}, '$.citations'), '[]'::JSON)"
    absent = "(starts_with(lower(t_{0}), 'not reported') OR starts_with(lower(t_{0}), 'not provided') OR starts_with(lower(t_{0}), 'no evidence retrieved'))".format(field)
    return f"""x_{field} AS (SELECT *, json_type({c}) IS NOT DISTINCT FROM 'OBJECT' AS o_{field}, trim(coalesce(json_extract_string({c}, '$.text'), '')) AS t_{field}, {_ints(cited)} AS bad_{field}, json_extract({cited}, '$[*]') AS raw_{field} FROM {{source}}),
y_{field} AS (SELECT *, o_{field} AND t_{field} <> '' AND NOT {absent} AS says_{field}, CASE WHEN bad_{field} THEN [] ELSE list_transform(raw_{field}, lambda r: r::INT) END AS nums_{field} FROM x_{field}),
z_{field} AS (SELECT *, CASE WHEN NOT o_{field} THEN ['structured_field_missing:' || i || ':{field}'] ELSE list_filter([CASE WHEN t_{field} = '' THEN 'structured_field_empty:' || i || ':{field}' END,
  CASE WHEN len(regexp_extract_all(t_{field}, '[\\w''-]+')) > 18 THEN 'structured_field_too_long:' || i || ':{field}' END, CASE WHEN bad_{field} THEN 'structured_citations_invalid:' || i || ':{field}' END,
  CASE WHEN len(list_filter(nums_{field}, lambda k: k NOT IN (1, 2))) > 0 THEN 'structured_citation_out_of_range:' || i || ':{field}' END,
  CASE WHEN says_{field} AND len(nums_{field}) = 0 AND '{field}' <> 'paper' THEN 'structured_field_uncited:' || i || ':{field}' END], lambda q: q IS NOT NULL) END AS codes_{field} FROM y_{field})"""


F35_SQL = f"""
WITH {_drafts_sql(TABLES)},
s AS (SELECT conv_id, turn, j, json_type(j, '$.items') = 'ARRAY' AS listed, lower(trim(coalesce(json_extract_string(j, '$.answer_status'), 'answered'))) AS status, trim(coalesce(json_extract_string(j, '$.summary'), '')) AS summary,
      CASE WHEN json_type(j, '$.items') = 'ARRAY' THEN json_array_length(j, '$.items')::INT ELSE 0 END AS n FROM d),
c AS (SELECT conv_id, turn, i, json_extract(j, '$.items[' || (i - 1) || ']') AS c FROM (SELECT conv_id, turn, j, unnest(range(1, n + 1)) AS i FROM s WHERE n > 0)),
{_cell_sql('paper').format(source='c')}, {_cell_sql('method').format(source='z_paper')},
r AS (SELECT conv_id, turn, i, json_type(c) = 'OBJECT' AS o, CASE WHEN json_type(c) <> 'OBJECT' THEN ['structured_item_invalid:' || i] ELSE list_concat(codes_paper, list_concat(codes_method, CASE WHEN says_paper OR says_method THEN [] ELSE ['structured_item_empty:' || i] END)) END AS codes,
      trim(CASE WHEN says_paper THEN array_to_string(regexp_extract_all(lower(t_paper), '\\w+'), ' ') ELSE '' END || ' ' || CASE WHEN says_method THEN array_to_string(regexp_extract_all(lower(t_method), '\\w+'), ' ') ELSE '' END) AS sig FROM z_method),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS p FROM r WHERE o),
p AS (SELECT a.conv_id, a.turn, list('structured_items_duplicate:' || a.p || ':' || b.p ORDER BY a.p, b.p) AS dup FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.p < b.p AND a.sig = b.sig AND a.sig <> '' GROUP BY ALL),
g AS (SELECT conv_id, turn, flatten(list(codes ORDER BY i)) AS codes FROM r GROUP BY ALL)
SELECT s.conv_id, s.turn, CASE WHEN j IS NULL THEN ['structured_output_invalid_json'] WHEN listed IS NOT TRUE THEN ['structured_output_missing_items'] ELSE list_concat(list_filter([
  CASE WHEN status NOT IN ('answered', 'insufficient_evidence') THEN 'structured_answer_status_invalid' END, CASE WHEN status = 'answered' AND n = 0 THEN 'structured_answer_empty' END, CASE WHEN status = 'answered' AND summary <> '' THEN 'structured_answer_summary_not_empty' END,
  CASE WHEN status = 'insufficient_evidence' AND n > 0 THEN 'structured_abstention_has_items' END, CASE WHEN status = 'insufficient_evidence' AND summary = '' THEN 'structured_abstention_missing_summary' END,
  CASE WHEN n > 2 THEN 'too_many_items' END, CASE WHEN n <> 2 THEN 'wrong_item_count' END], lambda q: q IS NOT NULL), list_concat(coalesce(codes, []), coalesce(dup, []))) END AS failures
FROM s LEFT JOIN g USING (conv_id, turn) LEFT JOIN p USING (conv_id, turn)"""


@query("f35_table_failures", F35_SQL)
def _(spark, sf):
    known = F.array(F.lit(1), F.lit(2))
    return _rows(spark, sf, TABLES).select("conv_id", "turn", structured.table_failures("draft", ["paper", "method"], known, most=2, exact=True).alias("failures"))


@query("f35_table_markdown", f"""
SELECT conv_id, turn, '| paper | the method |' || chr(10) || '| --- | --- |' || chr(10) || '| A\\|B' || conv_id || ' | alpha ' || turn || ' [2][1] |' || chr(10) || '| C |  |' AS markdown FROM conversations""")
def _(spark, sf):
    text = F.concat(F.lit('{"items":[{"paper":{"text":"A|B'), F.col("conv_id").cast("string"), F.lit('"},"the_method":{"text":" alpha\\n'), F.col("turn").cast("string"), F.lit('","citations":[2,1,2]}},{"the_method":{"text":""},"paper":{"text":"C"}}]}'))
    return table(spark, sf, "conversations").select("conv_id", "turn", structured.table_markdown(text, ["paper", "the_method"]).alias("markdown"))


def _structured_input(spark, sf):
    """Answers of five kinds: claims, items, neither, plain prose, a Markdown table."""
    n, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    claims = F.concat(F.lit('{"claims":[{"text":" Gain of '), n, F.lit(' points ","citations":['), t, F.lit(',2]},"odd",{"text":""},{"text":"Done!"}]}'))
    items = F.concat(F.lit('{"items":[{"z_method":{"text":"m'), n, F.lit('.","citations":['), t, F.lit(']},"a":{"text":"Not  reported here"},"b":"x"},{"k":{"text":""}},{"new_field":{"text":"Value '), t, F.lit('"}}]}'))
    plain = F.concat(F.lit("First [1, "), t, F.lit("] claim .  Second one [2]!\n\nThird"), n)
    grid = F.concat(F.lit("| the_name | value |\n|:--|--:|\n| n"), n, F.lit(" | v. |\n| other | not reported |\n| not provided | Not reported |"))
    kind = F.col("conv_id") % 5
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(kind == 0, claims).when(kind == 1, items).when(kind == 2, F.lit('{"other": 1}')).alias("structured"), F.when(kind == 4, grid).otherwise(plain).alias("answer")
    )


@query("f25_cited_claims", """
WITH b AS (SELECT conv_id, turn, conv_id % 5 AS k FROM conversations)
SELECT conv_id, turn, unnest([{'c': 'claim-1', 't': 'Gain of ' || conv_id || ' points', 'n': [turn, 2]}, {'c': 'claim-4', 't': 'Done!', 'n': []::BIGINT[]}], recursive := true) FROM b WHERE k = 0
UNION ALL SELECT conv_id, turn, unnest([{'c': 'claim-1:z_method', 't': 'm' || conv_id || '.', 'n': [turn]}, {'c': 'claim-3:new_field', 't': 'Value ' || turn, 'n': []::BIGINT[]}], recursive := true) FROM b WHERE k = 1
UNION ALL SELECT conv_id, turn, unnest([{'c': 'claim-1', 't': 'First  claim', 'n': [1, turn]}, {'c': 'claim-2', 't': 'Second one!', 'n': [2]}, {'c': 'claim-3', 't': 'Third' || conv_id, 'n': []::BIGINT[]}], recursive := true) FROM b WHERE k IN (2, 3)""")
def _(spark, sf):
    rows = _structured_input(spark, sf).where("conv_id % 5 < 4")
    found = rows.select("conv_id", "turn", F.explode(structured.cited_claims("structured", "answer")).alias("x"))
    return found.select("conv_id", "turn", F.col("x.claim_id").alias("c"), F.col("x.text").alias("t"), F.col("x.citations").cast("array<bigint>").alias("n"))


@query("f39_prose", """
SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'Gain of ' || conv_id || ' points. Done!' WHEN 1 THEN 'Contribution 1. Z method: m' || conv_id || '.' || chr(10) || chr(10) || 'Contribution 3. New field: Value ' || turn || '.'
  WHEN 4 THEN 'Contribution 1. The name: n' || conv_id || '. Value: v.' || chr(10) || chr(10) || 'Contribution 2. The name: other.' ELSE 'First [1, ' || turn || '] claim .  Second one [2]!' || chr(10) || chr(10) || 'Third' || conv_id END AS prose FROM conversations""")
def _(spark, sf):
    return _structured_input(spark, sf).select("conv_id", "turn", structured.prose("structured", "answer").alias("prose"))


@query("f36_response_failures", """
WITH b AS (SELECT conv_id, turn, conv_id % 5 AS k FROM conversations)
SELECT conv_id, turn, list_filter([CASE WHEN turn % 3 = 0 THEN 'truncated' END, CASE WHEN k = 4 THEN 'missing_citation' END, CASE WHEN k < 4 AND turn NOT IN (1, 2) THEN 'citation_out_of_range' END,
  CASE WHEN k <> 1 THEN 'missing_required_field:New Field' END, CASE WHEN k <> 4 THEN 'missing_required_field:value' END, CASE WHEN k IN (1) THEN 'incomplete_table' END, CASE WHEN k IN (1, 4) THEN 'too_many_items' END], lambda q: q IS NOT NULL) AS failures FROM b""")
def _(spark, sf):
    rows = _structured_input(spark, sf)
    # An item of one field makes the items' common fields those of the last one only.
    items = F.regexp_replace("structured", r'^\{"items":\[\{.*?\},\{"k":\{"text":""\}\},', '{"items":[{"new_field":{"text":"y"}},{"new_field":{"text":"x"},"k":{"text":"z"}},')
    finish = F.when(F.col("turn") % 3 == 0, F.lit(" Length ")).otherwise(F.lit("stop"))
    codes = structured.response_failures("answer", finish, items, F.array(F.lit(1), F.lit(2)), required=("New Field", "value", "value"), most=2)
    return rows.select("conv_id", "turn", codes.alias("failures"))


@query("f36_present_fields", """
SELECT conv_id, turn, list_sort(CASE conv_id % 5 WHEN 0 THEN ['claims'] WHEN 1 THEN ['items'] WHEN 2 THEN ['other'] WHEN 3 THEN []::VARCHAR[] ELSE ['the_name', 'value'] END) AS fields, conv_id % 5 = 1 AS incomplete,
  CASE conv_id % 5 WHEN 1 THEN 3 WHEN 4 THEN 3 END::INT AS n_items FROM conversations""")
def _(spark, sf):
    rows = _structured_input(spark, sf)
    names, incomplete = structured.present_fields("answer", F.col("structured"))
    return rows.select("conv_id", "turn", names.alias("fields"), incomplete.alias("incomplete"), structured.item_count("answer", F.col("structured")).alias("n_items"))


@query("f41_recovered_json", """
SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN '[{"s": "a' || conv_id || '", "v": 1}]' WHEN 1 THEN '[{"s": "b", "v": ' || turn || '}]' WHEN 2 THEN '[{"s": "c", "v": 2}]' END AS value FROM conversations""")
def _(spark, sf):
    n, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    kinds = [
        F.concat(F.lit('Sure {bad} [1, 2] here: {"analysis": {"list": [{"v": 1, "s": "a'), n, F.lit('"}]}} and [{"s": "late", "v": 9}]')), F.concat(F.lit('```json\n{"s": "b", "v": '), t, F.lit("}\n```")),
        F.lit('[{"x": 1}] then {"statements": [{"s": "c", "v": 2}]}'), F.lit("nothing [ here"),
    ]
    text = F.element_at(F.array(*kinds), (F.col("conv_id") % 4 + 1).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", structured.recovered(text, "array", ("s", "v")).alias("value"))


# ---- judges and metrics ---------------------------------------------------


@query("p28_adjudication", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id % 100) / 100.0::DOUBLE END AS c, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id * 3 % 100) / 100.0::DOUBLE END AS r, (event_id * 7 % 100) / 100.0::DOUBLE AS a, (event_id * 11 % 100) / 100.0::DOUBLE AS s FROM events),
x AS (SELECT *, list_filter([CASE WHEN c < 0.75 THEN 'correctness_below_threshold' END, CASE WHEN r >= 0.8 AND c < 0.75 THEN 'high_concept_recall_low_correctness' END, CASE WHEN abs(c - a) >= 0.4::DOUBLE THEN 'correctness_relevancy_disagreement' END], lambda q: q IS NOT NULL) AS trigger_reasons FROM e)
SELECT event_id, trigger_reasons, len(trigger_reasons) > 0 AS triggered, CASE WHEN len(trigger_reasons) > 0 THEN s END AS secondary_correctness, coalesce(len(trigger_reasons) > 0 AND abs(c - s) >= 0.2::DOUBLE, false) AS disagreement FROM x""")
def _(spark, sf):
    at = lambda k: (F.col("event_id") * k % 100) / 100.0
    cases = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 13 != 0, at(1)).alias("correctness"), F.when(F.col("event_id") % 11 != 0, at(3)).alias("concept_recall"), at(7).alias("answer_relevancy"), at(11).alias("_second")
    )
    return state.adjudicate(cases, "writer", "judge", "referee", F.col("_second")).select("event_id", "trigger_reasons", "triggered", "secondary_correctness", "disagreement")


@query("a16_concept_recall", f"""
WITH r AS (SELECT conv_id * 1000 + turn AS answer_id, turn, {phrase_sql('text')} AS said FROM conversations), w AS (SELECT *, string_split(said, ' ') AS w FROM r),
q AS (SELECT answer_id, said, unnest([{{'pos': 1, 'c': 'QQQ-zzz', 'a': [coalesce(w[1], ''), 'nowhere']}}, {{'pos': 2, 'c': coalesce(w[2], 'x') || ' !', 'a': ['x']}}, {{'pos': 3, 'c': 'qqq  ZZZ', 'a': [said]}}, {{'pos': 4, 'c': ' - ', 'a': ['e']}}, {{'pos': 5, 'c': 'neverthere', 'a': ['norhere']}}], recursive := true) FROM w WHERE turn % 4 <> 3),
n AS (SELECT answer_id, pos, said, c, {phrase_sql('c')} AS p, a FROM q), k AS (SELECT *, row_number() OVER (PARTITION BY answer_id, p ORDER BY pos) AS n FROM n WHERE p <> ''),
m AS (SELECT answer_id, count(*) FILTER (contains(said, p) OR len(list_filter(a, lambda x: contains(said, trim(regexp_replace({fold_sql('x')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))))) > 0) AS found, count(*) AS required FROM k WHERE n = 1 GROUP BY answer_id)
SELECT answer_id, coalesce(found, 0) AS found, coalesce(required, 0) AS required, CASE WHEN required > 0 THEN round(found / required::DOUBLE, 6) END AS recall FROM r LEFT JOIN m USING (answer_id)""")
def _(spark, sf):
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "turn", "text")
    words = F.split(T.phrase("text"), " ")
    word = lambda k, other: F.coalesce(F.try_element_at(words, F.lit(k)), F.lit(other))
    needs = [
        (1, F.lit("QQQ-zzz"), F.array(word(1, ""), F.lit("nowhere"))), (2, F.concat(word(2, "x"), F.lit(" !")), F.array(F.lit("x"))), (3, F.lit("qqq  ZZZ"), F.array(T.phrase("text"))),
        (4, F.lit(" - "), F.array(F.lit("e"))), (5, F.lit("neverthere"), F.array(F.lit("norhere"))),
    ]
    required = rows.where("turn % 4 <> 3").select("answer_id", F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), c.alias("concept"), a.alias("aliases")) for p, c, a in needs])).alias("x")).select("answer_id", "x.*")
    return answers.concept_recall(rows, required, "answer_id")


ITEM_SETS_SQL = """s AS (SELECT event_id, list_transform(range(event_id % 4), lambda i: ' Item  ' || ((event_id + i) % 5)) AS p, list_transform(range(event_id % 3), lambda i: 'item ' || ((event_id * 2 + i) % 5)) AS e FROM events),
n AS (SELECT event_id, list_distinct(list_transform(p, lambda x: lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))))) AS p, list_distinct(list_transform(e, lambda x: lower(x))) AS e FROM s)"""


def _item_sets(spark, sf):
    i = F.col("event_id")
    predicted = F.transform(F.when(i % 4 > 0, F.sequence(F.lit(0).cast("long"), i % 4 - 1)).otherwise(F.array().cast("array<bigint>")), lambda k: F.concat(F.lit(" Item  "), (i + k) % 5))
    expected = F.transform(F.when(i % 3 > 0, F.sequence(F.lit(0).cast("long"), i % 3 - 1)).otherwise(F.array().cast("array<bigint>")), lambda k: F.concat(F.lit("item "), (i * 2 + k) % 5))
    return table(spark, sf, "events").select("event_id", predicted.alias("predicted"), expected.alias("expected"))


@query("a16_item_metrics", f"""
WITH {ITEM_SETS_SQL} SELECT event_id, CASE WHEN len(e) > 0 THEN CASE WHEN len(p) > 0 THEN round(len(list_intersect(p, e)) / len(p)::DOUBLE, 6) ELSE 0 END END AS item_precision, CASE WHEN len(e) > 0 THEN round(len(list_intersect(p, e)) / len(e)::DOUBLE, 6) END AS item_recall,
  CASE WHEN len(e) > 0 THEN round(len(list_intersect(p, e)) / len(e)::DOUBLE, 6) ELSE 1 END AS completeness, CASE WHEN event_id % 5 > 0 AND len(e) > 0 THEN CASE WHEN len(p) > 0 THEN round(len(list_intersect(p, e)) / len(p)::DOUBLE, 6) ELSE 0 END END AS context_precision,
  CASE WHEN event_id % 5 > 0 AND len(e) > 0 THEN round(len(list_intersect(p, e)) / len(e)::DOUBLE, 6) END AS context_recall FROM n""")
def _(spark, sf):
    rows, reviewed = _item_sets(spark, sf), F.col("event_id") % 5 > 0
    p, e = F.col("predicted"), F.col("expected")
    low = lambda a: F.transform(a, lambda x: F.lower(T.squeeze(x)))
    made = {
        "item_precision": generation.item_precision(p, e), "item_recall": generation.item_recall(p, e), "completeness": generation.completeness(p, e),
        "context_precision": generation.context_precision(low(p), low(e), reviewed), "context_recall": generation.context_recall(low(p), low(e), reviewed),
    }
    return rows.select("event_id", *[F.round(c, 6).alias(name) for name, c in made.items()])


RUNS_SQL = """runs AS (SELECT event_id, event_type, event_id % 3 > 0 AS citation_valid, (event_id % 10) / 10.0::DOUBLE AS claim_citation_coverage, (event_id % 7) / 7.0::DOUBLE AS required_field_completeness, CASE WHEN event_id % 4 > 0 THEN (event_id % 9) / 9.0::DOUBLE END AS concept_recall,
  CASE event_id % 6 WHEN 0 THEN 'LENGTH' WHEN 1 THEN NULL ELSE 'stop' END AS finish_reason, event_id % 2 AS retry_count, event_id % 5 > 0 AS max_item_compliant, value AS latency_ms, CASE WHEN event_id % 8 > 0 THEN value / 1000 END AS estimated_cost,
  ['supported', 'partially_supported', ' Unsupported', 'unavailable'][event_id % 4 + 1] AS claim_verdict, ['supported', 'unsupported'][event_id % 2 + 1] AS item_verdict, CASE WHEN event_id % 5 = 0 THEN 'unjudged' ELSE 'judged' END AS judge_status FROM events)"""


@query("a15_generation_aggregate", f"""
WITH {RUNS_SQL} SELECT event_type, count(*) AS questions, round(avg(citation_valid::INT), 6) AS citation_validity_rate, round(avg(claim_citation_coverage), 6) AS claim_level_citation_coverage, round(avg(required_field_completeness), 6) AS required_field_completeness,
  round(avg(concept_recall), 6) AS concept_recall, round(avg((coalesce(lower(finish_reason), '') IN ('length', 'max_tokens', 'max_output_tokens', 'model_length'))::INT), 6) AS truncation_rate, round(avg((retry_count > 0)::INT), 6) AS retry_rate, round(avg(max_item_compliant::INT), 6) AS max_item_compliance_rate,
  NULL::DOUBLE AS qualifying_item_precision, NULL::DOUBLE AS qualifying_item_recall,
  round(count(*) FILTER (lower(trim(claim_verdict)) = 'unsupported') / nullif(count(*) FILTER (lower(trim(claim_verdict)) IN ('supported', 'partially_supported', 'unsupported')), 0)::DOUBLE, 6) AS unsupported_claim_rate,
  round(avg((item_verdict = 'unsupported')::INT), 6) AS incorrect_classification_rate, count(*) FILTER (item_verdict = 'unsupported') AS unsupported_qualifying_items, round(avg((claim_verdict = 'supported')::INT), 6) AS grounded_claim_rate,
  round(avg((judge_status = 'judged')::INT), 6) AS judge_coverage, NULL::DOUBLE AS calibration_exact_agreement, round(avg(latency_ms), 6) AS avg_latency_ms, round(avg(estimated_cost), 6) AS avg_cost, NULL::DOUBLE AS direct_context_precision, NULL::DOUBLE AS direct_context_recall FROM runs GROUP BY event_type""")
def _(spark, sf):
    i, none = F.col("event_id"), F.lit(None).cast("double")
    verdict = lambda check, v: F.struct(F.lit(check).alias("check"), v.alias("verdict"))
    claim = F.element_at(F.array(*map(F.lit, ("supported", "partially_supported", " Unsupported", "unavailable"))), (i % 4 + 1).cast("int"))
    item = F.when(i % 2 == 0, F.lit("supported")).otherwise(F.lit("unsupported"))
    runs = table(spark, sf, "events").select(
        "event_type", (i % 3 > 0).alias("citation_valid"), ((i % 10) / 10.0).alias("claim_citation_coverage"), ((i % 7) / 7.0).alias("required_field_completeness"), F.when(i % 4 > 0, (i % 9) / 9.0).alias("concept_recall"),
        F.when(i % 6 == 0, "LENGTH").when(i % 6 > 1, "stop").alias("finish_reason"), (i % 2).alias("retry_count"), (i % 5 > 0).alias("max_item_compliant"), none.alias("qualifying_item_precision"), none.alias("qualifying_item_recall"),
        F.array(verdict("claim_support", claim), verdict("item_qualification", item)).alias("judge_verdicts"), F.when(i % 5 == 0, "unjudged").otherwise("judged").alias("judge_status"), none.alias("calibration_exact_agreement"),
        F.col("value").alias("latency_ms"), F.when(i % 8 > 0, F.col("value") / 1000).alias("estimated_cost"), none.alias("direct_context_precision"), none.alias("direct_context_recall"),
    )
    return generation.aggregate(runs, by=["event_type"])


@query("a23_dataset_coverage", "SELECT user_id % 10 AS part, count(*) AS total, count(*) FILTER (event_id % 3 = 0) AS reviewed, count(*) FILTER (event_id % 3 <> 0) AS unreviewed, count(*) FILTER (event_id % 4 > 1) AS with_reference_answer, count(*) FILTER (event_id % 4 <= 1) AS without_reference_answer, 0::BIGINT AS evaluated FROM events GROUP BY 1")
def _(spark, sf):
    i = F.col("event_id")
    rows = table(spark, sf, "events").select((F.col("user_id") % 10).alias("part"), (i % 3 == 0).alias("reviewed"), F.when(i % 4 > 1, "text").when(i % 4 == 1, " ").alias("reference_answer"))
    return generation.dataset_coverage(rows, by=["part"])


@query("d15_support_flags", f"""
WITH b AS (SELECT conv_id, turn, text, list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9]+(?:[._+#-][A-Za-z0-9]+)*')), lambda t: length(t) > 1 AND t NOT IN ({", ".join(f"'{w}'" for w in T.STOP_WORDS)})) AS q FROM conversations),
s AS (SELECT *, {overlap_sql("list_slice(q, 1, 2)", "list_slice(q, 2, 1000)")} AS share FROM b)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'unknown_citation' WHEN 1 THEN 'missing_citation' ELSE CASE WHEN share >= 0.2 AND share > 0 THEN 'supported' ELSE 'unsupported' END END AS status, CASE WHEN turn % 4 > 1 THEN round(share, 4) END AS score FROM s""")
def _(spark, sf):
    q = T.content_tokens("text")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", q.alias("q"))
    cited = F.when(F.col("turn") % 4 == 0, F.array(F.lit(1), F.lit(9))).when(F.col("turn") % 4 == 1, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    claims = rows.select("conv_id", "turn", F.lit("claim-1").alias("claim_id"), F.array_join(F.slice("q", 1, 2), " ").alias("claim"), cited.alias("citations"))
    evidence = rows.select("conv_id", "turn", F.lit(1).alias("n"), F.slice("q", 2, 1000).alias("tokens"))
    return answers.support_flags(claims, evidence, ["conv_id", "turn"]).select("conv_id", "turn", "status", "score")
