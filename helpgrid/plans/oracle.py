"""SQL that states the registered queries independently, for DuckDB over the same tables."""

from __future__ import annotations

from helpgrid.functions.text import english_stop_words
from helpgrid.operators import evaluate as E
from helpgrid.operators import prompts as P
from helpgrid.plans.queries import BATCH_SIZE, SEED, SWEEP_ALPHAS, SWEEP_K, TOP_K


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STOP = ", ".join(quoted(word) for word in english_stop_words())
BLANKS = r"E' \t\n\r'"

KB = """
kb AS (
  SELECT d.doc_id AS kb_id, CAST(e.label AS VARCHAR) AS category, d.source AS subcategory,
         d.lang AS journey_stage, split_part(d.text, chr(10), 1) AS issue_description,
         CASE WHEN contains(d.text, chr(10))
              THEN substr(d.text, length(split_part(d.text, chr(10), 1)) + 2) END
           AS resolution_steps,
         e.embedding
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id),
corpus AS (
  SELECT kb_id, coalesce(category, '') || ' ' || coalesce(subcategory, '') || ' '
         || coalesce(issue_description, '') || ' ' || coalesce(resolution_steps, '') AS corpus
  FROM kb)"""

LABELLED = """
q AS (
  SELECT b.item_id AS query_id, b.text, e.embedding,
         CAST(e.label AS VARCHAR) AS expected_category, d.source AS expected_subcategory
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id
  LEFT JOIN documents d ON d.doc_id = b.item_id)"""

TURNS = """
turns AS (
  SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user')"""


def tokens(name: str, source: str, key: str, text: str) -> str:
    return f"""
{name}_words AS (
  SELECT {key}, list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                            lambda w: w NOT IN ({STOP})) AS words
  FROM {source}),
{name}_grams AS (
  SELECT {key}, words,
         CASE WHEN len(words) > 1
              THEN list_concat(words, list_transform(
                     list_zip(words[1:len(words)-1], words[2:]), lambda z: z[1] || ' ' || z[2]))
              ELSE words END AS grams
  FROM {name}_words),
{name}_tf AS MATERIALIZED (
  SELECT {key}, term, count(*) AS tf
  FROM (SELECT {key}, unnest(grams) AS term FROM {name}_grams) GROUP BY ALL)"""


DOC = tokens("doc", "corpus", "kb_id", "corpus")

IDF = """
idf AS (
  SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM kb)) / (1.0 + count(*))) + 1.0 AS idf
  FROM doc_tf GROUP BY term),
norms AS (
  SELECT kb_id, sqrt(sum(tf * idf * tf * idf)) AS norm
  FROM doc_tf JOIN idf USING (term) GROUP BY kb_id)"""


def query_terms(source: str = "q") -> str:
    return (
        tokens("query", source, "query_id", "text")
        + """,
query_known AS (
  SELECT query_id, term, tf, idf, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY query_id))
           AS length
  FROM query_tf JOIN idf USING (term)),
cosines AS (
  SELECT k.query_id, d.kb_id,
         round(sum(k.tf * k.idf / k.length * d.tf * k.idf) / any_value(n.norm), 12) AS kw
  FROM query_known k JOIN doc_tf d USING (term) JOIN norms n USING (kb_id)
  GROUP BY k.query_id, d.kb_id)"""
    )


INDEX = KB + "," + DOC + "," + IDF

#: The articles and, as further articles, the user turns of the conversations.
EVERY = f"""{KB},{TURNS},
every AS (
  SELECT kb_id, corpus AS body FROM corpus
  UNION ALL
  SELECT (SELECT max(doc_id) FROM documents) + 1 + query_id, '  ' || coalesce(text, '') || ' '
  FROM turns),{tokens("doc", "every", "kb_id", "body")}"""

UNIT = """
unit_q AS (
  SELECT query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / norm) AS u
  FROM (SELECT query_id, embedding,
               sqrt(list_sum(list_transform(embedding,
                 lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM q)),
unit_kb AS (
  SELECT kb_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / norm) AS u
  FROM (SELECT kb_id, embedding,
               sqrt(list_sum(list_transform(embedding,
                 lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM kb))"""

PAIRS = """
pairs AS (
  SELECT uq.query_id, uk.kb_id, coalesce(c.kw, 0.0) AS kw,
         coalesce(round(list_inner_product(uq.u, uk.u), 12), 0.0) AS sem
  FROM unit_q uq CROSS JOIN unit_kb uk
  LEFT JOIN cosines c ON c.query_id = uq.query_id AND c.kb_id = uk.kb_id),
ranges AS (
  SELECT query_id, min(sem) AS sem_min, max(sem) AS sem_max, min(kw) AS kw_min, max(kw) AS kw_max,
         count(*) FILTER (kw > 0) AS n_matched
  FROM pairs GROUP BY query_id),
scaled AS (
  SELECT p.query_id, p.kb_id,
         CASE WHEN sem_max > sem_min THEN (sem - sem_min) / (sem_max - sem_min) ELSE sem END AS sem,
         CASE WHEN kw_max > kw_min THEN (kw - kw_min) / (kw_max - kw_min) ELSE kw END AS kw
  FROM pairs p JOIN ranges r USING (query_id))"""

SEARCH = "WITH " + INDEX + "," + LABELLED + "," + query_terms() + "," + UNIT + "," + PAIRS


def hits(alpha: float | str, k: int = TOP_K, scores: str = "scaled") -> str:
    return f""",
hits AS (
  SELECT * FROM (
    SELECT query_id, kb_id, sem AS semantic_score, kw AS keyword_score,
           {alpha} * sem + (1 - {alpha}) * kw AS hybrid_score,
           row_number() OVER (PARTITION BY query_id
             ORDER BY round({alpha} * sem + (1 - {alpha}) * kw, 9) DESC, kb_id) AS rank
    FROM {scores})
  WHERE rank <= {k})"""


HYBRID = (
    SEARCH
    + hits(0.5)
    + """,
found AS (
  SELECT h.*, kb.category, kb.subcategory, kb.journey_stage, kb.issue_description,
         kb.resolution_steps
  FROM hits h JOIN kb USING (kb_id))"""
)

ROUNDED = """round(semantic_score, 6) + 0.0 AS semantic_score,
       round(keyword_score, 6) + 0.0 AS keyword_score,
       round(hybrid_score, 6) + 0.0 AS hybrid_score"""

PER_QUERY = (
    HYBRID
    + """,
per_query AS (
  SELECT q.query_id, q.text AS complaint, q.expected_category, q.expected_subcategory,
         coalesce(string_agg(coalesce(f.category, '-'), '|' ORDER BY f.rank), '') AS marked_categories,
         coalesce(string_agg(coalesce(f.subcategory, '-'), '|' ORDER BY f.rank), '')
           AS marked_subcategories,
         coalesce(string_agg(CASE WHEN f.rank IS NOT NULL THEN coalesce(f.category, '-') END, ', ' ORDER BY f.rank), '') AS shown_categories,
         count(f.rank) AS n_retrieved, max(f.hybrid_score) AS best_score,
         coalesce(bool_or(f.category = q.expected_category), false) AS hit,
         coalesce(bool_or(f.subcategory = q.expected_subcategory), false) AS sub_hit,
         coalesce(1.0 / min(CASE WHEN f.category = q.expected_category THEN f.rank END), 0.0)
           AS reciprocal_rank,
         coalesce(avg(f.hybrid_score), 0.0) AS avg_hybrid_score
  FROM q LEFT JOIN found f USING (query_id)
  GROUP BY q.query_id, q.text, q.expected_category, q.expected_subcategory)"""
)

RESPONSES = """
bodies AS (
  SELECT doc_id AS query_id, lang, text,
         CASE WHEN contains(text, chr(10)) THEN
           CAST(to_json(struct_pack(category := source, subcategory := lang,
             journey_stage := 'Stage ' || lang, confidence := confidence,
             summary := split_part(text, chr(10), 1),
             resolution_steps := string_split(text, chr(10)))) AS VARCHAR)
         ELSE
           CAST(to_json(struct_pack(category := source, subcategory := lang,
             journey_stage := 'Stage ' || lang, confidence := confidence,
             summary := split_part(text, chr(10), 1), resolution_steps := text)) AS VARCHAR)
         END AS body
  FROM (SELECT *, CASE WHEN n_chars < 500 THEN 'High' WHEN n_chars < 2000 THEN 'Medium'
                       WHEN n_chars < 5000 THEN 'Low' WHEN n_chars < 9000 THEN 'Unsure' END
                    AS confidence FROM documents)),
responses AS (
  SELECT query_id,
         CASE lang WHEN 'en' THEN body
                   WHEN 'de' THEN chr(10) || '```json' || chr(10) || body || chr(10) || '```' || chr(10)
                   WHEN 'es' THEN body || ' trailing'
                   ELSE text END AS raw
  FROM bodies)"""


def payloads(source: str, key: str) -> str:
    return f"""
{source}_stripped AS (SELECT {key}, trim(raw, {BLANKS}) AS t FROM {source}),
{source}_payload AS (
  SELECT {key}, CASE WHEN starts_with(t, '```')
                     THEN regexp_replace(string_split(t, '```')[2], '^json', '') ELSE t END AS payload
  FROM {source}_stripped),
{source}_value AS (
  SELECT {key}, payload,
         CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS v
  FROM {source}_payload)"""


EXTRACTED = (
    RESPONSES
    + ","
    + payloads("responses", "query_id")
    + """,
marked AS (
  SELECT *, coalesce(json_type(v) = 'OBJECT', false) AS good FROM responses_value),
extracted AS (
  SELECT query_id, payload, good, CASE WHEN good THEN 'ok' ELSE 'fallback' END AS status,
         CASE WHEN good THEN v->>'$.category' ELSE 'Unknown' END AS category,
         CASE WHEN good THEN v->>'$.subcategory' ELSE 'Unknown' END AS subcategory,
         CASE WHEN good THEN v->>'$.journey_stage' ELSE 'Unknown' END AS journey_stage,
         CASE WHEN good THEN v->>'$.confidence' ELSE 'Low' END AS confidence,
         CASE WHEN good THEN v->>'$.summary' ELSE 'Could not parse response.' END AS summary,
         CASE WHEN NOT good THEN [payload]
              WHEN json_type(v->'$.resolution_steps') = 'ARRAY'
                THEN CAST(v->'$.resolution_steps' AS VARCHAR[])
              ELSE [v->>'$.resolution_steps'] END AS steps
  FROM marked)"""
)

JUDGEMENTS = """
judgements AS (
  SELECT doc_id AS query_id,
         CASE lang WHEN 'en' THEN whole
                   WHEN 'de' THEN '```json' || chr(10) || '{' || f || '}' || chr(10) || '```'
                   WHEN 'es' THEN '[' || whole || ']'
                   ELSE '```JSON' || chr(10) || whole || chr(10) || '```' END AS raw
  FROM (
    SELECT doc_id, lang, '"faithfulness": ' || quality AS f,
           '{"faithfulness": ' || quality || ', "answer_relevance": ' || (1 - toxic)
             || ', "faithfulness_reason": "quality of ' || source
             || '", "relevance_reason": "tone of ' || source || '"}' AS whole
    FROM labels JOIN documents USING (doc_id)))"""

JUDGED = (
    JUDGEMENTS
    + ","
    + payloads("judgements", "query_id")
    + """,
judged AS (
  SELECT query_id, CASE WHEN good THEN 'ok' ELSE 'parse_error' END AS status,
         CASE WHEN good THEN coalesce(CAST(v->>'$.faithfulness' AS DOUBLE), 0.0) ELSE 0.0 END
           AS faithfulness,
         CASE WHEN good THEN coalesce(v->>'$.faithfulness_reason', '') ELSE 'Parse error' END
           AS faithfulness_reason,
         CASE WHEN good THEN coalesce(CAST(v->>'$.answer_relevance' AS DOUBLE), 0.0) ELSE 0.0 END
           AS answer_relevance,
         CASE WHEN good THEN coalesce(v->>'$.relevance_reason', '') ELSE 'Parse error' END
           AS relevance_reason
  FROM (SELECT *, coalesce(json_type(v) = 'OBJECT', false) AS good FROM judgements_value))"""
)

GENERATION = """
generation AS (
  SELECT q.query_id, q.text AS complaint, coalesce(x.category, '') AS llm_category,
         coalesce(x.subcategory, '') AS llm_subcategory,
         coalesce(j.faithfulness, 0.0) AS faithfulness,
         coalesce(j.answer_relevance, 0.0) AS answer_relevance,
         coalesce(j.faithfulness_reason, '') AS faithfulness_reason,
         coalesce(j.relevance_reason, '') AS relevance_reason
  FROM q LEFT JOIN extracted x USING (query_id) LEFT JOIN judged j USING (query_id))"""

METRICS = (
    PER_QUERY + "," + EXTRACTED + "," + JUDGED + "," + GENERATION + """,
metrics AS (
  SELECT avg(CAST(p.hit AS INT)) AS hit_rate, avg(CAST(p.sub_hit AS INT)) AS sub_hit_rate,
         avg(p.reciprocal_rank) AS mrr, avg(p.avg_hybrid_score) AS avg_hybrid_score,
         avg(g.faithfulness) AS faithfulness, avg(g.answer_relevance) AS answer_relevance
  FROM per_query p LEFT JOIN generation g USING (query_id))"""
)

GENERATED = """
batches AS (
  SELECT doc_id // 5 AS batch_id, count(*) FILTER (lang = 'fr') AS kind,
         list(struct_pack(category := coalesce(CAST(label AS VARCHAR), source),
                subcategory := source, journey_stage := CASE WHEN lang <> 'es' THEN lang END,
                issue_description := split_part(text, chr(10), 1), "length" := n_chars)
              ORDER BY doc_id) AS items
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY 1),
generated AS (
  SELECT batch_id,
         CASE kind WHEN 0 THEN CAST(to_json(items) AS VARCHAR)
                   WHEN 1 THEN '```json' || chr(10) || CAST(to_json(items) AS VARCHAR)
                               || chr(10) || '```'
                   WHEN 2 THEN CAST(to_json(items[1]) AS VARCHAR)
                   ELSE CAST(to_json(items) AS VARCHAR) || ' done' END AS raw
  FROM batches),""" + payloads("generated", "batch_id") + """,
listed AS (
  SELECT batch_id, CAST(v AS JSON[]) AS items FROM generated_value
  WHERE coalesce(json_type(v) = 'ARRAY', false)),
items AS (
  SELECT batch_id, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS position
  FROM listed),
new AS (
  SELECT batch_id, position, item->>'$.category' AS category,
         item->>'$.subcategory' AS subcategory, item->>'$.journey_stage' AS journey_stage,
         item->>'$.issue_description' AS issue_description,
         CASE WHEN (SELECT bool_or(json_exists(item, '$.resolution_steps')) FROM items)
              THEN item->>'$.resolution_steps' ELSE '' END AS resolution_steps
  FROM items)"""  # fmt: skip

ALLOWED = """
allowed AS (SELECT DISTINCT CAST(label AS VARCHAR) AS category FROM embeddings)"""

PLAN = f"""
places AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS place FROM allowed),
plan AS (
  SELECT request_id, request_id // {BATCH_SIZE} AS batch_id, category
  FROM (SELECT doc_id AS request_id,
               CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 8) AS BIGINT)
                 % (SELECT count(*) FROM places) AS place
        FROM documents)
  JOIN places USING (place))"""

CONTEXTS = """
contexts AS (
  SELECT query_id, string_agg(
           chr(10) || '[' || rank || '] Category: ' || coalesce(category, '') || ' > '
           || coalesce(subcategory, '') || chr(10) || '    Stage: ' || coalesce(journey_stage, '')
           || chr(10) || '    Issue: ' || coalesce(issue_description, '')
           || chr(10) || '    Resolution: ' || coalesce(resolution_steps, '') || chr(10),
           '' ORDER BY rank) AS context
  FROM found GROUP BY query_id),
judge_contexts AS (
  SELECT query_id, string_agg(
           '[' || coalesce(category, '') || ' > ' || coalesce(subcategory, '') || ']: '
           || coalesce(issue_description, '') || ' | ' || coalesce(resolution_steps, ''),
           chr(10) ORDER BY rank) AS judge_context
  FROM found GROUP BY query_id)"""

PROMPTS = f"""
prompts AS (
  SELECT query_id, {quoted(P.TRIAGE_INSTRUCTIONS)} || chr(10) || chr(10)
         || 'What the customer wrote:' || chr(10) || '\"\"\"' || text || '\"\"\"' || chr(10) || chr(10)
         || 'Entries found for it, best first:' || coalesce(context, '') || chr(10) || chr(10)
         || 'Now give that one object.' AS prompt
  FROM q LEFT JOIN contexts USING (query_id))"""

TIER = "CASE WHEN value >= 0.75 THEN 'good' WHEN value >= 0.5 THEN 'ok' ELSE 'bad' END"

RETRIEVAL_REPORT = """
report AS (
  SELECT substr(complaint, 1, 65) || '...' AS "Complaint",
         expected_category AS "Expected Category",
         expected_subcategory AS "Expected Subcategory",
         shown_categories AS "Retrieved Categories",
         CASE WHEN hit THEN '✅' ELSE '❌' END AS "Category Hit",
         CASE WHEN sub_hit THEN '✅' ELSE '❌' END AS "Subcat Hit",
         format('{:.2f}', reciprocal_rank) AS "Reciprocal Rank",
         format('{:.3f}', avg_hybrid_score) AS "Avg Hybrid Score"
  FROM per_query)"""

GENERATION_REPORT = """
report AS (
  SELECT substr(complaint, 1, 55) || '...' AS "Complaint", llm_category AS "LLM Category",
         llm_subcategory AS "LLM Subcategory", format('{:.2f}', faithfulness) AS "Faithfulness",
         faithfulness_reason AS "Faith Reason",
         format('{:.2f}', answer_relevance) AS "Answer Relevance",
         relevance_reason AS "Relevance Reason"
  FROM generation)"""


def empty_as_null(columns: str) -> str:
    names = [c.strip() for c in columns.split(",")]
    return ", ".join(f"nullif({n}, '') AS {n}" for n in names)


def sweep_sql() -> str:
    pairs = ", ".join(f"({a}, {k})" for a in SWEEP_ALPHAS for k in SWEEP_K)
    return (
        SEARCH
        + f""",
params AS (SELECT CAST(a AS DOUBLE) AS alpha, CAST(k AS INT) AS k FROM (VALUES {pairs}) t(a, k)),
ranked AS (
  SELECT alpha, query_id, kb_id, alpha * sem + (1 - alpha) * kw AS hybrid_score,
         row_number() OVER (PARTITION BY alpha, query_id
           ORDER BY round(alpha * sem + (1 - alpha) * kw, 9) DESC, kb_id) AS rank
  FROM scaled CROSS JOIN (SELECT DISTINCT alpha FROM params)),
graded AS (
  SELECT p.alpha, p.k, r.query_id, bool_or(coalesce(kb.category = q.expected_category, false)) AS hit,
         bool_or(kb.subcategory = q.expected_subcategory) AS sub_hit,
         coalesce(1.0 / min(CASE WHEN kb.category = q.expected_category THEN r.rank END), 0.0) AS rr,
         avg(r.hybrid_score) AS score
  FROM ranked r JOIN params p ON p.alpha = r.alpha AND r.rank <= p.k
  JOIN kb USING (kb_id) JOIN q ON q.query_id = r.query_id
  GROUP BY p.alpha, p.k, r.query_id)
SELECT alpha, k, round(avg(CAST(hit AS INT)), 6) AS hit_rate,
       round(avg(CAST(sub_hit AS INT)), 6) AS sub_hit_rate, round(avg(rr), 6) AS mrr,
       round(avg(score), 6) AS avg_hybrid_score, count(*) AS n_queries
FROM graded GROUP BY alpha, k"""
    )


def advice_sql() -> str:
    rules = " UNION ALL ".join(
        f"SELECT {i} AS position, {quoted(text)} AS advice FROM metrics WHERE {column} < {least}"
        for i, (column, least, text) in enumerate(E.ADVICE, 1)
    )
    return (
        METRICS
        + f""",
given AS ({rules})
SELECT position, advice FROM given
UNION ALL
SELECT 0, {quoted(E.ALL_GOOD)} WHERE NOT EXISTS (SELECT 1 FROM given)"""
    )


def tiers_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i} AS position, {quoted(label)} AS metric, {column} AS value FROM metrics"
        for i, (label, column) in enumerate(E.METRICS, 1)
    )
    return (
        METRICS
        + f""",
listed AS ({rows})
SELECT position, metric, round(value, 6) AS value,
       format('{{:.0f}}%', value * 100) AS shown, {TIER} AS tier
FROM listed"""
    )


ORACLE = {
    "hybrid_retrieve": f"""{HYBRID}
SELECT query_id, rank, kb_id, category, subcategory, journey_stage,
       {ROUNDED}
FROM found""",
    "semantic_retrieve": f"""{SEARCH}{hits(1.0)}
SELECT query_id, rank, kb_id, {ROUNDED} FROM hits""",
    "keyword_retrieve": f"""{SEARCH}{hits(0.0)}
SELECT query_id, rank, kb_id, {ROUNDED} FROM hits""",
    "dense_topk": f"""{SEARCH}{hits(1.0, scores="pairs")}
SELECT query_id, rank, kb_id, round(semantic_score, 6) + 0.0 AS semantic_score FROM hits""",
    "keyword_cosine_topk": f"""{SEARCH}{hits(0.0, scores="pairs")}
SELECT query_id, rank, kb_id, round(keyword_score, 6) + 0.0 AS keyword_score FROM hits""",
    "minmax_dense": f"""{SEARCH}
SELECT query_id, round(sem_min, 6) + 0.0 AS sem_min, round(sem_max, 6) + 0.0 AS sem_max
FROM ranges""",
    "minmax_keyword": f"""{SEARCH}
SELECT query_id, round(kw_min, 6) + 0.0 AS kw_min, round(kw_max, 6) + 0.0 AS kw_max, n_matched
FROM ranges""",
    "hybrid_alpha_sweep": sweep_sql(),
    "benchmark_passage_retrieval": f"""{SEARCH}{hits(0.0)}
SELECT q.query_id, count(*) FILTER (contains(d.text, q.text)) AS n_containing,
       min(CASE WHEN contains(d.text, q.text) THEN h.rank END) AS first_rank
FROM q JOIN hits h USING (query_id) JOIN documents d ON d.doc_id = h.kb_id GROUP BY q.query_id""",
    "corpus_assembly": f"WITH {KB} SELECT kb_id, corpus FROM corpus",
    "tokenize_filter": f"""WITH {KB},{DOC}
SELECT kb_id, len(words) AS n_words, len(grams) AS n_terms,
       coalesce(array_to_string(words, ' '), '') AS kept_text
FROM doc_grams""",
    "term_frequency": f"WITH {KB},{DOC} SELECT kb_id, term, tf FROM doc_tf",
    "smoothed_idf": f"WITH {INDEX} SELECT term, df, round(idf, 9) AS idf FROM idf",
    "tfidf_norms": f"""WITH {INDEX}
SELECT kb_id, count(term) AS n_terms, coalesce(round(any_value(norm), 6), 0.0) AS norm
FROM kb LEFT JOIN doc_tf USING (kb_id) LEFT JOIN norms USING (kb_id) GROUP BY kb_id""",
    "tfidf_weights": f"""WITH {INDEX}
SELECT kb_id, term, tf, round(tf * idf / norm, 6) AS weight
FROM doc_tf JOIN idf USING (term) JOIN norms USING (kb_id)""",
    "query_weights": f"""WITH {INDEX},{LABELLED},{query_terms()}
SELECT query_id, term, tf, round(tf * idf / length, 6) AS weight FROM query_known""",
    "index_refresh": f"""WITH {EVERY}
SELECT term, count(*) AS df,
       round(ln((1.0 + (SELECT count(*) FROM every)) / (1.0 + count(*))) + 1.0, 9) AS idf
FROM doc_tf GROUP BY term""",
    "index_refresh_norms": f"""WITH {EVERY},
weights AS (
  SELECT term, ln((1.0 + (SELECT count(*) FROM every)) / (1.0 + count(*))) + 1.0 AS idf FROM doc_tf GROUP BY term),
lengths AS (
  SELECT kb_id, count(*) AS n_terms, sqrt(sum(tf * idf * tf * idf)) AS norm
  FROM doc_tf JOIN weights USING (term) GROUP BY kb_id)
SELECT kb_id, CAST(coalesce(n_terms, 0) AS INTEGER) AS n_terms, coalesce(round(norm, 6), 0.0) AS norm
FROM every LEFT JOIN lengths USING (kb_id)""",
    "vector_normalize": """WITH n AS (
  SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding,
           lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings)
SELECT vec_id AS kb_id, generate_subscripts(embedding, 1) - 1 AS position,
       round(unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / norm)), 6) + 0.0 AS value
FROM n""",
    "vector_dimensions": 'SELECT len(embedding) AS "size", count(*) AS n FROM embeddings GROUP BY 1',
    "eval_per_query": f"""{PER_QUERY}
SELECT query_id, complaint, expected_category, expected_subcategory,
       marked_categories AS retrieved_categories, marked_subcategories AS retrieved_subcategories,
       n_retrieved, round(best_score, 6) AS best_score, hit, sub_hit,
       round(reciprocal_rank, 6) AS reciprocal_rank, round(avg_hybrid_score, 6) AS avg_hybrid_score
FROM per_query""",
    "eval_summary": f"""{PER_QUERY}
SELECT round(avg(CAST(hit AS INT)), 6) AS hit_rate,
       round(avg(CAST(sub_hit AS INT)), 6) AS sub_hit_rate,
       round(avg(reciprocal_rank), 6) AS mrr, round(avg(avg_hybrid_score), 6) AS avg_hybrid_score,
       count(*) AS n_queries
FROM per_query""",
    "eval_summary_tiers": tiers_sql(),
    "advice_rules": advice_sql(),
    "retrieval_breakdown": f"{PER_QUERY},{RETRIEVAL_REPORT} SELECT * FROM report",
    "retrieval_report_csv": f"""{PER_QUERY},{RETRIEVAL_REPORT}
SELECT * REPLACE (nullif("Retrieved Categories", '') AS "Retrieved Categories") FROM report""",
    "generation_eval": f"""WITH {LABELLED},{EXTRACTED},{JUDGED},{GENERATION}
SELECT * FROM generation""",
    "generation_breakdown": f"""WITH {LABELLED},{EXTRACTED},{JUDGED},{GENERATION},
{GENERATION_REPORT} SELECT * FROM report""",
    "generation_report_csv": f"""WITH {LABELLED},{EXTRACTED},{JUDGED},{GENERATION},
{GENERATION_REPORT}
SELECT * REPLACE (nullif("LLM Category", '') AS "LLM Category",
                  nullif("LLM Subcategory", '') AS "LLM Subcategory",
                  nullif("Faith Reason", '') AS "Faith Reason",
                  nullif("Relevance Reason", '') AS "Relevance Reason")
FROM report""",
    "context_block": f"{HYBRID},{CONTEXTS} SELECT * FROM contexts",
    "judge_context": f"{HYBRID},{CONTEXTS} SELECT * FROM judge_contexts",
    "triage_prompt": f"{HYBRID},{CONTEXTS},{PROMPTS} SELECT * FROM prompts",
    "judge_prompt": f"""{HYBRID},{CONTEXTS},{EXTRACTED}
SELECT query_id, {quoted(P.JUDGE_INSTRUCTIONS)} || chr(10) || chr(10) || 'The complaint was:'
       || chr(10) || q.text || chr(10) || chr(10) || 'The entries at hand were:' || chr(10)
       || coalesce(judge_context, '') || chr(10) || chr(10) || 'The answer to be checked is:' || chr(10)
       || coalesce(CAST(to_json(struct_pack(category := x.category, subcategory := x.subcategory,
            journey_stage := x.journey_stage, confidence := x.confidence, summary := x.summary,
            resolution_steps := x.steps)) AS VARCHAR), '') AS prompt
FROM q LEFT JOIN judge_contexts USING (query_id) LEFT JOIN extracted x USING (query_id)""",
    "fence_strip": f"""WITH {RESPONSES},{payloads("responses", "query_id")}
SELECT query_id, payload FROM responses_payload""",
    "response_extract": f"""WITH {EXTRACTED}
SELECT query_id, status, category, subcategory, journey_stage, confidence, summary,
       array_to_string(steps, '|') AS resolution_steps, len(steps) AS n_steps
FROM extracted""",
    "response_failure_counts": f"""WITH {EXTRACTED}
SELECT status, count(*) AS n FROM extracted GROUP BY status""",
    "judgement_extract": f"WITH {JUDGED} SELECT * FROM judged",
    "judgement_failure_counts": f"""WITH {JUDGED}
SELECT status, count(*) AS n FROM judged GROUP BY status""",
    "judgement_summary": f"""WITH {JUDGED}
SELECT round(avg(faithfulness), 6) AS faithfulness,
       round(avg(answer_relevance), 6) AS answer_relevance,
       count(*) FILTER (status <> 'ok') AS n_unusable,
       count(*) FILTER (faithfulness NOT BETWEEN 0 AND 1 OR answer_relevance NOT BETWEEN 0 AND 1)
         AS n_out_of_range,
       count(*) AS n_judged
FROM judged""",
    "confidence_tier": f"""WITH {EXTRACTED}
SELECT query_id, confidence,
       CASE WHEN confidence IN ('High', 'Medium', 'Low') THEN lower(confidence) ELSE 'low' END AS tier
FROM extracted""",
    "steps_explode": f"""WITH {EXTRACTED}
SELECT query_id, generate_subscripts(steps, 1) AS step, unnest(steps) AS text FROM extracted""",
    "resolution_steps_split": f"""WITH {KB},
written AS (
  SELECT kb_id, array_to_string(list_transform(
           string_split(coalesce(resolution_steps, ''), chr(10)),
           lambda line, i: i || '. ' || line), ' ') AS steps FROM kb),
cut AS (
  SELECT kb_id, string_split(regexp_replace(steps, '\\. (\\d+\\. )', '.' || chr(1) || '\\1', 'g'),
                             chr(1)) AS parts FROM written)
SELECT kb_id, generate_subscripts(parts, 1) AS step, unnest(parts) AS text FROM cut""",
    "score_clamp": f"""{SEARCH}{hits(0.5)}
SELECT query_id, rank, kb_id, least(round(2 * semantic_score, 6), 1.0) AS semantic_score,
       least(round(2 * keyword_score, 6), 1.0) AS keyword_score,
       least(round(2 * hybrid_score, 6), 1.0) AS hybrid_score
FROM hits""",
    "ticket_triage": f"""WITH {LABELLED},{EXTRACTED}
SELECT query_id, q.text AS complaint, status, coalesce(category, '—') AS category,
       coalesce(subcategory, '—') AS subcategory, coalesce(journey_stage, '—') AS journey_stage,
       coalesce(confidence, 'Low') AS confidence, coalesce(summary, '') AS summary,
       CASE WHEN confidence IN ('High', 'Medium', 'Low') THEN lower(confidence) ELSE 'low' END
         AS confidence_tier,
       generate_subscripts(steps, 1) AS step, unnest(steps) AS text
FROM q JOIN extracted USING (query_id) WHERE trim(q.text, {BLANKS}) <> ''""",
    "complaint_filter": f"""WITH {TURNS}
SELECT query_id, text FROM turns WHERE trim(text, {BLANKS}) <> ''""",
    "model_call": f"""{HYBRID},{CONTEXTS},{PROMPTS}
SELECT query_id, 'ok' AS status, right(prompt, 30) AS summary, length(prompt) AS "length"
FROM prompts""",
    "model_embed": """WITH given AS (
  SELECT 'article ' || doc_id AS id, text FROM documents UNION ALL SELECT 'query ' || item_id, text FROM benchmark),
sized AS (SELECT *, length(text) % 5 > 0 AS good FROM given)
SELECT id, CASE WHEN good THEN 'ok' ELSE 'error' END AS status,
       CASE WHEN good THEN CAST(length(text) AS BIGINT) END AS "length",
       CASE WHEN good THEN CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) END AS spaces,
       CASE WHEN good THEN CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) END AS breaks
FROM sized""",
    "generated_array_explode": f"WITH {GENERATED} SELECT * FROM new",
    "kb_conform": """SELECT doc_id AS kb_id, source AS category, '' AS subcategory,
       '' AS journey_stage, text AS issue_description, '' AS resolution_steps FROM documents""",
    "kb_category_validation": f"""WITH {GENERATED},{ALLOWED}
SELECT category, count(*) AS n FROM new
WHERE category NOT IN (SELECT category FROM allowed) GROUP BY category""",
    "kb_append": f"""WITH {KB},{GENERATED}
SELECT category, subcategory, journey_stage, issue_description, resolution_steps FROM kb
UNION ALL
SELECT category, subcategory, journey_stage, issue_description, resolution_steps FROM new""",
    "kb_growth": f"""WITH {KB},{GENERATED},{ALLOWED},
grown AS (
  SELECT category, resolution_steps FROM kb
  UNION ALL
  SELECT category, resolution_steps FROM new
  WHERE category IN (SELECT category FROM allowed))
SELECT category, count(*) AS n, count(*) FILTER (resolution_steps = '') AS n_without_steps
FROM grown GROUP BY category""",
    "kb_growth_search": f"""WITH {KB.split("corpus AS")[0].replace("kb AS (", "kb0 AS (", 1)}
{GENERATED.strip()},{ALLOWED},
kb AS (
  SELECT * FROM kb0
  UNION ALL BY NAME
  SELECT (SELECT max(doc_id) FROM documents) + 1
           + batch_id * (SELECT max(position) + 1 FROM new) + position AS kb_id,
         category, subcategory, journey_stage, issue_description, resolution_steps
  FROM new WHERE category IN (SELECT category FROM allowed)),
corpus AS{KB.split("corpus AS")[1]},{DOC},{IDF},{LABELLED},{query_terms()},
pairs AS (
  SELECT query_id, q.kb_id, coalesce(kw, 0.0) AS kw, 0.0 AS sem
  FROM (SELECT query_id, kb_id FROM q CROSS JOIN kb) q LEFT JOIN cosines USING (query_id, kb_id)){hits(0.0, scores="pairs")}
SELECT query_id, rank, kb_id, round(keyword_score, 6) + 0.0 AS keyword_score FROM hits""",
    "append_accounting": f"""WITH {KB},{GENERATED}
SELECT (SELECT count(*) FROM new) AS n_new,
       (SELECT count(*) FROM new) + (SELECT count(*) FROM kb) AS n_total""",
    "kb_coverage": f"""WITH {KB},
pairs AS (SELECT category, subcategory, count(*) AS n FROM kb GROUP BY ALL)
SELECT category, subcategory,
       CAST(sum(n) OVER (PARTITION BY category) AS BIGINT) AS category_entries,
       n AS subcategory_entries
FROM pairs""",
    "kb_csv_position": f"""WITH {KB}
SELECT row_number() OVER (ORDER BY kb_id) - 1 AS kb_id, {empty_as_null(
    "category, subcategory, journey_stage, issue_description, resolution_steps"
)} FROM kb""",
    "kb_csv_scan": f"""WITH {KB}
SELECT kb_id, {empty_as_null(
    "category, subcategory, journey_stage, issue_description, resolution_steps"
)} FROM kb""",
    "evaluation_set": f"""WITH {LABELLED}
SELECT query_id, text, expected_category, expected_subcategory FROM q""",
    "dense_vectors": f"""WITH {KB},{LABELLED}
SELECT 'article' AS kind, count(*) AS n, count(embedding) AS n_vectors FROM kb
UNION ALL SELECT 'query', count(*), count(embedding) FROM q""",
    "generation_plan": f"WITH {ALLOWED},{PLAN} SELECT * FROM plan",
    "generation_prompts": f"""WITH {ALLOWED},{PLAN}
SELECT batch_id, count(*) AS n_requested,
       {quoted(P.GENERATE_OPENING[0])} || count(*) || {quoted(P.GENERATE_OPENING[1])}
       || string_agg('"' || category || '"', ', ' ORDER BY request_id) || {quoted(P.GENERATE_OPENING[2])}
       || {quoted(P.GENERATE_INSTRUCTIONS)} AS prompt
FROM plan GROUP BY batch_id""",
    "stream_triage": f"""WITH {INDEX},{TURNS},
q AS (SELECT query_id, text FROM turns WHERE trim(text, {BLANKS}) <> ''),{query_terms()},
pairs AS (
  SELECT q.query_id, kb.kb_id, coalesce(c.kw, 0.0) AS kw
  FROM q CROSS JOIN kb LEFT JOIN cosines c ON c.query_id = q.query_id AND c.kb_id = kb.kb_id),
ranges AS (
  SELECT query_id, min(kw) AS kw_min, max(kw) AS kw_max FROM pairs GROUP BY query_id),
scaled AS (
  SELECT query_id, kb_id, 0.0 AS sem,
         CASE WHEN kw_max > kw_min THEN (kw - kw_min) / (kw_max - kw_min) ELSE kw END AS kw
  FROM pairs JOIN ranges USING (query_id)){hits(0.0)}
SELECT query_id, rank, kb_id, round(keyword_score, 6) + 0.0 AS keyword_score FROM hits""",
}
