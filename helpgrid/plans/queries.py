"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpgrid.functions import display as D
from helpgrid.functions import replies as R
from helpgrid.functions import text as X
from helpgrid.functions import vectors as V
from helpgrid.operators import evaluate as E
from helpgrid.operators import growth as G
from helpgrid.operators import index as I
from helpgrid.operators import jobs as J
from helpgrid.operators import prompts as P
from helpgrid.operators import replies as M
from helpgrid.operators import search as S
from helpgrid.operators import triage as H
from helpgrid.operators.model_call import call_model, embed
from helpgrid.plans import tables as T
from helpgrid.schemas import ARTICLE_FIELDS
from helpgrid.session import scratch_path
from helpgrid.sources import tables as IO
from helpgrid.streaming.triage import start_triage

TOP_K = 3
ALPHA = 0.5
SWEEP_ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)
SWEEP_K = (1, 3, 5, 10)
BATCH_SIZE = 5
SEED = 7

SCORES = ("semantic_score", "keyword_score", "hybrid_score")


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


# --- search -----------------------------------------------------------------------------------


def hits(spark: SparkSession, sf_dir: str, alpha: float = ALPHA, **options) -> DataFrame:
    return S.retrieve(T.index(spark, sf_dir), T.labelled(spark, sf_dir), TOP_K, alpha, **options)


def hit_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits with the whole article."""
    return S.with_articles(hits(spark, sf_dir), T.articles(spark, sf_dir))


def hybrid_retrieve(spark, sf_dir):
    shown = ["query_id", "rank", "kb_id", "category", "subcategory", "journey_stage"]
    return rounded(hit_articles(spark, sf_dir).select(*shown, *SCORES), *SCORES)


def semantic_retrieve(spark, sf_dir):
    return rounded(hits(spark, sf_dir, alpha=1.0), *SCORES)


def keyword_retrieve(spark, sf_dir):
    return rounded(hits(spark, sf_dir, alpha=0.0), *SCORES)


def dense_topk(spark, sf_dir):
    raw = hits(spark, sf_dir, alpha=1.0, scaled=False, used_only=True)
    return rounded(raw.select("query_id", "rank", "kb_id", "semantic_score"), "semantic_score")


def keyword_cosine_topk(spark, sf_dir):
    raw = hits(spark, sf_dir, alpha=0.0, scaled=False, used_only=True)
    return rounded(raw.select("query_id", "rank", "kb_id", "keyword_score"), "keyword_score")


def score_ranges(spark, sf_dir):
    return S.score_ranges(T.index(spark, sf_dir), T.labelled(spark, sf_dir))


def minmax_dense(spark, sf_dir):
    found = score_ranges(spark, sf_dir).select("query_id", "sem_min", "sem_max")
    return rounded(found, "sem_min", "sem_max")


def minmax_keyword(spark, sf_dir):
    found = score_ranges(spark, sf_dir).select("query_id", "kw_min", "kw_max", "n_matched")
    return rounded(found, "kw_min", "kw_max")


def sweep_hits(spark, sf_dir):
    found = S.sweep(
        T.index(spark, sf_dir), T.labelled(spark, sf_dir), max(SWEEP_K), SWEEP_ALPHAS
    )
    labels = T.articles(spark, sf_dir).select("kb_id", "category", "subcategory")
    return S.with_articles(found, labels)


def hybrid_alpha_sweep(spark, sf_dir):
    params = spark.createDataFrame(
        [(a, k) for a in SWEEP_ALPHAS for k in SWEEP_K], "alpha double, k int"
    )
    found = E.sweep_summary(T.labelled(spark, sf_dir), sweep_hits(spark, sf_dir), params)
    return rounded(found, "hit_rate", "sub_hit_rate", "mrr", "avg_hybrid_score")


def benchmark_passage_retrieval(spark, sf_dir):
    """Whether the best keyword hits contain the passage that was searched for."""
    items = T.labelled(spark, sf_dir)
    texts = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("kb_id"), "text")
    found = S.with_articles(hits(spark, sf_dir, alpha=0.0, used_only=True), texts)
    wanted = items.select("query_id", F.col("text").alias("passage"))
    return (
        wanted.join(found, "query_id")
        .groupBy("query_id")
        .agg(
            F.count_if(F.contains("text", "passage")).alias("n_containing"),
            F.min(F.when(F.contains("text", "passage"), F.col("rank"))).alias("first_rank"),
        )
    )


# --- index ------------------------------------------------------------------------------------


def corpus_assembly(spark, sf_dir):
    return T.articles(spark, sf_dir).select("kb_id", X.corpus_text().alias("corpus"))


def tokenize_filter(spark, sf_dir):
    kept = X.with_words(corpus_assembly(spark, sf_dir), "corpus")
    return kept.select(
        "kb_id",
        F.size("words").alias("n_words"),
        F.size(X.with_bigrams(F.col("words"))).alias("n_terms"),
        F.array_join("words", " ").alias("kept_text"),
    )


def term_frequency(spark, sf_dir):
    return I.postings(T.index(spark, sf_dir).counts.select("kb_id", "terms", "counts"))


def smoothed_idf(spark, sf_dir):
    return rounded(T.index(spark, sf_dir).idf, "idf", places=9)


def tfidf_norms(spark, sf_dir):
    found = T.index(spark, sf_dir).norms.select("kb_id", "n_terms", "norm")
    return rounded(found, "norm")


def tfidf_weights(spark, sf_dir):
    return rounded(I.tfidf_weights(T.index(spark, sf_dir)), "weight")


def query_weights(spark, sf_dir):
    found = S.query_weights(T.index(spark, sf_dir), T.labelled(spark, sf_dir))
    return rounded(found.select("query_id", "term", "tf", "weight"), "weight")


def _refreshed(spark, sf_dir):
    """The index after the user turns of the conversations have been added as articles."""
    turns = T.user_turns(T.table(spark, sf_dir, "conversations"))
    largest = T.table(spark, sf_dir, "documents").agg(F.max("doc_id")).scalar()
    added = G.conform(
        turns.select(
            (largest + 1 + F.col("query_id")).alias("kb_id"),
            F.col("text").alias("issue_description"),
        ),
        ["kb_id"],
    )
    return I.refresh_index(T.index(spark, sf_dir), added)


def index_refresh(spark, sf_dir):
    return rounded(_refreshed(spark, sf_dir).idf, "idf", places=9)


def index_refresh_norms(spark, sf_dir):
    """The norms of all articles, old and new, after the refresh."""
    return rounded(_refreshed(spark, sf_dir).norms.select("kb_id", "n_terms", "norm"), "norm")


def vector_normalize(spark, sf_dir):
    given = T.vectors(spark, sf_dir).withColumn("norm", V.l2_norm(F.col("embedding")))
    unit = given.select("kb_id", F.posexplode(V.unit_vector(F.col("embedding"), F.col("norm"))))
    return unit.select("kb_id", F.col("pos").alias("position"), F.round("col", 6).alias("value"))


def vector_dimensions(spark, sf_dir):
    given = T.vectors(spark, sf_dir)
    dimension = given.select(F.size("embedding")).first()[0]
    checked = given.select(F.size(V.checked_vector(F.col("embedding"), dimension)).alias("size"))
    return checked.groupBy("size").agg(F.count(F.lit(1)).alias("n"))


# --- evaluation -------------------------------------------------------------------------------


def per_query(spark, sf_dir):
    return E.evaluate_retrieval(T.labelled(spark, sf_dir), hit_articles(spark, sf_dir))


def eval_per_query(spark, sf_dir):
    found = per_query(spark, sf_dir).select(
        "query_id",
        "complaint",
        "expected_category",
        "expected_subcategory",
        F.array_join("retrieved_categories", "|", "-").alias("retrieved_categories"),
        F.array_join("retrieved_subcategories", "|", "-").alias("retrieved_subcategories"),
        F.size("hybrid_scores").alias("n_retrieved"),
        F.array_max("hybrid_scores").alias("best_score"),
        "hit",
        "sub_hit",
        "reciprocal_rank",
        "avg_hybrid_score",
    )
    return rounded(found, "best_score", "reciprocal_rank", "avg_hybrid_score")


def eval_summary(spark, sf_dir):
    found = E.summarize_retrieval(per_query(spark, sf_dir))
    return rounded(found, "hit_rate", "sub_hit_rate", "mrr", "avg_hybrid_score")


def generation(spark, sf_dir):
    return E.evaluate_generation(
        T.labelled(spark, sf_dir),
        M.extract_responses(T.responses(spark, sf_dir)),
        M.extract_judgements(T.judgements(spark, sf_dir)),
    )


def generation_eval(spark, sf_dir):
    return generation(spark, sf_dir)


def metrics(spark, sf_dir):
    return E.metric_row(per_query(spark, sf_dir), generation(spark, sf_dir))


def eval_summary_tiers(spark, sf_dir):
    found = E.metric_table(metrics(spark, sf_dir))
    return rounded(found.select("position", "metric", "value", "shown", "tier"), "value")


def advice_rules(spark, sf_dir):
    return E.advice(metrics(spark, sf_dir))


def retrieval_breakdown(spark, sf_dir):
    return E.retrieval_breakdown(per_query(spark, sf_dir))


def generation_breakdown(spark, sf_dir):
    return E.generation_breakdown(generation(spark, sf_dir))


def retrieval_report_csv(spark, sf_dir):
    """The retrieval report, written as CSV and read back."""
    path = scratch_path(spark, "report")
    report = E.retrieval_breakdown(per_query(spark, sf_dir))
    IO.write_report(report, path)
    return IO.read_csv(spark, path, report.schema)


def generation_report_csv(spark, sf_dir):
    path = scratch_path(spark, "report")
    report = E.generation_breakdown(generation(spark, sf_dir))
    IO.write_report(report, path)
    return IO.read_csv(spark, path, report.schema)


# --- prompts and replies ----------------------------------------------------------------------


def context_block(spark, sf_dir):
    return P.context_block(hit_articles(spark, sf_dir))


def judge_context(spark, sf_dir):
    return P.judge_context(hit_articles(spark, sf_dir))


def triage_prompt(spark, sf_dir):
    return P.triage_prompts(T.labelled(spark, sf_dir), hit_articles(spark, sf_dir))


def judge_prompt(spark, sf_dir):
    extracted = M.extract_responses(T.responses(spark, sf_dir))
    return P.judge_prompts(T.labelled(spark, sf_dir), hit_articles(spark, sf_dir), extracted)


def fence_strip(spark, sf_dir):
    return T.responses(spark, sf_dir).select(
        "query_id", R.without_fence(F.col("raw")).alias("payload")
    )


def response_extract(spark, sf_dir):
    found = M.extract_responses(T.responses(spark, sf_dir))
    return found.withColumns(
        {
            "n_steps": F.size("resolution_steps"),
            "resolution_steps": F.array_join("resolution_steps", "|"),
        }
    )


def response_failure_counts(spark, sf_dir):
    return M.status_counts(M.extract_responses(T.responses(spark, sf_dir)))


def judgement_extract(spark, sf_dir):
    return M.extract_judgements(T.judgements(spark, sf_dir))


def judgement_failure_counts(spark, sf_dir):
    return M.status_counts(M.extract_judgements(T.judgements(spark, sf_dir)))


def judgement_summary(spark, sf_dir):
    found = E.summarize_judgements(M.extract_judgements(T.judgements(spark, sf_dir)))
    return rounded(found, "faithfulness", "answer_relevance")


def confidence_tier(spark, sf_dir):
    found = M.extract_responses(T.responses(spark, sf_dir))
    return found.select(
        "query_id", "confidence", D.confidence_tier(F.col("confidence")).alias("tier")
    )


def steps_explode(spark, sf_dir):
    found = M.extract_responses(T.responses(spark, sf_dir))
    return M.numbered(found.select("query_id", "resolution_steps"))


def resolution_steps_split(spark, sf_dir):
    """Steps of an article, once its lines have been written as one text of numbered steps."""
    lines = F.split(F.coalesce("resolution_steps", F.lit("")), "\n")
    text = F.array_join(
        F.transform(lines, lambda line, i: F.concat((i + 1).cast("string"), F.lit(". "), line)), " "
    )
    steps = T.articles(spark, sf_dir).select("kb_id", D.numbered_steps(text).alias("steps"))
    return M.numbered(steps, "steps")


def score_clamp(spark, sf_dir):
    """Score bars of doubled scores, many of which exceed the limit."""
    found = hits(spark, sf_dir).withColumns({n: F.col(n) * 2 for n in SCORES})
    return rounded(H.score_bars(found).select("query_id", "rank", "kb_id", *SCORES), *SCORES)


def ticket_triage(spark, sf_dir):
    extracted = M.extract_responses(T.responses(spark, sf_dir))
    return H.triage_steps(T.labelled(spark, sf_dir), extracted)


def complaint_filter(spark, sf_dir):
    return H.complaints(T.user_turns(T.table(spark, sf_dir, "conversations")))


def _stub_model():
    """A deterministic stand-in for a model; it refuses texts that mention no article."""

    def answer(texts: list[str]) -> list[str]:
        if any("Category:" not in text for text in texts):
            raise ValueError("nothing to answer from")
        return [json.dumps({"summary": text[-30:], "length": len(text)}) for text in texts]

    return answer


def model_call(spark, sf_dir):
    """Replies of the stand-in to the triage prompts, read back as records."""
    replies = call_model(triage_prompt(spark, sf_dir), _stub_model)
    value = R.strict_json(F.col("raw"))
    return replies.select(
        "query_id",
        "status",
        R.field(value, "summary").alias("summary"),
        R.field(value, "length", "long").alias("length"),
    )


def _stub_embedder():
    """A deterministic stand-in; it refuses texts whose length is a multiple of five."""

    def answer(texts: list[str]) -> list[list[float]]:
        if any(len(text) % 5 == 0 for text in texts):
            raise ValueError("a text of such a length")
        return [[float(len(text)), float(text.count(" ")), float(text.count("\n"))] for text in texts]

    return answer


def model_embed(spark, sf_dir):
    """Vectors of all articles and queries by the stand-in. The second run finds all but failed calls in the log."""
    articles = T.table(spark, sf_dir, "documents").select(F.concat(F.lit("article "), "doc_id").alias("id"), "text")
    asked = T.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("query "), "item_id").alias("id"), "text")
    log = scratch_path(spark, "calls")
    embed(articles, _stub_embedder, log, "id")
    found = embed(articles.unionByName(asked), _stub_embedder, log, "id")
    return found.select("id", "status", *(F.get("embedding", F.lit(i)).cast("long").alias(c) for i, c in enumerate(("length", "spaces", "breaks"))))


# --- knowledge-base growth --------------------------------------------------------------------


def generated_array_explode(spark, sf_dir):
    return M.extract_articles(T.generated(spark, sf_dir))


def kb_conform(spark, sf_dir):
    given = T.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("kb_id"),
        F.col("text").alias("issue_description"),
        F.col("source").alias("category"),
        "n_chars",
    )
    return G.conform(given, ["kb_id"])


def kb_category_validation(spark, sf_dir):
    new = M.extract_articles(T.generated(spark, sf_dir))
    unknown = G.unknown_categories(new, T.allowed_categories(spark, sf_dir))
    return unknown.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def kb_append(spark, sf_dir):
    """The knowledge base with the generated articles appended, written and read back."""
    path = scratch_path(spark, "kb")
    IO.write_articles(T.articles(spark, sf_dir), path, "overwrite", key=False)
    new = M.extract_articles(T.generated(spark, sf_dir))
    IO.write_articles(new, path, "append", key=False)
    return spark.read.parquet(path)


def kb_growth(spark, sf_dir):
    """Articles per category after growth with checked categories."""
    grown, _, _ = G.grow(
        T.articles(spark, sf_dir).select(*ARTICLE_FIELDS),
        T.generated(spark, sf_dir),
        T.allowed_categories(spark, sf_dir),
    )
    return grown.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("resolution_steps") == "").alias("n_without_steps"),
    )


def kb_growth_search(spark, sf_dir):
    """Keyword search of all passages in the knowledge base after it has grown by the generated articles."""
    grown = J.grow(
        T.index(spark, sf_dir),
        T.articles(spark, sf_dir),
        T.generated(spark, sf_dir),
        T.allowed_categories(spark, sf_dir),
    )
    found = S.retrieve(
        grown.index, T.labelled(spark, sf_dir), TOP_K, 0.0, scaled=False, used_only=True
    )
    return rounded(found.select("query_id", "rank", "kb_id", "keyword_score"), "keyword_score")


def append_accounting(spark, sf_dir):
    new = M.extract_articles(T.generated(spark, sf_dir))
    return G.append_counts(T.articles(spark, sf_dir), new)


def kb_coverage(spark, sf_dir):
    return G.coverage(T.articles(spark, sf_dir))


def kb_csv_scan(spark, sf_dir):
    """The knowledge base after a round trip through CSV."""
    path = scratch_path(spark, "kb-csv")
    IO.write_articles(T.articles(spark, sf_dir), path, "overwrite", "csv")
    return IO.read_articles_csv(spark, path, with_key=True)


def kb_csv_position(spark, sf_dir):
    """The knowledge base from CSV files without ids: rows are numbered in the order of files and lines."""
    path = scratch_path(spark, "kb-csv")
    IO.write_ordered_csv(T.articles(spark, sf_dir), path, "kb_id", ARTICLE_FIELDS)
    return IO.read_articles_csv(spark, path)


def evaluation_set(spark, sf_dir):
    return T.labelled(spark, sf_dir).drop("embedding")


def dense_vectors(spark, sf_dir):
    """How many articles and queries have a vector."""
    held = T.index(spark, sf_dir).norms.select(
        F.lit("article").alias("kind"), F.col("has_vector").alias("present")
    )
    asked = T.labelled(spark, sf_dir).select(
        F.lit("query").alias("kind"), F.col("embedding").isNotNull().alias("present")
    )
    return held.unionByName(asked).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("present").alias("n_vectors")
    )


def _requests(spark, sf_dir):
    """One new article is requested for every article."""
    return T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"))


def generation_plan(spark, sf_dir):
    return G.plan_requests(
        _requests(spark, sf_dir), T.allowed_categories(spark, sf_dir), BATCH_SIZE, SEED
    )


def generation_prompts(spark, sf_dir):
    return G.request_prompts(generation_plan(spark, sf_dir))


# --- streaming --------------------------------------------------------------------------------


def stream_triage(spark, sf_dir):
    """The user turns of the conversations as a stream, searched by keywords."""
    schema = T.table(spark, sf_dir, "conversations").schema
    # as a pattern, the name may stand for one file or for a folder of them
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parque[t]")
    out = scratch_path(spark, "triage")
    query = start_triage(
        T.user_turns(stream),
        T.index(spark, sf_dir),
        out,
        scratch_path(spark, "triage-checkpoint"),
        top_k=TOP_K,
        alpha=0.0,
    )
    query.awaitTermination()
    found = spark.read.parquet(out).select("query_id", "rank", "kb_id", "keyword_score")
    return rounded(found, "keyword_score")


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_retrieve,
        semantic_retrieve,
        keyword_retrieve,
        dense_topk,
        keyword_cosine_topk,
        minmax_dense,
        minmax_keyword,
        hybrid_alpha_sweep,
        benchmark_passage_retrieval,
        corpus_assembly,
        tokenize_filter,
        term_frequency,
        smoothed_idf,
        tfidf_norms,
        tfidf_weights,
        query_weights,
        index_refresh,
        index_refresh_norms,
        vector_normalize,
        vector_dimensions,
        eval_per_query,
        eval_summary,
        eval_summary_tiers,
        advice_rules,
        retrieval_breakdown,
        retrieval_report_csv,
        generation_eval,
        generation_breakdown,
        generation_report_csv,
        context_block,
        judge_context,
        triage_prompt,
        judge_prompt,
        fence_strip,
        response_extract,
        response_failure_counts,
        judgement_extract,
        judgement_failure_counts,
        judgement_summary,
        confidence_tier,
        steps_explode,
        resolution_steps_split,
        score_clamp,
        ticket_triage,
        complaint_filter,
        model_call,
        model_embed,
        generated_array_explode,
        kb_conform,
        kb_category_validation,
        kb_append,
        kb_growth,
        kb_growth_search,
        append_accounting,
        kb_coverage,
        kb_csv_scan,
        kb_csv_position,
        evaluation_set,
        dense_vectors,
        generation_plan,
        generation_prompts,
        stream_triage,
    )
}
