"""One callable per registered query: (spark, sf_dir) -> DataFrame."""

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamhis import schemas
from tamhis.functions import chat
from tamhis.functions import text as X
from tamhis.operators import counts as N
from tamhis.operators import curation as C
from tamhis.operators import distributions as D
from tamhis.operators import requests as R
from tamhis.operators.chat import render_conversations
from tamhis.operators.embedding import BatchEncoder, TfidfEncoder
from tamhis.operators.nearest import nearest
from tamhis.operators.sampling import hash_sample
from tamhis.operators.split import split_exact
from tamhis.plans import curate as PC
from tamhis.plans import profile as PP
from tamhis.plans import retrieval as PR
from tamhis.plans import training as PT
from tamhis.profiles import LATIN
from tamhis.sources.readers import (
    head, read_cells, read_index, read_jsonl_strict, read_jsonl_tolerant, read_jsonl_within, read_raw_qa, read_training_csv,
)
from tamhis.sources.writers import write_index, write_instructions, write_training
from tamhis.streaming.curation import curate_stream
from tamhis.streaming.requests import prompt_stream
from tamhis.workspace import fresh_path, release, written
from workloads import adapters as A

#: A profile with marks to strip and without personal keywords.
MARKS = replace(LATIN, name="marks", personal=(), strip_marks="[.,]")


def _rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select([
        F.round(c, special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


def _lengths(spark, sf_dir):
    return PP.lengths(A.raw_qa(spark, sf_dir))


def _text(rule):
    def query(spark, sf_dir):
        return A.noisy_text(spark, sf_dir).select("doc_id", rule(F.col("text")).alias("text"))
    return query


# -- scans and reports -------------------------------------------------------------------------

def scan_raw(spark, sf_dir):
    return A.raw_qa(spark, sf_dir).select("row_id", *schemas.RAW_QA.names)


def head_n(spark, sf_dir):
    first = head(A.raw_qa(spark, sf_dir), 5)
    return first.select("row_id", F.substring(F.coalesce("question", "q_body"), 1, 300).alias("preview"))


def qa_report(spark, sf_dir):
    panel = A.panel_turns(spark, sf_dir)
    return panel.select("conv_id", "turn", R.report_lines().alias("lines"))


def panel_prompts(spark, sf_dir):
    return A.panel_turns(spark, sf_dir).select("conv_id", "turn", chat.panel_prompt(F.col("question")).alias("prompt"))


# -- sources and sinks, each written to the shared folder and read back --------------------------

def roundtrip_raw(spark, sf_dir):
    path = fresh_path(spark, "raw")
    A.raw_qa(spark, sf_dir).withColumnRenamed("row_id", "key").write.json(path, ignoreNullFields=False)
    return read_raw_qa(spark, path, "json", row_id="key").select("row_id", *schemas.RAW_QA.names)


def roundtrip_instructions(spark, sf_dir):
    path = fresh_path(spark, "instructions")
    write_instructions(A.records(spark, sf_dir), path)
    return read_jsonl_strict(spark, path)


#: Files by name: which remainders of the row ids modulo 16 each holds. Their sizes do not follow their names.
FILES = {"a": (3, 3), "b": (5, 15), "c": (0, 0), "d": (1, 2), "e": (4, 4)}


def _in_files(spark, sf_dir):
    """Raw rows without a key, dealt to files of very different sizes."""
    path = fresh_path(spark, "files")
    raw = written(A.raw_qa(spark, sf_dir), "raw")
    for name, (low, high) in FILES.items():
        part = raw.filter((F.col("row_id") % 16).between(low, high)).orderBy("row_id").select(*schemas.RAW_QA.names)
        part.write.json(f"{path}/{name}", ignoreNullFields=False)
    release(raw)
    return read_raw_qa(spark, f"{path}/*", "json")


def roundtrip_file_order(spark, sf_dir):
    """Rows numbered in the order of files and lines."""
    return _in_files(spark, sf_dir).select("row_id", *schemas.RAW_QA.names)


def dedup_file_order(spark, sf_dir):
    """The first row of every question in the order of files and lines."""
    return C.first_per_key(C.with_qa(_in_files(spark, sf_dir)), "q", "row_id").select("row_id", "q", "a")


def _spoiled_lines(spark, sf_dir):
    """Path of lines of which every seventh is spoiled in one of five ways."""
    path = fresh_path(spark, "lines")
    good = F.to_json(F.struct(*schemas.INSTRUCTION.names))
    way = F.floor(F.col("row_id") / 7) % 5
    bad = (F.when(way == 0, F.lit("{'instruction': 'x'}")).when(way == 1, F.concat(good, F.lit(" junk")))
           .when(way == 2, F.concat(good, good)).when(way == 3, F.concat(F.lit("["), good, F.lit("]")))
           .otherwise(F.lit("\u00a0")))
    A.records(spark, sf_dir).select(F.when(F.col("row_id") % 7 == 0, bad).otherwise(good).alias("value")).write.text(path)
    return path


def roundtrip_tolerant(spark, sf_dir):
    return read_jsonl_tolerant(spark, _spoiled_lines(spark, sf_dir))


def reject_budget(spark, sf_dir):
    """Records of a source with at most a quarter of unreadable lines, and how many there were."""
    records, counts = read_jsonl_within(spark, _spoiled_lines(spark, sf_dir), 0.25)
    kept = records.groupBy("input").agg(F.count(F.lit(1)).alias("records"))
    return kept.select("input", "records", *[F.lit(counts[c]).cast("long").alias(c) for c in ("lines", "rejected")])


def roundtrip_csv(spark, sf_dir):
    path = fresh_path(spark, "csv")
    texts = A.table(spark, sf_dir, "documents").select("text")
    texts.write.options(header=True, quoteAll=True, quote='"', escape='"').csv(path)
    return read_training_csv(spark, path)


def roundtrip_index(spark, sf_dir):
    path = fresh_path(spark, "index")
    write_index(A.index(spark, sf_dir), path)
    return read_index(spark, path).select("doc_id", "doc_text", F.col("embedding")[0].cast("double").alias("first"),
                                          F.size("embedding").cast("long").alias("dim"))


def roundtrip_training(spark, sf_dir):
    path = fresh_path(spark, "training")
    write_training(training_set(spark, sf_dir), path)
    return spark.read.schema("row_id long, text string, split string").json(path)


def batch_encoder(spark, sf_dir):
    """Vectors of a stand-in model: characters and line breaks."""
    encoder = BatchEncoder(lambda: lambda texts: [[len(t), t.count("\n")] for t in texts])
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoder.encode(docs, "text").select(
        "doc_id", F.col("embedding")[0].cast("long").alias("n_chars"), F.col("embedding")[1].cast("long").alias("n_breaks"))


# -- gates -------------------------------------------------------------------------------------

def coalesce_qa(spark, sf_dir):
    return C.with_qa(A.raw_qa_with_instructions(spark, sf_dir)).select("row_id", "q", "a")


def length_gate(spark, sf_dir):
    qa = C.with_qa(A.raw_qa(spark, sf_dir)).select("row_id", "q", "a")
    return qa.filter(C.long_enough(F.col("q"), F.col("a")))


def keyword_gate(spark, sf_dir):
    qa = C.with_qa(A.raw_qa(spark, sf_dir)).select("row_id", "q")
    return qa.filter(C.on_topic(F.col("q"), LATIN))


def valid_pairs(spark, sf_dir):
    flags = C.gate_flags(C.with_qa(A.raw_qa(spark, sf_dir)), LATIN)
    reason = C.reject_reason()
    return flags.select("row_id", reason.isNull().alias("valid"), reason.alias("reject_reason"))


def dropna_reply(spark, sf_dir):
    return PP.answered(A.raw_qa(spark, sf_dir)).select("row_id", "category", "question", "reply")


# -- text --------------------------------------------------------------------------------------

def word_counts(spark, sf_dir):
    return A.raw_qa(spark, sf_dir).select(
        "row_id",
        X.word_count(F.col("question")).alias("question_words"),
        X.word_count(F.col("reply")).alias("reply_words"),
        X.word_count(F.col("q_body"), none_as_text=True).alias("q_body_words"),
        X.word_count(F.col("a_body"), none_as_text=True).alias("a_body_words"),
    )


def char_lengths(spark, sf_dir):
    return A.raw_qa(spark, sf_dir).select(
        "row_id",
        X.char_count(F.col("question"), none_as_text=True).alias("question_len"),
        X.char_count(F.col("reply")).alias("reply_len"),
    )


def clean_text(spark, sf_dir):
    return C.cleaned(A.noisy_text(spark, sf_dir), ["text"], LATIN)


# -- chat --------------------------------------------------------------------------------------

def template_prompt(spark, sf_dir):
    return PT.template_records(A.records(spark, sf_dir)).select("row_id", "text")


def chatml_records(spark, sf_dir):
    return PT.chatml_records(A.records(spark, sf_dir)).select("row_id", "text")


def chat_render(spark, sf_dir):
    return render_conversations(A.table(spark, sf_dir, "conversations"))


def chat_render_parts(spark, sf_dir):
    return render_conversations(A.table(spark, sf_dir, "conversations"), turns_per_row=2)


def build_rag_docs(spark, sf_dir):
    return PR.documents(A.records(spark, sf_dir))


def prompt_messages(spark, sf_dir):
    """Both message lists of every request, one row per message, with the rendered prompt."""
    kinds = F.array(*[
        F.struct(F.lit(context is not None).alias("rag"), chat.prompt_messages(F.col("question"), context).alias("m"))
        for context in (None, F.col("answer"))
    ])
    both = (
        A.answered_turns(spark, sf_dir).select("conv_id", "turn", F.inline(kinds))
        .withColumn("prompt", chat.render_messages(F.col("m")))
    )
    return both.select("conv_id", "turn", "rag", "prompt", F.posexplode("m").alias("pos", "msg")).select(
        "conv_id", "turn", "rag", F.col("pos").cast("long").alias("pos"),
        F.col("msg.role").alias("role"), F.col("msg.content").alias("content"), "prompt",
    )


# -- requests and answers ----------------------------------------------------------------------

def validate_requests(spark, sf_dir):
    return R.validate_requests(A.requests(spark, sf_dir)).drop("conv_id")


def response_records(spark, sf_dir):
    answers = A.answered_turns(spark, sf_dir).select(
        "conv_id", "turn", F.concat(F.lit("\n "), F.col("answer"), F.lit(" ")).alias("answer"),
        (F.length("answer") / F.lit(7.0)).alias("elapsed"))
    return R.response_records(answers, "answer", "elapsed", "cpu", True)


def compare_answers(spark, sf_dir):
    return R.compare_answers(A.answers_by_model(spark, sf_dir), ["base", "tuned"], ["conv_id", "turn"])


# -- profile -----------------------------------------------------------------------------------

def column_profile(spark, sf_dir):
    return PP.columns(A.raw_qa(spark, sf_dir))


def duplicate_rows(spark, sf_dir):
    return N.duplicate_rows(A.raw_qa(spark, sf_dir), schemas.RAW_QA.names)


def describe_numeric(spark, sf_dir):
    return _rounded(PP.body_counts(A.raw_qa(spark, sf_dir)))


def describe_lengths(spark, sf_dir):
    return _rounded(D.describe(PP.numeric_counts(_lengths(spark, sf_dir))))


def describe_events(spark, sf_dir):
    """A continuous column: nearly every value is different."""
    events = A.table(spark, sf_dir, "events")
    vc = D.value_counts(events, {"value": F.col("value")}, ["event_type"])
    return _rounded(D.describe(vc, ["event_type", "series"]))


def category_counts(spark, sf_dir):
    return PP.categories(A.raw_qa(spark, sf_dir))


def category_value_counts(spark, sf_dir):
    return N.category_counts(PP.answered(A.raw_qa(spark, sf_dir))).orderBy(F.desc("n"), "category")


def category_share(spark, sf_dir):
    return N.category_share(PP.answered(A.raw_qa(spark, sf_dir)))


def top_words_answers(spark, sf_dir):
    return N.top_words(PP.answered(A.raw_qa(spark, sf_dir)), "reply")


def top_words_questions(spark, sf_dir):
    return N.top_words(PP.answered(A.raw_qa(spark, sf_dir)), "question")


def corr_matrix(spark, sf_dir):
    return _rounded(PP.correlations(A.raw_qa(spark, sf_dir)))


def _landed(spark, sf_dir, entry):
    """An entry of the profile of raw rows that land in three batches of different size, the second one twice."""
    raw = written(A.raw_qa(spark, sf_dir), "raw")
    store = PP.ProfileStore(spark, fresh_path(spark, "profile"))
    part = F.when(F.col("row_id") % 10 < 6, 0).when(F.col("row_id") % 10 < 7, 1).otherwise(2)
    for batch in (0, 1, 1, 2):
        store.add(raw.filter(part == batch), batch)
    release(raw)
    return store.profile([entry])[entry]


def describe_by_batches(spark, sf_dir):
    return _rounded(_landed(spark, sf_dir, "describe"))


def top_words_by_batches(spark, sf_dir):
    return _landed(spark, sf_dir, "top_words_answers")


def scatter_sample(spark, sf_dir):
    """Raw points of question and answer length: forty of each category, picked by hash."""
    raw = A.raw_qa(spark, sf_dir).select("row_id", "category", F.length(F.coalesce("question", "q_body")).cast("long").alias("x"),
                                         F.length(F.coalesce("reply", "a_body")).cast("long").alias("y"))
    return hash_sample(written(raw.filter("x is not null and y is not null"), "points"), "row_id", 40, ["category"])


def _event_counts(spark, sf_dir):
    """Values of the events, a continuous column: nearly every value is distinct."""
    return D.value_counts(A.table(spark, sf_dir, "events"), {"value": F.col("value")}, ["event_type"])


def histogram_events(spark, sf_dir):
    return _rounded(D.histogram(_event_counts(spark, sf_dir), ["event_type", "series"], whole=False))


def kde_events(spark, sf_dir):
    return _rounded(D.kde(_event_counts(spark, sf_dir), ["event_type", "series"]), density=9)


def boxplot_events(spark, sf_dir):
    return _rounded(D.boxplot(_event_counts(spark, sf_dir), ["event_type", "series"]))


def length_histogram(spark, sf_dir):
    return _rounded(D.histogram(PP.char_lengths(_lengths(spark, sf_dir))))


def boxplot_overall(spark, sf_dir):
    return _rounded(D.boxplot(PP.char_lengths(_lengths(spark, sf_dir))))


def top_category_boxplot(spark, sf_dir):
    # stored because the summaries read it repeatedly
    return _rounded(D.boxplot(written(PP.top_category_counts(_lengths(spark, sf_dir)), "value-counts"), ["category"]))


def top_category_mean_ci(spark, sf_dir):
    return _rounded(D.mean_interval(N.in_top_categories(_lengths(spark, sf_dir)), "reply_len", "category"))


def top_category_mean_bootstrap(spark, sf_dir):
    top = N.in_top_categories(_lengths(spark, sf_dir))
    return _rounded(D.mean_interval_bootstrap(top, "reply_len", "category", "row_id"))


def length_kde(spark, sf_dir):
    vc = PP.char_lengths(_lengths(spark, sf_dir))
    overlap = D.kde(vc).select(F.lit("overlap").alias("curve"), "*")
    overlay = D.kde(vc, cut=0.0).select(F.lit("histogram").alias("curve"), "*")
    return _rounded(overlap.unionByName(overlay), density=9)


def violin_summary(spark, sf_dir):
    return _rounded(D.violin(PP.char_lengths(_lengths(spark, sf_dir))), density=9)


def scatter_bins(spark, sf_dir):
    return D.grid_counts(written(_lengths(spark, sf_dir), "measures"), [("question_len", "reply_len")])


def pair_matrix(spark, sf_dir):
    return PP.pair_matrix(written(_lengths(spark, sf_dir), "measures"))


def pair_diagonal(spark, sf_dir):
    return _rounded(D.kde(PP.numeric_counts(_lengths(spark, sf_dir))), density=9)


def length_ecdf(spark, sf_dir):
    return _rounded(D.ecdf(PP.char_lengths(_lengths(spark, sf_dir))))


def length_unpivot(spark, sf_dir):
    return PP.length_unpivot(_lengths(spark, sf_dir))


# -- curation, training, retrieval -------------------------------------------------------------

def dedup_first(spark, sf_dir):
    qa = C.with_qa(A.raw_qa(spark, sf_dir)).select("row_id", "q", "a")
    return C.first_per_key(qa, "q", "row_id")


def curate_qa(spark, sf_dir):
    return PC.curate(A.raw_qa(spark, sf_dir), LATIN)


def curation_funnel(spark, sf_dir):
    return PC.curation_funnel(A.raw_qa(spark, sf_dir), LATIN)


def split_95_5(spark, sf_dir):
    return split_exact(A.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def training_set(spark, sf_dir):
    return PT.training_set(written(curate_qa(spark, sf_dir), "curated"))


def split_sizes(spark, sf_dir):
    return PT.split_sizes(training_set(spark, sf_dir))


def curate_marks(spark, sf_dir):
    """Curation with a profile that strips marks and names no personal keyword."""
    return PC.curate(A.raw_qa(spark, sf_dir), MARKS)


def normalize_marks(spark, sf_dir):
    return A.noisy_text(spark, sf_dir).select("doc_id", X.normalize(F.col("text"), MARKS).alias("text"))


def knn_top2(spark, sf_dir):
    """The two nearest vectors to the mean vector of each label, among vectors of which some are unusable."""
    vectors = A.spoiled_vectors(spark, sf_dir)
    return _rounded(nearest(vectors, A.label_means(spark, sf_dir), 2).withColumn("rank", F.col("rank").cast("long")))


def knn_all_top2(spark, sf_dir):
    """The two nearest vectors to every vector, by the cells of a stored index."""
    path = fresh_path(spark, "index")
    write_index(A.spoiled_vectors(spark, sf_dir).withColumn("doc_text", F.lit("")), path)
    index = read_index(spark, path)
    hits = nearest(index, index.select(F.col("doc_id").alias("query_id"), "embedding"), 2, cells=read_cells(spark, path))
    return _rounded(hits.withColumn("rank", F.col("rank").cast("long")))


def rag_prompts(spark, sf_dir):
    asked = R.validate_requests(A.requests(spark, sf_dir)).filter("status = 200")
    asked = A.with_query_vectors(asked.select("request_id", "conv_id", "message"), spark, sf_dir)
    return PR.rag_prompts(asked, A.index(spark, sf_dir)).select("request_id", "prompt")


def tfidf_embed(spark, sf_dir):
    """Non-zero weights of the document vectors."""
    encoder = TfidfEncoder()
    counts = written(encoder.counts(PR.documents(A.records(spark, sf_dir)), "doc_text").select("doc_id", "tf"), "tf")
    vectors = encoder.fit_counts(counts).weights(counts)
    weights = vectors.select("doc_id", F.inline("weights")).filter("weight <> 0")
    return _rounded(weights.withColumn("bucket", F.col("bucket").cast("long")))


def tfidf_rag_prompts(spark, sf_dir):
    """Curated documents, embedded and indexed; prompts for all accepted requests."""
    curated = written(curate_qa(spark, sf_dir), "curated")
    encoder = TfidfEncoder().fit(PR.documents(curated), "doc_text")
    index = PR.build_index(curated, encoder)
    asked = R.validate_requests(A.requests(spark, sf_dir)).filter("status = 200")
    asked = asked.select("request_id", "message")
    return PR.rag_prompts(encoder.encode(asked, "message"), index).select("request_id", "prompt")


# -- streams -----------------------------------------------------------------------------------

def _stream(spark, sf_dir, name):
    """A table as a stream of files; the pattern matches a single file as well as a folder of parts."""
    schema = A.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def stream_requests(spark, sf_dir):
    base = fresh_path(spark, "stream-requests")
    index = A.index(spark, sf_dir)
    return prompt_stream(
        A.requests_from_turns(_stream(spark, sf_dir, "conversations")), f"{base}/table", f"{base}/checkpoint",
        lambda accepted: A.with_query_vectors(accepted, spark, sf_dir), index,
    ).read()


def stream_curate(spark, sf_dir):
    base = fresh_path(spark, "stream-curate")
    raw = A.raw_from_documents(_stream(spark, sf_dir, "documents"))
    return curate_stream(raw, f"{base}/table", f"{base}/checkpoint", LATIN).read()


QUERIES = {
    "curate_qa": curate_qa,
    "scan_raw": scan_raw,
    "head_n": head_n,
    "qa_report": qa_report,
    "panel_prompts": panel_prompts,
    "roundtrip_raw": roundtrip_raw,
    "roundtrip_instructions": roundtrip_instructions,
    "roundtrip_tolerant": roundtrip_tolerant,
    "reject_budget": reject_budget,
    "roundtrip_file_order": roundtrip_file_order,
    "dedup_file_order": dedup_file_order,
    "roundtrip_csv": roundtrip_csv,
    "roundtrip_index": roundtrip_index,
    "roundtrip_training": roundtrip_training,
    "batch_encoder": batch_encoder,
    "coalesce_qa": coalesce_qa,
    "length_gate": length_gate,
    "keyword_gate": keyword_gate,
    "valid_pairs": valid_pairs,
    "dropna_reply": dropna_reply,
    "normalize_text": _text(lambda c: X.normalize(c, LATIN)),
    "strip_urls": _text(X.strip_urls),
    "strip_emails": _text(X.strip_emails),
    "cut_number_tail": _text(X.cut_number_tail),
    "cut_signature": _text(lambda c: X.cut_signature(c, LATIN)),
    "collapse_ws": _text(X.collapse_spaces),
    "clean_text": clean_text,
    "word_counts": word_counts,
    "char_lengths": char_lengths,
    "template_prompt": template_prompt,
    "chatml_records": chatml_records,
    "chat_render": chat_render,
    "chat_render_parts": chat_render_parts,
    "build_rag_docs": build_rag_docs,
    "prompt_messages": prompt_messages,
    "validate_requests": validate_requests,
    "response_records": response_records,
    "compare_answers": compare_answers,
    "column_profile": column_profile,
    "duplicate_rows": duplicate_rows,
    "describe_numeric": describe_numeric,
    "describe_lengths": describe_lengths,
    "describe_events": describe_events,
    "category_counts": category_counts,
    "category_value_counts": category_value_counts,
    "category_share": category_share,
    "top_words_answers": top_words_answers,
    "top_words_questions": top_words_questions,
    "corr_matrix": corr_matrix,
    "length_histogram": length_histogram,
    "describe_by_batches": describe_by_batches,
    "top_words_by_batches": top_words_by_batches,
    "scatter_sample": scatter_sample,
    "histogram_events": histogram_events,
    "kde_events": kde_events,
    "boxplot_events": boxplot_events,
    "boxplot_overall": boxplot_overall,
    "top_category_boxplot": top_category_boxplot,
    "top_category_mean_ci": top_category_mean_ci,
    "top_category_mean_bootstrap": top_category_mean_bootstrap,
    "length_kde": length_kde,
    "violin_summary": violin_summary,
    "scatter_bins": scatter_bins,
    "pair_matrix": pair_matrix,
    "pair_diagonal": pair_diagonal,
    "length_ecdf": length_ecdf,
    "length_unpivot": length_unpivot,
    "dedup_first": dedup_first,
    "curation_funnel": curation_funnel,
    "split_95_5": split_95_5,
    "training_set": training_set,
    "split_sizes": split_sizes,
    "curate_marks": curate_marks,
    "normalize_marks": normalize_marks,
    "knn_top2": knn_top2,
    "knn_all_top2": knn_all_top2,
    "rag_prompts": rag_prompts,
    "tfidf_embed": tfidf_embed,
    "tfidf_rag_prompts": tfidf_rag_prompts,
    "stream_requests": stream_requests,
    "stream_curate": stream_curate,
}
