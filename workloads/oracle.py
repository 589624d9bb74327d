"""DuckDB SQL with the same result as the registered queries, over the same whole tables."""

from tamhis import profiles as P
from tamhis.functions.chat import ASSISTANT_TURN
from tamhis.operators.distributions import POISSON_LIMITS
from tamhis.profiles import LATIN


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# -- table shapes ------------------------------------------------------------------------------

RAW = """
split AS (
  SELECT *, lang IN ('fr', 'es') AS body, split_part(text, chr(10), 1) AS first,
         CASE WHEN contains(text, chr(10)) THEN substr(text, length(split_part(text, chr(10), 1)) + 2) END AS rest
  FROM documents),
pieces AS (
  SELECT *, rest || chr(10) || 'Dr. ' || source AS signed, rest || chr(10) || '5' || chr(10) || ' ' || source AS rated
  FROM split),
raw AS (
  SELECT doc_id AS row_id, lang,
         CASE WHEN body THEN first END AS q_body,
         CASE WHEN body THEN signed END AS a_body,
         source, CASE WHEN doc_id % 53 <> 0 THEN source END AS category,
         len(regexp_extract_all(first, '\\S+'))::DOUBLE AS q_body_count,
         len(regexp_extract_all(CASE WHEN body THEN signed ELSE rated END, '\\S+'))::DOUBLE AS a_body_count,
         CASE WHEN NOT body THEN first END AS question,
         CASE WHEN NOT body THEN rated END AS reply
  FROM pieces)"""
RAW_COLUMNS = "q_body, a_body, category, q_body_count, a_body_count, question, reply"


def first_of(*columns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({c}, '')" for c in columns) + ", '')"


QA = RAW + f""",
qa AS (SELECT row_id, {first_of('question', 'q_body')} AS q, {first_of('reply', 'a_body')} AS a FROM raw)"""


def words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '\\S+'))"


def normalized(c: str, marks: str = "") -> str:
    bare = f"regexp_replace({c}, {lit(marks)}, '', 'g')" if marks else c
    folded = f"translate({bare}, {lit(LATIN.fold_from)}, {lit(LATIN.fold_to)})"
    return f"""(
      SELECT coalesce(string_agg(l[i], '' ORDER BY i), '')
      FROM (SELECT string_split({folded}, '') AS l) AS chars, unnest(range(1, len(l) + 1)) AS t(i)
      WHERE l[i] = chr(10) OR i = 1 OR l[i] <> l[i - 1]
         OR NOT ((i > 2 AND l[i] = l[i - 2]) OR (i < len(l) AND l[i] = l[i + 1])))"""


def any_of(c: str, needles) -> str:
    return "FALSE" if not needles else "(" + " OR ".join(f"contains({c}, {lit(n)})" for n in needles) + ")"


# The four cleaning patterns in this dialect.
def no_urls(c: str) -> str:
    return rf"regexp_replace({c}, 'http\S+|www\S+', '', 'g')"


def no_emails(c: str) -> str:
    return rf"regexp_replace({c}, '\S*@\S*\s?', '', 'g')"


def no_number_tail(c: str) -> str:
    return rf"regexp_replace({c}, '\n\s*\p{{Nd}}+\s*(\n.*)?$', '', 's')"


def no_signature(c: str) -> str:
    return rf"regexp_replace({c}, '\n\s*(Dr\.|Source:).*$', '', 's')"


def one_space(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def stripped(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def cleaned(c: str) -> str:
    return one_space(no_signature(no_number_tail(no_emails(no_urls(c)))))


def gates(personal=LATIN.personal, marks: str = "") -> str:
    return QA + f""",
normal AS (SELECT *, {normalized('q', marks)} AS nq FROM qa),
gates AS (
  SELECT row_id, q, a, q <> '' AND a <> '' AS non_empty,
         {words('a')} >= 15 AND {words('q')} >= 3 AS long_enough,
         {any_of('nq', LATIN.general)} AS general, {any_of('nq', personal)} AS personal
  FROM normal)"""


def curated(gated: str) -> str:
    return gated + f""",
clean AS (
  SELECT row_id, {cleaned('q')} AS instruction, '' AS input, {cleaned('a')} AS output
  FROM gates WHERE non_empty AND long_enough AND general AND NOT personal),
curated AS (
  SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY instruction ORDER BY row_id) = 1)"""


GATES, MARKS = gates(), "[.,]"
CURATED = curated(GATES)

NOISY = """
noisy AS (
  SELECT doc_id, 'see http://x.example/' || doc_id || ' or www.x.example' || chr(10) || text || ' ask me@' || source
         || '.org now' || chr(10) || ' ' || chr(10) || 'Dr. ' || lang || chr(10) || n_chars || chr(10) || ' end' AS text
  FROM documents)"""

RECORDS = """
records AS (
  SELECT doc_id AS row_id, split_part(text, chr(10), 1) AS instruction,
         CASE WHEN lang = 'en' THEN '' ELSE lang END AS input, text AS output
  FROM documents)"""

REQUESTS = """
requests AS (
  SELECT conv_id || '-' || turn AS request_id,
         CASE WHEN (conv_id + turn) % 10 = 3 THEN ' ' || chr(10) || '  ' ELSE text END AS message,
         nullif((conv_id * 37 + turn * 101) % 24 * 50, 0) AS max_tokens,
         CASE WHEN turn > 0 THEN ((conv_id + turn) % 19)::DOUBLE / 10 END AS temperature, conv_id
  FROM conversations WHERE role = 'user'),
filled AS (
  SELECT request_id, message, coalesce(max_tokens, 512)::BIGINT AS max_tokens,
         coalesce(temperature, 0.3::DOUBLE) AS temperature, conv_id
  FROM requests),
bad AS (
  SELECT *, concat_ws(',',
     CASE WHEN length(message) BETWEEN 2 AND 2000 THEN NULL ELSE 'message' END,
     CASE WHEN max_tokens BETWEEN 64 AND 1024 THEN NULL ELSE 'max_tokens' END,
     CASE WHEN temperature >= 0.1::DOUBLE AND temperature <= 1.5::DOUBLE THEN NULL ELSE 'temperature' END) AS fields
  FROM filled),
validated AS (
  SELECT request_id, message, max_tokens, temperature, conv_id,
         CASE WHEN fields <> '' THEN 422 WHEN trim(message, ' ' || chr(10)) = '' THEN 400 ELSE 200 END::BIGINT AS status,
         CASE WHEN fields <> '' THEN fields WHEN trim(message, ' ' || chr(10)) = '' THEN 'Message is empty.' END AS error
  FROM bad)"""

ANSWERED = """
answered AS (
  SELECT u.conv_id, u.turn, u.text AS question, s.text AS answer
  FROM conversations u JOIN conversations s ON s.conv_id = u.conv_id AND s.turn = u.turn + 1
  WHERE u.role = 'user' AND s.role = 'assistant')"""
PANEL = """
panel AS (
  SELECT u.conv_id, u.turn, u.text AS question, coalesce(s.text, '') AS answer
  FROM conversations u LEFT JOIN conversations s ON s.conv_id = u.conv_id AND s.turn = u.turn + 1 AND s.role = 'assistant'
  WHERE u.role = 'user')"""

LENGTHS = RAW + f""",
lengths AS (
  SELECT row_id, category, length(question) AS question_len, length(reply) AS reply_len,
         {words('question')} AS question_word_count, {words('reply')} AS answer_word_count
  FROM raw WHERE reply IS NOT NULL)"""

CHARS = LENGTHS + """,
vals AS (
  SELECT 'Question' AS series, question_len::DOUBLE AS value FROM lengths WHERE question_len IS NOT NULL
  UNION ALL SELECT 'Answer', reply_len::DOUBLE FROM lengths WHERE reply_len IS NOT NULL)"""

NUMBERS = LENGTHS + """,
vals AS (
  SELECT 'Q Len' AS series, question_len::DOUBLE AS value FROM lengths
  UNION ALL SELECT 'A Len', reply_len::DOUBLE FROM lengths
  UNION ALL SELECT 'Q Words', question_word_count::DOUBLE FROM lengths
  UNION ALL SELECT 'A Words', answer_word_count::DOUBLE FROM lengths)"""

TOP6 = LENGTHS + """,
names AS (
  SELECT category FROM lengths WHERE category IS NOT NULL GROUP BY category ORDER BY count(*) DESC, category LIMIT 6),
top6 AS (SELECT * FROM lengths WHERE category IN (SELECT category FROM names))"""


def stats(key: str) -> str:
    return f"""
stats AS (
  SELECT {key}, count(*) AS cnt, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS lo, max(value) AS hi,
         quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
  FROM vals GROUP BY {key})"""


DESCRIBED = """SELECT {keys}, cnt AS count, round(mean, 6) AS mean, round(std, 6) AS std, round(lo, 6) AS min, round(q1, 6) AS q1,
           round(median, 6) AS median, round(q3, 6) AS q3, round(hi, 6) AS max FROM stats"""


def boxplot(key: str) -> str:
    return f"""
fenced AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS hf FROM stats)
SELECT {key}, cnt AS count, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(least(min(value) FILTER (value BETWEEN lf AND hf), q1), 6) AS whisker_low,
       round(greatest(max(value) FILTER (value BETWEEN lf AND hf), q3), 6) AS whisker_high,
       count(*) FILTER (value NOT BETWEEN lf AND hf) AS outliers
FROM vals JOIN fenced USING ({key}) GROUP BY {key}, cnt, q1, median, q3"""


def kde(points: int, cut: float, name: str) -> str:
    return f"""
{name}_shape AS (
  SELECT series, cnt, std * pow(cnt, -0.2) AS bw, lo - {cut} * std * pow(cnt, -0.2) AS start,
         (hi - lo + {2 * cut} * std * pow(cnt, -0.2)) / {points - 1} AS step
  FROM stats WHERE std > 0),
{name}_grid AS (
  SELECT *, start + point * step AS x FROM {name}_shape, range({points}) AS t(point)),
{name} AS (
  SELECT series, point, x, sum(exp(-0.5 * ((x - value) / bw) * ((x - value) / bw))) / (any_value(cnt) * any_value(bw) * sqrt(2 * pi())) AS density
  FROM {name}_grid JOIN vals USING (series) GROUP BY series, point, x)"""


def describe_count(columns, where: str = "TRUE", stage: str = "") -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{stage}' AS stage, '{c}' AS column, '{'double' if c.endswith('_count') else 'string'}' AS dtype, "
        f"count(*) AS n, count({c}) AS non_null, count(*) - count({c}) AS nulls FROM raw WHERE {where}"
        for c in columns
    )


def grid(pairs, bins: int) -> str:
    columns = sorted({c for pair in pairs for c in pair})
    bounds = ", ".join(f'min("{c}")::DOUBLE AS "{c}_lo", max("{c}")::DOUBLE AS "{c}_hi"' for c in columns)

    def index(c):
        width = f'(("{c}_hi" - "{c}_lo") / {bins}.0::DOUBLE)'
        guess = f'least(floor(("{c}" - "{c}_lo") / {width}), {bins - 1})'
        return (f'CASE WHEN {width} <= 0 THEN 0 ELSE {guess} - (CASE WHEN "{c}" < "{c}_lo" + {guess} * {width} THEN 1 ELSE 0 END)'
                f' + (CASE WHEN {guess} < {bins - 1} AND "{c}" >= "{c}_lo" + ({guess} + 1) * {width} THEN 1 ELSE 0 END) END')

    parts = "\nUNION ALL ".join(
        f"""SELECT '{x}' AS x, '{y}' AS y, ({index(x)})::BIGINT AS x_bin, ({index(y)})::BIGINT AS y_bin
        FROM frame, bounds WHERE "{x}" IS NOT NULL AND "{y}" IS NOT NULL""" for x, y in pairs)
    return f"""
bounds AS (SELECT {bounds} FROM frame), cells AS ({parts})
SELECT x, y, x_bin, y_bin, count(*) AS n FROM cells GROUP BY ALL"""


def top_words(c: str) -> str:
    return f"""WITH {RAW}, w AS (SELECT unnest(regexp_extract_all({c}, '\\S+')) AS word FROM raw WHERE reply IS NOT NULL)
SELECT word, count(*) AS n FROM w WHERE length(word) > 2 GROUP BY word ORDER BY n DESC, word LIMIT 10"""


def correlations(columns) -> str:
    return f"WITH {RAW}, frame AS (SELECT q_body_count, a_body_count, length(question) AS question_len, length(reply) AS reply_len FROM raw WHERE reply IS NOT NULL)\n" + \
        "\nUNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS r FROM frame"
                            for x in columns for y in columns)


def chat(*turns: tuple[str, str]) -> str:
    return " || chr(10) || ".join(f"'<|im_start|>{role}' || chr(10) || {content} || '<|im_end|>'" for role, content in turns)


RAG_SYSTEM = lit(f"{P.SYSTEM_PROMPT}\n{P.RAG_INSTRUCTION}")


def rag_user(question: str, context: str) -> str:
    return f"{lit(P.REFERENCE_HEADER)} || chr(10) || {context} || chr(10) || chr(10) || {lit(P.QUESTION_HEADER)} || chr(10) || {question}"


def prompt(system: str, user: str) -> str:
    return f"{chat(('system', system), ('user', user))} || chr(10) || {lit(ASSISTANT_TURN)}"


CHATML = chat(
    ("system", lit(P.SYSTEM_PROMPT)),
    ("user", f"{stripped('instruction')} || CASE WHEN {stripped('input')} <> '' THEN chr(10) || {stripped('input')} ELSE '' END"),
    ("assistant", stripped("output")),
)
SPLIT = """
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || {key}), {key}) AS r, count(*) OVER () AS n FROM {table})"""
TEST_ROW = "CASE WHEN r <= ceil(n * 0.05::DOUBLE) THEN 'test' ELSE 'train' END AS split"


FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def nearest(index: str, queries: str) -> str:
    return f"""
pairs AS (
  SELECT q.query_id, d.doc_id, list_distance(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS distance
  FROM (SELECT * FROM {queries} WHERE {FINITE}) q JOIN (SELECT * FROM {index} WHERE {FINITE}) d ON len(q.embedding) = len(d.embedding)),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM pairs QUALIFY rank <= 2)"""


SPOILED = """
items AS (
  SELECT vec_id AS doc_id, CASE
    WHEN vec_id % 97 <> 0 THEN embedding
    WHEN vec_id // 97 % 4 = 0 THEN list_append(embedding[:-2], 'nan'::FLOAT)
    WHEN vec_id // 97 % 4 = 1 THEN list_append(embedding[:-2], 'inf'::FLOAT)
    WHEN vec_id // 97 % 4 = 2 THEN list_append(embedding[:-2], NULL)
    ELSE embedding[:-2] END AS embedding
  FROM embeddings)"""

PROMPTED = REQUESTS + f""",
idx AS (SELECT doc_id, text AS doc_text, embedding FROM documents JOIN embeddings ON vec_id = doc_id),
asked AS (
  SELECT v.*, embedding FROM validated v
  LEFT JOIN embeddings ON vec_id = conv_id * 3 + split_part(request_id, '-', 2)::BIGINT WHERE status = 200),
queries AS (SELECT request_id AS query_id, embedding FROM asked),
{nearest('idx', 'queries')},
contexts AS (
  SELECT query_id AS request_id, string_agg(doc_text, chr(10) || chr(10) ORDER BY rank) AS context
  FROM hits JOIN idx USING (doc_id) GROUP BY query_id),
prompted AS (
  SELECT request_id, status, error, CASE WHEN embedding IS NULL THEN {prompt(lit(P.SYSTEM_PROMPT), 'message')}
         ELSE {prompt(RAG_SYSTEM, rag_user('message', "coalesce(context, '')"))} END AS prompt
  FROM asked LEFT JOIN contexts USING (request_id))"""


def buckets(source: str, key: str, column: str, name: str) -> str:
    return f"""
{name}_words AS (SELECT {key}, unnest(regexp_split_to_array(lower({column}), '\\s+')) AS w FROM {source}),
{name}_tf AS (SELECT {key}, ('0x' || md5(w)[1:4])::INT % 256 AS bucket, count(*) AS tf FROM {name}_words WHERE w <> '' GROUP BY ALL)"""


def weights(name: str, key: str, idf: str) -> str:
    return f"""
{name}_raw AS (SELECT {key}, bucket, tf * idf AS w FROM {name}_tf JOIN {idf} USING (bucket)),
{name}_weights AS (
  SELECT {key}, bucket, CASE WHEN norm > 0 THEN w / norm ELSE 0 END AS weight
  FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY {key})) AS norm FROM {name}_raw))"""


def idf(source: str) -> str:
    return f"""
idf AS (
  SELECT bucket, ln(((SELECT count(*) FROM {source}) + 1.0::DOUBLE) / (coalesce(df, 0) + 1.0::DOUBLE)) AS idf
  FROM range(256) AS r(bucket) LEFT JOIN (SELECT bucket, count(*) AS df FROM doc_tf GROUP BY bucket) USING (bucket))"""


def vectors(name: str, source: str, key: str) -> str:
    return f"""
{name}_vectors AS (
  SELECT k.{key}, list(coalesce(weight, 0.0::DOUBLE) ORDER BY b) AS embedding
  FROM (SELECT DISTINCT {key} FROM {source}) AS k CROSS JOIN range(256) AS r(b)
  LEFT JOIN {name}_weights AS w ON w.{key} = k.{key} AND w.bucket = b GROUP BY k.{key})"""


DOCS = f"""
texts AS (
  SELECT row_id AS doc_id, {stripped("instruction || ' ' || input")} AS q, {stripped('output')} AS a FROM {{records}}),
docs AS (
  SELECT doc_id, {lit(P.DOCUMENT_QUESTION)} || q || {lit(P.DOCUMENT_ANSWER)} || a AS doc_text FROM texts WHERE q <> '' AND a <> '')"""

TFIDF_PROMPTS = CURATED + f""", {DOCS.format(records='curated')}, {REQUESTS},
asked AS (SELECT request_id, message FROM validated WHERE status = 200),
{buckets('docs', 'doc_id', 'doc_text', 'doc')}, {idf('docs')}, {weights('doc', 'doc_id', 'idf')}, {vectors('doc', 'docs', 'doc_id')},
{buckets('asked', 'request_id', 'message', 'ask')}, {weights('ask', 'request_id', 'idf')}, {vectors('ask', 'asked', 'request_id')},
queries AS (SELECT request_id AS query_id, embedding FROM ask_vectors), {nearest('doc_vectors', 'queries')},
contexts AS (
  SELECT query_id AS request_id, string_agg(doc_text, chr(10) || chr(10) ORDER BY rank) AS context
  FROM hits JOIN docs USING (doc_id) GROUP BY query_id)"""

NUMERIC_COLUMNS = ("q_body_count", "a_body_count", "question_len", "reply_len")
PAIR_FRAME = """,
frame AS (SELECT question_len AS "Q Len", reply_len AS "A Len", question_word_count AS "Q Words", answer_word_count AS "A Words" FROM lengths),"""
PAIR_COLUMNS = ("Q Len", "A Len", "Q Words", "A Words")
REASON = """CASE WHEN NOT non_empty THEN 'empty' WHEN NOT long_enough THEN 'short'
       WHEN NOT general THEN 'not_general' WHEN personal THEN 'personal' END"""


def text_rule(expression: str) -> str:
    return f"WITH {NOISY} SELECT doc_id, {expression} AS text FROM noisy"


#: The order of rows in files that are named a to e and hold remainders of the row ids modulo 16.
FILE_ORDER = f"""{RAW},
filed AS (
  SELECT row_number() OVER (ORDER BY file, row_id) - 1 AS row_id, {RAW_COLUMNS}
  FROM (SELECT *, CASE row_id % 16 WHEN 3 THEN 'a' WHEN 0 THEN 'c' WHEN 1 THEN 'd' WHEN 2 THEN 'd' WHEN 4 THEN 'e' ELSE 'b' END AS file FROM raw))"""


EVENT_VALUES = "vals AS (SELECT event_type AS series, value FROM events WHERE value IS NOT NULL AND NOT isnan(value))"


def histogram(rule: str) -> str:
    """Counts of the bins of vals; ``rule`` makes a bin's width of the automatic one."""
    return f"""widths AS (
      SELECT *, hi - lo AS span, least(greatest(2.0::DOUBLE * (q3 - q1) / pow(cnt, 1.0::DOUBLE / 3), (hi - lo) / sqrt(cnt) / 2), (hi - lo) / (log2(cnt) + 1)) AS rule FROM stats),
    shape AS (SELECT series, lo, CASE WHEN span > 0 THEN ceil(span / {rule}) ELSE 1 END::BIGINT AS bins, span FROM widths),
    edges AS (
      SELECT series, bin, bins, lo + bin * (span / bins) AS l, lo + (bin + 1) * (span / bins) AS r
      FROM (SELECT *, unnest(range(bins)) AS bin FROM shape)),
    counted AS (
      SELECT e.series, bin, round(l, 6) AS "left", round(r, 6) AS "right", count(v.value) AS n
      FROM edges e LEFT JOIN vals v ON v.series = e.series AND (v.value >= l OR bin = 0) AND (v.value < r OR bin = bins - 1) GROUP BY ALL)"""


ORACLE_SQL = {
    "curate_qa": f"WITH {CURATED} SELECT row_id, instruction, input, output FROM curated",
    "scan_raw": f"WITH {RAW} SELECT row_id, {RAW_COLUMNS} FROM raw",
    "head_n": f"WITH {RAW} SELECT row_id, substr(coalesce(question, q_body), 1, 300) AS preview FROM raw ORDER BY row_id LIMIT 5",
    "qa_report": f"WITH {PANEL} SELECT conv_id, turn, {lit(P.REPORT_QUESTION)} || question || chr(10) || {lit(P.REPORT_ANSWER)} || answer AS lines FROM panel",
    "panel_prompts": f"""WITH {PANEL} SELECT conv_id, turn,
       {prompt(f"{lit(P.PANEL_HEAD)} || question || {lit(P.PANEL_TAIL)}", 'question')} AS prompt FROM panel""",
    "roundtrip_raw": f"WITH {RAW} SELECT row_id, {RAW_COLUMNS} FROM raw",
    "roundtrip_instructions": f"WITH {RECORDS} SELECT instruction, input, output FROM records",
    "roundtrip_tolerant": f"WITH {RECORDS} SELECT instruction, input, output FROM records WHERE row_id % 7 <> 0",
    "reject_budget": f"""WITH {RECORDS},
spoiled AS (SELECT *, row_id % 7 = 0 AS bad, row_id % 7 = 0 AND (row_id // 7) % 5 = 4 AS blank FROM records)
SELECT input, count(*) FILTER (NOT bad) AS records, (SELECT count(*) FROM spoiled WHERE NOT blank) AS lines,
       (SELECT count(*) FROM spoiled WHERE bad AND NOT blank) AS rejected
FROM spoiled GROUP BY input HAVING count(*) FILTER (NOT bad) > 0""",
    "roundtrip_file_order": f"WITH {FILE_ORDER} SELECT row_id, {RAW_COLUMNS} FROM filed",
    "dedup_file_order": f"""WITH {FILE_ORDER},
pairs AS (SELECT row_id, coalesce(nullif(question, ''), nullif(q_body, ''), '') AS q, coalesce(nullif(reply, ''), nullif(a_body, ''), '') AS a FROM filed)
SELECT min(row_id) AS row_id, q, arg_min(a, row_id) AS a FROM pairs GROUP BY q""",
    "roundtrip_csv": "SELECT text FROM documents",
    "roundtrip_index": """SELECT doc_id, text AS doc_text, embedding[1]::DOUBLE AS first, len(embedding) AS dim
       FROM documents JOIN embeddings ON vec_id = doc_id""",
    "roundtrip_training": f"WITH {CURATED}, {SPLIT.format(key='row_id', table='curated')} SELECT row_id, {CHATML} AS text, {TEST_ROW} FROM ranked",
    "batch_encoder": """SELECT doc_id, length(text) AS n_chars, length(text) - length(replace(text, chr(10), '')) AS n_breaks
       FROM documents""",
    "coalesce_qa": f"""WITH {RAW}, more AS (
      SELECT *, CASE WHEN lang = 'de' THEN 'Q: ' || source END AS instruction, CASE WHEN lang = 'de' THEN '' END AS output FROM raw)
    SELECT row_id, {first_of('instruction', 'question', 'q_body')} AS q, {first_of('output', 'reply', 'a_body')} AS a FROM more""",
    "length_gate": f"WITH {QA} SELECT row_id, q, a FROM qa WHERE q <> '' AND a <> '' AND {words('a')} >= 15 AND {words('q')} >= 3",
    "keyword_gate": f"WITH {GATES} SELECT row_id, q FROM gates WHERE general AND NOT personal",
    "valid_pairs": f"WITH {GATES} SELECT row_id, {REASON} IS NULL AS valid, {REASON} AS reject_reason FROM gates",
    "dropna_reply": f"WITH {RAW} SELECT row_id, category, question, reply FROM raw WHERE reply IS NOT NULL",
    "normalize_text": text_rule(normalized("text")),
    "strip_urls": text_rule(no_urls("text")),
    "strip_emails": text_rule(no_emails("text")),
    "cut_number_tail": text_rule(no_number_tail("text")),
    "cut_signature": text_rule(no_signature("text")),
    "collapse_ws": text_rule(one_space("text")),
    "clean_text": text_rule(cleaned("text")),
    "word_counts": f"""WITH {RAW} SELECT row_id, {words('question')} AS question_words, {words('reply')} AS reply_words,
       coalesce({words('q_body')}, 1) AS q_body_words, coalesce({words('a_body')}, 1) AS a_body_words FROM raw""",
    "char_lengths": f"WITH {RAW} SELECT row_id, length(coalesce(question, 'None')) AS question_len, length(reply) AS reply_len FROM raw",
    "template_prompt": f"WITH {RECORDS} SELECT row_id, {lit(P.TEMPLATE_HEAD)} || instruction || {lit(P.TEMPLATE_MIDDLE)} || output || '<|im_end|>' AS text FROM records",
    "chatml_records": f"WITH {RECORDS} SELECT row_id, {CHATML} AS text FROM records",
    "chat_render": f"""SELECT conv_id, 0::BIGINT AS part,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || {lit(ASSISTANT_TURN)} AS chat
     FROM conversations GROUP BY conv_id""",
    "chat_render_parts": f"""WITH numbered AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r, count(*) OVER (PARTITION BY conv_id) AS total
      FROM conversations)
    SELECT conv_id, r // 2 AS part, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)
           || CASE WHEN r // 2 = (any_value(total) - 1) // 2 THEN {lit(ASSISTANT_TURN)} ELSE '' END AS chat
    FROM numbered GROUP BY conv_id, r // 2""",
    "build_rag_docs": f"WITH {RECORDS}, {DOCS.format(records='records')} SELECT doc_id, doc_text FROM docs",
    "prompt_messages": f"""WITH {ANSWERED}, both_kinds AS (
      SELECT conv_id, turn, FALSE AS rag, {lit(P.SYSTEM_PROMPT)} AS s, question AS u FROM answered
      UNION ALL SELECT conv_id, turn, TRUE, {RAG_SYSTEM}, {rag_user('question', 'answer')} FROM answered)
    SELECT conv_id, turn, rag, 0::BIGINT AS pos, 'system' AS role, s AS content, {prompt('s', 'u')} AS prompt FROM both_kinds
    UNION ALL SELECT conv_id, turn, rag, 1::BIGINT, 'user', u, {prompt('s', 'u')} FROM both_kinds""",
    "validate_requests": f"WITH {REQUESTS} SELECT request_id, message, max_tokens, temperature, status, error FROM validated",
    "response_records": f"""WITH {ANSWERED} SELECT conv_id, turn, {stripped('answer')} AS response, round(length(answer) / 7.0::DOUBLE, 2) AS elapsed_seconds,
       'cpu' AS device, TRUE AS rag, {lit(P.DISCLAIMER)} AS disclaimer FROM answered""",
    "compare_answers": f"WITH {ANSWERED} SELECT conv_id, turn, 'In short: ' || answer AS base, answer AS tuned FROM answered",
    "column_profile": f"WITH {RAW} " + "\nUNION ALL ".join([
        describe_count(RAW_COLUMNS.split(", "), stage="all_rows"),
        describe_count(("q_body_count", "a_body_count"), "reply IS NOT NULL", "with_reply"),
        describe_count(("q_body", "a_body", "category", "question", "reply"), "reply IS NOT NULL", "without_counts")]),
    "duplicate_rows": f"""WITH {RAW}, g AS (SELECT count(*) AS c FROM raw GROUP BY {RAW_COLUMNS})
    SELECT sum(c)::BIGINT AS n_rows, count(*) AS n_distinct, (sum(c) - count(*))::BIGINT AS duplicates FROM g""",
    "describe_numeric": f"""WITH {RAW}, vals AS (
      SELECT 'q_body_count' AS series, q_body_count AS value FROM raw WHERE reply IS NOT NULL
      UNION ALL SELECT 'a_body_count', a_body_count FROM raw WHERE reply IS NOT NULL
      UNION ALL SELECT 'question_word_count', {words('question')}::DOUBLE FROM raw WHERE reply IS NOT NULL
      UNION ALL SELECT 'answer_word_count', {words('reply')}::DOUBLE FROM raw WHERE reply IS NOT NULL), {stats('series')}
    {DESCRIBED.format(keys='series')}""",
    "describe_lengths": f"WITH {NUMBERS}, {stats('series')} {DESCRIBED.format(keys='series')}",
    "describe_events": f"""WITH vals AS (SELECT event_type, 'value' AS series, value FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
      {stats('event_type, series')} {DESCRIBED.format(keys='event_type, series')}""",
    "category_counts": f"WITH {RAW} SELECT coalesce(category, 'None') AS category, count(*) AS n FROM raw WHERE reply IS NOT NULL GROUP BY 1",
    "category_value_counts": f"WITH {RAW} SELECT category, count(*) AS n FROM raw WHERE reply IS NOT NULL AND category IS NOT NULL GROUP BY 1 ORDER BY n DESC, category",
    "category_share": f"""WITH {RAW}, c AS (SELECT category, count(*) AS n FROM raw WHERE reply IS NOT NULL AND category IS NOT NULL GROUP BY 1),
      r AS (SELECT *, row_number() OVER (ORDER BY n DESC, category) > 6 AS is_rest FROM c),
      s AS (SELECT CASE WHEN is_rest THEN 'Other' ELSE category END AS label, is_rest, sum(n)::BIGINT AS n FROM r GROUP BY 1, 2)
    SELECT label, is_rest, n, round(100.0::DOUBLE * n / (SELECT sum(n)::BIGINT FROM c), 1) AS percent FROM s""",
    "top_words_answers": top_words("reply"),
    "top_words_questions": top_words("question"),
    "corr_matrix": correlations(NUMERIC_COLUMNS),
    "length_histogram": f"""WITH {CHARS}, {stats('series')}, {histogram('greatest(rule, 1.0)')} SELECT * FROM counted""",
    "describe_by_batches": f"WITH {NUMBERS}, {stats('series')} {DESCRIBED.format(keys='series')}",
    "top_words_by_batches": top_words("reply"),
    "scatter_sample": f"""WITH {RAW}, points AS (
      SELECT row_id, category, length(coalesce(question, q_body)) AS x, length(coalesce(reply, a_body)) AS y FROM raw)
    SELECT * FROM points WHERE x IS NOT NULL AND y IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5('42:' || row_id), row_id) <= 40""",
    "histogram_events": f"""WITH {EVENT_VALUES}, {stats('series')}, {histogram('rule')}
      SELECT series AS event_type, 'value' AS series, bin, "left", "right", n FROM counted""",
    "kde_events": f"""WITH {EVENT_VALUES}, {stats('series')}, {kde(200, 3.0, 'curve')}
      SELECT series AS event_type, 'value' AS series, point, round(x, 6) AS x, round(density, 9) AS density FROM curve""",
    "boxplot_events": f"""WITH {EVENT_VALUES}, {stats('series')}, boxes AS (WITH {boxplot('series').strip()})
      SELECT series AS event_type, 'value' AS series, * EXCLUDE (series) FROM boxes""",
    "boxplot_overall": f"WITH {CHARS}, {stats('series')}, {boxplot('series')}",
    "top_category_boxplot": f"""WITH {TOP6}, vals AS (SELECT category, 'Question' AS series, question_len::DOUBLE AS value FROM top6),
      {stats('category')}, {boxplot('category')}""",
    "top_category_mean_ci": f"""WITH {TOP6} SELECT category, count(reply_len) AS n, round(avg(reply_len), 6) AS mean,
       round(avg(reply_len) - 1.96::DOUBLE * stddev_samp(reply_len) / sqrt(count(reply_len)), 6) AS ci_low,
       round(avg(reply_len) + 1.96::DOUBLE * stddev_samp(reply_len) / sqrt(count(reply_len)), 6) AS ci_high FROM top6 GROUP BY category""",
    "top_category_mean_bootstrap": f"""WITH {TOP6}, sums AS (
      SELECT category, ('0x' || md5('42:' || row_id)[1:8])::BIGINT % 100 AS bucket, count(*) AS n, sum(reply_len)::DOUBLE AS s
      FROM top6 WHERE reply_len IS NOT NULL GROUP BY ALL),
    drawn AS (SELECT *, ('0x' || md5('42:' || draw || ':' || bucket)[1:8])::BIGINT AS u FROM sums, range(1000) AS t(draw)),
    weighted AS (SELECT *, len(list_filter({POISSON_LIMITS}, lambda x: u >= x)) AS w FROM drawn),
    means AS (SELECT category, draw, sum(w * s) / nullif(sum(w * n), 0) AS m FROM weighted GROUP BY ALL),
    whole AS (SELECT category, sum(n)::BIGINT AS n, sum(s) / sum(n) AS mean FROM sums GROUP BY category)
    SELECT category, any_value(n) AS n, round(any_value(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_low,
           round(quantile_cont(m, 0.975), 6) AS ci_high FROM means JOIN whole USING (category) GROUP BY category""",
    "length_kde": f"""WITH {CHARS}, {stats('series')}, {kde(200, 3.0, 'overlap')}, {kde(200, 0.0, 'overlay')}
    SELECT 'overlap' AS curve, series, point, round(x, 6) AS x, round(density, 9) AS density FROM overlap
    UNION ALL SELECT 'histogram', series, point, round(x, 6), round(density, 9) FROM overlay""",
    "violin_summary": f"""WITH {CHARS}, {stats('series')}, {kde(100, 2.0, 'outline')}
    SELECT series, point, round(x, 6) AS x, round(density, 9) AS density, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3
    FROM outline JOIN stats USING (series)""",
    "scatter_bins": f"WITH {LENGTHS}, frame AS (SELECT * FROM lengths), {grid([('question_len', 'reply_len')], 50)}",
    "pair_matrix": f"WITH {LENGTHS} {PAIR_FRAME} {grid([(x, y) for x in PAIR_COLUMNS for y in PAIR_COLUMNS if x != y], 20)}",
    "pair_diagonal": f"""WITH {NUMBERS}, {stats('series')}, {kde(200, 3.0, 'curve')}
    SELECT series, point, round(x, 6) AS x, round(density, 9) AS density FROM curve""",
    "length_ecdf": f"""WITH {CHARS}, vc AS (SELECT series, value, count(*) AS n FROM vals GROUP BY ALL)
    SELECT series, value, n, round(sum(n) OVER (PARTITION BY series ORDER BY value)::DOUBLE / sum(n) OVER (PARTITION BY series), 6) AS share FROM vc""",
    "length_unpivot": f"""WITH {LENGTHS} SELECT row_id, 'Question' AS type, question_len AS char_length FROM lengths
    UNION ALL SELECT row_id, 'Answer', reply_len FROM lengths""",
    "dedup_first": f"WITH {QA} SELECT row_id, q, a FROM qa QUALIFY row_number() OVER (PARTITION BY q ORDER BY row_id) = 1",
    "curation_funnel": f"""WITH {GATES} SELECT count(*) AS n_rows, count(*) FILTER (non_empty) AS n_non_empty,
       count(*) FILTER (non_empty AND long_enough) AS n_long_enough, count(*) FILTER (non_empty AND long_enough AND general) AS n_general,
       count(*) FILTER (non_empty AND long_enough AND general AND NOT personal) AS n_not_personal,
       count(DISTINCT CASE WHEN non_empty AND long_enough AND general AND NOT personal THEN {cleaned('q')} END) AS n_unique FROM gates""",
    "split_95_5": f"WITH {SPLIT.format(key='doc_id', table='documents')} SELECT doc_id, {TEST_ROW} FROM ranked",
    "training_set": f"WITH {CURATED}, {SPLIT.format(key='row_id', table='curated')} SELECT row_id, {CHATML} AS text, {TEST_ROW} FROM ranked",
    "split_sizes": f"""WITH {CURATED}, {SPLIT.format(key='row_id', table='curated')}, parts AS (SELECT {TEST_ROW} FROM ranked)
    SELECT split, count(*) AS n FROM parts GROUP BY split""",
    "curate_marks": f"WITH {curated(gates(personal=(), marks=MARKS))} SELECT row_id, instruction, input, output FROM curated",
    "normalize_marks": text_rule(normalized("text", MARKS)),
    "knn_all_top2": f"""WITH {SPOILED}, queries AS (SELECT doc_id AS query_id, embedding FROM items), {nearest('items', 'queries')}
    SELECT query_id, doc_id, round(distance, 6) AS distance, rank FROM hits""",
    "knn_top2": f"""WITH {SPOILED},
    parts AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    sums AS (SELECT label, pos, avg(v) AS v FROM parts GROUP BY ALL),
    queries AS (SELECT label::BIGINT AS query_id, list(v ORDER BY pos) AS embedding FROM sums GROUP BY label), {nearest('items', 'queries')}
    SELECT query_id, doc_id, round(distance, 6) AS distance, rank FROM hits""",
    "rag_prompts": f"WITH {PROMPTED} SELECT request_id, prompt FROM prompted",
    "tfidf_embed": f"""WITH {RECORDS}, {DOCS.format(records='records')}, {buckets('docs', 'doc_id', 'doc_text', 'doc')},
      {idf('docs')}, {weights('doc', 'doc_id', 'idf')}
    SELECT doc_id, bucket::BIGINT AS bucket, round(weight, 6) AS weight FROM doc_weights WHERE weight <> 0""",
    "tfidf_rag_prompts": f"""WITH {TFIDF_PROMPTS}
    SELECT request_id, {prompt(RAG_SYSTEM, rag_user('message', "coalesce(context, '')"))} AS prompt FROM asked LEFT JOIN contexts USING (request_id)""",
    "stream_requests": f"""WITH {PROMPTED} SELECT request_id, status, error, prompt FROM prompted
    UNION ALL SELECT request_id, status, error, NULL FROM validated WHERE status <> 200""",
    "stream_curate": f"WITH {CURATED} SELECT row_id, instruction, input, output FROM curated",
}
