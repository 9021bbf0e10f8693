"""The registered queries once more, as DuckDB SQL over the same parquet tables.

Written apart from the library: other date arithmetic, other window shapes, and
model answers resolved by hand. ``STUDY`` derives the study tables.
"""

from __future__ import annotations

from recallspark.operators.prompts import PAIRS_INSTRUCTION, PAIRS_REQUEST, POINTS_INSTRUCTION, POINTS_REQUEST

NOW = "TIMESTAMP '2024-01-15 10:00:00'"
TEXT_FORM = "'%Y-%m-%d %H:%M:%S'"

IGNORED = "CASE WHEN o_orderstatus = 'P' AND o_orderkey % 11 = 0 THEN 1 WHEN o_orderstatus = 'O' THEN NULL ELSE 0 END"

STUDY = f"""
WITH owners AS (SELECT count(*) - 1 AS n FROM supplier),
subjects AS (
  SELECT s_suppkey AS id, s_name AS name,
         CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE 1 + (s_suppkey % 41) / CAST(10 AS DOUBLE) END AS difficulty,
         CAST((s_nationkey % 9) * 0.5 AS DOUBLE) AS credits,
         CASE s_suppkey % 20 WHEN 19 THEN NULL WHEN 18 THEN '' WHEN 17 THEN 'TBD'
              ELSE CAST(DATE '2024-01-15' + CAST(s_suppkey % 45 - 10 AS INTEGER) AS VARCHAR) END AS ddl
  FROM supplier),
cards AS (
  SELECT o_orderkey AS id,
         CAST(CASE WHEN o_orderkey % 97 = 0 THEN -1 ELSE o_custkey % (SELECT n FROM owners) END AS BIGINT) AS subject_id,
         'Order ' || o_orderkey || ' is ____' AS question, o_orderpriority AS answer,
         strftime(o_orderdate, {TEXT_FORM}) AS created_at,
         CASE o_orderkey % 50 WHEN 49 THEN NULL WHEN 48 THEN 'never'
              ELSE strftime(TIMESTAMP '2024-01-15 00:00:00' - to_days(CAST(o_orderkey % 40 AS INTEGER))
                            + to_hours(o_orderkey % 24), {TEXT_FORM}) END AS last_reviewed_at,
         o_orderkey % 7 AS review_count,
         CASE WHEN o_orderkey % 31 <> 30 THEN CAST((o_custkey + o_orderkey) % 6 AS INTEGER) END AS mastery_level,
         CAST({IGNORED} AS INTEGER) AS ignored
  FROM orders),
live AS (SELECT * FROM cards WHERE ignored IS NULL OR ignored = 0),
reviews AS (
  SELECT event_id AS review_id,
         CASE WHEN event_id % 53 = 0 THEN -7 ELSE user_id * 7 + event_id % 10 END AS card_id, ts AS reviewed_at,
         CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 WHEN 'error' THEN 0 WHEN 'signup' THEN -1 ELSE 9 END
           AS grade
  FROM events),
logs AS (
  SELECT event_id AS id, event_id AS card_id, strftime(ts, {TEXT_FORM}) AS recommended_at
  FROM events WHERE event_type = 'view' AND event_id % 10 = 0),
today AS (SELECT * FROM logs WHERE try_cast(recommended_at AS TIMESTAMP)::DATE = DATE '2024-01-15'),
imports AS (
  SELECT doc_id AS id, CAST(doc_id % (SELECT n FROM owners) AS BIGINT) AS subject_id,
         source || '-' || lang || '.md' AS file_name, '2024-01-15 09:00:00' AS imported_at
  FROM documents),
files AS (
  SELECT doc_id, CAST(doc_id % (SELECT n FROM owners) AS BIGINT) AS subject_id,
         source || '-' || lang || CASE doc_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.md' WHEN 2 THEN '' ELSE '.pdf.txt' END
           AS file_name,
         CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN NULL ELSE 'text/markdown' END AS mime_type, text
  FROM documents),
candidates AS (
  SELECT c.id, c.subject_id, c.question, c.answer, c.created_at, c.last_reviewed_at, c.review_count, c.mastery_level,
         s.ddl, s.credits, s.difficulty, s.name AS subject_name
  FROM live c JOIN subjects s ON s.id = c.subject_id
  WHERE c.mastery_level < 5 AND c.id NOT IN (SELECT card_id FROM today)),
measured AS (
  SELECT *,
         CAST(floor((epoch_us(try_strptime(ddl, '%Y-%m-%d')) - epoch_us({NOW})) / 86400000000) AS INTEGER) AS due,
         CAST(floor((epoch_us({NOW}) - epoch_us(try_strptime(last_reviewed_at, {TEXT_FORM}))) / 86400000000) AS INTEGER)
           AS idle
  FROM candidates),
factors AS (
  SELECT *, coalesce(due, 999) AS days_left,
         CASE WHEN due IS NULL THEN 0.0::DOUBLE WHEN due < 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE / (due + 1) END AS urgency,
         (CASE WHEN credits IS NULL OR credits = 0 THEN 1.0::DOUBLE ELSE credits END)
         * (CASE WHEN difficulty IS NULL OR difficulty = 0 THEN 1.0::DOUBLE ELSE difficulty END) AS importance,
         coalesce(idle, 100) AS days_since_review, 5 - mastery_level AS mastery_gap
  FROM measured),
scored AS (
  SELECT id, subject_id, question, answer, created_at, last_reviewed_at, review_count, mastery_level, subject_name,
         days_left, urgency, importance, days_since_review, mastery_gap,
         urgency * 100.0::DOUBLE + importance * 5.0::DOUBLE + days_since_review * 1.0::DOUBLE
           + mastery_gap * 6.0::DOUBLE AS priority_score,
         coalesce(nullif(concat_ws(' + ',
           CASE WHEN urgency < 0.1::DOUBLE THEN NULL WHEN days_left < 0 THEN '已逾期'
                WHEN days_left < 3 THEN 'DDL 仅剩 ' || days_left || ' 天' ELSE 'DDL 临近' END,
           CASE WHEN days_since_review > 7 THEN '很久没复习' END,
           CASE WHEN mastery_level < 2 THEN '掌握度低' END,
           CASE WHEN importance > 10 THEN '重点学科' END), ''), '综合推荐') AS reason
  FROM factors),
ranked AS (SELECT *, row_number() OVER (ORDER BY priority_score DESC, id) AS place FROM scored),
progress AS (
  SELECT s.id AS subject_id, s.name,
         coalesce(avg(CASE WHEN c.ignored IS NULL OR c.ignored = 0 THEN c.mastery_level END), 0.0::DOUBLE) AS avg_mastery,
         CAST(sum(CASE WHEN c.ignored IS NULL OR c.ignored = 0 THEN 1 ELSE 0 END) AS BIGINT) AS card_count,
         count(c.id) AS stored
  FROM subjects s LEFT JOIN cards c ON s.id = c.subject_id GROUP BY s.id, s.name),
totals AS (
  SELECT count(*) AS total_cards,
         count(*) FILTER (WHERE try_cast(last_reviewed_at AS TIMESTAMP)::DATE = DATE '2024-01-15') AS today_reviews,
         avg(mastery_level) AS mean_mastery
  FROM live),
names AS (
  SELECT subject_id, string_agg(DISTINCT file_name, ',' ORDER BY file_name) AS imported_files
  FROM imports GROUP BY subject_id),
known AS (
  SELECT r.*, c.mastery_level AS m0, c.ignored AS g0, c.review_count AS c0,
         CASE WHEN grade = -1 THEN 1 WHEN grade IN (0, 1, 2) THEN 0 END AS flag
  FROM reviews r JOIN cards c ON c.id = r.card_id),
segments AS (
  SELECT *, count(*) FILTER (WHERE grade IN (0, 2)) OVER w AS seg, row_number() OVER w AS nth,
         last_value(flag IGNORE NULLS) OVER w AS last_flag
  FROM known WINDOW w AS (PARTITION BY card_id ORDER BY reviewed_at, review_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
based AS (
  SELECT *, coalesce(max(CASE grade WHEN 2 THEN 5 WHEN 0 THEN 0 END) OVER (PARTITION BY card_id, seg), m0, 0) AS base,
         count(*) FILTER (WHERE grade = 1) OVER (PARTITION BY card_id, seg ORDER BY reviewed_at, review_id
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raises
  FROM segments),
history AS (
  SELECT card_id, review_id, reviewed_at, grade,
         CAST(CASE WHEN raises > 0 THEN least(5, base + raises) ELSE base END AS INTEGER) AS mastery_level,
         CAST(coalesce(last_flag, g0, 0) AS INTEGER) AS ignored, c0 + nth AS review_count, nth,
         count(*) OVER (PARTITION BY card_id) AS of
  FROM based),
final AS (
  SELECT card_id, mastery_level, ignored, review_count, strftime(reviewed_at, {TEXT_FORM}) AS last_reviewed_at
  FROM history WHERE nth = of),
bodies AS (
  SELECT doc_id, trim(regexp_replace(trim(raw, ' ' || chr(10)), '^```(json)?|```$', '', 'g'), ' ' || chr(10)) AS body
  FROM (SELECT doc_id, CASE doc_id % 10
    WHEN 0 THEN '```json' || chr(10) || '{{"points":' || lines || '}}' || chr(10) || '```'
    WHEN 1 THEN '{{"n":1,"zz":' || lines || ',"aa":["q"]}}' WHEN 2 THEN lines WHEN 3 THEN text
    WHEN 4 THEN '{{"points":"[x","k":' || lines || '}}'
    WHEN 5 THEN '  {{"points":[1,2.0,0.25,true,' || to_json(text) || ']}}' WHEN 6 THEN '{{"points":[]}}'
    WHEN 7 THEN '{{"points":{{"a":[1]}},"b":' || lines || '}}' WHEN 8 THEN '{{"points":' || lines || '}} and more' END AS raw
    FROM (SELECT doc_id, text, to_json(string_split(text, chr(10)))::VARCHAR AS lines FROM documents))),
objects AS (
  SELECT doc_id, CASE WHEN json_valid(body) THEN CASE WHEN json_type(body) = 'OBJECT' THEN CAST(body AS JSON) END END AS o FROM bodies),
lists AS (
  SELECT doc_id, CASE WHEN json_type(o, '$.points') = 'ARRAY' THEN json_extract(o, '$.points') ELSE list_filter(
    list_transform(json_keys(o), lambda k: json_extract(o, '$."' || k || '"')), lambda v: json_type(v) = 'ARRAY')[1] END AS l
  FROM objects),
points AS (
  SELECT doc_id, coalesce(list_filter(list_transform(CAST(l AS JSON[]), lambda v: trim(
    CASE json_type(v) WHEN 'BOOLEAN' THEN upper(substr(v ->> '$', 1, 1)) || substr(v ->> '$', 2) ELSE v ->> '$' END)),
    lambda p: p <> ''), CAST([] AS VARCHAR[])) AS points
  FROM lists),
pairs AS (
  SELECT doc_id, subject_id, file_name, text, unnest(CASE doc_id % 6
    WHEN 0 THEN of_lines WHEN 1 THEN of_lines
    WHEN 5 THEN [{{'pos': 0, 'q': text, 'a': '2.0'}}] ELSE [] END, recursive := true)
  FROM (SELECT *, list_transform(string_split(text, chr(10)), lambda x, i: {{'pos': CAST(i - 1 AS INTEGER), 'q': '____ ' || x,
                                 'a': string_split(x, ' ')[1]}}) AS of_lines FROM files)),
pages AS (
  SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn, text) || chr(10) AS text
  FROM conversations GROUP BY conv_id),
texts AS (
  SELECT f.doc_id, subject_id, file_name, CASE WHEN is_pdf THEN coalesce(p.text, '') ELSE f.text END AS text
  FROM (SELECT *, coalesce(mime_type, '') LIKE '%pdf%' OR lower(file_name) LIKE '%.pdf' AS is_pdf FROM files) f
  LEFT JOIN pages p USING (doc_id))
"""

CARD = "id, subject_id, question, answer, created_at, last_reviewed_at, review_count, mastery_level"

def _model(texts: str) -> str:
    """The stand-in model's first answers: texts go to it in pieces of 15,000 characters, an empty text as one."""
    return f"""
, asked AS (
  SELECT * EXCLUDE (pieces), generate_subscripts(pieces, 1) - 1 AS part, unnest(pieces) AS n
  FROM (SELECT doc_id, subject_id, file_name, list_transform(range(0, greatest(length(text), 1), 15000),
               lambda i: least(15000, length(text) - i)) AS pieces FROM {texts})),
answered AS (
  SELECT *, CASE WHEN n % 7 = 0 THEN NULL WHEN n % 2 = 0 THEN '```json' || chr(10) || '{{"points": ["' || n || ' characters"]}}'
            || chr(10) || '```' ELSE '{{"points": ["' || n || ' characters"]}}' END AS raw,
         CASE WHEN n % 7 = 0 THEN 'RuntimeError: no answer' END AS error
  FROM asked)
"""


def _cloze(texts: str) -> str:
    return STUDY + CLOZE.replace("FROM documents", f"FROM {texts}")


CLOZE = r""",
statement AS (
  SELECT doc_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS point
  FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+[ ]+|[。！？]+|\n+'), lambda x: trim(x)),
                                   lambda x: x <> '') AS p
        FROM documents)),
word AS (
  SELECT doc_id, pos, unnest(list_distinct(list_filter(
    list_transform(string_split(point, ' '), lambda w: lower(regexp_replace(w, '[^\p{L}]', '', 'g'))),
    lambda k: length(k) >= 3))) AS key
  FROM statement),
spread AS (SELECT key, count(DISTINCT doc_id) AS df FROM word GROUP BY key),
chosen AS (
  SELECT doc_id, pos, arg_min(key, row(df, -length(key), key)) AS key
  FROM word JOIN spread USING (key) GROUP BY doc_id, pos),
cloze AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos,
       array_to_string(list_transform(string_split(point, ' '), lambda w:
         CASE WHEN lower(regexp_replace(w, '[^\p{L}]', '', 'g')) = key THEN '____' ELSE w END), ' ') AS q,
       array_to_string(list_filter(string_split(point, ' '), lambda w:
         lower(regexp_replace(w, '[^\p{L}]', '', 'g')) = key), ' ') AS a
FROM statement JOIN chosen USING (doc_id, pos)
WHERE len(list_filter(list_transform(string_split(point, ' '), lambda w: lower(regexp_replace(w, '[^\p{L}]', '', 'g'))),
                      lambda k: k <> '' AND k <> key)) > 0)
"""


# The cards after the day's grades; every third card was appended after they had been read.
REGRADED = """, regraded AS (
  SELECT c.id, c.subject_id, CASE WHEN f.card_id IS NULL THEN c.last_reviewed_at ELSE f.last_reviewed_at END AS last_reviewed_at,
         CASE WHEN f.card_id IS NULL THEN c.mastery_level ELSE f.mastery_level END AS mastery_level,
         CASE WHEN f.card_id IS NULL THEN c.ignored ELSE f.ignored END AS ignored
  FROM cards c LEFT JOIN final f ON f.card_id = c.id AND c.id % 3 <> 2)"""


def _numbered(key: str) -> str:
    return f"row_number() OVER (ORDER BY substr(md5(CAST({key} AS VARCHAR)), 1, 4), {key})"


def _new_cards(source: str, start: str) -> str:
    return f"""SELECT {start} + row_number() OVER (ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 4), doc_id, pos) AS id,
      subject_id, q AS question, a AS answer, '2024-01-15 10:00:00' AS created_at,
      '2024-01-15 10:00:00' AS last_reviewed_at, CAST(0 AS BIGINT) AS review_count, 0 AS mastery_level, 0 AS ignored
      FROM {source}"""


def _queue(limit: int) -> str:
    return (f"{STUDY} SELECT CAST(place AS INTEGER) AS position, {CARD}, subject_name, priority_score, reason FROM ranked "
            f"WHERE place <= {limit} - (SELECT count(*) FROM today)")


def _quota(limit: int) -> str:
    return (f"{STUDY} SELECT CAST({limit} AS BIGINT) AS daily_limit, count(*) AS today_recommended_count, "
            f"greatest({limit} - count(*), 0) AS remaining, count(*) >= {limit} AS daily_limit_reached FROM today")


HISTORY = f"""{STUDY} SELECT card_id, review_id, strftime(reviewed_at, {TEXT_FORM}) AS reviewed_at, grade, mastery_level,
  ignored, review_count FROM history"""

TOP = f"{STUDY} SELECT id, question, subject_name, priority_score, CAST(place AS INTEGER) AS position FROM ranked WHERE place <= 5"

SQL = {
    "all_subjects": f"{STUDY} SELECT * FROM subjects",
    "live_cards": f"{STUDY} SELECT * FROM live",
    "learning_cards": f"{STUDY} SELECT * FROM live WHERE mastery_level < 5",
    "schema_backfill": f"{STUDY} SELECT * REPLACE (0 AS ignored) FROM cards",
    "cards_reviewed_on_day": f"""{STUDY} SELECT id, last_reviewed_at FROM cards
        WHERE try_cast(last_reviewed_at AS TIMESTAMP)::DATE = DATE '2024-01-15'""",
    "card_by_id": f"{STUDY} SELECT * FROM cards WHERE id = 42",
    "review_candidates": f"{STUDY} SELECT * FROM candidates",
    "priority_scores": f"{STUDY} SELECT * FROM scored",
    "ranked_cards": f"{STUDY} SELECT id, priority_score, place AS position FROM ranked",
    "reason_counts": f"{STUDY} SELECT reason, count(*) AS cards FROM scored GROUP BY reason",
    "recommended_card": f"{STUDY} SELECT {CARD}, priority_score, reason FROM ranked WHERE place = 1",
    "recommended_log_row": f"""{STUDY} SELECT (SELECT max(id) FROM logs) + 1 AS id, id AS card_id,
        '2024-01-15 10:00:00' AS recommended_at FROM ranked WHERE place = 1""",
    "top_priority_cards": TOP,
    "top_card_lines": f"""{STUDY} SELECT CAST(place AS INTEGER) AS position,
        place || '. [' || subject_name || '] ' || question AS line FROM ranked WHERE place <= 5""",
    "recommendations_on_day": f"{STUDY} SELECT count(*) AS today_recommended_count FROM today",
    "quota_status": _quota(100),
    "quota_status_limit_5": _quota(5),
    "quota_line": f"{STUDY} SELECT count(*) || ' / 100' AS quota_line FROM today",
    "daily_queue": _queue(100),
    "daily_queue_limit_20": _queue(20),
    "queue_log_rows": f"""{STUDY} SELECT (SELECT max(id) FROM logs) + place AS id, id AS card_id,
        '2024-01-15 10:00:00' AS recommended_at FROM ranked WHERE place <= 100 - (SELECT count(*) FROM today)""",
    "random_card": f"{STUDY} SELECT {CARD} FROM live WHERE mastery_level < 5 ORDER BY md5('7-' || id), id LIMIT 1",
    "dashboard_totals": f"""{STUDY} SELECT total_cards, today_reviews, round(mean_mastery, 2) AS avg_mastery, mean_mastery
        FROM totals""",
    "total_lines": f"""{STUDY} SELECT total_cards, today_reviews, round(mean_mastery, 2) || ' / 5.0' AS mastery_line
        FROM totals""",
    "subject_progress": f"""{STUDY} SELECT subject_id, name, avg_mastery, card_count, avg_mastery / 5.0::DOUBLE AS progress
        FROM progress""",
    "subject_progress_strict": f"""{STUDY} SELECT subject_id, name, avg_mastery,
        CASE WHEN stored = 0 THEN 0 ELSE card_count END AS card_count, avg_mastery / 5.0::DOUBLE AS progress FROM progress""",
    "progress_lines": f"""{STUDY} SELECT subject_id, name || ' (' || card_count || ')' AS heading,
        least(avg_mastery / 5.0::DOUBLE, 1.0::DOUBLE) AS bar FROM progress""",
    "subject_imports": f"{STUDY} SELECT * FROM names",
    "subjects_view": f"""{STUDY} SELECT s.*, coalesce(n.imported_files, '') AS imported_files
        FROM subjects s LEFT JOIN names n ON n.subject_id = s.id""",
    "subject_names": f"{STUDY} SELECT id AS subject_id, name AS subject_name FROM subjects",
    "grade_steps": f"""{STUDY} SELECT review_id, card_id, grade,
        CAST(CASE grade WHEN 2 THEN 5 WHEN 0 THEN 0 WHEN 1 THEN least(5, coalesce(m0, 0) + 1) ELSE coalesce(m0, 0) END
             AS INTEGER) AS new_mastery,
        CAST(coalesce(flag, g0, 0) AS INTEGER) AS new_ignored FROM known""",
    "review_history": HISTORY,
    "review_history_ranged": HISTORY,
    "cards_after_reviews": f"""{STUDY} SELECT c.id, c.subject_id, c.question, c.answer, c.created_at,
        CASE WHEN f.card_id IS NULL THEN c.last_reviewed_at ELSE f.last_reviewed_at END AS last_reviewed_at,
        CASE WHEN f.card_id IS NULL THEN c.review_count ELSE f.review_count END AS review_count,
        CASE WHEN f.card_id IS NULL THEN c.mastery_level ELSE f.mastery_level END AS mastery_level,
        CASE WHEN f.card_id IS NULL THEN c.ignored ELSE f.ignored END AS ignored
        FROM cards c LEFT JOIN final f ON f.card_id = c.id""",
    "stream_card_state": f"{STUDY} SELECT * FROM final",
    "document_routes": f"""{STUDY} SELECT doc_id, file_name, mime_type,
        CASE WHEN coalesce(mime_type, '') LIKE '%pdf%' OR lower(file_name) LIKE '%.pdf' THEN 'pdf' ELSE 'text' END AS kind
        FROM files""",
    "decoded_documents": f"{STUDY} SELECT doc_id, file_name, text FROM files",
    "pages_text": f"{STUDY} SELECT * FROM pages",
    "document_texts": f"{STUDY} SELECT doc_id, file_name, text FROM texts",
    "point_prompts": f"""SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS part, '{POINTS_INSTRUCTION}' AS system,
        '{POINTS_REQUEST}' || unnest(p) AS "user" FROM (SELECT doc_id, list_transform(
        range(0, greatest(length(text), 1), 15000), lambda i: substr(text, i + 1, 15000)) AS p FROM documents)""",
    "completion_points": f"""{STUDY} SELECT doc_id, CAST(len(points) AS INTEGER) AS found,
        array_to_string(points, '|') AS points FROM points""",
    "numbered_points": f"""{STUDY} SELECT doc_id, array_to_string(list_transform(points, lambda p, i: i || '. ' || p), chr(10))
        AS points_text FROM points WHERE len(points) > 0""",
    "card_prompts": f"""{STUDY} SELECT doc_id, 0 AS part, '{PAIRS_INSTRUCTION}' AS system, '{PAIRS_REQUEST}'
        || array_to_string(list_transform(points, lambda p, i: i || '. ' || p), chr(10)) AS "user"
        FROM points WHERE len(points) > 0""",
    "completion_cards": f"{STUDY} SELECT doc_id, pos, q, a FROM pairs",
    "cards_json": f"""{STUDY} SELECT doc_id, CAST(to_json(list({{'q': q, 'a': a}} ORDER BY pos)) AS VARCHAR) AS cards_json
        FROM pairs GROUP BY doc_id""",
    "imported_cards": f"{STUDY} {_new_cards('pairs', '(SELECT max(id) FROM cards)')}",
    "imported_file_rows": f"""{STUDY} SELECT (SELECT max(id) FROM imports) + {_numbered('doc_id')} AS id, subject_id, file_name,
        '2024-01-15 10:00:00' AS imported_at FROM (SELECT DISTINCT doc_id, subject_id, file_name FROM pairs)""",
    "import_report": f"""{STUDY} SELECT f.doc_id, length(f.text) AS text_chars,
        (SELECT count(*) FROM pairs p WHERE p.doc_id = f.doc_id) AS card_count FROM files f""",
    "added_subjects": f"""{STUDY} SELECT (SELECT max(id) FROM subjects) + {_numbered('c_custkey')} AS id, c_name AS name,
        1 + (c_custkey % 41) / CAST(10 AS DOUBLE) AS difficulty, CAST((c_nationkey % 9) * 0.5 AS DOUBLE) AS credits,
        CAST(DATE '2024-01-15' + CAST(c_custkey % 45 AS INTEGER) AS VARCHAR) AS ddl
        FROM customer WHERE c_custkey % 10 <> 0""",
    "completed_prompts": f"{STUDY} {_model('files')} SELECT doc_id, CAST(part AS INTEGER) AS part, raw, error FROM answered",
    "completed_prompts_kept": f"{STUDY} {_model('files')} SELECT doc_id, CAST(part AS INTEGER) AS part, raw, error FROM answered",
    "unlogged_cards_by_bit_map": f"""{STUDY} SELECT id, mastery_level FROM live
        WHERE mastery_level < 5 AND id NOT IN (SELECT card_id FROM logs)""",
    "summed_totals": f"""{STUDY}{REGRADED} SELECT count(*) AS total_cards,
        count(*) FILTER (WHERE try_cast(last_reviewed_at AS TIMESTAMP)::DATE = DATE '2024-01-15') AS today_reviews,
        round(avg(mastery_level), 2) AS avg_mastery, avg(mastery_level) AS mean_mastery FROM regraded WHERE coalesce(ignored, 0) = 0""",
    "summed_progress": f"""{STUDY}{REGRADED} SELECT s.id AS subject_id, s.name, coalesce(m.mean, 0.0::DOUBLE) AS avg_mastery,
        coalesce(m.n, 1) AS card_count, coalesce(m.mean, 0.0::DOUBLE) / 5.0::DOUBLE AS progress FROM subjects s LEFT JOIN (
        SELECT subject_id, avg(mastery_level) FILTER (WHERE coalesce(ignored, 0) = 0) AS mean, count(*) FILTER (WHERE coalesce(ignored, 0) = 0) AS n
        FROM regraded GROUP BY subject_id) m ON m.subject_id = s.id""",
    "reserved_subjects": f"""{STUDY} SELECT (SELECT max(id) FROM subjects)
        + row_number() OVER (ORDER BY c_custkey % 2, substr(md5(CAST(c_custkey AS VARCHAR)), 1, 4), c_custkey) AS id, c_name AS name,
        1 + (c_custkey % 41) / CAST(10 AS DOUBLE) AS difficulty, CAST((c_nationkey % 9) * 0.5 AS DOUBLE) AS credits,
        CAST(DATE '2024-01-15' + CAST(c_custkey % 45 AS INTEGER) AS VARCHAR) AS ddl
        FROM customer WHERE c_custkey % 10 <> 0""",
    "model_import_report": f"""{STUDY} {_model('texts')} SELECT t.doc_id, length(t.text) AS text_chars, count(*) FILTER (WHERE error IS NULL)
        AS card_count, string_agg('1:' || part || ':' || error, ',' ORDER BY part) AS errors
        FROM texts t JOIN answered USING (doc_id) GROUP BY ALL""",
    "model_import_cards": f"""{STUDY} {_model('texts')}, made AS (
        SELECT doc_id, subject_id, part AS pos, '____ characters' AS q, CAST(n AS VARCHAR) AS a
        FROM asked WHERE n % 7 <> 0)
        {_new_cards('made', '(SELECT max(id) FROM cards)')}""",
    "cloze_cards": f"{_cloze('documents')} SELECT * FROM cloze",
    "cloze_import_cards": f"""{_cloze('texts')} SELECT (SELECT max(id) FROM cards) + {_numbered("doc_id || ':' || pos")} AS id,
        subject_id, q AS question, a AS answer, '2024-01-15 10:00:00' AS created_at,
        '2024-01-15 10:00:00' AS last_reviewed_at, CAST(0 AS BIGINT) AS review_count, 0 AS mastery_level, 0 AS ignored
        FROM cloze JOIN files USING (doc_id)""",
    "cloze_import_rows": f"""{_cloze('texts')} SELECT (SELECT max(id) FROM imports) + {_numbered("doc_id")} AS id, subject_id,
        file_name, '2024-01-15 10:00:00' AS imported_at FROM files WHERE doc_id IN (SELECT doc_id FROM cloze)""",
    "cloze_import_report": f"""{_cloze('texts')} SELECT doc_id, length(text) AS text_chars,
        (SELECT count(*) FROM cloze c WHERE c.doc_id = t.doc_id) AS card_count FROM texts t""",
    "declared_tables": f"""{STUDY} SELECT c.id, question, ignored, name AS subject_name
        FROM cards c JOIN subjects s ON s.id = c.subject_id""",
    # Every fourth card comes from a file without the column; cards appended after the read have no grades; odd log texts.
    "stored_tables": STUDY.replace(IGNORED, f"CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE {IGNORED} END") + """, kept_logs AS (
        SELECT id, CASE WHEN id % 40 = 0 THEN NULL WHEN id % 30 = 0 THEN 'never' WHEN id % 30 = 10 THEN '2024-1-5 10:00:00'
            ELSE recommended_at END AS said FROM logs)
        SELECT 'card' AS kind, c.id, CAST(coalesce(f.mastery_level, c.mastery_level) AS INTEGER) AS mastery_level,
            coalesce(f.ignored, c.ignored) AS ignored, coalesce(f.review_count, c.review_count) AS review_count,
            coalesce(f.last_reviewed_at, c.last_reviewed_at) AS at
        FROM cards c LEFT JOIN final f ON f.card_id = c.id AND c.id % 4 <> 3
        UNION ALL SELECT 'log', id, NULL, NULL, NULL, said FROM kept_logs
        UNION ALL SELECT 'log of the day', id, NULL, NULL, NULL, said FROM kept_logs WHERE said LIKE '2024-01-15%'""",
}
