"""DuckDB SQL equivalents of the named queries (independent formulation, same column names)."""

from __future__ import annotations

from chatlake.functions.text import CLEAN_KEEP_COLON, CLEAN_NO_COLON, FILE_PLACEHOLDER, TOKEN_RULE
from chatlake.sources.stopwords import read_stopword_list

ORACLES: dict[str, str] = {}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _stopwords_sql() -> str:
    return "SELECT unnest([" + ", ".join(_lit(w) for w in read_stopword_list()) + "]) AS term"


def _clean(col: str, keep_colon: bool = True) -> str:
    pat = CLEAN_KEEP_COLON if keep_colon else CLEAN_NO_COLON
    return f"regexp_replace(replace({col}, {_lit(FILE_PLACEHOLDER)}, ''), {_lit(pat)}, '', 'g')"


def _tokens(col: str, keep_colon: bool = True) -> str:
    return f"regexp_extract_all(lower({_clean(col, keep_colon)}), {_lit(TOKEN_RULE)})"


def _tfidf_sql(group: str | None, keep_colon: bool, stop: bool, k: int = 100) -> str:
    g = f"{group}, " if group else ""
    gj = f"USING ({group})" if group else "ON TRUE"
    sw = f"WHERE term NOT IN (SELECT term FROM sw)" if stop else ""
    top = (f"SELECT {g}term, weight, row_number() OVER (PARTITION BY {group} ORDER BY weight DESC, term) AS rank "
           f"FROM agg QUALIFY rank <= {k}") if group else f"SELECT term, weight FROM agg ORDER BY weight DESC, term LIMIT {k}"
    rel_part = f"PARTITION BY {group}" if group else ""
    rank_col = "rank, " if group else ""
    return f"""
WITH sw AS ({_stopwords_sql()}),
docs AS (SELECT {g}doc_id, text FROM documents WHERE text IS NOT NULL),
n AS (SELECT {g}count(*) AS n FROM docs {"GROUP BY " + group if group else ""}),
toks AS (SELECT {g}doc_id, unnest({_tokens("text", keep_colon)}) AS term FROM docs),
tf AS (SELECT {g}doc_id, term, count(*) AS tf FROM toks {sw} GROUP BY ALL),
dfs AS (SELECT {g}term, count(*) AS df FROM tf GROUP BY ALL),
v AS (SELECT tf.*, tf.tf * (ln((1 + n.n) / (1 + dfs.df)) + 1) AS v
      FROM tf JOIN dfs USING ({g}term) JOIN n {gj}),
nw AS (SELECT {g}term, v / sqrt(sum(v * v) OVER (PARTITION BY {g}doc_id)) AS w FROM v),
agg AS (SELECT {g}term, sum(w) AS weight FROM nw GROUP BY ALL),
top AS ({top})
SELECT {g}{rank_col}term, round(weight, 6) AS weight,
       round(weight / max(weight) OVER ({rel_part}), 6) AS rel_weight
FROM top"""


ORACLES["keyword_top100"] = _tfidf_sql(None, True, True)
ORACLES["keyword_per_source"] = _tfidf_sql("source", True, True)
ORACLES["keyword_notebook_variant"] = _tfidf_sql(None, False, False)
ORACLES["vocab_shape"] = f"""
SELECT (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_docs,
       (SELECT count(DISTINCT term) FROM (SELECT unnest({_tokens("text", False)}) AS term
                                          FROM documents WHERE text IS NOT NULL)) AS n_terms"""


# ---------------------------------------------------------------- word statistics
from chatlake.functions.text import PY_WHITESPACE  # noqa: E402
from chatlake.sources.stopwords import NOTEBOOK_EXTRA  # noqa: E402

_WORDS = f"list_filter(regexp_split_to_array(text, {_lit(PY_WHITESPACE)}), lambda x: x <> '')"
_WC = f"coalesce(len({_WORDS}), 0)"

ORACLES["term_counts"] = f"""
WITH sw AS ({_stopwords_sql()} UNION SELECT unnest([{", ".join(_lit(w) for w in NOTEBOOK_EXTRA)}])),
t AS (SELECT unnest({_tokens("text", False)}) AS term FROM documents)
SELECT term, count(*) AS n FROM t WHERE term NOT IN (SELECT term FROM sw) GROUP BY term"""

ORACLES["sorted_tokens"] = f"""
SELECT doc_id, array_to_string(list_sort(list_filter(
         regexp_split_to_array({_clean("text", False)}, {_lit(PY_WHITESPACE)}), lambda x: x <> '')), ' ') AS sorted_text
FROM documents WHERE text IS NOT NULL"""

ORACLES["words_count"] = f"SELECT doc_id, {_WC} AS words_count FROM documents"

ORACLES["words_mean_p99"] = f"""
SELECT lang, count(*) AS n_messages, round(avg({_WC}), 6) AS mean_words,
       round(quantile_cont({_WC}, 0.99), 6) AS p99_words
FROM documents GROUP BY lang"""

ORACLES["words_hist"] = f"""
WITH w AS (SELECT {_WC} AS wc FROM documents),
b AS (SELECT min(wc) AS lo, max(wc) AS hi FROM w),
k AS (SELECT CASE WHEN hi = lo THEN 1 ELSE least(floor((wc - lo) * 10 / (hi - lo)) + 1, 10) END::INT AS bucket,
             lo, hi FROM w, b)
SELECT bucket, round(lo + (bucket - 1) * (hi - lo) / 10, 6) AS bucket_start, count(*) AS n
FROM k GROUP BY bucket, lo, hi"""

ORACLES["corpus_chars"] = """
SELECT CAST(coalesce(sum(length(text)), 0) + 2 * greatest(count(text) - 1, 0) AS BIGINT) AS n_chars,
       count(text) AS n_messages FROM documents"""

ORACLES["conversation_concat"] = """
SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS all_text, count(text) AS n_parts
FROM conversations GROUP BY conv_id"""

ORACLES["messages_per_day"] = """
SELECT user_id, CAST(ts AS DATE) AS day, count(*) / 1 AS n_messages FROM events GROUP BY ALL"""

# ---------------------------------------------------------------- chat rows
_UNIX = "(1704067200 + conv_id * 3600 + turn * 60)"
_MSGS = f"""(SELECT 'chat ' || conv_id AS chat_name, conv_id AS chat_idx, turn AS pos, turn AS msg_id,
        CASE WHEN role <> 'system' THEN role END AS sender,
        strftime(make_timestamp({_UNIX} * 1000000), '%Y-%m-%dT%H:%M:%S') AS date,
        {_UNIX} AS date_unixtime, 'text' AS msg_type, replace(text, chr(10), ' ') AS msg_content,
        '' AS forwarded_from
 FROM conversations)"""
_COMPOSED = f"""(SELECT chat_idx, pos,
        msg_content || chr(10) || 'From the chat: ' || chat_name || chr(10) || chr(10) || 'Sender: ' || sender
        || chr(10) || 'Forwarded from: ' || forwarded_from AS text, date
 FROM {_MSGS} m)"""

ORACLES["chat_rows"] = f"SELECT * FROM {_MSGS} m"
ORACLES["last_n_messages"] = f"SELECT * FROM {_MSGS} m ORDER BY chat_idx DESC, pos DESC LIMIT (SELECT count(*) // 3 FROM conversations)"
ORACLES["compose_text"] = f"SELECT * FROM {_COMPOSED} c WHERE text IS NOT NULL"
ORACLES["render_hits"] = f"""
WITH s AS (SELECT DISTINCT chat_idx AS query_id, text || chr(10) || chr(10) || 'Date: ' || split_part(date, 'T', 1) AS s
           FROM {_COMPOSED} c WHERE text IS NOT NULL AND date IS NOT NULL),
p AS (SELECT query_id, string_split(s, 'From the chat: ') AS parts FROM s)
SELECT query_id, parts[1] AS body, parts[2] AS origin,
       '```' || chr(10) || parts[1] || '```' || coalesce('From the chat: ' || parts[2], '') AS rendered
FROM p"""
ORACLES["distinct_chats"] = f"SELECT DISTINCT chat_idx, chat_name FROM {_MSGS} m"


# ---------------------------------------------------------------- accounts
_USERS = """(SELECT c_custkey AS user_id, c_custkey AS telegram_id, c_name AS username,
        CASE WHEN c_custkey // 10 <> c_custkey THEN c_custkey // 10 END AS invited_by_id FROM customer)"""
_PAYMENTS = """(SELECT o_orderkey AS payment_id, o_custkey AS user_id, o_orderdate AS paid_at,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 3 WHEN '3' THEN 6 WHEN '4' THEN 12 END
        AS months FROM orders)"""
_PRICES = "(SELECT * FROM (VALUES (1, 640), (3, 580), (6, 540), (12, 480)) t(months, monthly_price))"
_VALID = f"(SELECT * FROM {_PAYMENTS} p WHERE months IN (SELECT months FROM {_PRICES} pr))"
_ENDS = f"""(SELECT user_id, min(paid_at) AS first_paid, CAST(sum(months) AS BIGINT) AS total_months, count(*) AS n_payments,
        min(paid_at) + to_days(CAST(sum(months) * 30 AS INTEGER)) AS subscription_end_date
 FROM {_VALID} v GROUP BY user_id)"""

ORACLES["subscription_end"] = f"SELECT * FROM {_ENDS} e"
ORACLES["subscription_running"] = f"""
SELECT months, payment_id, user_id, paid_at,
       CAST(sum(months) OVER w AS BIGINT) AS running_months,
       min(paid_at) OVER (PARTITION BY user_id)
         + to_days(CAST(30 * sum(months) OVER w AS INTEGER)) AS end_after
FROM {_VALID} v
WINDOW w AS (PARTITION BY user_id ORDER BY paid_at, payment_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
ORACLES["active_access"] = f"""
SELECT u.user_id, u.username, e.subscription_end_date,
       coalesce(e.subscription_end_date >= TIMESTAMP '2001-01-01 00:00:00', false) AS active,
       coalesce(e.subscription_end_date >= TIMESTAMP '2001-01-01 00:00:00', false)
         OR u.username IN ('Customer#000000001', 'Customer#000000002', 'Customer#000000003') AS access
FROM {_USERS} u LEFT JOIN {_ENDS} e USING (user_id)"""
ORACLES["referral_counts"] = f"""
SELECT a.user_id, count(b.user_id) AS invited_total, count(e.subscription_end_date) AS invited_paid
FROM {_USERS} a LEFT JOIN {_USERS} b ON b.invited_by_id = a.user_id
LEFT JOIN {_ENDS} e ON e.user_id = b.user_id
GROUP BY a.user_id"""
ORACLES["insert_if_absent"] = f"""
SELECT user_id, telegram_id, username, invited_by_id FROM {_USERS} u
UNION ALL
SELECT DISTINCT user_id, user_id AS telegram_id, 'there' AS username, NULL AS invited_by_id FROM events
WHERE user_id NOT IN (SELECT telegram_id FROM {_USERS} u2)"""
ORACLES["search_counter"] = "SELECT user_id, count(*) AS queries_count FROM events WHERE event_type = 'view' GROUP BY user_id"
ORACLES["quota_24h"] = """
SELECT event_id, user_id, ts, prior_24h, prior_24h <= 30 AS within_quota FROM (
  SELECT event_id, user_id, ts,
         count(*) OVER (PARTITION BY user_id ORDER BY ts
                        RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) - 1 AS prior_24h
  FROM events)"""
_SENDERS = f"""(SELECT user_id, telegram_id, username, invited_by_id, greatest(c_acctbal, 0.0) / 45 AS volume
  FROM {_USERS} u0 JOIN customer c0 ON c0.c_custkey = u0.user_id
  UNION ALL SELECT DISTINCT user_id, user_id, 'there', NULL, NULL FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer))"""
ORACLES["quota_asof"] = f"""
SELECT user_id, n_24h, n_24h <= 30 AND coalesce(volume, 0) <= 200 AS within_limits FROM (
  SELECT s.user_id, any_value(volume) AS volume, count(e.ts) FILTER (ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 DAY
                                   AND ts <= TIMESTAMP '2024-01-30 00:00:00') AS n_24h
  FROM {_SENDERS} s LEFT JOIN events e USING (user_id) GROUP BY s.user_id)"""
ORACLES["inviter_assign"] = f"""
WITH s AS (SELECT * FROM {_SENDERS} s0),
l AS (SELECT e.user_id AS telegram_id, i.user_id AS named, row_number() OVER (PARTITION BY e.user_id ORDER BY ts DESC, event_id DESC) AS r
      FROM events e JOIN s i ON i.telegram_id = 200 * (CAST(json_extract(props, '$.k') AS INTEGER) % 10)
      WHERE event_type = 'signup' AND CAST(json_extract(props, '$.k') AS INTEGER) % 10 <> 5)
SELECT user_id, s.telegram_id, username, coalesce(named, invited_by_id) AS invited_by_id FROM s LEFT JOIN l ON l.telegram_id = s.telegram_id AND r = 1"""
# one message after the other, as the handlers are tried
ORACLES["mode_routing"] = f"""
WITH RECURSIVE
e AS (SELECT event_id, user_id, ts, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) % 10 AS k FROM events),
m AS (SELECT *, CASE event_type WHEN 'signup' THEN '/start' WHEN 'view' THEN '/search' WHEN 'purchase' THEN 'payment' WHEN 'error' THEN
               CASE WHEN k <= 1 THEN '/import' WHEN k <= 3 THEN '/subscribe' WHEN k = 4 THEN '/note' WHEN k <= 7 THEN '/chat' WHEN k = 8 THEN 'reset' ELSE '/help' END END AS command,
             CASE WHEN event_type = 'purchase' AND k <> 9 THEN [1, 3, 6, 12][1 + k % 4] END AS months FROM e),
p AS (SELECT *, sum(months) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS paid,
             min(ts) FILTER (months IS NOT NULL) OVER (PARTITION BY user_id) AS first_paid,
             count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) - 1 AS prior,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM m),
g AS (SELECT p.*, coalesce(paid > 0 AND first_paid + to_days(CAST(30 * paid AS INTEGER)) >= ts, false)
               OR coalesce(s.username IN ('Customer#000000001', 'Customer#000000002', 'Customer#000000003'), false) AS sub,
             prior <= 30 AND coalesce(s.volume, 0) <= 200 AS within,
             EXISTS (SELECT 1 FROM documents d WHERE d.source = 'src' || p.user_id) AS noted
      FROM p LEFT JOIN {_SENDERS} s ON s.user_id = p.user_id),
w AS (
  SELECT g.*, '' AS before, CASE WHEN command IN ('/start', '/note') THEN 'notes' WHEN command = '/chat' THEN 'chat' WHEN command = '/subscribe' THEN 'subscription_choice'
    WHEN command = '/import' AND sub THEN 'wait_for_json' WHEN command = '/search' AND within AND noted THEN 'search'
    WHEN command = 'payment' AND k <> 9 THEN 'notes' ELSE '' END AS after FROM g WHERE i = 1
  UNION ALL
  SELECT g.*, w.after AS before, CASE
    WHEN g.command IN ('/start', '/note') THEN 'notes' WHEN g.command = '/chat' THEN 'chat' WHEN g.command = '/subscribe' THEN 'subscription_choice'
    WHEN g.command = 'reset' THEN '' WHEN g.command = '/help' THEN w.after
    WHEN g.command = '/import' THEN CASE WHEN g.sub THEN 'wait_for_json' ELSE w.after END
    WHEN g.command = '/search' THEN CASE WHEN g.within AND g.noted THEN 'search' ELSE w.after END
    WHEN w.after = 'subscription_choice' THEN CASE WHEN g.event_type = 'click' AND g.k IN (1, 3, 6) THEN 'wait_for_payment' ELSE w.after END
    WHEN g.command = 'payment' THEN CASE WHEN g.k <> 9 THEN 'notes' ELSE w.after END
    WHEN w.after = 'chat' AND g.sub AND NOT g.within THEN ''
    WHEN w.after = 'search' AND g.sub AND (NOT g.within OR g.value >= 30) THEN ''
    ELSE w.after END AS after
  FROM w JOIN g ON g.user_id = w.user_id AND g.i = w.i + 1)
SELECT event_id, user_id, ts, command, nullif(before, '') AS mode_before, nullif(after, '') AS mode_after FROM w"""
ORACLES["payload_split"] = f"""
SELECT payment_id, payload, split_part(payload, '_', 1) AS goal, TRY_CAST(split_part(payload, '_', 2) AS INTEGER) AS months_num
FROM (SELECT payment_id, 'subscribe_' || coalesce(CAST(months AS VARCHAR), 'x') AS payload FROM {_PAYMENTS} p)"""
_ISO = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%g", "%Y-%m-%d", "%Y%m%dT%H%M%S", "%Y-%m-%dT%H:%M", "%Y-%m-%dT%H", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S-03:30")
_ISO_TEXT = " ".join(f"WHEN {k} THEN strftime(ts, '{f}')" for k, f in enumerate(_ISO))
ORACLES["event_parse"] = f"""
SELECT event_id, CASE WHEN event_type = 'error' THEN props ELSE CASE event_id % 8 {_ISO_TEXT} END END AS event_text,
       CASE WHEN event_type <> 'error' THEN CASE event_id % 8 WHEN 1 THEN date_trunc('millisecond', ts) WHEN 2 THEN date_trunc('day', ts)::TIMESTAMP
            WHEN 4 THEN date_trunc('minute', ts) WHEN 5 THEN date_trunc('hour', ts) ELSE date_trunc('second', ts) END END AS event_at,
       CASE WHEN event_type <> 'error' THEN CASE event_id % 8 WHEN 6 THEN 0 WHEN 7 THEN -12600 END END AS utc_offset
FROM events"""
ORACLES["note_texts"] = """
SELECT * FROM (SELECT conv_id, turn, nullif(CASE WHEN turn % 4 = 3 THEN text WHEN (conv_id + turn) % 7 = 0 THEN '' ELSE text END, '') AS note FROM conversations)
WHERE note IS NOT NULL"""
ORACLES["index_names"] = "SELECT DISTINCT 'index-' || (label % 3 + 1) AS index_name FROM embeddings"
ORACLES["note_vectors"] = ("SELECT doc_id, list_transform(['a', 'e', 'i', 'n', 'o', 'r', 's', 't'], lambda c: length(text) - length(replace(text, c, ''))) AS v "
                           "FROM documents WHERE text IS NOT NULL")
ORACLES["props_json"] = """
SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       json_extract(props, '$.k') IS NOT NULL AS has_k,
       CASE WHEN json_type(props) = 'OBJECT' THEN 'OBJECT' WHEN json_type(props) = 'ARRAY' THEN 'ARRAY'
            WHEN json_valid(props) THEN 'SCALAR' END AS kind
FROM events"""
ORACLES["first_note"] = "SELECT source, min(doc_id) AS first_doc_id, count(*) AS n_items FROM documents GROUP BY source"
ORACLES["price_choices"] = f"""
SELECT p.payment_id, p.user_id, p.months, coalesce(u.invited_by_id IS NOT NULL, false) AS invited,
       CAST(round(CASE WHEN u.invited_by_id IS NOT NULL
                       THEN CAST(pr.monthly_price * p.months AS DECIMAL(12,2)) * 0.8
                       ELSE CAST(pr.monthly_price * p.months AS DECIMAL(12,2)) END * 100, 2) AS DECIMAL(14,2))
         AS amount_minor
FROM {_PAYMENTS} p JOIN {_PRICES} pr USING (months) LEFT JOIN {_USERS} u USING (user_id)"""
ORACLES["choice_rejects"] = f"""
SELECT payment_id, user_id FROM {_PAYMENTS} p
WHERE months IS NULL OR months NOT IN (SELECT months FROM {_PRICES} pr)"""
ORACLES["subscription_labels"] = """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d_%H-%M-%S') AS paid_label,
       strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d_%H-%M-%S') AS end_label FROM orders"""
ORACLES["note_documents"] = f"""
SELECT u.user_id, format('user_{{:d}}_notes', u.telegram_id) AS namespace,
       coalesce(nullif(u.username, ''), 'there') AS username, d.text AS page_content,
       CAST(d.doc_id AS VARCHAR) AS source, substr(d.text, 1, 20) AS preview
FROM documents d JOIN {_USERS} u ON u.user_id = TRY_CAST(regexp_extract(d.source, '^src([0-9]+)$', 1) AS BIGINT)
WHERE nullif(d.text, '') IS NOT NULL"""
ORACLES["pending_notes"] = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


# ---------------------------------------------------------------- chunking
def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_lit('^' + PY_WHITESPACE + '|' + PY_WHITESPACE + '$')}, '', 'g')"


def _jl(arr: str, sep_len: int) -> str:
    return f"(coalesce(list_sum(list_transform({arr}, lambda y: length(y))), 0) + {sep_len} * greatest(len({arr}) - 1, 0))"


def _chunk_sql(sep: str = "\n", size: int = 1024, overlap: int = 256) -> str:
    s = len(sep)
    sep_sql = " || ".join(f"chr({ord(c)})" for c in sep)
    rest = "list_slice(acc.cur, i, len(acc.cur))"
    admissible = (f"{_jl(rest, s)} <= {overlap} AND ({_jl(rest, s)} + length(d) "
                  f"+ CASE WHEN len({rest}) > 0 THEN {s} ELSE 0 END <= {size} OR {_jl(rest, s)} = 0)")
    overflow = f"(len(acc.cur) > 0 AND {_jl('acc.cur', s)} + length(d) + {s} > {size})"
    emitted = _strip(f"array_to_string(acc.cur, {sep_sql})")
    start = f"list_filter(range(1, len(acc.cur) + 2), lambda i: {admissible})[1]"
    step = (f"lambda acc, d: {{'docs': CASE WHEN {overflow} AND length({emitted}) > 0 "
            f"THEN list_append(acc.docs, {emitted}) ELSE acc.docs END, "
            f"'cur': list_append(CASE WHEN {overflow} THEN list_slice(acc.cur, {start}, len(acc.cur)) "
            f"ELSE acc.cur END, d)}}")
    last = _strip(f"array_to_string(st.cur, {sep_sql})")
    return f"""
WITH p AS (SELECT doc_id, list_filter(string_split(text, {sep_sql}), lambda x: x <> '') AS parts
           FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_reduce(parts, {step},
                                  {{'docs': []::VARCHAR[], 'cur': []::VARCHAR[]}}) AS st FROM p),
g AS (SELECT doc_id, CASE WHEN length({last}) > 0 THEN list_append(st.docs, {last}) ELSE st.docs END AS cs FROM f)
SELECT doc_id, generate_subscripts(cs, 1) - 1 AS chunk_idx, unnest(cs) AS chunk, length(unnest(cs)) AS n_chars
FROM g"""


ORACLES["chunks"] = _chunk_sql("\n")

# ---------------------------------------------------------------- retrieval
_E = """(SELECT vec_id, label, format('user_{:d}_notes', label) AS namespace,
        CASE (label % 3 + 3) % 3 WHEN 0 THEN 'index-1' WHEN 1 THEN 'index-2' ELSE 'index-3' END AS index_name,
        CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
_Q = f"""(SELECT namespace AS query_id, namespace, list_transform(q, lambda y: y / sqrt(list_dot_product(q, q))) AS q
 FROM (SELECT namespace, list(x ORDER BY i) AS q
       FROM (SELECT namespace, i, avg(x) AS x
             FROM (SELECT namespace, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM {_E} e0)
             GROUP BY namespace, i)
       GROUP BY namespace))"""
_S = f"""(SELECT q.query_id, e.vec_id,
        (1 + list_dot_product(q.q, e.v) / (sqrt(list_dot_product(q.q, q.q)) * sqrt(list_dot_product(e.v, e.v)))) / 2
          AS score
 FROM {_Q} q JOIN {_E} e USING (namespace))"""


def _top(k: int, threshold: float | None) -> str:
    where = f"WHERE score >= {threshold}" if threshold is not None else ""
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
                FROM {_S} s {where}) WHERE rank <= {k})"""


def _noted(k, threshold):
    return f"""(SELECT h.*, d.source, d.text AS page_content FROM {_top(k, threshold)} h
               LEFT JOIN documents d ON d.doc_id = h.vec_id)"""


ORACLES["vector_topk"] = f"SELECT query_id, rank, vec_id, round(score, 6) AS score FROM {_top(5, 0.6)} t"
ORACLES["hits_dedup"] = f"""
SELECT query_id, source, vec_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, vec_id) AS r
  FROM {_noted(5, 0.6)} n WHERE source IS NOT NULL) WHERE r = 1"""


def _context(tail: str | None) -> str:
    t = f" || chr(10) || chr(10) || 'Answer to ' || query_id || chr(10) || chr(10) || {_lit(tail)}" if tail else ""
    return f"""
SELECT query_id, count(*) AS n_docs,
       string_agg(page_content, chr(10) || chr(10) ORDER BY r){t} AS context
FROM (SELECT query_id, page_content, min(rank) AS r FROM {_noted(4, None)} n GROUP BY query_id, page_content)
GROUP BY query_id"""


ORACLES["gated_search"] = f"""
WITH u AS (SELECT s.*, coalesce(e.subscription_end_date >= TIMESTAMP '2001-01-01 00:00:00', false)
                  OR s.username IN ('Customer#000000001', 'Customer#000000002', 'Customer#000000003') AS access
           FROM {_SENDERS} s LEFT JOIN {_ENDS} e USING (user_id)),
q AS (SELECT user_id, within_limits FROM ({ORACLES["quota_asof"]})),
a AS (SELECT u.telegram_id, access, within_limits, (SELECT count(*) FROM events v WHERE v.user_id = u.user_id AND event_type = 'view') AS made,
             access AND within_limits AS ok FROM u JOIN q USING (user_id) WHERE u.telegram_id IN (SELECT label FROM embeddings)),
h AS (SELECT TRY_CAST(regexp_extract(query_id, '([0-9]+)', 1) AS BIGINT) AS telegram_id, string_agg(vec_id, ',' ORDER BY rank) AS hits FROM {_top(5, 0.6)} t GROUP BY query_id)
SELECT a.telegram_id, access, within_limits, made + ok::INT AS queries_count, CASE WHEN ok THEN hits END AS hits FROM a LEFT JOIN h USING (telegram_id)"""
ORACLES["rag_context"] = _context(None)
ORACLES["context_union"] = _context('Carefully analyze relevant documents provided above and just say "OK"')
ORACLES["index_stats"] = f"SELECT index_name, namespace, count(*) AS n_records FROM {_E} e GROUP BY ALL"
ORACLES["index_clear"] = (f"SELECT index_name, namespace, count(*) AS n_records FROM {_E} e "
                          f"WHERE index_name NOT IN ('index-1') AND namespace <> 'user_1_notes' GROUP BY ALL")

ORACLES["export_roundtrip"] = """
SELECT 'chat ' || conv_id AS chat_name, turn AS msg_id, role AS sender, 'user' || conv_id AS sender_id,
       CAST(NULL AS BIGINT) AS reply_to_msg_id,
       strftime(make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000), '%Y-%m-%dT%H:%M:%S') AS date,
       1704067200 + conv_id * 3600 + turn * 60 AS date_unixtime, 'text' AS msg_type,
       replace(coalesce(text, ''), chr(10), ' ') AS msg_content, '' AS forwarded_from,
       '' AS action, 0 AS has_mention, 0 AS has_email, 0 AS has_phone, 0 AS has_hashtag,
       0 AS is_bot_command
FROM conversations WHERE role <> 'system'"""

# ---------------------------------------------------------------- streaming (same results as batch)
ORACLES["stream_users"] = f"""
SELECT user_id, telegram_id, username, '' AS first_name, '' AS last_name FROM {_USERS} u
UNION ALL
SELECT DISTINCT 20 * user_id, 20 * user_id, CASE WHEN user_id % 3 <> 0 THEN 'user' || 20 * user_id ELSE 'there' END,
       CASE WHEN user_id % 5 <> 0 THEN 'First ' || 20 * user_id ELSE '' END, '' FROM events WHERE 20 * user_id NOT IN (SELECT c_custkey FROM customer)"""
ORACLES["stream_modes"] = ORACLES["mode_routing"]
ORACLES["stream_quota"] = """
SELECT user_id, window_start, window_start + INTERVAL 1 DAY AS window_end, count(*) AS n_messages,
       count(*) <= 30 AS within_quota
FROM (SELECT user_id, date_trunc('hour', ts) - to_hours(k) AS window_start FROM events, range(0, 24) r(k))
GROUP BY user_id, window_start"""
ORACLES["stream_index"] = ORACLES["chunks"].replace(
    "SELECT doc_id, generate_subscripts(cs, 1) - 1 AS chunk_idx",
    "SELECT doc_id, format('user_{:d}_notes', u) AS namespace, "
    "CASE u % 3 WHEN 0 THEN 'index-1' WHEN 1 THEN 'index-2' ELSE 'index-3' END AS index_name, "
    "generate_subscripts(cs, 1) - 1 AS chunk_idx").replace(
    "SELECT doc_id, list_filter(", "SELECT doc_id, TRY_CAST(regexp_extract(source, '^src([0-9]+)$', 1) AS BIGINT) AS u, list_filter(").replace(
    "SELECT doc_id, list_reduce(", "SELECT doc_id, u, list_reduce(").replace(
    "SELECT doc_id, CASE WHEN length(", "SELECT doc_id, u, CASE WHEN length(")
ORACLES["csv_roundtrip"] = f"SELECT text, date FROM {_COMPOSED} c WHERE text IS NOT NULL"
ORACLES["chunk_store"] = ORACLES["stream_index"]
ORACLES["users_with_notes"] = f"""
SELECT user_id, username FROM {_USERS} u
WHERE EXISTS (SELECT 1 FROM documents d WHERE TRY_CAST(regexp_extract(d.source, '^src([0-9]+)$', 1) AS BIGINT) = u.user_id)"""


# The exact streaming quota must equal the batch trailing count over the same messages.
ORACLES["stream_quota_exact"] = ORACLES["quota_24h"]

# ---------------------------------------------------------------- rich exports, CSV sinks (rules restated from the reference)
_RICH = """
m AS (SELECT *, (conv_id * 7 + turn) % 9 AS kind, 1704067200 + conv_id * 3600 + turn * 60 AS unix FROM conversations),
r AS (SELECT *, 'see ' || coalesce(text, '') || '@a' AS listed FROM m WHERE kind <> 8 AND conv_id % 11 <> 10),
p AS (SELECT *, CASE kind WHEN 0 THEN 'text' WHEN 1 THEN 'link' WHEN 2 THEN 'sticker' WHEN 3 THEN 'video_file' WHEN 4 THEN 'file'
                          WHEN 5 THEN 'photo' WHEN 6 THEN 'poll' ELSE 'location' END AS msg_type,
             replace(CASE kind WHEN 0 THEN coalesce(text, '') WHEN 1 THEN listed WHEN 2 THEN 's.webp' WHEN 3 THEN '?' WHEN 4 THEN 'doc.pdf'
                          WHEN 5 THEN 'p.jpg' WHEN 6 THEN CAST(turn AS VARCHAR) ELSE '1.5,2.25' END, chr(10), ' ') AS msg_content FROM r),
n AS (SELECT *, 'chat ' || conv_id AS chat_name, 0 AS second FROM p
      UNION ALL SELECT *, 'Unknown Chat', 1 FROM p WHERE conv_id % 3 <> 0)"""
ORACLES["export_rich"] = f"""WITH {_RICH}
SELECT chat_name, turn AS msg_id, CASE WHEN conv_id % 4 = 0 THEN '' ELSE role END AS sender, 'user' || conv_id AS sender_id,
       CASE WHEN turn % 3 = 2 THEN turn - 1 END AS reply_to_msg_id, strftime(make_timestamp(unix * 1000000), '%Y-%m-%dT%H:%M:%S') AS date,
       unix AS date_unixtime, msg_type, msg_content, CASE WHEN turn % 2 = 1 THEN 'someone' ELSE '' END AS forwarded_from, '' AS action,
       (kind = 1)::INT AS has_mention, 0 AS has_email, 0 AS has_phone, 0 AS has_hashtag, 0 AS is_bot_command FROM n"""
ORACLES["import_chunks"] = f"""WITH {_RICH},
documents AS (SELECT conv_id * 1000000 + turn * 10 + second AS doc_id, strftime(make_timestamp(unix * 1000000), '%Y-%m-%dT%H:%M:%S') AS date,
  msg_content || chr(10) || 'From the chat: ' || chat_name || chr(10) || chr(10) || 'Sender: ' || CASE WHEN conv_id % 4 = 0 THEN '' ELSE role END
  || chr(10) || 'Forwarded from: ' || CASE WHEN turn % 2 = 1 THEN 'someone' ELSE '' END AS text FROM n),
x AS ({_chunk_sql(chr(10))})
SELECT 'user_42_notes' AS namespace, date, chunk_idx, chunk, n_chars FROM x JOIN documents USING (doc_id)"""
ORACLES["export_rejects"] = """
SELECT 'unrecognised layout' AS reason, count(DISTINCT conv_id) AS n FROM conversations WHERE conv_id % 11 = 10 HAVING count(*) > 0"""
ORACLES["messages_csv"] = """
SELECT 'chat ' || conv_id AS chat_name, turn AS msg_id, CASE WHEN role <> 'system' AND role <> '' THEN role END AS sender,
       strftime(make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000), '%Y-%m-%dT%H:%M:%S') AS date,
       nullif(replace(text, chr(10), ' '), '') AS msg_content FROM conversations"""
ORACLES["notes_csv"] = """
SELECT TRY_CAST(regexp_extract(source, '^src([0-9]+)$', 1) AS BIGINT) AS telegram_id, doc_id AS message_id, nullif(text, '') AS text
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"""
ORACLES["stream_exports"] = ORACLES["export_rich"]
