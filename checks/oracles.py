"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from checks.catalog import BOUNDS, HEAD, PROMPT, SHARE, TABLES, WEIGHTS

# --- derived sources --------------------------------------------------------------------

NL = "chr(10)"
SPACES = (
    r"[ \t\n\r\f\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

QA = """qa AS (
  SELECT a.conv_id * 4294967296 + a.turn AS key, a.conv_id, a.turn,
         a.text AS question, b.text AS answer
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')"""
TURNS = "turns AS (SELECT conv_id AS key, turn AS idx, role, text AS content FROM conversations)"
SPELLED = """spelled AS (
  SELECT conv_id AS key, turn AS idx, text AS content,
         CASE WHEN role = 'user' THEN CASE WHEN length(text) % 2 = 0 THEN 'Human' ELSE 'USER' END
              WHEN role = 'assistant' THEN CASE length(text) % 3 WHEN 0 THEN 'Bot' WHEN 1 THEN 'tool_use' END
              ELSE 'AI' END AS spelling
  FROM conversations),
named AS (
  SELECT *, CASE WHEN lower(spelling) IN ('human', 'user') THEN 'user'
                 WHEN lower(spelling) IN ('bot', 'ai') THEN 'assistant' ELSE spelling END AS role
  FROM spelled)"""
ALPACA = f"""alpaca AS (
  SELECT doc_id AS key, 'Continue this text in ' || lang AS instruction,
         CASE doc_id % 3 WHEN 1 THEN '' WHEN 2 THEN string_split(text, {NL})[1] END AS input,
         text AS output
  FROM documents)"""
ASKED = f"""CASE WHEN coalesce(input, '') = '' THEN instruction
         ELSE instruction || {NL} || {NL} || input END"""
PAIRS = f"""labelled AS (
  SELECT doc_id, lang, text, quality,
         row_number() OVER (PARTITION BY lang, quality ORDER BY doc_id) - 1 AS i,
         count(*) FILTER (quality = 0) OVER (PARTITION BY lang) AS n
  FROM documents JOIN labels USING (doc_id)),
pairs AS (
  SELECT g.doc_id AS key, string_split(g.text, {NL})[1] AS prompt,
         g.text AS chosen, b.text AS rejected
  FROM labelled g JOIN labelled b
    ON b.lang = g.lang AND b.quality = 0 AND g.quality = 1 AND b.i = g.i % g.n
  WHERE g.n > 0)"""
HALF_EMPTY = """answers AS (
  SELECT key, CASE WHEN conv_id % 4 = 0 THEN ' ' ELSE question END AS question,
         CASE WHEN conv_id % 4 = 0 THEN ' ' ELSE answer END AS answer FROM qa)"""


def _with(*parts: str, select: str) -> str:
    return f"WITH {', '.join(parts)} {select}" if parts else select


def _two(question: str, answer: str, table: str) -> str:
    return f"""SELECT key, 0::BIGINT AS idx, 'user' AS role, {question} AS content FROM {table}
UNION ALL SELECT key, 1::BIGINT, 'assistant', {answer} FROM {table}"""


def _joined(items: str) -> str:
    return f"array_to_string(list_filter({items}, lambda x: x <> ''), {NL})"


LINES = f"string_split(content, {NL})"
STD_QA = _with(QA, select=_two("question", "answer", "qa"))
CHAT_ROWS = _with(TURNS, select="SELECT key, idx, role, content FROM turns")
HEADED = f"""string_agg('### ' || CASE coalesce(role, 'user') WHEN 'user' THEN 'Instruction'
  WHEN 'assistant' THEN 'Response' WHEN 'system' THEN 'System' WHEN 'tool_use' THEN 'Tool_Use'
  ELSE role END || ':' || {NL} || content, {NL} || {NL} ORDER BY idx)"""


def _headed_pair(question: str, answer: str) -> str:
    return (
        f"'### Instruction:' || {NL} || {question} || {NL} || {NL} || "
        f"'### Response:' || {NL} || {answer}"
    )


# Rows of the merged sources: target-shaped, with position, length, payload and blank flag.
CHAT_PAYLOAD = "string_agg(role || ':' || content, '||' ORDER BY idx)"
PROMPT_TURN = f"system:{PROMPT}||"


def _merged_rows(prompt: bool = False) -> str:
    """Chats, tasks, texts (and half-empty answers) in the chat shape, one row each."""
    extra = len(PROMPT) if prompt else 0
    lead = f"'{PROMPT_TURN}' || " if prompt else ""
    plain = f"{lead}'user:' || %s || '||assistant:' || %s"
    opening = "arg_min(role, idx) <> 'system'" if prompt else "false"
    return f"""merged AS (
  SELECT 0 AS src, 'cb_chats' AS label, key,
         CASE WHEN {opening} THEN '{PROMPT_TURN}' ELSE '' END || {CHAT_PAYLOAD} AS payload,
         sum(length(content)) + CASE WHEN {opening} THEN {extra} ELSE 0 END AS len
  FROM turns GROUP BY key
  UNION ALL
  SELECT 1, 'cb_tasks', key, {plain % (ASKED, "output")},
         length({ASKED}) + length(output) + {extra} FROM alpaca
  UNION ALL
  SELECT 2, 'cb_texts', doc_id, {lead}'assistant:' || text, length(text) + {extra} FROM documents
  UNION ALL
  SELECT 3, 'cb_answers', key, {plain % ("question", "answer")},
         length(question) + length(answer) + {extra} FROM answers)"""


CHATS_TASKS_TEXTS = [TURNS, ALPACA, QA, HALF_EMPTY, _merged_rows()]
LABELS = "CASE src WHEN 0 THEN 'chats' WHEN 1 THEN 'tasks' WHEN 2 THEN 'texts' ELSE 'answers' END"
WITHIN = f"len BETWEEN {BOUNDS[0]} AND {BOUNDS[1]}"


def _kept(rows: str, order: str) -> str:
    return f"""kept AS (
  SELECT * FROM (
    SELECT *, sha256(payload) AS h,
           row_number() OVER (PARTITION BY payload ORDER BY {order}) AS rn
    FROM {rows} WHERE {WITHIN}) WHERE rn = 1)"""


def _split(identity: str, seed: int = 42, share: float = 0.1) -> str:
    """Exactly the first tenth in order of a hash of the row's identity."""
    number = f"substr(md5('{seed}/split:' || {identity}), 1, 13)"
    return f"""parted AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY {number}, {identity})
                  <= ceil(count(*) OVER () * {share}::DOUBLE) THEN 'test' ELSE 'train' END AS split
  FROM kept)"""


def _ordered(identity: str, ties: str, content: str = "h") -> str:
    """Each final row with its place in its split."""
    return f"""SELECT label AS source_dataset, split, {content} AS content,
  row_number() OVER (PARTITION BY split ORDER BY substr(md5('42:' || {identity}), 1, 13), {ties}) - 1 AS position
FROM parted"""


PER_SPLIT = _ordered("h", "h")
MERGE = [TURNS, ALPACA, QA, HALF_EMPTY, _merged_rows(prompt=True)]
MERGE_KEPT = [*MERGE, _kept("merged", "src, key"), _split("h")]

TEXT_MERGED = f"""merged AS (
  SELECT 0 AS src, 'cb_chats' AS label, key, {HEADED} AS payload FROM turns GROUP BY key
  UNION ALL SELECT 1, 'cb_tasks', key, {_headed_pair(f"({ASKED})", "output")} FROM alpaca
  UNION ALL SELECT 2, 'cb_texts', doc_id, text FROM documents
  UNION ALL SELECT 3, 'cb_answers', key, {_headed_pair("question", "answer")} FROM answers),
measured AS (SELECT *, length(payload) AS len FROM merged)"""

INDEXED = """indexed AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY key) - 1 AS i FROM merged),
sizes AS (SELECT src, count(*) AS n FROM merged GROUP BY src)"""


# --- draws ---------------------------------------------------------------------------------

MIXED = """rows AS (
  SELECT 0 AS src, doc_id AS key, text AS content FROM documents
  UNION ALL SELECT 1, conv_id, string_agg(text, '|' ORDER BY turn) FROM conversations GROUP BY conv_id
  UNION ALL SELECT 2, key, question FROM qa),
indexed AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY key) - 1 AS i FROM rows),
sizes AS (SELECT src, count(*) AS n FROM rows GROUP BY src)"""


def _draws(weights, stop: str) -> str:
    """Draws by weight up to the stop, each with its number among its source's draws."""
    total, upto, cases = sum(weights), 0.0, []
    for i, w in enumerate(weights[:-1]):
        upto += w / total
        cases.append(f"WHEN u < {upto!r}::DOUBLE THEN {i}")
    shares = " ".join(f"WHEN {i} THEN {w / total!r}" for i, w in enumerate(weights))
    agg = "max" if stop == "all_exhausted" else "min"
    return f"""tickets AS (
  SELECT unnest(range((SELECT (1.5 * max(n / (CASE src {shares} END)) + 1000)::BIGINT FROM sizes))) AS t),
units AS (
  SELECT t, ('0x' || substr(md5('42:' || t), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE AS u
  FROM tickets),
drawn AS (SELECT t, CASE {' '.join(cases)} ELSE {len(weights) - 1} END AS src FROM units),
picked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t) - 1 AS k FROM drawn),
halt AS (SELECT {agg}(t) AS t FROM picked JOIN sizes USING (src) WHERE k = n - 1),
used AS (
  SELECT p.t, p.src, p.k, p.k % s.n AS i FROM picked p JOIN sizes s USING (src)
  WHERE p.t <= (SELECT t FROM halt))"""


def _round_robin(stop: str) -> str:
    agg = "max" if stop == "all_exhausted" else "min"
    return f"""cycles AS (SELECT unnest(range((SELECT {agg}(n) FROM sizes))) AS c),
used AS (SELECT c * (SELECT count(*) FROM sizes) + src AS t, src, c % n AS i FROM cycles, sizes)"""


USED = """SELECT t AS draw, u.src::BIGINT AS source, u.i AS row_index, x.key, x.content
FROM used u JOIN indexed x ON x.src = u.src AND x.i = u.i"""

# --- reports ----------------------------------------------------------------------------------

FORMATS = {"documents": "text", "benchmark": "text", "conversations": "text"}
COLUMNS = {
    "region": "r_regionkey,r_name",
    "nation": "n_nationkey,n_name,n_regionkey",
    "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment",
    "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal",
    "part": "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice",
    "orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
    "lineitem": (
        "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,"
        "l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate"
    ),
    "events": "event_id,ts,user_id,event_type,value,props",
    "documents": "doc_id,text,lang,source,n_chars",
    "embeddings": "vec_id,embedding,label",
    "pages": "page_id,url,html",
    "benchmark": "item_id,text",
    "labels": "doc_id,quality,toxic",
    "conversations": "conv_id,turn,role,text",
}


def _inspected() -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{t}' AS source, '{FORMATS.get(t, "unknown")}' AS format, count(*) AS n_rows,
  '{COLUMNS[t]}' AS columns FROM {t}"""
        for t in TABLES
    )


def _layouts() -> str:
    qa, chats = "(SELECT count(*) FROM qa)", "(SELECT count(DISTINCT conv_id) FROM conversations)"
    docs = "(SELECT count(*) FROM documents)"
    rows = [
        ("alpaca", "alpaca", docs, "instruction,input,output"),
        ("blocks", "chatml", chats, "messages"),
        ("chatml", "chatml", chats, "messages"),
        ("content", "text", "(SELECT count(*) FROM pages)", "content"),
        ("fuzzy", "alpaca_fuzzy", qa, "task_description,model_answer"),
        ("io", "input_output", qa, "input,output"),
        ("manual", "unknown", qa, "q_txt,a_txt"),
        ("preference", "preference", "(SELECT count(*) FROM pairs)", "prompt,chosen,rejected"),
        ("prompt", "prompt_completion", qa, "prompt,response"),
        ("qa", "qa", qa, "question,answer"),
        ("sharegpt", "sharegpt", chats, "conversations"),
        ("text", "text", docs, "text"),
    ]
    body = "\nUNION ALL ".join(
        f"SELECT '{a}' AS source, '{b}' AS format, {n} AS n_rows, '{c}' AS columns"
        for a, b, n, c in rows
    )
    return _with(QA, PAIRS, select=body)


PROFILE = _with(
    QA,
    HALF_EMPTY,
    ALPACA,
    select="""SELECT 'chats' AS source, 'sharegpt' AS format,
  count(DISTINCT conv_id) AS n_rows, avg(length(text)) AS avg_length, 0::BIGINT AS n_missing,
  0::BIGINT AS n_empty, 0::BIGINT AS n_json_like FROM conversations
UNION ALL SELECT 'empty', 'qa', count(*), avg(length(question) + length(answer)), 0,
  count(*) FILTER (trim(question) = '' AND trim(answer) = ''),
  count(*) FILTER (question LIKE '[{%') + count(*) FILTER (answer LIKE '[{%') FROM answers
UNION ALL SELECT 'texts', 'text', count(*), avg(length(text)), count(*) FILTER (text = ''),
  count(*) FILTER (NOT regexp_matches(text, '[^ \\t\\n\\r]')),
  count(*) FILTER (text LIKE '[{%') FROM documents
UNION ALL SELECT 'tasks', 'alpaca', count(*),
  avg(length(instruction) + length(coalesce(input, '')) + length(output)),
  count(*) FILTER (coalesce(input, '') = '') + count(*) FILTER (output = ''),
  0, count(*) FILTER (input LIKE '[{%') + count(*) FILTER (output LIKE '[{%') FROM alpaca""",
)


def _bins(rows: str) -> str:
    return f"""SELECT greatest(1, ((len - low) * 12 + high - low - 1) // greatest(high - low, 1))::BIGINT AS bin,
  count(*) AS n_rows, min(len)::BIGINT AS shortest, max(len)::BIGINT AS longest
FROM (SELECT len, min(len) OVER () AS low, max(len) OVER () AS high FROM {rows}) GROUP BY 1"""


def _rate(rows: str, blank: str, limit: float, by: str | None = None) -> str:
    group = f"{by} AS source_dataset, " if by else ""
    return f"""SELECT {group}count(*) AS sample_size, count(*) FILTER ({blank}) AS empty_rows,
  count(*) FILTER ({blank}) / count(*)::DOUBLE AS empty_rate,
  count(*) FILTER ({blank}) / count(*)::DOUBLE > {limit} AS flagged FROM {rows}
{"GROUP BY 1" if by else ""}"""


# a merged row is blank when nothing but role names, separators and spaces is left of it
ANSWER_BLANK = "src = 3 AND payload = 'user: ||assistant: '"
BLANK_TEXT = "NOT regexp_matches(text, '[^ \\t\\n\\r]')"
TOP_REPEATS = """SELECT key, source, substr(content, 1, 140) AS preview FROM (
  SELECT key, source, content, part,
         row_number() OVER (PARTITION BY payload ORDER BY part, key) AS rn FROM {rows})
WHERE rn > 1 ORDER BY part, key LIMIT 3"""

TWICE = f"""chats AS (
  SELECT key, {CHAT_PAYLOAD} AS payload, arg_min(content, idx) AS content FROM turns GROUP BY key),
doubled AS (
  SELECT 0::BIGINT AS part, *, 'chats' AS source FROM chats
  UNION ALL SELECT 1, *, 'chats' FROM chats)"""
FIRST_OF = """SELECT key, part FROM (
  SELECT key, part, row_number() OVER (PARTITION BY {payload} ORDER BY part, key) AS rn FROM {rows})
WHERE rn = 1"""
ALL_DOCUMENTS = "SELECT doc_id, text, lang, n_chars FROM documents"
SAVED = """SELECT unnest(['jsonl', 'csv', 'parquet']) AS kind, key,
  CASE WHEN row_number() OVER (ORDER BY substr(md5('42/split:' || key), 1, 13), key)
       <= ceil(count(*) OVER () * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split,
  n_messages, length, content, 'chats' AS source_dataset
FROM (SELECT conv_id AS key, count(*) AS n_messages, sum(length(text))::BIGINT AS length,
             sha256(string_agg(role || ':' || text, '||' ORDER BY turn)) AS content
      FROM conversations GROUP BY conv_id)"""


def _first_by_hash(rows: str, salt: str, size: str) -> str:
    number = f"substr(md5('{salt}:' || key), 1, 13)"
    return f"row_number() OVER (ORDER BY {number}, key) <= {size} FROM {rows}"


def _full_interleave(used: str) -> list[str]:
    chosen = f"""mixed AS (
  SELECT u.t, x.* EXCLUDE (i) FROM used u JOIN indexed x ON x.src = u.src AND x.i = u.i)"""
    return [*MERGE, INDEXED, used, chosen]


def oracle_sql() -> dict[str, str]:
    docs = "SELECT doc_id AS key, text FROM documents"
    prompt_rows = f"""SELECT key, 0::BIGINT AS idx, 'system' AS role, '{PROMPT}' AS content
FROM turns GROUP BY key HAVING arg_min(role, idx) <> 'system'
UNION ALL SELECT key, idx + CASE WHEN first_value(role) OVER (PARTITION BY key ORDER BY idx)
  <> 'system' THEN 1 ELSE 0 END, role, content FROM turns"""
    pair_chat = _with(PAIRS, select=_two("prompt", "chosen", "pairs"))
    pair_rows = _with(PAIRS, select="SELECT key, prompt, chosen, rejected FROM pairs")
    per_source = """SELECT {labels} AS source_dataset, 'train' AS source_split,
  count(*) AS n_rows, sum(len)::BIGINT AS n_chars FROM {rows} WHERE src < 3 GROUP BY 1"""
    assistant = "SELECT doc_id AS key, 0::BIGINT AS idx, 'assistant' AS role, text AS content FROM documents"
    flagship_rows = [*CHATS_TASKS_TEXTS[:-1], _merged_rows()]
    roles = f"""SELECT role, count(*) AS n_messages FROM (
  SELECT role FROM turns UNION ALL SELECT unnest(['user', 'assistant']) FROM alpaca
  UNION ALL SELECT 'assistant' FROM documents
  UNION ALL SELECT unnest(['user', 'assistant']) FROM answers) GROUP BY 1"""
    merge_roles = """SELECT role, count(*) AS n_messages FROM (
  SELECT role FROM kept JOIN turns USING (key) WHERE src = 0
  UNION ALL SELECT unnest(['user', 'assistant']) FROM kept WHERE src IN (1, 3)
  UNION ALL SELECT 'assistant' FROM kept WHERE src = 2
  UNION ALL SELECT 'system' FROM kept WHERE src > 0
  UNION ALL SELECT 'system' FROM kept JOIN (
    SELECT key FROM turns GROUP BY key HAVING arg_min(role, idx) <> 'system') USING (key)
    WHERE src = 0) GROUP BY 1"""
    counters = f"""SELECT (SELECT count(*) FROM merged) AS rows_before_filters,
  (SELECT count(*) FROM merged WHERE {WITHIN}) AS rows_after_filters,
  (SELECT count(*) FROM merged WHERE {WITHIN}) - count(*) AS duplicates_removed,
  count(*) AS final_rows, count(*) FILTER (split = 'train') AS train_rows,
  count(*) FILTER (split = 'test') AS test_rows, 0::BIGINT AS empty_rows FROM parted"""
    robin = "".join(_round_robin("all_exhausted"))
    repeats = _full_interleave(robin)
    rr_kept = f"kept AS (SELECT *, '0::' || t AS h FROM mixed WHERE {WITHIN})"
    rr_number = "substr(md5('42/split:' || h), 1, 13)"
    rr_parted = f"""parted AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY {rr_number}, t)
    <= ceil(count(*) OVER () * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM kept)"""
    drawn = _full_interleave(_draws([0.2, 0.3, 0.4, 0.1], "all_exhausted"))

    return {
        "flagship_merge": _with(
            *flagship_rows,
            "three AS (SELECT * FROM merged WHERE src < 3)",
            _kept("three", "src, key"),
            select=per_source.format(labels=LABELS, rows="kept"),
        ),
        "inspect_sources": _inspected(),
        "inspect_layouts": _layouts(),
        "inspect_profile": f"""SELECT 'cb_profiled' AS source, 'text' AS format, count(*) AS n_rows,
  'key,text' AS columns, avg(length(text) + length(doc_id::VARCHAR)) AS avg_length,
  count(*) FILTER (text = '') AS n_missing, count(*) FILTER ({BLANK_TEXT}) AS n_empty FROM documents""",
        "detect_empty_first": """SELECT 'chats' AS source, 'chatml' AS format,
  count(DISTINCT conv_id) AS n_rows, 'messages' AS columns FROM conversations""",
        "source_profile": PROFILE,
        "source_roles": _with(
            SPELLED,
            select="""SELECT 'chats' AS source, coalesce(spelling, '?') AS role,
  count(*) AS n_turns FROM named GROUP BY 2""",
        ),
        "peek_pages": "SELECT page_id AS key, html AS content FROM pages ORDER BY page_id LIMIT 5",
        "std_alpaca": _with(ALPACA, select=_two(ASKED, "output", "alpaca")),
        "std_prompt_response": STD_QA,
        "std_prompt_completion": STD_QA,
        "std_qa": STD_QA,
        "std_input_output": STD_QA,
        "std_sharegpt": CHAT_ROWS,
        "std_chatml": CHAT_ROWS,
        "std_roles": _with(SPELLED, select="SELECT key, idx, role, content FROM named"),
        "std_text": docs,
        "std_content": "SELECT page_id AS key, html AS text FROM pages",
        "std_preference": pair_rows,
        "std_fuzzy": STD_QA,
        "std_manual": STD_QA,
        "coerce_blocks": _with(TURNS, select=f"SELECT key, idx, role, {_joined(LINES)} AS content FROM turns"),
        "coerce_content_blocks": _with(TURNS, select=f"SELECT key, idx, role, {_joined(LINES)} AS content FROM turns"),
        "coerce_typed_blocks": _with(TURNS, select=f"SELECT key, idx, role, {_joined(LINES)} AS content FROM turns"),
        "coerce_dict_value": STD_QA,
        "coerce_map_value": STD_QA,
        "coerce_json_dump": _with(
            QA,
            select=_two(
                "question",
                """'{"body": ' || to_json(answer)::VARCHAR || ', "turn": ' || turn || ', "even": ' ||
  CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END || ', "nothing": null, "ids": [' ||
  turn || ', ' || conv_id || ']}'""",
                "qa",
            ),
        ),
        "coerce_scalars": f"""SELECT doc_id AS key, 0::BIGINT AS idx, 'user' AS role,
  n_chars || {NL} || {NL} || CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END AS content
FROM documents UNION ALL
SELECT doc_id, 1, 'assistant', (n_chars // 2) || CASE WHEN n_chars % 2 = 0 THEN '.0' ELSE '.5' END
FROM documents""",
        "coerce_list": f"""SELECT doc_id AS key, {_joined("string_split(text, ' ')")} AS text
FROM documents""",
        "coerce_json_deep": """SELECT doc_id AS key, CASE WHEN doc_id % 3 = 0
  THEN '{"b":' || to_json(text)::VARCHAR || ',"a":2}' ELSE text END AS text FROM documents""",
        "coerce_json_deeper": "SELECT doc_id AS key, coalesce(text, '') AS text FROM documents",
        "coerce_json_content": _with(
            TURNS,
            select=f"""SELECT key, idx, role, CASE WHEN role = 'assistant' THEN {_joined(LINES)}
  ELSE content END AS content FROM turns""",
        ),
        "chat_to_text": _with(TURNS, select=f"SELECT key, {HEADED} AS text FROM turns GROUP BY key"),
        "roles_to_text": _with(SPELLED, select=f"SELECT key, {HEADED} AS text FROM named GROUP BY key"),
        "pref_to_text": _with(
            PAIRS, select=f"SELECT key, {_headed_pair('prompt', 'chosen')} AS text FROM pairs"
        ),
        "text_to_chat": assistant,
        "pref_to_chat": pair_chat,
        "pref_to_pref": pair_rows,
        "concat_provenance": _with(
            *flagship_rows, select=per_source.format(labels=LABELS, rows="merged")
        ),
        "align_missing": _with(
            PAIRS,
            select="""SELECT 0::BIGINT AS source, count(DISTINCT conv_id) AS n_rows,
  count(DISTINCT conv_id) AS n_messages, 0::BIGINT AS n_text, 0::BIGINT AS n_chosen FROM conversations
UNION ALL SELECT 1, count(*), 0, count(*), 0 FROM documents
UNION ALL SELECT 2, count(*), 0, 0, count(*) FROM pairs""",
        ),
        "interleave_round_robin": _with(QA, MIXED, _round_robin("all_exhausted"), select=USED),
        "interleave_round_robin_first": _with(QA, MIXED, _round_robin("first_exhausted"), select=USED),
        "interleave_weighted": _with(QA, MIXED, _draws(WEIGHTS, "all_exhausted"), select=USED),
        "interleave_unnormalized": _with(QA, MIXED, _draws(WEIGHTS, "first_exhausted"), select=USED),
        "interleave_weighted_first": _with(QA, MIXED, _draws(WEIGHTS, "first_exhausted"), select=USED),
        "system_prompt": _with(TURNS, select=prompt_rows),
        "length_filter_chat": """SELECT conv_id AS key, sum(length(text))::BIGINT AS length
FROM conversations GROUP BY 1 HAVING sum(length(text)) BETWEEN 500 AND 5000""",
        "length_filter_text": "SELECT doc_id AS key, n_chars AS length FROM documents WHERE n_chars <= 2000",
        "length_filter_pref": _with(
            PAIRS,
            select="""SELECT key, length(prompt) + length(chosen) + length(rejected) AS length
FROM pairs WHERE length(prompt) + length(chosen) + length(rejected) >= 1000""",
        ),
        "dedupe_text": """SELECT min(doc_id) AS key, 0::BIGINT AS part FROM documents GROUP BY text""",
        "dedupe_chat": _with(TURNS, TWICE, select=FIRST_OF.format(payload="payload", rows="doubled")),
        "dedupe_strict": _with(TURNS, TWICE, select=FIRST_OF.format(payload="payload", rows="doubled")),
        "dedupe_pref": _with(
            PAIRS, select="SELECT min(key) AS key, 0::BIGINT AS part FROM pairs GROUP BY prompt, chosen, rejected"
        ),
        "dedupe_normalized": _with(
            f"""copies AS (
  SELECT 0::BIGINT AS part, doc_id AS key, text FROM documents
  UNION ALL SELECT 1, doc_id, '  ' || translate(text, '{LOWER}', '{UPPER}') FROM documents
  UNION ALL SELECT 2, doc_id, replace(text, ' ', '  ') FROM documents),
clean AS (SELECT *, lower(trim(regexp_replace(text, '{SPACES}', ' ', 'g'))) AS payload FROM copies)""",
            select=FIRST_OF.format(payload="payload", rows="clean"),
        ),
        "dedupe_examples": _with(
            "texts AS (SELECT doc_id AS key, 'texts' AS source, text AS content, text AS payload, 0 AS part FROM documents)",
            select=TOP_REPEATS.format(rows="texts"),
        ),
        "dedupe_examples_chat": _with(TURNS, TWICE, select=TOP_REPEATS.format(rows="doubled")),
        "head_cap": f"{docs} ORDER BY doc_id LIMIT {HEAD}",
        "sample_fraction": f"""SELECT key, text FROM (SELECT key, text, {_first_by_hash(
            f"({docs})", "42/sample", f"greatest(1, floor(count(*) OVER () * {SHARE}::DOUBLE))"
        ).replace(" FROM ", " AS chosen FROM ", 1)}) WHERE chosen""",
        "shuffle_order": """SELECT doc_id AS key,
  row_number() OVER (ORDER BY substr(md5('42:' || doc_id), 1, 13), doc_id) - 1 AS position,
  n_chars AS length FROM documents""",
        "train_test_split": """SELECT doc_id AS key,
  CASE WHEN row_number() OVER (ORDER BY substr(md5('42/split:' || doc_id), 1, 13), doc_id)
       <= ceil(count(*) OVER () * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM documents""",
        "train_test_count": _with(
            QA,
            select="""SELECT key,
  CASE WHEN row_number() OVER (ORDER BY substr(md5('7/split:' || key), 1, 13), key) <= 25
       THEN 'test' ELSE 'train' END AS split FROM qa""",
        ),
        "row_numbers": """SELECT doc_id, lang,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS position FROM documents""",
        "quality_by_source": _with(
            *CHATS_TASKS_TEXTS, select=_rate("merged", ANSWER_BLANK, 0.05, LABELS)
        ),
        "source_report": _with(
            *CHATS_TASKS_TEXTS,
            select=f"""SELECT *, CASE source_dataset WHEN 'chats' THEN 'chatml' WHEN 'tasks' THEN 'alpaca'
  WHEN 'texts' THEN 'text' ELSE 'qa' END AS format, CASE source_dataset WHEN 'chats' THEN 0
  WHEN 'tasks' THEN 1 WHEN 'texts' THEN 2 ELSE 3 END::BIGINT AS source
FROM ({_rate("merged", ANSWER_BLANK, 0.05, LABELS)})""",
        ),
        "source_report_twice": f"""SELECT *, 'texts' AS source_dataset, 'text' AS format FROM (
{_rate("documents", BLANK_TEXT, 0.05, "doc_id % 2").replace("AS source_dataset", "AS source")})""",
        "quality_overall": _with(*CHATS_TASKS_TEXTS, select=_rate("merged", ANSWER_BLANK, 0.02)),
        "quality_preference": _with(
            PAIRS, select=_rate("pairs", "trim(chosen) = '' OR trim(rejected) = ''", 0.05, "'pairs'")
        ),
        "source_counts": _with(
            *CHATS_TASKS_TEXTS,
            select=f"SELECT {LABELS} AS source_dataset, count(*) AS n_rows FROM merged GROUP BY 1",
        ),
        "role_counts": _with(*CHATS_TASKS_TEXTS[:-1], select=roles),
        "length_histogram": _bins("(SELECT n_chars AS len FROM documents)"),
        "merge_counters": _with(*MERGE_KEPT, select=counters),
        "merge_lengths": _with(*MERGE_KEPT, select=_bins("parted")),
        "merge_roles": _with(*MERGE_KEPT, select=merge_roles),
        "merge_from_file": _with(*MERGE_KEPT, select=counters),
        "merge_many_roles": """SELECT unnest(['a', 'b']) || doc_id AS role, count(*) AS n_messages
FROM documents GROUP BY 1""",
        "merge_role_top": """SELECT unnest(['a', 'b']) || doc_id AS role, count(*) AS n_messages
FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1000""",
        "refusals": """SELECT 'texts' AS source, 'texts: the target is ''preference'' but this source was read as ''text''
 and has no chosen and rejected columns' AS message, count(*) AS n_rows FROM documents
UNION ALL SELECT 'chats', 'chats: the target is ''preference'' but this source was read as ''chatml''
 and has no chosen and rejected columns', count(DISTINCT conv_id) FROM conversations
UNION ALL SELECT 'numbers', 'the layout of ''numbers'' is not recognised (columns: foo, bar); give its format and columns',
 count(*) FROM documents
UNION ALL SELECT 'sheet', 'unsupported file type .xlsx (use csv, json, jsonl, parquet)', count(*) FROM documents""".replace(
            "\n and has", " and has"
        ),
        "card_counts": _with(
            *MERGE_KEPT,
            select=f"""SELECT unnest(['rows_before_filters', 'rows_after_filters', 'duplicates_removed', 'final_rows',
  'split: train', 'split: test', 'empty_rows']) AS name, unnest([rows_before_filters, rows_after_filters,
  duplicates_removed, final_rows, train_rows, test_rows, empty_rows]) AS n FROM ({counters})""",
        ),
        "merge_view_without_order": """SELECT sha256(text) AS content FROM (
  SELECT text FROM documents UNION SELECT text FROM benchmark)""",
        "merge_jsonl_capped_sampled": f"""SELECT greatest(1, floor(least({3 * HEAD}, n) * {SHARE}::DOUBLE))::BIGINT AS n_rows,
  n_rows AS n_planned, n_rows AS n_known FROM (SELECT count(*) AS n FROM documents)""",
        "merge_jsonl_interleave": """WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, text FROM documents),
b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, text FROM benchmark),
t AS (SELECT unnest(range((SELECT greatest((SELECT count(*) FROM d), (SELECT count(*) FROM b))))) AS c)
SELECT 'documents' AS source_dataset, 'train' AS split, sha256(text) AS content, 2 * c AS position
FROM t JOIN d ON d.i = c % (SELECT count(*) FROM d)
UNION ALL SELECT 'benchmark', 'train', sha256(text), 2 * c + 1
FROM t JOIN b ON b.i = c % (SELECT count(*) FROM b)""",
        "full_merge": _with(*MERGE_KEPT, select=PER_SPLIT),
        "full_merge_text": _with(
            TURNS, ALPACA, QA, HALF_EMPTY, TEXT_MERGED, _kept("measured", "src, key"), _split("h"),
            select=PER_SPLIT,
        ),
        "full_merge_interleave": _with(*drawn, _kept("mixed", "t"), _split("h"), select=PER_SPLIT),
        "full_merge_repeats": _with(*repeats, rr_kept, rr_parted, select=_ordered("h", "t", "sha256(payload)")),
        "read_csv": "SELECT doc_id, nullif(text, '') AS text, lang, n_chars FROM documents",
        "read_jsonl": ALL_DOCUMENTS,
        "read_json": ALL_DOCUMENTS,
        "read_json_split": ALL_DOCUMENTS,
        "read_csv_two_headers": "SELECT doc_id, nullif(text, '') AS text, lang, n_chars FROM documents",
        "read_parquet_order": "SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents",
        "read_capped": f"SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT {HEAD}",
        "read_table": f"""SELECT doc_id, text FROM (SELECT doc_id, text,
  row_number() OVER (ORDER BY substr(md5('42/sample:0::' || doc_id), 1, 13), doc_id)
    <= greatest(1, floor(count(*) OVER () * {SHARE}::DOUBLE)) AS chosen
  FROM documents WHERE doc_id % 4 <> 0) WHERE chosen""",
        "write_round_trip": SAVED,
        "publish_round_trip": """SELECT key, text FROM (SELECT doc_id AS key, text,
  row_number() OVER (ORDER BY substr(md5('42/split:' || doc_id), 1, 13), doc_id)
    <= ceil(count(*) OVER () * 0.1::DOUBLE) AS chosen FROM documents) WHERE chosen""",
        "saved_preview": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 50",
        "stream_ingest": assistant,
    }
