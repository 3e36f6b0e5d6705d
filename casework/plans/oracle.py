"""The queries again as SQL for another engine, to compare results with.

Each text is written from the rules of an operator, not from its Spark plan:
the replay, for one, is a step-by-step recursive query here.
"""

from __future__ import annotations

from ..operators.envelopes import INJECTION_PHRASES
from ..operators.masterdata import NO_ID
from ..operators.prompts import (
    FINAL_TEMPLATE,
    PROGRESS_TEMPLATE,
    REPLAN_TEMPLATE,
    START_TEMPLATE,
    SUPERVISOR_HEADER,
    WORKER_HEADER,
)
from ..sources.caseload import CHANNELS, CLAIM, DEFAULT_MODEL, DESKS, DUNNING_LEVELS, FORGERY, ROUTES
from .flow import PRIOR_HEADER


# What the rules say, written out once more, so that a slip in the code under test shows.
TRUE_WORDS = ("1", "on", "t", "true", "y", "yes")
FALSE_WORDS = ("0", "f", "false", "n", "no", "off")
MASKS = (
    ("email", r"\b[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b", "<iban>"),
    ("vat_id", r"\bDE\d{6,12}\b", "<vat_id>"),
    ("phone", r"\+\d{1,3} ?\(?\d{2,5}\)?[ /-]?\d{3,5}(?:[ -]?\d{2,5})?", "<phone>"),
)
HEADER_FIELDS = {
    "invoice_number": r"(?i)(?:rechnung|invoice)(?:s?(?:nummer|number|nr\.?|no\.?))?[ :#]+([A-Z0-9-]*\d[A-Z0-9-]*)",
    "invoice_date": r"\b(\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4})\b",
    "supplier": r"(?i)(?:lieferant|supplier)[ :]+([^,;\n]+)",
    "total": r"(?i)(?:betrag|total|summe)[ :]+(?:EUR ?)?(\d[\d.,]*\d)",
    "tax_id": r"\b(DE\d{6,12})\b",
}


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def defang(value: str) -> str:
    opened = rf"regexp_replace({value}, '(?i)<\s*external_content\b[^>]*>', '<external_content_NESTED>', 'g')"
    return rf"regexp_replace({opened}, '(?i)<\s*/\s*external_content\s*>', '</external_content_NESTED>', 'g')"


def wrap(value: str, source: str) -> str:
    return f"""'<external_content source="' || {source} || '">' || {defang(value)} || '</external_content>'"""


def hits(value: str, pattern: str) -> str:
    return f"len(regexp_extract_all({value}, {text(pattern)}))"


def filled(template: str, values: dict[str, str]) -> str:
    """A template as a SQL concatenation."""
    out, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [text(head), values[name]]
    return " || ".join([*out, text(rest)])


# Case tables, as common table expressions

TEXTS = f"""
texts AS (
  SELECT doc_id, {texts(CHANNELS)}[CAST(substr(source, 4) AS INT) + 1] AS source,
         text || CASE lang WHEN 'fr' THEN {text(' ' + FORGERY)} WHEN 'es' THEN {text(' ' + CLAIM)} ELSE '' END AS content
  FROM documents)"""

CASES = """
cases AS (
  SELECT doc_id AS case_id, lang,
         CASE WHEN lang <> 'fr' THEN 'Lieferant DE' || (doc_id + 100000) || ' ' ELSE '' END || text AS task
  FROM documents)"""

INVOICE_TEXTS = """
invoice_texts AS (
  SELECT doc_id AS case_id,
         CASE lang
           WHEN 'de' THEN 'Rechnungsnummer: R-' || doc_id || ' vom 2025-04-11, Lieferant: ' || source
                          || '; Betrag: EUR ' || n_chars || ',50; '
           WHEN 'en' THEN 'Invoice no. ' || doc_id || ' tax id DE' || (doc_id + 100000) || '. '
           ELSE '' END || text AS text
  FROM documents)"""

VENDORS = """
vendors AS (
  SELECT 'DE' || (s_suppkey + 100000) AS vendor_id, s_name AS name,
         CASE WHEN s_acctbal >= 0 THEN 'DE' || lpad(CAST(s_suppkey AS VARCHAR), 20, '0') END AS iban,
         'N' || s_nationkey AS country,
         CASE WHEN s_acctbal > 5000 THEN '30 days' ELSE '14 days' END AS payment_terms,
         s_acctbal < 0 AS is_blocked
  FROM supplier)"""

VENDOR_AGES = """
aged AS (
  SELECT v.*, l.changed_on
  FROM vendors v LEFT JOIN (
    SELECT 'DE' || (l_suppkey + 100000) AS vendor_id, CAST(max(l_shipdate) AS DATE) AS changed_on
    FROM lineitem GROUP BY l_suppkey) l ON v.vendor_id = l.vendor_id)"""

TRANSCRIPT = f"""
transcript AS (
  SELECT conv_id AS case_id, turn AS seq,
         CASE WHEN role = 'system' THEN 'orchestrator' ELSE role END AS speaker,
         text || CASE WHEN role = 'assistant' THEN {text(' ' + FORGERY)} ELSE '' END AS content
  FROM conversations)"""

LINES = f"""
lines AS (
  SELECT case_id, seq, '[' || speaker || '] ' ||
         CASE WHEN speaker = 'orchestrator' THEN content ELSE {wrap('content', text('worker'))} END AS line
  FROM transcript)"""

STEPS = """
steps AS (
  SELECT user_id AS case_id, event_id AS seq,
         event_type = 'purchase' AND value > 100 AS is_request_satisfied,
         event_type = 'view' AS is_in_loop,
         event_type IN ('click', 'purchase', 'signup') AS is_progress_being_made,
         CASE event_type WHEN 'signup' THEN 'ghost' WHEN 'error' THEN 'finance' ELSE 'procurement' END AS next_speaker,
         CASE WHEN value >= 5 THEN 'Check ' || event_type END AS instruction,
         CASE WHEN value < 50 THEN 'done' ELSE 'open' END AS reply,
         CASE WHEN event_type = 'purchase' AND value > 100 THEN 'Booked ' || event_id END AS final_answer
  FROM events)"""

WORKERS = f"""
worker_log AS (
  SELECT n_nationkey AS reg_seq, {texts(DESKS)}[n_regionkey + 1] AS name,
         'Answers for ' || n_name AS description,
         'You know the records of ' || n_name || '.' AS system_prompt
  FROM nation),
workers AS (
  SELECT f.name, f.position, l.description, l.system_prompt
  FROM (SELECT name, min(reg_seq) AS position, max(reg_seq) AS latest FROM worker_log GROUP BY name) f
  JOIN worker_log l ON l.name = f.name AND l.reg_seq = f.latest)"""

ROUTING = "routing(role, model_id) AS (VALUES " + ", ".join(f"({text(r)}, {text(m)})" for r, m in ROUTES.items()) + ")"

# One step at a time, as the loop itself goes. Accumulates counters per case.
REPLAY = """
numbered AS (
  SELECT s.*, w.name IS NOT NULL AS known, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS n
  FROM steps s LEFT JOIN workers w ON w.name = s.next_speaker),
walked AS (
  SELECT case_id, 0::BIGINT AS n, 0::BIGINT AS seq, 0::BIGINT AS stall, 0::BIGINT AS replans, '' AS route
  FROM (SELECT DISTINCT case_id FROM steps)
  UNION ALL
  SELECT case_id, n, seq, CASE WHEN route = 'replan' THEN 0 ELSE stalled END,
         CASE WHEN route = 'replan' THEN replans + 1 ELSE replans END, route
  FROM (
    SELECT case_id, n, seq, stalled, replans,
           CASE WHEN ended THEN 'after_terminal'
                WHEN is_request_satisfied THEN 'finalize:satisfied'
                WHEN stalled < 2 AND known THEN 'dispatch'
                WHEN replans >= 2 THEN 'finalize:budget'
                ELSE 'replan' END AS route
    FROM (
      SELECT s.case_id, s.n, s.seq, s.is_request_satisfied, s.known, w.replans,
             w.route LIKE 'finalize%' OR w.route = 'after_terminal' AS ended,
             CASE WHEN s.is_in_loop OR NOT s.is_progress_being_made THEN w.stall + 1 ELSE 0 END AS stalled
      FROM walked w JOIN numbered s ON s.case_id = w.case_id AND s.n = w.n + 1) x) y),
trace AS (
  SELECT case_id, seq, route,
         CASE WHEN route <> 'after_terminal' THEN stall END AS stall_count,
         CASE WHEN route <> 'after_terminal' THEN replans END AS replan_count
  FROM walked WHERE n > 0),
summary AS (
  SELECT case_id, count(*) AS n_steps,
         count(*) FILTER (WHERE route = 'dispatch') AS n_dispatched,
         count(*) FILTER (WHERE route = 'after_terminal') AS n_after_terminal,
         max(replan_count) AS replan_count,
         arg_max(stall_count, seq) FILTER (WHERE stall_count IS NOT NULL) AS stall_count,
         max(seq) FILTER (WHERE route LIKE 'finalize%') AS ended_at,
         coalesce(max(route) FILTER (WHERE route LIKE 'finalize%'), 'open') AS outcome
  FROM trace GROUP BY case_id)"""

TRACE = f"WITH RECURSIVE {STEPS}, {WORKERS}, {REPLAY}"

DESK = "CASE event_type WHEN 'signup' THEN 'ghost' WHEN 'error' THEN 'finance' ELSE 'procurement' END"
LEDGERS = f"""
ledgers AS (
  SELECT user_id AS case_id, event_id AS revision,
         ['type ' || event_type, 'band ' || CAST(floor(value / 50) AS BIGINT)] AS facts,
         ['[procurement] verify ' || event_type,
          '[' || {DESK} || '] post ' || CAST(floor(value / 50) AS BIGINT), 'close'] AS plan
  FROM events
  WHERE value >= 2 AND value <= 200 AND NOT (event_type = 'error' AND value > 100))"""

PLAN_STEPS = f"""
plan_lines AS (
  SELECT case_id, revision, CAST(i - 1 AS BIGINT) AS step, plan[i] AS line
  FROM ledgers, LATERAL (SELECT unnest(generate_series(1, len(plan))) AS i)),
plan_steps AS (
  SELECT case_id, revision, step,
         nullif(regexp_extract(line, '^\\[([^\\]]+)\\]\\s*(.*)$', 1), '') AS worker,
         CASE WHEN line LIKE '[%' THEN regexp_extract(line, '^\\[([^\\]]+)\\]\\s*(.*)$', 2) ELSE line END AS text
  FROM plan_lines),
known_plan AS (
  SELECT p.*, w.name IS NOT NULL AS known FROM plan_steps p LEFT JOIN workers w ON w.name = p.worker)"""

VAT = r"\b(DE[0-9]{6,12})\b"
ENRICHED = f"""
named AS (SELECT *, nullif(regexp_extract(task, {text(VAT)}, 1), '') AS vendor_id FROM cases),
enriched AS (
  SELECT c.case_id, c.lang, c.task, c.vendor_id, v.vendor_id IS NOT NULL AS found, v.name, v.is_blocked,
         CASE WHEN c.vendor_id IS NULL THEN {text(NO_ID)}
              WHEN v.vendor_id IS NULL THEN 'Vendor ' || c.vendor_id || ' not found in master data.'
              ELSE 'Vendor ' || c.vendor_id || ' located. Name: ' || {wrap('v.name', text('datev'))}
                   || ' IBAN (REQUIRES non-LLM revalidation before payment): '
                   || {wrap("coalesce(v.iban, '')", text('datev'))} END AS summary
  FROM named c LEFT JOIN vendors v ON v.vendor_id = c.vendor_id)"""



def with_prior(prior: str) -> str:
    return f"task || {text(chr(10) * 2 + PRIOR_HEADER + chr(10))} || {prior}"


FLOW = f"""
first_step AS (
  SELECT case_id, lang, task, summary AS s0, '[stammdaten]' || chr(10) || {wrap('summary', text('worker'))} AS p1,
         'Not found: ' || CASE WHEN regexp_matches(task, {text(VAT)}) THEN '' ELSE 'tax_id' END AS s1
  FROM enriched),
second_step AS (
  SELECT *, p1 || chr(10) || chr(10) || '[fields]' || chr(10) || {wrap('s1', text('worker'))} AS p2 FROM first_step),
flow AS (
  SELECT *, 'Reviewed ' || length({with_prior('p2')}) || ' characters' AS s2 FROM second_step)"""

# JSON texts the replies are made of.
BODY = """
bodies AS (
  SELECT user_id AS case_id, event_id AS seq, event_type, value,
    '{"is_request_satisfied": ' || CASE WHEN event_type = 'purchase' AND value > 100 THEN 'true' ELSE 'false' END
    || ', "is_in_loop": ' || CASE event_type WHEN 'view' THEN 'true' WHEN 'error' THEN '"yes"' ELSE 'false' END
    || CASE WHEN event_type = 'click' AND value > 150 THEN ''
            ELSE ', "is_progress_being_made": ' || CASE WHEN event_type IN ('view', 'error') THEN '0' ELSE '1' END END
    || ', "next_speaker": '
    || CASE WHEN event_type = 'signup' THEN 'null' WHEN value BETWEEN 60 AND 80 THEN '7' ELSE '"procurement"' END
    || ', "instruction_or_question": "Check ' || replace(props, '"', '\\"') || '"'
    || ', "final_answer": '
    || CASE WHEN event_type = 'purchase' AND value > 100 THEN '"Booked ' || event_id || '"' ELSE 'null' END
    || CASE WHEN event_type = 'view' THEN '' ELSE ', "reasoning": "step ' || event_id || '"' END
    || ', "confidence": ' || CAST(floor(value) AS BIGINT) || '}' AS body
  FROM events),
raws AS (
  SELECT case_id, seq,
    CASE WHEN value < 2 THEN body || ' x' WHEN value > 200 THEN '[' || body || ']'
         WHEN event_type = 'click' THEN '```json' || chr(10) || body || chr(10) || '```' ELSE body END AS raw
  FROM bodies),
bare AS (
  SELECT case_id, seq, trim(regexp_replace(raw, '(?m)^```(?:json)?\\s*|\\s*```$', '', 'g'), chr(10) || ' ') AS j FROM raws),
valid AS (SELECT case_id, seq, CASE WHEN json_valid(j) THEN j END AS j FROM bare)"""


def flag(name: str) -> str:
    value = f"lower(json_extract_string(j, '$.{name}'))"
    kind = f"json_type(j, '$.{name}')"
    words = ", ".join(text(w) for w in TRUE_WORDS), ", ".join(text(w) for w in FALSE_WORDS)
    return (
        f"CASE WHEN {kind} IN ('BOOLEAN', 'VARCHAR') AND {value} IN ({words[0]}) THEN true"
        f" WHEN {kind} IN ('BOOLEAN', 'VARCHAR') AND {value} IN ({words[1]}) THEN false"
        f" WHEN {kind} IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST({value} AS DOUBLE) = 1 THEN true"
        f" WHEN {kind} IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST({value} AS DOUBLE) = 0 THEN false END"
    )


FLAGS = ("is_request_satisfied", "is_in_loop", "is_progress_being_made")
OPTIONAL = ("next_speaker", "instruction_or_question", "final_answer")
PARSED = f"""
read AS (
  SELECT case_id, seq, j, {", ".join(f"{flag(f)} AS {f}" for f in FLAGS)},
         CASE WHEN j IS NULL THEN 'not_json' WHEN json_type(j) <> 'OBJECT' THEN 'not_object' END AS shape
  FROM valid),
judged AS (
  SELECT *, CASE WHEN shape IS NOT NULL THEN shape
    {" ".join(f"WHEN json_type(j, '$.{f}') IS NULL THEN 'missing:{f}' WHEN {f} IS NULL THEN 'type:{f}'" for f in FLAGS)}
    {" ".join(f"WHEN json_type(j, '$.{f}') NOT IN ('VARCHAR', 'NULL') THEN 'type:{f}'" for f in OPTIONAL)}
    WHEN json_type(j, '$.reasoning') <> 'VARCHAR' THEN 'type:reasoning' END AS reason
  FROM read)"""

HISTORY = """
seen AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
changes AS (SELECT * FROM seen WHERE before IS NULL OR before <> event_type)"""

CENTS = "CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)"
RECON = f"""
po AS (SELECT l_orderkey AS po_number, CAST(sum({CENTS}) AS BIGINT) AS po_cents
       FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey),
invoice AS (SELECT l_orderkey AS po_number, CAST(sum({CENTS}) AS BIGINT) AS invoice_cents,
                   CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS invoiced
            FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey),
both_sides AS (
  SELECT coalesce(po.po_number, invoice.po_number) AS po_number, po_cents, invoice_cents,
         invoice_cents - po_cents AS difference_cents
  FROM po FULL JOIN invoice ON po.po_number = invoice.po_number)"""


def recon_status(tolerance: int) -> str:
    return (
        "CASE WHEN po_cents IS NULL THEN 'missing_po' WHEN invoice_cents IS NULL THEN 'missing_invoice' "
        f"WHEN abs(difference_cents) <= {tolerance} THEN 'matched' ELSE 'amount_mismatch' END"
    )


def masked_steps() -> tuple[str, str]:
    """The masked text, and the counts each mask finds on the text before it."""
    seen, counts = "text", []
    for name, pattern, replacement in MASKS:
        counts.append(f"{hits(seen, pattern)} AS n_{name}")
        seen = f"regexp_replace({seen}, {text(pattern)}, {text(replacement)}, 'g')"
    return seen, ", ".join(counts)


MASKED, MASK_COUNTS = masked_steps()
OPEN_HITS = hits("content", r"(?i)<\s*external_content\b[^>]*>")
CLOSE_HITS = hits(
    r"regexp_replace(content, '(?i)<\s*external_content\b[^>]*>', '<external_content_NESTED>', 'g')",
    r"(?i)<\s*/\s*external_content\s*>",
)
PHRASE_ROWS = ", ".join(f"({text(p)})" for p in INJECTION_PHRASES)
FIELD_COLUMNS = ", ".join(f"nullif(regexp_extract(text, {text(p)}, 1), '') AS {n}" for n, p in HEADER_FIELDS.items())
MISSING_FIELDS = ", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in HEADER_FIELDS)

REPLAY_TRACE = f"{TRACE} SELECT * FROM trace"
ENRICH = f"WITH {CASES}, {VENDORS}, {ENRICHED} SELECT case_id, vendor_id, found, summary, name, is_blocked FROM enriched"
STALL_RUNS = f"""WITH {STEPS},
  marked AS (SELECT case_id, seq, is_in_loop OR NOT is_progress_being_made AS stalled FROM steps),
  runs AS (SELECT *, sum(CASE WHEN stalled THEN 0 ELSE 1 END) OVER (PARTITION BY case_id ORDER BY seq) AS run FROM marked)
  SELECT case_id, min(seq) AS started_at, max(seq) AS ended_at, count(*) AS n_stalls
  FROM runs WHERE stalled GROUP BY case_id, run"""
LOOPS = f"""WITH {STEPS}
  SELECT case_id, seq, next_speaker, instruction, reply,
    coalesce(lag(seq) OVER w IS NOT NULL AND lag(next_speaker) OVER w IS NOT DISTINCT FROM next_speaker
      AND lag(instruction) OVER w IS NOT DISTINCT FROM instruction AND lag(reply) OVER w IS NOT DISTINCT FROM reply, false)
      AS repeats_previous
  FROM steps WINDOW w AS (PARTITION BY case_id ORDER BY seq)"""
DELTA = f"""WITH {LEDGERS},
  paired AS (SELECT *, lag(facts) OVER w AS facts_before, lag(plan) OVER w AS plan_before
             FROM ledgers WINDOW w AS (PARTITION BY case_id ORDER BY revision))
  SELECT case_id, revision,
    array_to_string(list_filter(facts, lambda x: NOT list_contains(facts_before, x)), '|') AS learned,
    array_to_string(list_filter(facts_before, lambda x: NOT list_contains(facts, x)), '|') AS dropped,
    array_to_string(list_filter(plan, lambda x: list_contains(plan_before, x)), '|') AS repeated_steps
  FROM paired WHERE facts_before IS NOT NULL"""
INTERVALS = f"""WITH {HISTORY}
  SELECT user_id, event_id AS valid_from, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to, event_type
  FROM changes"""
AS_OF = """SELECT p.user_id, p.event_id, p.status, e.event_type
  FROM (SELECT o_custkey AS user_id, o_orderkey AS event_id, o_orderstatus AS status FROM orders) p
  ASOF LEFT JOIN (SELECT user_id, event_id, event_type FROM events) e
    ON p.user_id = e.user_id AND p.event_id >= e.event_id"""


def ledger_reply(collides: str, revision: str) -> str:
    return f"""
  SELECT user_id AS case_id, event_id AS seq,
    CASE WHEN reason IS NULL THEN 'type ' || event_type || '|band ' || band END AS facts,
    CASE WHEN reason IS NULL THEN '' END AS guesses,
    CASE WHEN reason IS NULL THEN '[procurement] verify ' || event_type || '|[' || {DESK} || '] post ' || band || '|close' END AS plan
    {revision}, reason
  FROM (SELECT *, CAST(floor(value / 50) AS BIGINT) AS band,
          CASE WHEN value > 200 THEN 'not_json' WHEN {collides} THEN 'key_collision'
               WHEN value < 2 THEN 'type:facts' END AS reason
        FROM events) e"""


def stub_reply(user: str, model: str = text(DEFAULT_MODEL)) -> str:
    return f"{model} || ':' || length({user}) || ':' || replace({user}, ' ', '_')"


ANSWERS = """
answers AS (
  SELECT conv_id AS case_id, arg_max(text || ' (by ' || role || ')', turn) AS final_answer
  FROM conversations GROUP BY conv_id)"""
REQUESTS = f"""
dispatches AS (
  SELECT conv_id AS case_id, turn AS step, CASE WHEN turn = 0 THEN 'procurement' ELSE 'finance' END AS next_speaker,
         CASE WHEN length(text) >= 80 THEN text END AS instruction
  FROM conversations WHERE role = 'user'),
sent AS (
  SELECT d.case_id, d.step, coalesce(r.model_id, {text(DEFAULT_MODEL)}) AS model_id,
         {text(WORKER_HEADER)} || chr(10) || chr(10) || w.system_prompt AS system, d.instruction AS "user"
  FROM dispatches d JOIN workers w ON w.name = d.next_speaker LEFT JOIN routing r ON r.role = w.name
  WHERE d.instruction <> '')"""

PRIORS = f"""WITH {CASES}, {VENDORS}, {ENRICHED}, {FLOW}
    SELECT case_id, 0::BIGINT AS step, 'stammdaten' AS name, '' AS prior FROM flow
    UNION ALL SELECT case_id, 1, 'fields', p1 FROM flow
    UNION ALL SELECT case_id, 2, 'review', p2 FROM flow"""

ORACLES: dict[str, str] = {
    "envelope_documents": f"WITH {TEXTS} SELECT doc_id, source, {wrap('content', 'source')} AS envelope FROM texts",
    "envelope_audit": f"""WITH {TEXTS}, counted AS (SELECT source, {OPEN_HITS} + {CLOSE_HITS} AS forged FROM texts)
        SELECT source, count(*) AS n_texts, count(*) FILTER (WHERE forged > 0) AS n_forged_texts,
               CAST(sum(forged) AS BIGINT) AS forged_tags, max(forged) AS max_forged
        FROM counted GROUP BY source""",
    "envelope_detect": r"""
        SELECT page_id, length(content) AS n_chars
        FROM (SELECT page_id, CASE WHEN contains(url, '/fr/')
                THEN '<external_content source="search">' || html || '</external_content>' ELSE html END AS content FROM pages)
        WHERE regexp_matches(content, '(?i)<\s*external_content\b[^>]*>')
          AND regexp_matches(content, '(?i)<\s*/\s*external_content\s*>')""",
    "source_domain_reject": f"""WITH {TEXTS} SELECT doc_id, source FROM texts
        WHERE source NOT IN ('ocr', 'datev', 'github', 'search', 'langfuse', 'git', 'env', 'worker')""",
    "injection_scan": f"""WITH {TEXTS}, phrases(phrase) AS (VALUES {PHRASE_ROWS}),
        found AS (SELECT source, phrase, (length(lower(content)) - length(replace(lower(content), phrase, ''))) // length(phrase) AS n
                  FROM texts, phrases)
        SELECT source, phrase, count(*) AS n_texts, CAST(sum(n) AS BIGINT) AS n_hits FROM found WHERE n > 0 GROUP BY source, phrase""",
    "phrase_screen": f"""WITH {TEXTS},
        sentences AS (SELECT unnest(string_split_regex(text, '[.\\n] *')) AS sentence FROM benchmark),
        phrases AS (SELECT DISTINCT array_to_string(list_slice(string_split(sentence, ' '), 1, 3), ' ') AS phrase FROM sentences),
        found AS (SELECT source, phrase, (length(lower(content)) - length(replace(lower(content), lower(phrase), ''))) // length(phrase) AS n
                  FROM texts JOIN phrases ON length(phrase) >= 8 AND contains(lower(content), lower(phrase)))
        SELECT source, phrase, count(*) AS n_texts, CAST(sum(n) AS BIGINT) AS n_hits FROM found GROUP BY source, phrase""",
    "mask_traces": f"WITH {INVOICE_TEXTS} SELECT case_id, {MASKED} AS masked, {MASK_COUNTS} FROM invoice_texts",
    "transcripts": f"""WITH {TRANSCRIPT}, {LINES}
        SELECT case_id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY seq) AS transcript
        FROM lines GROUP BY case_id
        UNION ALL
        SELECT doc_id, 0, '(empty)' FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations)""",
    "transcript_parts": f"""WITH {TRANSCRIPT}, {LINES},
        placed AS (SELECT case_id, seq, line, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY case_id ORDER BY seq
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2048 AS cut FROM lines),
        numbered AS (SELECT *, dense_rank() OVER (PARTITION BY case_id ORDER BY cut) - 1 AS part FROM placed)
        SELECT case_id, part, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY seq) AS transcript
        FROM numbered GROUP BY case_id, part""",
    "stage_contract": """
        WITH n AS (SELECT count(*) AS every, count(*) FILTER (WHERE lang <> 'fr') AS others FROM documents)
        SELECT 0::BIGINT AS step, 'fields' AS stage, every AS n_before, every AS n_after, true AS kept FROM n
        UNION ALL SELECT 1, 'others', every, others, every = others FROM n
        UNION ALL SELECT 2, 'review', others, others, true FROM n""",
    "dispatch_rows": """
        WITH sent AS (
          SELECT q.conv_id AS case_id, q.turn AS step, CASE WHEN q.turn = 0 THEN 'procurement' ELSE 'finance' END AS who,
                 q.text AS instruction, coalesce(a.text, '') AS reply
          FROM conversations q LEFT JOIN conversations a
            ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
          WHERE q.role = 'user' AND length(q.text) >= 80)
        SELECT case_id, step * 2 AS seq, 'orchestrator' AS speaker, '-> ' || who || ': ' || instruction AS content FROM sent
        UNION ALL SELECT case_id, step * 2 + 1, who, reply FROM sent""",
    "prior_context": PRIORS,
    "prior_context_log": PRIORS,
    "output_log": f"""WITH {CASES}, {VENDORS}, {ENRICHED}
        SELECT case_id, 0::BIGINT AS step, 'stammdaten' AS name, summary FROM enriched
        UNION ALL SELECT case_id, 1, 'review', 'Reviewed ' || length(task) || ' characters' FROM cases""",
    "composed_task": f"""WITH {CASES}, {VENDORS}, {ENRICHED}, {FLOW}
        SELECT case_id, {with_prior('p1')} AS composed_task FROM flow""",
    "final_summary": f"""WITH {CASES}, {VENDORS}, {ENRICHED}, {FLOW}
        SELECT o_orderkey AS case_id, CASE WHEN f.case_id IS NULL THEN 0 ELSE 3 END::BIGINT AS n_steps,
               CASE WHEN f.case_id IS NULL THEN '(no crews ran)' ELSE s2 END AS final_summary
        FROM orders LEFT JOIN flow f ON f.case_id = o_orderkey""",
    "vendor_enrich": ENRICH,
    "vendor_enrich_salted": ENRICH,
    "vendor_quality": f"""WITH {VENDORS}, {VENDOR_AGES},
        counted AS (SELECT count(*) AS n_records,
                           count(*) FILTER (WHERE changed_on IS NULL OR DATE '2001-12-01' - changed_on > 60) AS n_stale,
                           count(*) - count(name) AS a, count(*) - count(iban) AS b,
                           count(*) - count(country) AS c, count(*) - count(payment_terms) AS d FROM aged)
        SELECT n_records, n_stale, 'name' AS field, a AS n_null FROM counted
        UNION ALL SELECT n_records, n_stale, 'iban', b FROM counted
        UNION ALL SELECT n_records, n_stale, 'country', c FROM counted
        UNION ALL SELECT n_records, n_stale, 'payment_terms', d FROM counted""",
    "vendor_flags": f"""WITH {VENDORS}, {VENDOR_AGES}
        SELECT vendor_id, CASE WHEN iban IS NULL THEN 'iban' ELSE '' END AS null_fields,
               changed_on IS NULL OR DATE '2001-12-01' - changed_on > 60 AS is_stale FROM aged""",
    "id_consistency": rf"""
        WITH named AS (
          SELECT conv_id AS case_id, text || CASE WHEN role = 'assistant' AND turn < 4 THEN ' DE' || (conv_id + 100000)
                                                  WHEN role = 'system' THEN ' DE' || (conv_id + 900000) ELSE '' END AS text
          FROM conversations),
        ids AS (SELECT case_id, unnest(regexp_extract_all(text, {text(VAT)}, 1)) AS id FROM named),
        per_case AS (
          SELECT c.case_id, count(id) AS n_mentions, count(DISTINCT id) AS n_ids, min(id) AS first_id, max(id) AS last_id
          FROM (SELECT DISTINCT case_id FROM named) c LEFT JOIN ids ON ids.case_id = c.case_id GROUP BY c.case_id)
        SELECT *, CASE n_ids WHEN 0 THEN 'missing' WHEN 1 THEN 'consistent' ELSE 'inconsistent' END AS status FROM per_case""",
    "ledger_parse": f"""WITH {BODY}, {PARSED}
        SELECT case_id, seq, {", ".join(f"CASE WHEN reason IS NULL THEN {f} END AS {f}" for f in FLAGS)},
               {", ".join(f"CASE WHEN reason IS NULL THEN json_extract_string(j, '$.{f}') END AS {f}" for f in OPTIONAL)},
               CASE WHEN reason IS NULL THEN coalesce(json_extract_string(j, '$.reasoning'), '') END AS reasoning, reason
        FROM judged""",
    "ledger_quarantine": f"WITH {BODY}, {PARSED} SELECT reason, count(*) AS n_replies FROM judged WHERE reason IS NOT NULL GROUP BY reason",
    "first_ledger_parse": ledger_reply(
        "event_type = 'error' AND value > 100",
        ", CASE WHEN reason IS NULL THEN CASE WHEN event_type = 'view' THEN 3 ELSE 0 END::BIGINT END AS revision",
    ),
    "next_ledger_parse": ledger_reply("event_type = 'view' OR (event_type = 'error' AND value > 100)", ""),
    "plan_steps": f"WITH {LEDGERS}, {WORKERS}, {PLAN_STEPS} SELECT case_id, revision, step, worker, text, known FROM known_plan",
    "plan_workers": f"""WITH {LEDGERS}, {WORKERS}, {PLAN_STEPS}
        SELECT worker, known, count(*) AS n_steps, count(DISTINCT case_id) AS n_cases FROM known_plan GROUP BY worker, known""",
    "facts_delta": DELTA,
    "facts_delta_chunked": DELTA,
    "replan_inputs": f"""WITH {LEDGERS},
        latest AS (SELECT * FROM ledgers QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY revision DESC) = 1)
        SELECT c_custkey AS case_id, coalesce(array_to_string(facts, chr(10)), '(none)') AS current_facts,
               coalesce(array_to_string(plan, chr(10)), '(none)') AS current_plan,
               coalesce(revision, 0) + 1 AS next_revision
        FROM customer LEFT JOIN latest ON case_id = c_custkey""",
    "replay_trace": REPLAY_TRACE,
    "replay_trace_chunked": REPLAY_TRACE,
    "stream_replay": REPLAY_TRACE,
    "stream_replay_any_order": f"""{TRACE} SELECT t.* FROM trace t JOIN events e ON e.event_id = t.seq
        WHERE e.ts <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "replay_summary": f"{TRACE} SELECT * FROM summary",
    "run_summary": f"""{TRACE}, {CASES}, {LEDGERS},
        latest AS (SELECT * FROM ledgers QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY revision DESC) = 1),
        sent AS (
          SELECT t.case_id, t.seq, s.next_speaker, s.instruction, s.reply
          FROM trace t JOIN steps s ON s.case_id = t.case_id AND s.seq = t.seq WHERE t.route = 'dispatch' AND s.instruction <> ''),
        said AS (
          SELECT case_id, 2 * seq AS place, '[orchestrator] -> ' || next_speaker || ': ' || instruction AS line FROM sent
          UNION ALL
          SELECT case_id, 2 * seq + 1, '[' || next_speaker || '] ' || {wrap('reply', text('worker'))} FROM sent),
        told AS (SELECT case_id, count(*) AS n, string_agg(line, chr(10) ORDER BY place) AS transcript FROM said GROUP BY case_id),
        asked AS (
          SELECT u.*, told.n, told.transcript, {filled(FINAL_TEMPLATE, {
              'task': "coalesce(c.task, 'case ' || u.case_id)", 'transcript': "coalesce(told.transcript, '(empty)')"})} AS prompt
          FROM summary u LEFT JOIN cases c ON c.case_id = u.case_id LEFT JOIN told ON told.case_id = u.case_id)
        SELECT u.case_id,
               CASE WHEN outcome = 'open' THEN '(no answer produced)' WHEN s.final_answer <> '' THEN s.final_answer
                    ELSE trim({stub_reply('prompt')}, chr(10) || ' ') END AS summary,
               coalesce(u.n, 0) AS n_transcript_rows, coalesce(u.transcript, '(empty)') AS transcript,
               replan_count, stall_count, outcome, l.revision,
               array_to_string(l.facts, '|') AS facts, array_to_string(l.plan, '|') AS plan
        FROM asked u LEFT JOIN steps s ON s.case_id = u.case_id AND s.seq = u.ended_at
        LEFT JOIN latest l ON l.case_id = u.case_id""",
    "stall_runs": STALL_RUNS,
    "stall_runs_chunked": STALL_RUNS,
    "loop_detect": LOOPS,
    "loop_detect_chunked": LOOPS,
    "registry_view": """
        SELECT p_brand AS name, min(p_partkey) AS position, arg_max(p_name, p_partkey) AS description,
               'Handles ' || arg_max(p_type, p_partkey) || ' parts.' AS system_prompt,
               CASE WHEN arg_max(p_size, p_partkey) < 10 THEN arg_max(p_type, p_partkey) ELSE p_brand END AS role
        FROM part GROUP BY p_brand""",
    "manifest": """
        SELECT count(*) AS n_workers, string_agg('- ' || name || ': ' || description, chr(10) ORDER BY position) AS manifest
        FROM (SELECT p_brand AS name, min(p_partkey) AS position, arg_max(p_name, p_partkey) AS description FROM part GROUP BY p_brand)""",
    "known_workers": f"WITH {STEPS}, {WORKERS} SELECT case_id, seq, next_speaker FROM steps WHERE next_speaker IN (SELECT name FROM workers)",
    "unknown_workers": f"WITH {STEPS}, {WORKERS} SELECT case_id, seq, next_speaker FROM steps WHERE next_speaker NOT IN (SELECT name FROM workers)",
    "unknown_worker_report": f"""WITH {STEPS}, {WORKERS} SELECT next_speaker, count(*) AS n_uses FROM steps
        WHERE next_speaker NOT IN (SELECT name FROM workers) GROUP BY next_speaker""",
    "routing_view": "SELECT p_type AS role, arg_max(p_brand, p_partkey) AS model_id FROM part GROUP BY p_type",
    "model_assignment": f"""WITH {STEPS}, {ROUTING} SELECT seq AS call_id, next_speaker AS role, coalesce(model_id, {text(DEFAULT_MODEL)}) AS model_id
        FROM steps LEFT JOIN routing ON role = next_speaker""",
    "model_usage": f"""WITH {STEPS}, {ROUTING} SELECT coalesce(model_id, {text(DEFAULT_MODEL)}) AS model_id, count(*) AS n_calls,
        count(DISTINCT next_speaker) AS n_roles FROM steps LEFT JOIN routing ON role = next_speaker GROUP BY 1""",
    "requests": f'WITH {WORKERS}, {ROUTING}, {REQUESTS} SELECT case_id, step, model_id, system, "user" FROM sent',
    "batch_score": f"""WITH {WORKERS}, {ROUTING}, {REQUESTS}
        SELECT case_id, step, model_id, ' ' || {stub_reply('"user"', 'model_id')} || chr(10) AS reply, CAST(NULL AS VARCHAR) AS error FROM sent""",
    "batch_score_once": f"""WITH {WORKERS}, {ROUTING}, {REQUESTS}
        SELECT case_id, step, model_id, ' ' || {stub_reply('"user"', 'model_id')} || chr(10) AS reply, CAST(NULL AS VARCHAR) AS error FROM sent""",
    "render_prompts": f"""WITH {CASES}, {TRANSCRIPT}, {LINES}, {LEDGERS}, {WORKERS},
        latest AS (SELECT * FROM ledgers QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY revision DESC) = 1),
        told AS (SELECT case_id, string_agg(line, chr(10) ORDER BY seq) AS transcript FROM lines GROUP BY case_id),
        shown AS (SELECT string_agg('- ' || name || ': ' || description, chr(10) ORDER BY position) AS manifest FROM workers)
        SELECT c.case_id, {filled(PROGRESS_TEMPLATE, {
            'task': 'c.task', 'worker_manifest': 'shown.manifest',
            'plan': "coalesce(array_to_string(latest.plan, chr(10)), '(none)')",
            'transcript': "coalesce(told.transcript, '(empty)')"})} AS prompt
        FROM cases c LEFT JOIN latest ON latest.case_id = c.case_id LEFT JOIN told ON told.case_id = c.case_id, shown""",
    "start_prompts": f"""WITH {CASES},
        shown AS (
          SELECT string_agg('- ' || name || ': ' || description, chr(10) ORDER BY position) AS manifest
          FROM (SELECT p_brand AS name, min(p_partkey) AS position, arg_max(p_name, p_partkey) AS description FROM part GROUP BY p_brand))
        SELECT case_id, {text(DEFAULT_MODEL)} AS model_id, {text(SUPERVISOR_HEADER)} AS system,
               {filled(START_TEMPLATE, {'task': 'task', 'worker_manifest': 'manifest'})} AS "user" FROM cases, shown""",
    "replan_prompts": f"""WITH {TRANSCRIPT}, {LINES}, {LEDGERS}, {WORKERS},
        latest AS (SELECT * FROM ledgers QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY revision DESC) = 1),
        told AS (SELECT case_id, string_agg(line, chr(10) ORDER BY seq) AS transcript FROM lines GROUP BY case_id),
        shown AS (SELECT string_agg('- ' || name || ': ' || description, chr(10) ORDER BY position) AS manifest FROM workers)
        SELECT c_custkey AS case_id, coalesce(latest.revision, 0) + 1 AS next_revision, {filled(REPLAN_TEMPLATE, {
            'task': 'c_name', 'worker_manifest': 'shown.manifest',
            'current_facts': "coalesce(array_to_string(latest.facts, chr(10)), '(none)')",
            'current_plan': "coalesce(array_to_string(latest.plan, chr(10)), '(none)')",
            'transcript': "coalesce(told.transcript, '(empty)')"})} AS prompt
        FROM customer LEFT JOIN latest ON latest.case_id = c_custkey LEFT JOIN told ON told.case_id = c_custkey, shown""",
    "final_answers": f"""WITH {ANSWERS}, {CASES}, {TRANSCRIPT}, {LINES},
        told AS (SELECT case_id, string_agg(line, chr(10) ORDER BY seq) AS transcript FROM lines GROUP BY case_id),
        asked AS (
          SELECT a.*, {filled(FINAL_TEMPLATE, {
              'task': "coalesce(c.task, 'case ' || a.case_id)", 'transcript': "coalesce(told.transcript, '(empty)')"})} AS prompt
          FROM answers a LEFT JOIN cases c ON c.case_id = a.case_id LEFT JOIN told ON told.case_id = a.case_id)
        SELECT case_id,
               CASE WHEN final_answer LIKE '%(by user)' THEN trim({stub_reply('prompt')}, chr(10) || ' ') ELSE final_answer END AS final_answer,
               CASE WHEN final_answer LIKE '%(by user)' THEN 'model' ELSE 'given' END AS origin
        FROM asked""",
    "attribution": f"""WITH {ANSWERS}
        SELECT s.case_id, speaker, regexp_matches(final_answer, '(^|[^\\p{{L}}\\p{{N}}_])' || speaker || '($|[^\\p{{L}}\\p{{N}}_])') AS cited
        FROM (SELECT DISTINCT conv_id AS case_id, role AS speaker FROM conversations) s JOIN answers a ON a.case_id = s.case_id""",
    "po_invoice_recon": f"WITH {RECON} SELECT po_number, po_cents, invoice_cents, {recon_status(0)} AS status, difference_cents FROM both_sides",
    "recon_totals": f"""WITH {RECON} SELECT {recon_status(500_000)} AS status, count(*) AS n_keys,
        CAST(sum(po_cents) AS BIGINT) AS po_cents, CAST(sum(invoice_cents) AS BIGINT) AS invoice_cents FROM both_sides GROUP BY 1""",
    "delivery_recon": f"""WITH {RECON},
        delivered AS (SELECT l_orderkey AS po_number, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS delivered
                      FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY l_orderkey),
        matched AS (SELECT coalesce(d.po_number, i.po_number) AS po_number, delivered, invoiced
                    FROM delivered d FULL JOIN invoice i ON i.po_number = d.po_number)
        SELECT po_number, delivered, invoiced,
               CASE WHEN delivered IS NULL THEN 'missing_delivery' WHEN invoiced IS NULL THEN 'missing_invoice'
                    WHEN delivered = invoiced THEN 'matched' WHEN delivered < invoiced THEN 'short_delivery'
                    ELSE 'over_delivery' END AS status,
               greatest(coalesce(invoiced, 0) - coalesce(delivered, 0), 0) AS shortfall FROM matched""",
    "dunning": f"""
        WITH aged AS (
          SELECT o_orderkey AS item, DATE '1998-01-01' - (CAST(o_orderdate AS DATE) + 30) AS days,
                 CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS current_level
          FROM orders WHERE o_orderstatus = 'O'),
        levelled AS (
          SELECT *, CASE {" ".join(f"WHEN days >= {d} THEN {n}" for n, d in sorted(DUNNING_LEVELS, reverse=True))} ELSE 0 END AS level FROM aged)
        SELECT item, CAST(greatest(days, 0) AS BIGINT) AS days_overdue, CAST(level AS BIGINT) AS dunning_level,
               level > current_level AS escalate FROM levelled""",
    "dunning_by_customer": f"""
        WITH steps(level, days) AS (VALUES {", ".join(f"({n}, {d})" for n, d in DUNNING_LEVELS)}),
        named AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 1000000 ELSE 0 END AS quiet
                  FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'MACHINERY'),
        due AS (SELECT o_orderkey AS item, o_custkey AS customer, CAST(o_orderdate AS DATE) + 30 AS due_on,
                       CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS current_level
                FROM orders WHERE o_orderstatus = 'O'),
        aged AS (SELECT *, DATE '1998-01-01' - due_on AS days FROM due),
        reached AS (
          SELECT a.item, max(s.level) AS level FROM aged a LEFT JOIN named n ON n.c_custkey = a.customer
          JOIN steps s ON a.days >= CASE WHEN n.c_custkey IS NULL OR a.due_on < DATE '1996-01-01' THEN s.days ELSE s.days // 2 END + coalesce(n.quiet, 0)
          GROUP BY a.item)
        SELECT a.item, a.customer, CAST(greatest(a.days, 0) AS BIGINT) AS days_overdue, CAST(coalesce(r.level, 0) AS BIGINT) AS dunning_level,
               coalesce(r.level, 0) > a.current_level AS escalate
        FROM aged a LEFT JOIN reached r ON r.item = a.item""",
    "booking_codes": """
        WITH posted AS (SELECT p_partkey AS posting, p_size AS account, CASE WHEN p_type = 'SMALL' THEN 'SKR04' ELSE 'SKR03' END AS chart FROM part)
        SELECT posting, account, chart,
               CASE WHEN listed THEN chart || '-' || account END AS booking_code, listed AS in_chart
        FROM (SELECT *, CASE chart WHEN 'SKR03' THEN account - 1 ELSE account - 15 END IN (SELECT n_nationkey FROM nation) AS listed FROM posted)""",
    "booking_rejects": """
        WITH posted AS (SELECT p_size AS account, CASE WHEN p_type = 'SMALL' THEN 'SKR04' ELSE 'SKR03' END AS chart FROM part)
        SELECT chart, account, count(*) AS n_postings FROM posted
        WHERE CASE chart WHEN 'SKR03' THEN account - 1 ELSE account - 15 END NOT IN (SELECT n_nationkey FROM nation)
        GROUP BY chart, account""",
    "field_extract": f"""WITH {INVOICE_TEXTS}, found AS (SELECT case_id, {FIELD_COLUMNS} FROM invoice_texts)
        SELECT *, array_to_string(list_filter([{MISSING_FIELDS}], lambda x: x IS NOT NULL), ',') AS low_confidence FROM found""",
    "field_accuracy": """
        WITH pairs AS (
          SELECT d.lang AS workflow, unnest(['quality', 'toxic']) AS field,
                 unnest([CAST(d.n_chars > 500 AS INT) = l.quality, CAST(contains(d.text, '!!') AS INT) = l.toxic]) AS ok
          FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
        SELECT workflow, field, count(*) AS n_values, count(*) FILTER (WHERE ok) AS n_correct,
               count(*) FILTER (WHERE ok) / count(*) AS accuracy, grouping(workflow, field) AS level
        FROM pairs GROUP BY ROLLUP (workflow, field)""",
    "kpis": """
        SELECT event_type AS workflow, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n_cases,
               1 - count(*) FILTER (WHERE value > 60) / count(*) AS straight_through_rate,
               count(*) FILTER (WHERE value > 60) / count(*) AS escalation_rate,
               CASE WHEN count(*) FILTER (WHERE value <= 100) > 0
                    THEN count(*) FILTER (WHERE value > 60 AND value <= 100) / count(*) FILTER (WHERE value <= 100) END AS false_positive_rate,
               CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) / count(*) AS cents_per_case
        FROM events GROUP BY 1, 2""",
    "attr_history": INTERVALS,
    "attr_history_chunked": INTERVALS,
    "attr_as_of": AS_OF,
    "attr_as_of_chunked": AS_OF,
    "approval_queue": """
        SELECT o_orderkey, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS amount_cents FROM orders
        WHERE CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) > 1000000""",
    "stream_enrich": f"WITH {CASES}, {VENDORS}, {ENRICHED} SELECT case_id, vendor_id, found, summary FROM enriched",
    "stream_enrich_versions": """
        SELECT e.event_id AS case_id, 'DE' || (e.user_id + 100000) AS vendor_id, s.s_suppkey IS NOT NULL AS found,
               s.s_name || CASE WHEN s.s_acctbal < 0 AND e.ts >= TIMESTAMP '2024-01-15 12:00:00' THEN ' (moved)' ELSE '' END AS name
        FROM events e LEFT JOIN supplier s ON s.s_suppkey = e.user_id
        WHERE e.ts <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "stream_audit": """
        WITH closed AS (
          SELECT date_trunc('hour', ts) AS hour, CASE WHEN event_type = 'signup' THEN 'env' ELSE 'git' END AS source,
                 CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS forged
          FROM events
          WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)
        SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS window_start, source, count(*) AS n_texts,
               count(*) FILTER (WHERE forged > 0) AS n_forged_texts, CAST(sum(forged) AS BIGINT) AS forged_tags
        FROM closed GROUP BY hour, source""",
    "stream_audit_open": """
        SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
               CASE WHEN event_type = 'signup' THEN 'env' ELSE 'git' END AS source, count(*) AS n_texts,
               count(*) FILTER (WHERE event_type = 'error') AS n_forged_texts,
               CAST(2 * count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS forged_tags
        FROM events GROUP BY 1, 2""",
    "stream_dedup": "SELECT user_id, event_id, event_type FROM events",
}
