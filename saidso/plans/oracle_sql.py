"""The same named queries as DuckDB SQL over the same Parquet tables."""

from __future__ import annotations

from saidso.functions.hedge import HEDGE_TABLE
from saidso.functions.tokens import FILLERS
from saidso.plans.driver_tables import EVIDENCE_COLUMNS, HEDGED_COLUMNS, LEDGER_COLUMNS, PAGE_COLUMNS, VOTES, select_sql

LEDGER = f"ledger AS ({select_sql(LEDGER_COLUMNS, 'orders')})"
HEDGED = f"hedged AS ({select_sql(HEDGED_COLUMNS, 'documents')})"

DRIFT = """
occasion AS (
  SELECT person_slug, topic, said_date, max(id) AS last_id, max(target_date) IS NOT NULL AS dated
  FROM ledger GROUP BY ALL),
before AS (
  SELECT person_slug, topic, said_date,
    lag(last_id) OVER w AS previous_id,
    last_value(CASE WHEN dated THEN said_date END IGNORE NULLS)
      OVER (PARTITION BY person_slug, topic ORDER BY said_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dated_on
  FROM occasion WINDOW w AS (PARTITION BY person_slug, topic ORDER BY said_date)),
pick AS (
  SELECT c.id, p.id AS pid, p.target_date AS was, p.verdict = 'correct' AS met
  FROM ledger c JOIN before b USING (person_slug, topic, said_date)
  JOIN ledger p ON p.person_slug = c.person_slug AND p.topic = c.topic AND p.said_date = b.dated_on AND p.target_date IS NOT NULL
  WHERE c.target_date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY p.verdict = 'correct', abs(p.target_date - c.target_date), p.id) = 1),
drift AS (
  SELECT c.*, b.previous_id, k.pid, k.was, k.met, c.target_date - k.was AS shift,
    CASE WHEN b.previous_id IS NULL THEN 'first'
         WHEN k.id IS NULL OR k.met THEN 'reaffirmed'
         WHEN c.target_date - k.was >= 60 THEN 'pushed_later'
         WHEN c.target_date - k.was <= -60 THEN 'pulled_earlier'
         ELSE 'reaffirmed' END AS label
  FROM ledger c JOIN before b USING (person_slug, topic, said_date) LEFT JOIN pick k ON k.id = c.id)
"""

COUNTS = """
  count(*) FILTER (WHERE type = 'prediction') AS predictions,
  count(*) FILTER (WHERE type = 'prediction' AND verdict = 'correct') AS correct,
  count(*) FILTER (WHERE type = 'prediction' AND verdict = 'incorrect') AS incorrect,
  count(*) FILTER (WHERE type = 'prediction' AND verdict = 'partial') AS partial,
  count(*) FILTER (WHERE type = 'prediction' AND verdict = 'unresolvable') AS unresolvable,
  count(*) FILTER (WHERE type = 'prediction' AND verdict = 'too_early') AS too_early,
  count(*) FILTER (WHERE type = 'prediction' AND verdict = 'pending') AS pending
"""

SCORES = f"""
scores AS (
  SELECT person_slug, min(person) AS person, count(*) AS claims, {COUNTS},
    CAST(sum(pow(CAST(round(implied_probability * 10000) AS BIGINT) - CASE verdict WHEN 'correct' THEN 10000 ELSE 0 END, 2))
      FILTER (WHERE type = 'prediction' AND verdict IN ('correct', 'incorrect')) AS DOUBLE)
      / (1e8::DOUBLE * nullif(count(*) FILTER (WHERE type = 'prediction' AND verdict IN ('correct', 'incorrect')), 0)) AS brier,
    median(CAST(resolved_on - said_date AS DOUBLE) / (target_date - said_date))
      FILTER (WHERE type = 'prediction' AND verdict IN ('correct', 'incorrect') AND resolved_on > target_date AND target_date > said_date)
      AS lateness_multiplier,
    count(*) FILTER (WHERE label IN ('pushed_later', 'goalposts_moved', 'reversed')) AS drift_events
  FROM drift GROUP BY person_slug)
"""



def _page_text() -> str:
    """Elements dropped tag by tag (no page nests two of a kind), blocks to lines, the references that occur decoded, ampersands last."""
    text = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "noscript", "template", "svg", "head", "title", "nav", "header", "footer", "aside", "form", "iframe"):
        text = f"regexp_replace({text}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    text = f"regexp_replace({text}, '(?i)<br\\s*/?>', chr(10), 'g')"
    names = "p|div|section|article|main|blockquote|li|ul|ol|h[1-6]|tr|table|pre|figure|figcaption|dd|dt"
    text = f"regexp_replace(regexp_replace({text}, '(?i)</(?:{names})\\s*>', chr(10) || chr(10), 'g'), '(?i)<(?:p|div|section|article|main|blockquote|li|h[1-6]|tr|pre|figure|dd|dt)\\b[^>]*>', chr(10) || chr(10), 'g')"
    text = f"regexp_replace({text}, '<[^>]+>', '', 'g')"
    for written, meant in (("&copy;", "©"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{written}', '{meant}')"
    lines = f"array_to_string(list_transform(string_split({text}, chr(10)), lambda l: trim(regexp_replace(l, '[ \\t]+', ' ', 'g'))), chr(10))"
    return f"SELECT page_id, regexp_replace(regexp_replace({lines}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM pages"


BASE = f"WITH {LEDGER}"
DRIFTED = f"{BASE},{DRIFT}"
SCORED = f"{DRIFTED},{SCORES}"

ORACLE: dict[str, str] = {
    "page_text": _page_text(),
    "person_scorecard": f"""{SCORED}
SELECT person_slug, person, claims, predictions, correct, incorrect, partial, unresolvable, too_early, pending, drift_events,
  CAST(correct AS DOUBLE) / nullif(correct + incorrect, 0) AS accuracy,
  (correct + 0.5::DOUBLE * partial) / nullif(correct + incorrect + partial, 0) AS credit_accuracy,
  brier, round(lateness_multiplier, 6) AS lateness_multiplier
FROM scores""",
    "leaderboard": f"""{SCORED}
SELECT person_slug, predictions, correct, incorrect, partial, too_early + pending AS open, drift_events,
  correct + incorrect < 5 AS thin_record,
  CASE WHEN brier IS NULL OR correct + incorrect < 5 THEN NULL WHEN brier < 0.25 THEN 'better' WHEN brier > 0.25 THEN 'worse' ELSE 'same' END
    AS versus_coin_flip,
  CAST(correct AS DOUBLE) / nullif(correct + incorrect, 0) AS accuracy,
  brier, round(lateness_multiplier, 6) AS lateness_multiplier
FROM scores""",
    "corpus_totals": f"""{SCORED}
SELECT count(*) AS people, CAST(sum(claims) AS BIGINT) AS claims, CAST(sum(correct + incorrect + partial + unresolvable) AS BIGINT) AS graded,
  CAST(sum(pending + too_early) AS BIGINT) AS open, CAST(sum(drift_events) AS BIGINT) AS drift_events FROM scores""",
    "topic_scorecard": f"""{BASE}
SELECT person_slug, topic, count(*) AS predictions, count(*) FILTER (WHERE verdict = 'correct') AS correct,
  count(*) FILTER (WHERE verdict = 'incorrect') AS incorrect, count(*) FILTER (WHERE verdict = 'partial') AS partial,
  CAST(count(*) FILTER (WHERE verdict = 'correct') AS DOUBLE) / nullif(count(*) FILTER (WHERE verdict IN ('correct', 'incorrect')), 0) AS accuracy
FROM ledger WHERE type = 'prediction' GROUP BY ALL""",
    "calibration": f"""{BASE}, b AS (
  SELECT *, CAST(least(floor(round(implied_probability * 1000) / 100), 9) AS INT) AS bucket_no FROM ledger
  WHERE type = 'prediction' AND verdict IN ('correct', 'incorrect'))
SELECT person_slug, bucket_no, format('{{:.1f}}-{{:.1f}}', bucket_no / 10.0, (bucket_no + 1) / 10.0) AS bucket, count(*) AS n,
  CAST(sum(CAST(round(implied_probability * 10000) AS BIGINT)) AS DOUBLE) / (count(*) * 10000::DOUBLE) AS predicted, avg(CASE verdict WHEN 'correct' THEN 1.0::DOUBLE ELSE 0 END) AS observed
FROM b GROUP BY ALL""",
    "lateness_multiplier": f"""{BASE}
SELECT person_slug, round(median(CAST(resolved_on - said_date AS DOUBLE) / (target_date - said_date)), 6) AS lateness_multiplier
FROM ledger WHERE type = 'prediction' AND verdict IN ('correct', 'incorrect') AND resolved_on > target_date AND target_date > said_date
GROUP BY ALL""",
    "deadline_drift": f"""{DRIFTED}
SELECT id, person_slug, topic, label,
  CASE WHEN previous_id IS NULL THEN NULL WHEN pid IS NULL THEN previous_id ELSE pid END AS previous_claim_id,
  CASE WHEN previous_id IS NULL AND target_date IS NULL THEN 'First recorded claim on this topic.'
       WHEN previous_id IS NULL THEN concat('First recorded claim on this topic, with a deadline of ', target_date, '.')
       WHEN pid IS NULL THEN 'Restated the claim; no earlier deadline to compare.'
       WHEN met THEN concat('The earlier deadline (', was, ') was met; this sets a new one, ', target_date, '.')
       WHEN shift >= 60 THEN concat('Deadline moved from ', was, ' to ', target_date, '.')
       WHEN shift <= -60 THEN concat('Deadline moved earlier, from ', was, ' to ', target_date, '.')
       WHEN was = target_date THEN concat('Restated with the same deadline, ', target_date, '.')
       ELSE concat('Restated with a deadline of ', target_date, ' (previously ', was, ').') END AS note
FROM drift""",
}

VOTE_ROWS = "votes AS (" + "\nUNION ALL ".join(
    f"SELECT o_orderkey AS claim_id, '{j}' AS judge, {verdict} AS verdict, {conf} AS confidence FROM orders"
    + (" WHERE o_orderkey % 4 <> 1" if j == "C" else "")
    for j, verdict, conf in VOTES
) + ")"

EVIDENCE = f"""
ev AS ({select_sql(EVIDENCE_COLUMNS, 'lineitem')}),
read AS ({select_sql(PAGE_COLUMNS, "lineitem WHERE l_returnflag <> 'N'")}),
evk AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(url, '^https?://(www\\.)?', ''), '/\\?utm_source=x&', '?'), '#top$', '') AS key FROM ev),
readk AS (SELECT *, regexp_replace(regexp_replace(url, '^https?://', ''), '&UTM_medium=y$', '') AS key FROM read),
ok AS (SELECT * FROM evk WHERE (claim_id, judge, key) IN (SELECT (claim_id, judge, key) FROM readk))
"""

# Round robin by hand: the state after each turn, one recursive step per (round, judge), then the cited pages in order.
EVIDENCE_MERGE = f"""WITH RECURSIVE {EVIDENCE},
own AS (SELECT o_orderkey AS claim_id, 'site0.example.com/a/0?id=0' AS own_key, CAST(o_orderdate AS DATE) AS target FROM orders),
q AS (
  SELECT claim_id, judge, key, min((pos, url, date)) AS r FROM ok JOIN own USING (claim_id) WHERE key <> own_key GROUP BY ALL),
ql AS (SELECT claim_id, judge, list({{'key': key, 'url': r[2], 'date': r[3]}} ORDER BY r[1], r[2]) AS items FROM q GROUP BY ALL),
pg AS (
  SELECT claim_id, key, min((judge, pos, url)) AS r FROM readk JOIN own USING (claim_id) WHERE key <> own_key GROUP BY ALL),
pl AS (SELECT claim_id, list({{'key': key, 'url': r[3], 'date': NULL::DATE}} ORDER BY r[1], r[2], r[3]) AS items FROM pg GROUP BY ALL),
queues AS (
  SELECT o.claim_id, target, a.items AS qa, b.items AS qb, pl.items AS pages
  FROM own o LEFT JOIN ql a ON a.claim_id = o.claim_id AND a.judge = 'A' LEFT JOIN ql b ON b.claim_id = o.claim_id AND b.judge = 'B'
  LEFT JOIN pl ON pl.claim_id = o.claim_id
  WHERE a.items IS NOT NULL OR b.items IS NOT NULL OR pl.items IS NOT NULL),
state AS (
  SELECT claim_id, 0 AS turn, [{{'key': '', 'url': '', 'date': NULL::DATE}}][1:0] AS taken FROM queues
  UNION ALL
  SELECT s.claim_id, s.turn + 1,
    CASE WHEN len(taken) >= 5 THEN taken
         ELSE list_concat(taken, list_filter(
           CASE WHEN s.turn >= 10 THEN pages[s.turn - 9:s.turn - 9] WHEN s.turn % 2 = 0 THEN qa ELSE qb END,
           lambda x: NOT list_contains(list_transform(taken, lambda t: t.key), x.key))[1:1]) END
  FROM state s JOIN queues USING (claim_id) WHERE s.turn < 10 + len(coalesce(pages, [])))
SELECT claim_id, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY coalesce(e.date >= target, false) DESC, i) - 1 AS INT) AS place,
  e.url AS url, e.date AS date
FROM (SELECT claim_id, target, unnest(taken) AS e, generate_subscripts(taken, 1) AS i
      FROM (SELECT claim_id, target, max_by(taken, turn) AS taken FROM state JOIN queues USING (claim_id) GROUP BY ALL))
"""

_HEDGE_NORM = "lower(hedge)"


def _hedge_case(column: str, otherwise: str) -> str:
    """The longest phrase of the table in `column`, as an ordered CASE of RE2 patterns."""
    flat = sorted(((ph, p) for p, phrases in HEDGE_TABLE for ph in phrases), key=lambda x: -len(x[0]))
    norm = (
        f"regexp_replace(regexp_replace(lower({column}), '(a |one )?hundred[ -]?(percent|per cent)', '100%', 'g'), "
        "'(fifty|50)[ -/](fifty|50)', '50/50', 'g')"
    )
    whens = []
    for phrase, p in flat:
        ending = "(s|d|ed)?" if phrase[-1].isalpha() else ""
        pattern = "(^|[^a-z0-9])" + phrase.lower().replace("'", "''") + ending + "([^a-z0-9]|$)"
        value = "'" + phrase.replace("'", "''") + "'" if otherwise == "phrase" else f"{p}::DOUBLE"
        whens.append(f"WHEN regexp_matches({norm}, '{pattern}') THEN {value}")
    return "CASE " + " ".join(whens) + " END"


_NEGATED = "regexp_matches(claim, '(?i)(^|[^a-z0-9_])(will not|is not going to|never|no longer|cannot|not)([^a-z0-9_]|$)')"

ORACLE.update({
    "moving_chains": f"""{DRIFTED}
SELECT person_slug, topic, count(*) AS claims, count(*) FILTER (WHERE label IN ('pushed_later', 'pulled_earlier')) AS notable,
  min(said_date) AS first_said, max(said_date) AS last_said,
  arg_min(target_date, (said_date, id)) FILTER (WHERE target_date IS NOT NULL) AS first_deadline,
  arg_max(target_date, (said_date, id)) FILTER (WHERE target_date IS NOT NULL) AS last_deadline
FROM drift GROUP BY ALL HAVING count(*) >= 2 AND notable > 0 ORDER BY notable DESC, claims DESC, topic, person_slug LIMIT 4""",
    "chain_summary": f"""{DRIFTED}, c AS (
  SELECT person_slug, topic, count(*) AS claims, count(*) FILTER (WHERE label = 'pushed_later') AS pushed_later,
    count(*) FILTER (WHERE label = 'pulled_earlier') AS pulled_earlier,
    min((said_date, id)) FILTER (WHERE label = 'pushed_later') AS pushed_at, min((said_date, id)) FILTER (WHERE label = 'pulled_earlier') AS pulled_at,
    min(said_date) AS first_said, max(said_date) AS last_said,
    arg_min(target_date, (said_date, id)) FILTER (WHERE target_date IS NOT NULL) AS first_deadline,
    arg_max(target_date, (said_date, id)) FILTER (WHERE target_date IS NOT NULL) AS last_deadline, count(target_date) AS dated
  FROM drift GROUP BY ALL HAVING count(*) >= 2 AND count(*) FILTER (WHERE type <> 'factual') > 0),
t AS (
  SELECT *, CASE pushed_later WHEN 1 THEN 'once' WHEN 2 THEN 'twice' ELSE concat(pushed_later, ' times') END AS pushed_n,
    CASE pulled_earlier WHEN 1 THEN 'once' WHEN 2 THEN 'twice' ELSE concat(pulled_earlier, ' times') END AS pulled_n,
    CASE WHEN month(first_deadline) = 12 AND day(first_deadline) = 31 THEN CAST(year(first_deadline) AS VARCHAR)
         WHEN first_deadline = last_day(first_deadline) THEN strftime(first_deadline, '%b %Y') ELSE strftime(first_deadline, '%b %-d, %Y') END AS d1,
    CASE WHEN month(last_deadline) = 12 AND day(last_deadline) = 31 THEN CAST(year(last_deadline) AS VARCHAR)
         WHEN last_deadline = last_day(last_deadline) THEN strftime(last_deadline, '%b %Y') ELSE strftime(last_deadline, '%b %-d, %Y') END AS d2,
    concat(claims, ' claims, ', strftime(first_said, '%b %Y'), ' to ', strftime(last_said, '%b %Y')) AS span FROM c),
u AS (
  SELECT *, concat_ws(', ', CASE WHEN pushed_later > 0 THEN concat('Deadline pushed later ', pushed_n) END,
    CASE WHEN dated >= 2 AND d1 <> d2 THEN concat(d1, ' → ', d2) END) AS parts FROM t)
SELECT person_slug, topic, claims, pushed_later, pulled_earlier, first_deadline, last_deadline,
  CASE WHEN parts = '' THEN span ELSE concat(parts, '. ', span, '.') END AS summary,
  CASE WHEN pushed_later + pulled_earlier = 0 THEN NULL ELSE concat('Story on ', topic, ': ',
    CASE WHEN pulled_earlier = 0 THEN concat('deadline pushed later ', pushed_n)
         WHEN pushed_later = 0 THEN concat('deadline pulled earlier ', pulled_n)
         WHEN pushed_at < pulled_at THEN concat('deadline pushed later ', pushed_n, ', deadline pulled earlier ', pulled_n)
         ELSE concat('deadline pulled earlier ', pulled_n, ', deadline pushed later ', pushed_n) END,
    ' (', year(first_said), ' to ', year(last_said), ').') END AS story
FROM u""",
    "latest_move": f"""{DRIFTED}
SELECT person_slug, id, topic, said_date, label FROM drift WHERE label IN ('pushed_later', 'pulled_earlier')
QUALIFY row_number() OVER (PARTITION BY person_slug ORDER BY said_date DESC, id) = 1""",
    "chain_steps": f"""{BASE}
SELECT person_slug, topic, said_date, id,
  CASE WHEN target_date IS NULL THEN concat('no deadline (said ', said_date, ')') ELSE CAST(target_date AS VARCHAR) END AS step
FROM ledger QUALIFY count(*) OVER (PARTITION BY person_slug, topic) >= 2""",
    "drift_label_merge": f"""{DRIFTED}, n AS (
  SELECT *, CAST(claim AS BIGINT) AS k, row_number() OVER (PARTITION BY person_slug, topic ORDER BY said_date, id) AS nth,
    min(said_date) OVER (PARTITION BY person_slug, topic) < max(said_date) OVER (PARTITION BY person_slug, topic) AS moves,
    CASE WHEN previous_id IS NULL THEN NULL WHEN pid IS NULL THEN previous_id ELSE pid END AS prev,
    CASE WHEN previous_id IS NULL AND target_date IS NULL THEN 'First recorded claim on this topic.'
       WHEN previous_id IS NULL THEN concat('First recorded claim on this topic, with a deadline of ', target_date, '.')
       WHEN pid IS NULL THEN 'Restated the claim; no earlier deadline to compare.'
       WHEN met THEN concat('The earlier deadline (', was, ') was met; this sets a new one, ', target_date, '.')
       WHEN shift >= 60 THEN concat('Deadline moved from ', was, ' to ', target_date, '.')
       WHEN shift <= -60 THEN concat('Deadline moved earlier, from ', was, ' to ', target_date, '.')
       WHEN was = target_date THEN concat('Restated with the same deadline, ', target_date, '.')
       ELSE concat('Restated with a deadline of ', target_date, ' (previously ', was, ').') END AS note FROM drift),
p AS (
  SELECT *, CASE k % 6 WHEN 0 THEN 'goalposts_moved' WHEN 1 THEN 'reversed' WHEN 2 THEN 'escalated' WHEN 3 THEN 'softened'
      WHEN 4 THEN 'reaffirmed' ELSE 'reversed' END AS proposed,
    CASE WHEN k % 6 = 5 THEN 'Second thoughts.' WHEN k % 11 IN (0, 1) THEN '' ELSE concat('Restated differently in order ', claim, '.') END AS said FROM n),
r AS (
  SELECT *, moves AND nth > 1 AND label <> 'first' AND proposed <> 'reaffirmed'
      AND (label NOT IN ('pushed_later', 'pulled_earlier') OR proposed IN ('goalposts_moved', 'reversed')) AS wins,
    CASE WHEN said = '' THEN concat('Labeled ', replace(proposed, '_', ' '), ' relative to the previous claim.') ELSE said END AS fresh FROM p)
SELECT id,
  CASE WHEN k % 13 = 0 AND origin = 'seed' AND moves THEN 'softened' WHEN wins THEN proposed ELSE label END AS label,
  CASE WHEN k % 13 = 0 AND origin = 'seed' AND moves THEN NULL ELSE prev END AS previous_claim_id,
  CASE WHEN k % 13 = 0 AND origin = 'seed' AND moves THEN 'Hand label.'
       WHEN wins AND label IN ('pushed_later', 'pulled_earlier') THEN concat(fresh, ' ', note) WHEN wins THEN fresh ELSE note END AS note,
  CASE WHEN k % 13 = 0 AND origin = 'seed' AND moves THEN 'human:editor' WHEN wins THEN 'model-x' END AS labeled_by
FROM r""",
    "due_predictions": f"""{BASE}
SELECT id, person_slug, said_date, target_date, verdict FROM ledger
WHERE type = 'prediction' AND target_date <= DATE '2001-01-01' AND verdict IN ('pending', 'too_early')""",
    "person_slice": f"{BASE} SELECT id, said_date, type, topic, verdict FROM ledger WHERE person_slug = 'person-5'",
    "latest_statements": f"{BASE} SELECT id, person_slug, said_date, claim FROM ledger ORDER BY said_date DESC, id LIMIT 6",
    "statement_facets": f"""{BASE}
SELECT id, concat_ws(' ', 'all', CASE WHEN type = 'prediction' THEN 'prediction' END, CASE WHEN verdict IN ('correct', 'incorrect') THEN verdict END,
  CASE WHEN type = 'prediction' AND verdict IN ('pending', 'too_early') THEN 'waiting' END) AS tags FROM ledger""",
    **{
        f"people_ranking_{polarity}": f"""{BASE}, s AS (
  SELECT person_slug, count(*) FILTER (WHERE verdict = 'correct') AS correct, count(*) FILTER (WHERE verdict = 'incorrect') AS incorrect,
    count(*) FILTER (WHERE verdict = 'partial') AS partial FROM ledger WHERE type = 'prediction' GROUP BY ALL)
SELECT *, CAST(correct AS DOUBLE) / nullif(correct + incorrect, 0) AS accuracy, false AS thin FROM s WHERE correct + incorrect + partial >= 2"""
        for polarity in ("wrong", "right")
    },
    "claim_ids": f"{BASE} SELECT id AS stored_id, id, person_slug FROM ledger",
    "duplicate_ids": f"{BASE} SELECT id, 2::BIGINT AS copies FROM ledger WHERE verdict = 'partial'",
    "ledger_totals": f"""{BASE} SELECT count(*) AS claims, count(DISTINCT person_slug) AS people,
  count(*) FILTER (WHERE verdict NOT IN ('pending', 'too_early')) AS graded FROM ledger""",
    "claim_quality": f"""{BASE}, r AS (
  SELECT id, CASE WHEN type = 'prediction' AND target_date IS NULL THEN ['error', 'a prediction needs a target_date'] END AS a,
    CASE WHEN origin <> 'seed' THEN ['error', 'origin must be "seed" (got "extracted")'] END AS b,
    CASE WHEN said_date > DATE '2001-01-01' THEN ['error', 'said_date # is after today (#)'] END AS c,
    CASE WHEN verdict NOT IN ('pending', 'too_early') THEN ['error', 'grading.graded_at is not an ISO timestamp'] END AS d,
    CASE WHEN verdict = 'too_early' THEN ['error', 'verdict is too_early but there is no grading'] END AS e,
    CASE WHEN verdict = 'pending' AND target_date <= DATE '2001-01-01' THEN ['warning', 'deadline # has passed: grade it'] END AS f,
    CASE WHEN verdict NOT IN ('pending', 'too_early') AND resolved_on > DATE '2001-01-01' THEN ['error', 'grading.resolved_on # is after today (#)'] END AS g,
    CASE WHEN type = 'prediction' AND target_date > DATE '2001-01-01' AND verdict = 'correct' AND resolved_on IS NULL
         THEN ['error', 'graded correct before the deadline (#) without resolved_on'] END AS h,
    CASE WHEN type = 'prediction' AND target_date > DATE '2001-01-01' AND verdict IN ('incorrect', 'partial') AND resolved_on IS NULL
         THEN ['warning', concat('graded ', verdict, ' before the deadline (#)')] END AS i,
    CASE WHEN person = concat('person ', claim) AND length(claim) > 2
         THEN ['warning', concat('quote names ', claim, ' in the third person: check it is not a reporter''s paraphrase')] END AS j
  FROM ledger)
SELECT id, x[1] AS severity, x[2] AS message FROM (SELECT id, unnest([a, b, c, d, e, f, g, h, i, j]) AS x FROM r) WHERE x IS NOT NULL""",
    "ledger_upsert": f"""{BASE}
SELECT id, person_slug, claim, CASE WHEN specificity = 2 THEN 'maybe' ELSE hedge END AS hedge, verdict, origin, specificity,
  verdict NOT IN ('pending', 'too_early') AS graded,
  CASE WHEN specificity = 5 THEN 'kept' WHEN specificity = 2 AND hedge <> 'maybe' THEN 'updated' ELSE 'unchanged' END AS change FROM ledger
UNION ALL
SELECT substr(sha1(concat(person_slug, '|', said_date, '|', claim, ' again')), 1, 12), person_slug, concat(claim, ' Again!'), hedge, 'pending', 'extracted',
  NULL, false, 'added' FROM ledger WHERE specificity = 5""",
    "field_patch": f"""{BASE}
SELECT id, CASE WHEN verdict = 'correct' AND specificity <> 1 THEN 'definitely' ELSE hedge END AS hedge, topic FROM ledger""",
    "vote_combine": f"""WITH {VOTE_ROWS}, v AS (
  SELECT *, CAST(floor(least(1.0, greatest(0.0, CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END)) * 1000000 + 0.5) AS BIGINT) AS c FROM votes),
g AS (SELECT claim_id, verdict, count(*) AS n, CAST(sum(c) AS BIGINT) AS s, arg_min(judge, (-c, judge)) AS lead FROM v GROUP BY ALL),
t AS (SELECT claim_id, CAST(sum(n) AS BIGINT) AS votes, max((n, verdict, s, lead)) AS top FROM g GROUP BY ALL),
l AS (SELECT claim_id, arg_min(judge, (-c, judge)) AS any_lead FROM v GROUP BY ALL)
SELECT claim_id, CASE WHEN top[1] >= votes // 2 + 1 THEN top[2] ELSE 'unresolvable' END AS verdict,
  CASE WHEN top[1] >= votes // 2 + 1 THEN floor(top[3] / (top[1] * 1000000.0::DOUBLE) * 100 + 0.5) / 100 ELSE 0.5 END AS confidence,
  NOT top[1] >= votes // 2 + 1 AS disputed, CASE WHEN top[1] >= votes // 2 + 1 THEN top[1] ELSE votes END AS winners,
  CASE WHEN top[1] >= votes // 2 + 1 THEN top[4] ELSE any_lead END AS lead, votes
FROM t JOIN l USING (claim_id)""",
    "tie_break_demand": f"""WITH {VOTE_ROWS}
SELECT claim_id, 'C' AS judge FROM votes WHERE judge <> 'C' GROUP BY claim_id HAVING count(*) = 2 AND count(DISTINCT verdict) = 2""",
    "deadline_gate": f"""{BASE}
SELECT id, 'too_early' AS verdict, 1.0::DOUBLE AS confidence,
  concat('The deadline (', target_date, ') has not passed yet (today is 2001-01-01).') AS rationale, 'rule:deadline' AS graded_by
FROM ledger WHERE target_date > DATE '2001-01-01'""",
    "evidence_verified": f"WITH {EVIDENCE} SELECT claim_id, judge, pos, part, url, key FROM ok",
    "evidence_merge": EVIDENCE_MERGE,
    "hedge_probability": f"""WITH {HEDGED}
SELECT doc_id, {_hedge_case('hedge', 'phrase')} AS phrase, coalesce({_hedge_case('hedge', 'p')}, 0.85::DOUBLE) AS p FROM hedged""",
    "implied_and_claim_probability": f"""WITH {HEDGED}, m AS (
  SELECT doc_id, claim, {_hedge_case('hedge', 'p')} AS hp, {_hedge_case('claim', 'p')} AS cp FROM hedged)
SELECT doc_id, coalesce(hp, cp, 0.85::DOUBLE) AS implied,
  CASE WHEN hp < 0.5 AND {_NEGATED} THEN round((1 - hp) * 20) / 20 ELSE coalesce(hp, 0.85::DOUBLE) END AS claim_p FROM m""",
    "url_keys": """WITH p AS (
  SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
s AS (
  SELECT page_id, regexp_replace(regexp_extract(u, '^https?://([^?]*)', 1), '^www\\.', '') AS left_part, regexp_extract(u, '\\?(.*)$', 1) AS query FROM p),
k AS (
  SELECT page_id, rtrim(left_part, '/') AS page,
    list_aggregate(list_filter(string_split(query, '&'), lambda x: NOT lower(x) LIKE 'utm\\_%' ESCAPE '\\'), 'string_agg', '&') AS kept FROM s)
SELECT page_id, CASE WHEN coalesce(kept, '') = '' THEN page ELSE concat(page, '?', kept) END AS url_key,
  CASE WHEN coalesce(kept, '') = '' THEN page ELSE concat(page, '?', kept) END AS source_key FROM k""",
    "public_urls": """
SELECT page_id, url, true AS public FROM pages
UNION ALL
SELECT page_id, concat('http://', concat_ws('.', a, b, c, d), '/x'),
  NOT (a IN (0, 10, 127) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
    OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19)) OR a >= 224)
FROM (SELECT page_id, page_id % 256 AS a, (page_id * 7) % 256 AS b, (page_id * 13) % 256 AS c, (page_id * 29) % 256 AS d FROM pages)""",
    "page_titles": """
SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(
  regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t]+', ' ', 'g')), '') AS title
FROM pages""",
    "sft_export": f"""{BASE}
SELECT id, 'Grade one prediction from the evidence given.' AS brief, concat('Speaker: ', person, chr(10), 'Said: ', said_date, ' in "', source_title, '" ', source_url, chr(10), 'Quote: "', quote, '"', chr(10),
  'Claim (', type, '): ', claim, chr(10), 'Deadline: ', coalesce(CAST(target_date AS VARCHAR), 'none stated'), chr(10),
  'Resolution criteria: order ', claim, ' ships', chr(10), chr(10), 'Evidence:', chr(10), '[1] report ', claim,
  coalesce(' (' || CAST(resolved_on AS VARCHAR) || ')', ''), ' https://news.example.org/', claim, chr(10), '    what happened to order ', claim) AS prompt,
  concat('{{"verdict":"', verdict, '","confidence":0.9,"rationale":"Recorded as ', verdict, '.","resolvedOn":',
    CASE WHEN resolved_on IS NULL THEN 'null' ELSE concat('"', CAST(resolved_on AS VARCHAR), '"') END, '}}') AS answer
FROM ledger WHERE verdict NOT IN ('pending', 'too_early') AND NOT disputed""",
    "scorecard_parity": f"""{BASE}, s AS (
  SELECT person_slug, {COUNTS},
    CAST(sum(pow(CAST(round(implied_probability * 10000) AS BIGINT) - CASE verdict WHEN 'correct' THEN 10000 ELSE 0 END, 2))
      FILTER (WHERE type = 'prediction' AND verdict IN ('correct', 'incorrect')) AS DOUBLE)
      / (1e8::DOUBLE * nullif(count(*) FILTER (WHERE type = 'prediction' AND verdict IN ('correct', 'incorrect')), 0)) AS brier
  FROM ledger GROUP BY person_slug),
l AS (
  SELECT person_slug, predictions AS n, concat('accuracy ', coalesce(printf('%.3f', floor(CAST(correct AS DOUBLE) / nullif(correct + incorrect, 0) * 1000 + 0.5) / 1000), 'n/a'), ' · Brier ',
    coalesce(printf('%.3f', floor(brier * 1000 + 0.5) / 1000), 'n/a'), ' · ') AS head FROM s)
SELECT person_slug, concat(head, n, CASE WHEN n = 1 THEN ' bet' ELSE ' bets' END) AS ours, concat(head, n + 1, CASE WHEN n = 0 THEN ' bet' ELSE ' bets' END) AS theirs
FROM l WHERE n % 7 = 0""",
    "sync_plan": f"""{BASE}, c AS (
  SELECT *, CAST(claim AS BIGINT) AS k, concat('people/', person_slug) AS page,
    CASE WHEN target_date IS NULL THEN claim ELSE concat(claim, ' (deadline ', target_date, ')') END AS text,
    CASE WHEN type = 'prediction' AND NOT disputed AND verdict NOT IN ('pending', 'too_early') THEN verdict END AS q FROM ledger),
s AS (
  SELECT *, CASE WHEN k % 5 < 3 THEN k END AS linked, k % 5 < 3 AS wrote,
    CASE WHEN k % 5 = 0 AND verdict IN ('correct', 'incorrect') THEN 'correct' END AS pushed,
    CASE WHEN k % 5 = 2 AND verdict = 'incorrect' THEN 'correct' END AS held,
    k % 5 = 3 AND k % 11 <> 0 AS found FROM c),
n AS (SELECT *, coalesce(linked, CASE WHEN found THEN k END) AS row FROM s WHERE NOT wrote OR linked IS NULL OR (q IS NOT NULL AND q IS DISTINCT FROM pushed)),
a AS (
  SELECT *, unnest([
    CASE WHEN NOT wrote THEN 'add_timeline' END,
    CASE WHEN linked IS NULL AND found THEN 'link_take' END,
    CASE WHEN row IS NULL THEN 'add_take' END,
    CASE WHEN q IS NOT NULL AND pushed IS NULL AND (row IS NULL OR held IS NULL) THEN 'resolve' END,
    CASE WHEN q IS NOT NULL AND pushed IS NULL AND row IS NOT NULL AND held = q THEN 'record' END,
    CASE WHEN (q IS NOT NULL AND pushed IS NULL AND row IS NOT NULL AND held <> q) OR (pushed <> q AND row IS NOT NULL) THEN 'conflict' END]) AS action FROM n)
SELECT id, page, action, CAST(row AS INT) AS row, q AS quality, coalesce(held, pushed) AS held,
  CASE WHEN action = 'add_timeline' THEN concat(source_title, ' — "', quote, '" ', source_url) ELSE text END AS text
FROM a WHERE action IS NOT NULL""",
})

TURNS = "turns AS (SELECT conv_id, CAST(turn AS INT) AS turn, role, text, concat(role, ': ', text) AS line FROM conversations)"
PLACED = f"""{TURNS}, placed AS (
  SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM turns)"""

FILLER_LIST = "[" + ", ".join(f"'{w}'" for w in FILLERS) + "]"


def _match_text(column: str) -> str:
    """Match words as one string: lower case, letters and digits only, fillers dropped."""
    return (
        f"concat(' ', array_to_string(list_filter(regexp_extract_all(lower(strip_accents({column})), '[\\p{{L}}\\p{{N}}]+'), "
        f"lambda w: NOT list_contains({FILLER_LIST}, w)), ' '), ' ')"
    )


MOVED_NOTE = (
    "CASE label WHEN 'pushed_later' THEN concat('Deadline moved from ', strftime(was, '%b %-d, %Y'), ' to ', strftime(target_date, '%b %-d, %Y'), '.') "
    "ELSE concat('Deadline moved earlier, from ', strftime(was, '%b %-d, %Y'), ' to ', strftime(target_date, '%b %-d, %Y'), '.') END"
)
FEED = f"""
items AS (
  SELECT 'new_statements' AS kind, max(extracted_on) AS date, person_slug, source_url AS ref,
    concat(count(*), ' new statement', CASE WHEN count(*) = 1 THEN '' ELSE 's' END, ' from "', min(source_title), '" (', min(person), ')') AS text
  FROM drift WHERE origin = 'extracted' AND extracted_on > DATE '2000-12-02' AND extracted_on <= DATE '2001-01-01' GROUP BY person_slug, source_url
  UNION ALL
  SELECT 'came_due', target_date, person_slug, id, concat('Deadline passed: "', claim, '" (', person, '). ',
    CASE WHEN verdict IN ('pending', 'too_early') THEN 'Waiting to be graded.' WHEN verdict = 'correct' THEN 'Came true.'
         WHEN verdict = 'incorrect' THEN 'Did not happen.' WHEN verdict = 'partial' THEN 'Partly.' ELSE 'Could not be judged.' END)
  FROM drift WHERE type = 'prediction' AND target_date > DATE '2000-12-02' AND target_date <= DATE '2001-01-01'
  UNION ALL
  SELECT 'coming_due', target_date, person_slug, id, concat('Due ', strftime(target_date, '%b %-d, %Y'), ': "', claim, '" (', person, ')')
  FROM drift WHERE type = 'prediction' AND target_date > DATE '2001-01-01' AND target_date <= DATE '2001-02-01' AND verdict IN ('pending', 'too_early')
  UNION ALL
  SELECT 'story_moved', said_date, person_slug, id, concat(person, ': ', CASE label WHEN 'pushed_later' THEN 'deadline pushed' ELSE 'deadline pulled in' END,
    ' on Topic ', substr(topic, 7), '. ', {MOVED_NOTE})
  FROM drift WHERE label IN ('pushed_later', 'pulled_earlier')
    AND (coalesce(extracted_on > DATE '2000-12-02', false) OR (said_date > DATE '2000-01-02' AND said_date <= DATE '2001-01-01')))
"""

PROPOSED = """
pp AS (
  SELECT page_id, unnest(CASE WHEN page_id % 3 = 0 THEN [0, 1] ELSE [0] END) AS copy, url FROM pages),
proposed AS (
  SELECT concat('person-', page_id % 20) AS person_slug, page_id * 2 + copy AS ordinal, page_id, concat('talk ', page_id) AS title,
    DATE '2000-03-01' + CAST(page_id % 400 AS INT) AS day, CAST(page_id % 40 AS INT) AS minutes, regexp_replace(url, '#.*$', '') AS u FROM pp),
keyed AS (
  SELECT *, rtrim(regexp_replace(regexp_extract(u, '^https?://([^?]*)', 1), '^www\\.', ''), '/') AS page,
    list_aggregate(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: NOT lower(x) LIKE 'utm\\_%' ESCAPE '\\'), 'string_agg', '&') AS kept
  FROM proposed),
keys AS (SELECT *, CASE WHEN coalesce(kept, '') = '' THEN page ELSE concat(page, '?', kept) END AS key FROM keyed)
"""
VALIDATED = f"""{PROPOSED},
v1 AS (
  SELECT person_slug, ordinal, title, key, CASE WHEN day <= DATE '2001-01-01' THEN day END AS date, CASE WHEN minutes > 0 THEN minutes END AS duration_min,
    CASE WHEN day < DATE '2000-07-01' THEN 'older than the window' WHEN page_id % 17 = 5 THEN 'missing a title or description' END AS r FROM keys),
v2 AS (
  SELECT *, min(ordinal) FILTER (WHERE r IS NULL AND coalesce(duration_min, 10) >= 10) OVER (PARTITION BY person_slug, key) AS first_long,
    min(ordinal) FILTER (WHERE r IS NULL AND duration_min BETWEEN 5 AND 9) OVER (PARTITION BY person_slug, key) AS first_clip,
    count(*) FILTER (WHERE r IS NULL AND coalesce(duration_min, 10) >= 10) OVER (PARTITION BY person_slug) > 0 AS any_long FROM v1),
v AS (
  SELECT *, coalesce(r, CASE WHEN first_long < ordinal THEN 'a duplicate' WHEN duration_min < 5 THEN 'a short clip'
    WHEN duration_min < 10 AND any_long THEN 'a short clip' WHEN duration_min < 10 AND first_clip < ordinal THEN 'a duplicate' END) AS reason FROM v2)
"""

RETRIEVAL = f"""{DRIFTED},
pool AS (
  SELECT c_custkey AS question_id, c_custkey % 4 AS m, d.*, d.verdict IN ('correct', 'incorrect', 'partial') AS graded,
    d.label IN ('pushed_later', 'pulled_earlier') AS notable,
    type = 'prediction' AND target_date IS NOT NULL AND verdict IN ('pending', 'too_early') AS fits
  FROM customer JOIN drift d ON d.person_slug = concat('person-', c_custkey)),
flags AS (
  SELECT *, bool_or(notable) OVER (PARTITION BY question_id, topic) AS chain_moved, bool_or(notable) OVER (PARTITION BY question_id) AS any_moved,
    count(*) OVER (PARTITION BY question_id) AS n, row_number() OVER (PARTITION BY question_id ORDER BY said_date DESC, id) AS newest,
    count(*) FILTER (WHERE fits AND year(target_date) = 1999) OVER (PARTITION BY question_id) AS n1, count(*) FILTER (WHERE fits) OVER (PARTITION BY question_id) AS n2
  FROM pool),
picked AS (
  SELECT *, m <> 2 OR n1 > 0 AS scoped,
    CASE m WHEN 0 THEN 5 + CAST(newest <= greatest(1, ceil(n * 0.2)) AS INT) WHEN 1 THEN CAST(graded AS INT) WHEN 2 THEN 0 ELSE CAST(notable AS INT) END AS score
  FROM flags
  WHERE m IN (0, 1) OR (m = 3 AND (chain_moved OR NOT any_moved))
    OR (m = 2 AND CASE WHEN n1 > 0 THEN fits AND year(target_date) = 1999 WHEN n2 > 0 THEN fits ELSE true END))
"""

ORACLE.update({
    "segment_layout": f"""WITH {PLACED}
SELECT conv_id AS transcript_id, turn AS seg_no, off AS offset, off + length(role) + 2 AS text_start, turn * 30.0::DOUBLE AS start_sec FROM placed""",
    "segment_times": f"""WITH {PLACED}, n AS (SELECT conv_id, max(off + length(line)) AS n_chars FROM placed GROUP BY ALL),
asked AS (SELECT conv_id, unnest(range(0, n_chars, 1000)) AS c FROM n)
SELECT a.conv_id AS transcript_id, c AS char_offset, turn AS seg_no, turn * 30.0::DOUBLE AS start_sec
FROM asked a JOIN placed p ON p.conv_id = a.conv_id AND c >= off AND c < off + length(line) + 1""",
    "trimmed_minutes": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
p AS (SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS seg_no FROM l),
u AS (SELECT *, 900 - coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS room FROM p),
c AS (SELECT *, left(text, room) AS piece, CASE WHEN contains(left(text, room), ' ') THEN length(left(text, room)) - strpos(reverse(left(text, room)), ' ') ELSE -1 END AS at_word
      FROM u WHERE room > 0)
SELECT 'conversation' AS kind, conv_id AS transcript_id, CAST(turn AS INT) AS seg_no, text FROM conversations WHERE turn < 3
UNION ALL
SELECT 'document', doc_id, CAST(seg_no AS INT), CASE WHEN length(text) <= room THEN text WHEN at_word > room * 0.5 THEN trim(left(piece, at_word)) ELSE trim(piece) END
FROM c WHERE length(text) <= room OR trim(CASE WHEN at_word > room * 0.5 THEN left(piece, at_word) ELSE piece END) <> ''""",
    "quote_verify_exact": f"""WITH b AS (SELECT item_id, {_match_text('text')} AS q FROM benchmark), d AS (SELECT doc_id, {_match_text('text')} AS t FROM documents)
SELECT item_id AS candidate_id, doc_id AS transcript_id, 1.0::DOUBLE AS score FROM b JOIN d ON contains(t, q)""",
    "people_links": """WITH known AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT o_orderkey AS text_id, CASE WHEN b.k IS NULL OR b.k = o_custkey THEN concat('person-', o_custkey) ELSE concat('person-', o_custkey, ',person-', b.k) END AS slugs
FROM orders LEFT JOIN known b ON b.k = o_custkey % 100""",
    "question_plans": """WITH known AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT c_custkey AS question_id, CASE c_custkey % 4 WHEN 0 THEN 'said_about' WHEN 1 THEN 'track_record' WHEN 2 THEN 'due' ELSE 'drift' END AS kind,
  CASE WHEN k IS NULL THEN '' ELSE concat('person-', k) END AS people, CASE WHEN c_custkey % 4 = 0 THEN 'topic' ELSE '' END AS terms,
  CASE WHEN c_custkey % 4 = 0 THEN 'topic-0,topic-1,topic-2' ELSE '' END AS topics,
  CASE WHEN c_custkey % 4 = 2 THEN DATE '1999-01-01' END AS window_start, CASE WHEN c_custkey % 4 = 2 THEN DATE '1999-12-31' END AS window_stop,
  CASE WHEN c_custkey % 4 = 2 THEN 'target_date' END AS window_field
FROM customer LEFT JOIN known ON k = c_custkey""",
    "question_retrieval": f"""{RETRIEVAL}
SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN m = 2 THEN target_date END NULLS FIRST, score DESC,
    CASE WHEN m = 2 THEN NULL ELSE said_date END DESC, id) - 1 AS INT) AS place, id, CAST(score AS INT) AS score, scoped
FROM picked QUALIFY place < 12""",
    "recent_additions": f"""{BASE}
SELECT person_slug, source_url AS source_key, count(*) AS n, max(coalesce(extracted_on, said_date)) AS added FROM ledger GROUP BY ALL
ORDER BY added DESC, n DESC, person_slug, source_key LIMIT 5""",
    "whats_new_feed": f"""{DRIFTED}, {FEED}
SELECT * FROM items ORDER BY date DESC, list_position(['came_due', 'story_moved', 'new_statements', 'discovered', 'coming_due'], kind), text, ref LIMIT 8""",
    "feed_counts": f"{DRIFTED}, {FEED} SELECT kind, count(*) AS n, min(date) AS first, max(date) AS last FROM items GROUP BY ALL",
    "people_cards": f"""{SCORED},
w AS (SELECT c_custkey AS k, concat('person-', c_custkey) AS person_slug,
  CASE WHEN c_custkey % 9 <> 0 THEN CAST(TIMESTAMP '2001-01-01' - to_hours(CAST((c_custkey * 37) % 2000 AS INT)) AS DATE) END AS checked FROM customer WHERE c_acctbal > 0),
last AS (SELECT person_slug, max(said_date) AS last_statement FROM ledger GROUP BY ALL),
mv AS (SELECT person_slug, concat('Story moved on Topic ', substr(topic, 7), CASE label WHEN 'pushed_later' THEN ' (deadline pushed)' ELSE ' (deadline pulled in)' END) AS story_moved
  FROM drift WHERE label IN ('pushed_later', 'pulled_earlier') QUALIFY row_number() OVER (PARTITION BY person_slug ORDER BY said_date DESC, id) = 1),
np AS (SELECT concat('person-', page_id % 200) AS person_slug, count(*) FILTER (WHERE page_id % 3 = 0) AS new_appearances FROM pages GROUP BY ALL),
j AS (SELECT w.person_slug, s.* EXCLUDE (person_slug), correct + incorrect + partial AS g, pending + too_early AS o, last_statement, coalesce(new_appearances, 0) AS new_appearances,
    story_moved, greatest(checked, last_statement) AS active
  FROM w LEFT JOIN scores s USING (person_slug) LEFT JOIN last USING (person_slug) LEFT JOIN mv USING (person_slug) LEFT JOIN np USING (person_slug))
SELECT person_slug, CASE WHEN claims IS NULL THEN 'Nothing on record yet'
    WHEN g > 0 THEN concat(correct, ' of ', g, ' came true', CASE WHEN partial > 0 THEN concat(', ', partial, ' partly') ELSE '' END, CASE WHEN o > 0 THEN concat(' · ', o, ' waiting') ELSE '' END)
    WHEN o = 1 THEN '1 prediction waiting on its deadline' WHEN o > 0 THEN concat(o, ' predictions waiting on their deadline')
    WHEN claims = 1 THEN '1 statement on record, no predictions yet' ELSE concat(claims, ' statements on record, no predictions yet') END AS record,
  coalesce(o, 0) AS waiting, coalesce(claims, 0) AS claims, last_statement, new_appearances, story_moved, active FROM j""",
    "due_rechecks": """WITH w AS (SELECT concat('person-', c_custkey) AS slug,
  CASE WHEN c_custkey % 9 <> 0 THEN TIMESTAMP '2001-01-01' - to_hours(CAST((c_custkey * 37) % 2000 AS INT)) END AS last_checked_at FROM customer WHERE c_acctbal > 0)
SELECT * FROM w WHERE coalesce(last_checked_at, TIMESTAMP '1970-01-01') <= TIMESTAMP '2000-12-31' ORDER BY coalesce(last_checked_at, TIMESTAMP '1970-01-01'), slug LIMIT 10""",
    "appearance_dedupe": f"""WITH {PROPOSED}
SELECT ordinal, person_slug, key, ordinal > min(ordinal) OVER (PARTITION BY person_slug, key) AS duplicate FROM keys""",
    "appearance_validation": f"WITH {VALIDATED} SELECT person_slug, ordinal, date, duration_min, key, reason IS NULL AS kept, reason FROM v",
    "appearance_ranking": f"""WITH {VALIDATED}
SELECT person_slug, CAST(row_number() OVER (PARTITION BY person_slug ORDER BY date DESC NULLS LAST, coalesce(duration_min, 0) DESC, title, ordinal) AS INT) AS place, ordinal
FROM v WHERE reason IS NULL QUALIFY place <= 5""",
    "speaker_topics": f"""{BASE}
SELECT person_slug, string_agg(topic, ',' ORDER BY topic) AS topics FROM (SELECT DISTINCT person_slug, topic FROM ledger WHERE source_url <> 'https://example.com/episode/1') GROUP BY ALL""",
    "main_topic": f"""{BASE}, c AS (SELECT person_slug, topic, count(*) AS n FROM ledger GROUP BY ALL)
SELECT person_slug, topic, n FROM c QUALIFY row_number() OVER (PARTITION BY person_slug ORDER BY n DESC, topic) = 1""",
    "daily_new_statements": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "live_dedupe": "SELECT DISTINCT concat(user_id, '/', event_type) AS id FROM events",
    "live_drift": f"""{DRIFTED}
SELECT DISTINCT person_slug, topic, said_date, target_date, label, CASE WHEN previous_id IS NULL THEN NULL WHEN pid IS NULL THEN previous_id ELSE pid END AS previous_claim_id
FROM drift""",
    "live_upsert": f"{BASE} SELECT id, person_slug, said_date, verdict, origin FROM ledger",
})
