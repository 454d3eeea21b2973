"""DuckDB SQL that computes each registered query's result from the same tables.

Statements are put together from named common table expressions. The score,
verdict and catalog rules are written here once more in SQL, in the sequential form
where one exists (recursion over positions), not in the closed form of the jobs.
"""

from __future__ import annotations

import re

_ROUND = "CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def _round(x: str, digits: int) -> str:
    return _ROUND.format(x=x, digits=digits)


def _title(x: str) -> str:
    return f"(upper({x}[1]) || {x}[2:])"


_CATEGORY = "['view','click','signup','purchase','error'][CAST(({n}) % 5 + 1 AS INTEGER)]"

_ISSUE = {
    "unsupported": "'Rejected unsupported category: ' || category",
    "duplicate": "'Rejected duplicate category recommendation: ' || category",
    "evidence": "'Rejected ' || category || ': numeric evidence was missing or not an exact verified fact.'",
    "numeric": "'Rejected ' || category || ': numeric claims must appear only as exact evidence lines.'",
    "guarantee": "'Rejected ' || category || ': guaranteed outcomes are unsupported.'",
}
_ISSUE_CASE = "CASE verdict " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _ISSUE.items()) + " END"

_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"

# Common table expressions by name; each names the others it reads.
_CTES: dict[str, str] = {
    "region_ids": "SELECT r_regionkey AS region_key, lower(r_name) AS company_id FROM region",
    "customer_region": """
        SELECT c_custkey, company_id, lower(c_mktsegment) AS customer_tier
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region_ids ON n_regionkey = region_key""",
    "base_events": """
        SELECT e.*, c.company_id, c.customer_tier,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) >= 85 AS escalated,
               ['email','phone','web form','chat'][CAST(user_id % 4 + 1 AS INTEGER)] AS channel
        FROM events e JOIN customer_region c ON user_id = c_custkey""",
    "tickets": """
        SELECT company_id, 'TKT-' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS ticket_id,
               ts AS created_at, event_type AS category, props AS description,
               value AS resolution_minutes, escalated, channel, customer_tier
        FROM base_events""",
    "raw_tickets": """
        SELECT company_id,
               CASE WHEN event_id % 107 = 0 THEN NULL
                    WHEN event_id % 103 = 50 THEN 'TKT-' || lpad(CAST(event_id // 500 AS VARCHAR), 8, '0')
                    ELSE 'TKT-' || lpad(CAST(event_id AS VARCHAR), 8, '0') END AS ticket_id,
               CASE WHEN event_id % 79 = 0 THEN 'yesterday'
                    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')
                         || ['Z','+02:00',''][CAST(event_id % 3 + 1 AS INTEGER)] END AS created_at,
               CASE WHEN event_id % 97 = 0 THEN 'parking permits' ELSE event_type END AS category,
               CASE WHEN event_id % 83 = 0 THEN '' WHEN event_id % 89 = 0 THEN 'NA'
                    ELSE props END AS description,
               CASE WHEN event_id % 101 = 0 THEN '-5' WHEN event_id % 109 = 0 THEN 'ten'
                    ELSE CAST(value AS VARCHAR) END AS resolution_minutes,
               CASE WHEN event_id % 113 = 0 THEN 'maybe'
                    WHEN escalated THEN ['yes','TRUE','1','on','t'][CAST(event_id % 5 + 1 AS INTEGER)]
                    ELSE ['no','FALSE','0','off','f'][CAST(event_id % 5 + 1 AS INTEGER)] END AS escalated,
               CASE WHEN company_id = 'europe' THEN CAST(event_id % 4 AS VARCHAR)
                    WHEN event_id % 127 = 0 THEN NULL ELSE channel END AS channel,
               customer_tier, CASE WHEN event_id % 131 = 0 THEN 'cut off' END AS unreadable
        FROM base_events""",
    "factors": """
        SELECT * FROM (VALUES ('view', 1.00::DOUBLE, 1.00::DOUBLE), ('click', 0.95, 0.95),
            ('signup', 0.65, 0.65), ('purchase', 0.50, 0.50), ('error', 0.18, 0.18))
            AS f(category, repetitiveness, process_consistency)""",
    "draft_lists": """
        SELECT 'recommendations' AS kind, batch_id, count(*) AS n, 'category' AS first_field FROM rec_base WHERE stage = 0 GROUP BY batch_id
        UNION ALL SELECT 'analyses', batch_id, count(*), 'category' FROM analyses GROUP BY batch_id
        UNION ALL SELECT 'questions', batch_id, coalesce(n, 0), 'question_id'
                  FROM docs LEFT JOIN (SELECT batch_id, count(*) AS n FROM question_drafts GROUP BY 1) USING (batch_id)""",
    "parsed_tickets": r"""
        SELECT *,
               CASE WHEN regexp_matches(created_at, '^\d{4}-\d{2}-\d{2}T')
                    THEN CAST(created_at[1:26] AS TIMESTAMP)
                         - CASE WHEN created_at LIKE '%+02:00' THEN INTERVAL 2 HOUR
                                ELSE INTERVAL 0 HOUR END END AS t_time,
               TRY_CAST(resolution_minutes AS DOUBLE) AS t_minutes,
               CASE WHEN lower(escalated) IN ('yes','true','1','on','t') THEN TRUE
                    WHEN lower(escalated) IN ('no','false','0','off','f') THEN FALSE END AS t_flag,
               category IN (SELECT category FROM factors) AS t_known
        FROM raw_tickets""",
    "judged_tickets": """
        SELECT *, list_filter([
            CASE WHEN unreadable IS NOT NULL THEN 'row: unreadable' END,
            CASE WHEN ticket_id IS NULL THEN 'ticket_id: missing' END,
            CASE WHEN description IN ('', 'NA') THEN 'description: missing' END,
            CASE WHEN channel IS NULL THEN 'channel: missing' END,
            CASE WHEN t_time IS NULL THEN 'created_at: not a time' END,
            CASE WHEN NOT t_known THEN 'category: outside domain' END,
            CASE WHEN t_minutes IS NULL THEN 'resolution_minutes: not a number' END,
            CASE WHEN t_minutes < 0 THEN 'resolution_minutes: negative' END,
            CASE WHEN t_flag IS NULL THEN 'escalated: not a flag' END], lambda v: v IS NOT NULL) AS violations
        FROM parsed_tickets""",
    "duplicates": """
        SELECT company_id, ticket_id, count(*) AS occurrences FROM raw_tickets
        WHERE ticket_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
    "shares": """
        SELECT company_id, category, count(*) AS ticket_count,
               count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER (PARTITION BY company_id) AS category_percentage,
               max(count(*)) OVER (PARTITION BY company_id) AS maximum_category_count
        FROM tickets GROUP BY company_id, category""",
    "metrics": """
        SELECT company_id, category, ticket_count, category_percentage,
               minutes / ticket_count AS average_resolution_minutes,
               minutes / CAST(60 AS DOUBLE) AS total_handling_hours,
               escalation_rate, maximum_category_count,
               row_number() OVER (PARTITION BY company_id ORDER BY ticket_count DESC, category) AS position
        FROM shares JOIN (
            SELECT company_id, category,
                   CAST(sum(CAST(resolution_minutes AS DECIMAL(18,6))) AS DOUBLE) AS minutes,
                   avg(CAST(escalated AS INTEGER)) AS escalation_rate
            FROM tickets GROUP BY company_id, category) USING (company_id, category)""",
    "overall": f"""
        SELECT company_id, count(*) AS total_ticket_count,
               {_round("CAST(sum(CAST(resolution_minutes AS DECIMAL(18,6))) AS DOUBLE) / 60", 2)} AS total_handling_hours,
               {_round("avg(CAST(escalated AS INTEGER))", 6)} AS overall_escalation_rate
        FROM tickets GROUP BY company_id""",
    "scored": f"""
        SELECT *, {_round('''least(greatest(100 * (
            CAST(0.30 AS DOUBLE) * (CAST(ticket_count AS DOUBLE) / maximum_category_count)
            + CAST(0.25 AS DOUBLE) * repetitiveness
            + CAST(0.15 AS DOUBLE) * least(greatest(average_resolution_minutes, 0) / 90, 1)
            + CAST(0.15 AS DOUBLE) * (1 - least(greatest(escalation_rate, 0), 1))
            + CAST(0.15 AS DOUBLE) * process_consistency), 0), 100)''', 2)} AS automation_score
        FROM metrics JOIN factors USING (category)""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY automation_score DESC, category) AS rank,
               array_to_string(list_filter([
                   CASE WHEN volume_ratio >= 0.75 THEN 'High volume increases the potential impact'
                        WHEN volume_ratio >= 0.35 THEN 'Moderate volume creates a meaningful opportunity'
                        ELSE 'Lower volume limits the potential impact' END,
                   CASE WHEN repetitiveness >= 0.8 THEN 'the workflow is highly repetitive'
                        WHEN repetitiveness < 0.4 THEN 'limited repetition reduces suitability' END,
                   CASE WHEN average_resolution_minutes >= 60
                        THEN 'long handling time increases potential savings but does not guarantee suitability' END,
                   CASE WHEN escalation_rate >= 0.30 THEN 'a high escalation rate reduces the score'
                        WHEN escalation_rate <= 0.08 THEN 'a low escalation rate supports automation suitability' END,
                   CASE WHEN process_consistency < 0.5 THEN 'an inconsistent process reduces the score'
                        WHEN process_consistency >= 0.8
                        THEN 'a consistent process supports repeatable automation' END],
                   lambda f: f IS NOT NULL), '; ') || '.' AS explanation
        FROM (SELECT *, CAST(ticket_count AS DOUBLE) / maximum_category_count AS volume_ratio FROM scored)""",
    "facts": """
        SELECT company_id, category, rank, explanation, [
            'Ticket count: ' || format('{:,}', ticket_count),
            'Category percentage: ' || printf('%.2f', category_percentage) || '%',
            'Average resolution minutes: ' || printf('%.2f', average_resolution_minutes),
            'Total handling hours: ' || printf('%.2f', total_handling_hours),
            'Escalation rate: ' || printf('%.2f', escalation_rate * 100) || '%',
            'Automation score: ' || printf('%.2f', automation_score) || '/100'] AS lines
        FROM ranked""",
    "companies": """
        SELECT g.company_id AS id, upper(g.company_id[1]) || CASE WHEN g.company_id = 'middle east'
                   THEN 'iddle East' ELSE g.company_id[2:] END AS short_name,
               s.headquarters, coalesce(s.support_team_size, 0) AS support_team_size,
               p.first_day, p.last_day, p.n AS tickets_seen, region_key
        FROM region_ids g
        JOIN (SELECT company_id, CAST(min(created_at) AS DATE) AS first_day,
                     CAST(max(created_at) AS DATE) AS last_day, count(*) AS n
              FROM tickets GROUP BY company_id) p USING (company_id)
        LEFT JOIN (SELECT n_regionkey, count(*) AS support_team_size, min(n_name) AS headquarters
                   FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey) s
             ON n_regionkey = region_key""",
    # One audit per document: its id is the key of all parts.
    "docs": """
        SELECT doc_id AS batch_id, company_id, text, string_split(text, chr(10)) AS l, lang, source
        FROM documents JOIN region_ids ON doc_id % 5 = region_key""",
    "process_docs": f"""
        SELECT batch_id, d.company_id, CASE WHEN batch_id % 59 = 7 THEN '' ELSE {_STRIP.format(x='''array_to_string(list_transform(
                   l, lambda x, i:
                   CASE (i - 1) % 4
                     WHEN 0 THEN '## ' || ['View','Click','Signup','Purchase','Error'][
                            CAST((batch_id + (i - 1) // 4) % 5 + 1 AS INTEGER)]
                            || chr(10) || chr(10) || '- **Manual steps:** ' || x
                     WHEN 1 THEN '- **Systems used:** ' || x
                     WHEN 2 THEN '- **Common exceptions:** ' || x
                     ELSE x END), chr(10))
               || CASE WHEN batch_id % 17 = 0 THEN chr(10) || 'Shared desk with ' || b.company_id ELSE '' END
               || CASE WHEN batch_id % 67 = 3 THEN chr(10) || 'Columns are ticket_id and created_at' ELSE '' END
               || coalesce(chr(10) || 'A ticket says: ' || props, '')''')} END AS text
        FROM docs d JOIN region_ids b ON (batch_id + 1) % 5 = b.region_key
        LEFT JOIN (SELECT event_id, props FROM events WHERE event_id % 61 = 5) ON event_id = batch_id""",
    "doc_lines": """
        SELECT batch_id, company_id, unnest(string_split(text, chr(10))) AS raw,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM process_docs""",
    "rec_base": """
        SELECT 0 AS stage, batch_id, company_id, pos,
               ['view','click','purchase','parking permits','signup','view'][CAST((batch_id + pos * (batch_id % 3 + 1)) % 6 + 1 AS INTEGER)] AS category,
               array_to_string(list_filter(l, lambda x, i: (i - 1) % (batch_id % 4 + 1) = pos), ' ') AS flow
        FROM (SELECT *, unnest(range(batch_id % 4 + 1)) AS pos FROM docs)
        UNION ALL
        SELECT 1, batch_id, company_id, pos,
               ['view','click','purchase','parking permits','signup','view'][CAST((batch_id + 1 + pos * (batch_id % 2)) % 6 + 1 AS INTEGER)],
               array_to_string(list_filter(l, lambda x, i: (i - 1) % (batch_id % 4 + 1) = pos), ' ')
        FROM (SELECT *, unnest(range(batch_id % 4 + 1)) AS pos FROM docs WHERE batch_id % 3 = 0)""",
    "rec_drafts": """
        SELECT r.*, lines,
               CASE WHEN lines IS NULL THEN ['Ticket count: 1', 'Automation score: 50.00/100']
                    WHEN stage = 1 THEN CASE WHEN batch_id % 10 = 0 THEN ['No such line', lines[1]] ELSE [lines[1], lines[6]] END
                    WHEN batch_id % 7 = 0 THEN [lines[1], 'Automation score: 0.01/100']
                    WHEN batch_id % 11 = 0 THEN [lines[6]]
                    ELSE [lines[1], lines[6]] END AS evidence,
               CASE WHEN batch_id % 47 = 0 THEN ''
                    WHEN batch_id % 13 = 0 THEN 'Guaranteed savings' ELSE 'x' END AS benefits,
               CASE WHEN batch_id % 53 = 0 THEN '' WHEN stage = 1 THEN 'Refined: assist with ' || category
                    ELSE 'Assist with ' || category END AS title
        FROM rec_base r LEFT JOIN facts USING (company_id, category)""",
    "rec_own": """
        SELECT *, CASE WHEN lines IS NULL THEN 'unsupported'
                       WHEN len(evidence) < 2 OR len(list_filter(evidence, lambda e: NOT list_contains(lines, e))) > 0
                       THEN 'evidence'
                       WHEN regexp_matches(flow, '[0-9]') THEN 'numeric'
                       WHEN lower(flow) LIKE '%guarantee%' OR lower(benefits) LIKE '%guarantee%' THEN 'guarantee'
                       ELSE 'accepted' END AS own
        FROM rec_drafts WHERE pos < 3""",
    # One step per position; ``seen`` holds the categories accepted so far.
    "rec_all": """
        SELECT stage, batch_id, company_id, category, title, CAST(0 AS BIGINT) AS pos, own AS verdict,
               CASE WHEN own = 'accepted' THEN [category] ELSE CAST([] AS VARCHAR[]) END AS seen
        FROM rec_own WHERE pos = 0
        UNION ALL
        SELECT s.stage, s.batch_id, n.company_id, n.category, n.title, n.pos,
               CASE WHEN n.own <> 'unsupported' AND list_contains(s.seen, n.category) THEN 'duplicate' ELSE n.own END,
               CASE WHEN n.own = 'accepted' THEN list_append(s.seen, n.category) ELSE s.seen END
        FROM rec_all s JOIN rec_own n ON n.stage = s.stage AND n.batch_id = s.batch_id AND n.pos = s.pos + 1""",
    "rec_steps": "SELECT batch_id, pos, company_id, category, title, verdict FROM rec_all WHERE stage = 0",
    "rec_refined": "SELECT batch_id, pos, company_id, category, title, verdict FROM rec_all WHERE stage = 1",
    "question_drafts": f"""
        SELECT batch_id, pos, company_id,
               CASE WHEN batch_id % 41 = 0 THEN 'Q 0' ELSE 'q' || CAST(pos // (1 + batch_id % 2) AS VARCHAR) END AS question_id,
               concat_ws(' ', CASE (batch_id + pos) % 8 WHEN 0 THEN 'What is the average resolution time of this:'
                    WHEN 1 THEN 'Please PROVIDE more information about this:'
                    WHEN 2 THEN 'Which systems are used for this:'
                    ELSE 'Who approves this request:' END,
                    array_to_string(list_filter(l, lambda x, i: (i - 1) % n = pos), ' ')) AS question,
               CASE WHEN (batch_id + pos) % 29 = 0 THEN 'Short' ELSE 'The answer changes the approval path.' END AS rationale,
               CASE WHEN (batch_id + pos) % 9 = 0 THEN [{_CATEGORY.format(n="batch_id + pos")}, 'parking permits']
                    ELSE [{_CATEGORY.format(n="batch_id + pos")}] END AS related,
               CASE WHEN pos % 2 = 0 THEN batch_id % 2 = 0 END AS required
        FROM (SELECT *, batch_id // 2 % 5 AS n, unnest(range(batch_id // 2 % 5)) AS pos FROM docs)""",
    "question_own": r"""
        SELECT *, CASE
            WHEN regexp_matches(lower(question), 'ticket count|how many tickets|category percentage|average resolution|resolution minutes|handling hours|escalation rate|automation score') THEN 'known metric'
            WHEN regexp_matches(lower(question), 'provide more information|what are your business goals') THEN 'vague'
            WHEN regexp_matches(lower(question), 'which systems are used|what systems are used|what are the manual steps|what exception cases|which exceptions are documented') THEN 'documented'
            WHEN len(list_filter(related, lambda r: NOT list_contains(known, r))) > 0 THEN 'unsupported'
            ELSE 'accepted' END AS own
        FROM question_drafts JOIN (SELECT company_id, list(category) AS known FROM shares GROUP BY company_id)
             USING (company_id)
        WHERE pos < 3""",
    "question_steps": """
        SELECT batch_id, company_id, question_id, question, CAST(0 AS BIGINT) AS pos, own AS verdict,
               CASE WHEN own = 'accepted' THEN [question_id] ELSE CAST([] AS VARCHAR[]) END AS seen
        FROM question_own WHERE pos = 0
        UNION ALL
        SELECT s.batch_id, n.company_id, n.question_id, n.question, n.pos,
               CASE WHEN list_contains(s.seen, n.question_id) THEN 'duplicate' ELSE n.own END,
               CASE WHEN n.own = 'accepted' THEN list_append(s.seen, n.question_id) ELSE s.seen END
        FROM question_steps s JOIN question_own n ON n.batch_id = s.batch_id AND n.pos = s.pos + 1""",
    "question_verdicts": """
        SELECT *, CASE verdict
            WHEN 'duplicate' THEN 'Rejected duplicate clarification id: '
            WHEN 'known metric' THEN 'Rejected clarification that requests a canonical metric: '
            WHEN 'vague' THEN 'Rejected vague clarification: '
            WHEN 'documented' THEN 'Rejected clarification that requests documented information: '
            WHEN 'unsupported' THEN 'Rejected clarification with unsupported category: ' END || question_id AS issue
        FROM question_steps""",
    "answers": rf"""
        SELECT batch_id, pos, CASE WHEN n = 3 THEN 'q-other' ELSE 'q' || CAST(n AS VARCHAR) END AS question_id,
               {_STRIP.format(x='''CASE WHEN (batch_id + pos) % 10 = 0 THEN ' ' || chr(9) || ' '
                    WHEN batch_id % 16 = 6 AND n = 0 THEN 'Our Handling Hours are 7.'
                    ELSE '  ' || array_to_string(list_filter(l, lambda x, i: (i - 1) % 4 = pos), ' ') || chr(10) END''')} AS answer
        FROM (SELECT *, CASE WHEN batch_id % 2 = 0 THEN pos ELSE 3 - pos END AS n
              FROM (SELECT *, unnest(range(4)) AS pos FROM docs))""",
    "answer_checks": """
        SELECT a.*, q.question, a.answer <> '' AND q.question IS NOT NULL AS kept,
               a.answer <> '' AND q.question IS NOT NULL AND regexp_matches(a.answer, '[0-9]')
               AND regexp_matches(lower(a.answer), 'ticket count|category percentage|average resolution|resolution minutes|handling hours|escalation rate|automation score') AS contradiction
        FROM answers a LEFT JOIN (SELECT * FROM question_verdicts WHERE verdict = 'accepted') q
             USING (batch_id, question_id)""",
    "answer_verdicts": """
        SELECT batch_id, pos, question_id, answer, question,
               CASE WHEN rejected THEN 'submission rejected' WHEN NOT kept THEN 'dropped' ELSE 'accepted' END AS verdict,
               CASE WHEN rejected THEN 'Stakeholder clarification cannot overwrite canonical audit metrics.' END AS issue,
               CASE WHEN NOT rejected AND kept THEN 'stakeholder-provided clarification' END AS source_label
        FROM (SELECT *, bool_or(contradiction) OVER (PARTITION BY batch_id) AS rejected FROM answer_checks)""",
    "analyses": f"""
        SELECT batch_id, pos, company_id, source, lang, list_filter(l, lambda x, i: (i - 1) % 5 = pos) AS steps,
               CASE WHEN pos = 0 AND batch_id % 12 = 0 THEN 'parking permits'
                    WHEN pos = 0 AND batch_id % 12 = 6 THEN {_CATEGORY.format(n="batch_id + 1")}
                    ELSE {_CATEGORY.format(n="batch_id + pos")} END AS category
        FROM (SELECT *, unnest(range(CASE WHEN batch_id % 13 = 0 THEN 4 ELSE 5 END)) AS pos FROM docs)""",
    "coverage": """
        SELECT coalesce(b.batch_id, NULL) AS batch_id, coalesce(b.company_id, x.company_id) AS company_id,
               coalesce(expected, 0) AS expected, coalesce(entries, 0) AS entries,
               coalesce(covered, 0) AS covered, coalesce(unexpected, 0) AS unexpected,
               coalesce(expected, 0) - coalesce(covered, 0) AS missing,
               coalesce(expected, 0) = coalesce(covered, 0) AND coalesce(unexpected, 0) = 0
               AND coalesce(entries, 0) = coalesce(expected, 0) AS ok
        FROM (SELECT a.batch_id, a.company_id, count(*) AS entries,
                     count(DISTINCT s.category) AS covered,
                     count(DISTINCT CASE WHEN s.category IS NULL THEN a.category END) AS unexpected
              FROM analyses a LEFT JOIN shares s USING (company_id, category)
              GROUP BY a.batch_id, a.company_id) b
        FULL JOIN (SELECT company_id, count(*) AS expected FROM shares GROUP BY company_id) x USING (company_id)""",
    "narratives": """
        SELECT batch_id, CASE WHEN batch_id % 71 = 0 THEN '' ELSE 'Report: ' || text END AS summary, l AS limits,
               'Refined: ' || text AS later_summary, list_transform(l, lambda x: 'Limit: ' || x) AS later_limits
        FROM docs""",
    "reports": f"""
        SELECT n.batch_id, r.batch_id IS NOT NULL AS refined,
               CASE WHEN r.batch_id IS NULL THEN summary ELSE later_summary END AS summary,
               CASE WHEN r.batch_id IS NULL THEN limits ELSE list_concat(later_limits, coalesce(issues, [])) END AS limits
        FROM narratives n
        JOIN (SELECT DISTINCT batch_id FROM rec_steps WHERE verdict = 'accepted') i USING (batch_id)
        LEFT JOIN (SELECT DISTINCT batch_id FROM rec_refined WHERE verdict = 'accepted'
                   AND batch_id NOT IN (SELECT batch_id FROM answer_verdicts WHERE verdict = 'submission rejected')) r USING (batch_id)
        LEFT JOIN (SELECT batch_id, list({_ISSUE_CASE} ORDER BY pos) AS issues
                   FROM rec_refined WHERE verdict <> 'accepted' GROUP BY batch_id) USING (batch_id)
        WHERE summary <> ''""",
    "completeness": r"""
        SELECT *, CAST((NOT evidence)::INT + (NOT process_analysis)::INT + (NOT report)::INT
                       + (NOT clarification_questions)::INT AS INTEGER) AS missing_parts,
               evidence AND process_analysis AND report AND clarification_questions AS ok
        FROM (SELECT batch_id, batch_id % 59 <> 7 AS evidence,
                     batch_id IN (SELECT batch_id FROM coverage WHERE ok AND batch_id IS NOT NULL) AS process_analysis,
                     batch_id IN (SELECT batch_id FROM reports) AS report,
                     batch_id NOT IN (SELECT batch_id FROM question_drafts GROUP BY batch_id HAVING count(*) > 3
                         OR bool_or(NOT regexp_full_match(question_id, '[a-z0-9_-]+') OR length(rationale) < 10)) AS clarification_questions
              FROM docs)""",
    "active_recommendations": """
        SELECT x.* FROM rec_steps x JOIN reports p USING (batch_id) WHERE NOT refined AND verdict = 'accepted'
        UNION ALL
        SELECT x.* FROM rec_refined x JOIN reports p USING (batch_id) WHERE refined AND verdict = 'accepted'""",
    "result_lines": """
        SELECT batch_id, 0 AS part, rank AS major, unnest(range(len(f))) AS place, unnest(f) AS line
        FROM docs JOIN (SELECT company_id, rank,
                     list_append(lines, 'Deterministic ranking — ' || category || ': ' || explanation) AS f FROM facts) USING (company_id)
        UNION ALL
        SELECT batch_id, 1, pos, unnest(range(len(f))), unnest(f) FROM (
            SELECT batch_id, pos, list_concat(
                list_transform(steps, lambda s: 'Process documentation — ' || category || ' — repetitive step: ' || s),
                ['Process documentation — ' || category || ' — system: Desk ' || source,
                 'Process documentation — ' || category || ' — exception: Language ' || lang]) AS f FROM analyses)
        UNION ALL
        SELECT batch_id, 2, pos, unnest([0, 1, 2]), unnest([
            'Verified recommendation — ' || category || ' — title: ' || title,
            'Verified recommendation — ' || category || ' — risk: Wrong routing in ' || category,
            'Verified recommendation — ' || category || ' — human review: An agent confirms each reply'])
        FROM active_recommendations
        UNION ALL
        SELECT batch_id, 3, line_no, 0, 'Process documentation — ' || raw[3:]
        FROM doc_lines WHERE raw LIKE '- **%'""",
    "catalog": """
        SELECT batch_id, line, row_number() OVER (PARTITION BY batch_id ORDER BY o) - 1 AS line_no
        FROM (SELECT batch_id, line, min((part, major, place)) AS o FROM result_lines
              WHERE batch_id IN (SELECT batch_id FROM completeness WHERE ok) GROUP BY batch_id, line)""",
    "chat_answers": f"""
        SELECT a.*, coalesce(lines[1], 'No line') AS line,
               CASE WHEN (batch_id + turn) % 23 = 5 THEN '' ELSE 'What does the evidence say?' END AS question,
               said || CASE kind WHEN 0 THEN ' ' || coalesce(lines[1], 'No line')
                                 WHEN 4 THEN ' That is 42.5% of all.' ELSE '' END
                    || CASE WHEN batch_id % 9 = 0 THEN ' Guaranteed.' ELSE '' END AS answer,
               CASE kind WHEN 1 THEN ['Invented fact']
                    WHEN 0 THEN [coalesce(lines[1], 'No line')] WHEN 4 THEN [coalesce(lines[1], 'No line')]
                    WHEN 2 THEN ['Process documentation — **Manual steps:** ' || a.l[1]]
                    WHEN 5 THEN [coalesce(lines[1], 'No line'), 'Process documentation — **Manual steps:** ' || coalesce(o.l[1], 'none')]
                    WHEN 6 THEN ['Process documentation — ' || {_CATEGORY.format(n="batch_id")} || ' — repetitive step: ' || a.l[1]]
                    ELSE CAST([] AS VARCHAR[]) END AS cited
        FROM (SELECT d.batch_id, d.company_id, d.l, turn, c.text AS said, (conv_id + turn) % 7 AS kind,
                     {_CATEGORY.format(n="conv_id + turn")} AS category
              FROM conversations c JOIN docs d ON conv_id = d.batch_id WHERE role = 'assistant') a
        LEFT JOIN (SELECT batch_id - 5 AS batch_id, l FROM docs) o USING (batch_id)
        LEFT JOIN facts USING (company_id, category)""",
    "last_turns": """
        SELECT conv_id AS batch_id, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS t,
               count(*) FILTER (role = 'assistant' AND turn % 4 = 1) AS detailed
        FROM (SELECT * FROM conversations WHERE role IN ('user', 'assistant')
              QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6)
        GROUP BY conv_id""",
    "accepted_counts": "SELECT batch_id, count(*) AS n FROM rec_steps WHERE verdict = 'accepted' GROUP BY 1",
    "context_figures": """
        SELECT d.batch_id, d.company_id, a.n AS analyses, r.n AS recommendations, md5(r.titles) AS titles_md5,
               md5(coalesce(q.t, '')) AS answers_md5, coalesce(q.n, 0) AS answers, md5(p.summary) AS summary_md5,
               md5(array_to_string(p.limits, chr(10))) AS limitations_md5, coalesce(h.n, 0) AS turns,
               coalesce(h.detailed, 0) AS detailed_turns, md5(coalesce(h.t, '')) AS turns_md5,
               c.n AS catalog_lines, c.m AS catalog_md5
        FROM docs d JOIN (SELECT batch_id FROM completeness WHERE ok) USING (batch_id)
        JOIN reports p USING (batch_id)
        JOIN (SELECT batch_id, count(*) AS n FROM analyses GROUP BY 1) a USING (batch_id)
        JOIN (SELECT batch_id, count(*) AS n, string_agg(title, chr(10) ORDER BY pos) AS titles
              FROM active_recommendations GROUP BY 1) r USING (batch_id)
        LEFT JOIN (SELECT batch_id, count(*) AS n, string_agg(answer, chr(10) ORDER BY pos) AS t
                   FROM answer_verdicts WHERE verdict = 'accepted' GROUP BY 1) q USING (batch_id)
        LEFT JOIN last_turns h USING (batch_id)
        JOIN (SELECT batch_id, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY line_no)) AS m
              FROM catalog GROUP BY batch_id) c USING (batch_id)""",
}


# Columns that Spark types as int where DuckDB gives bigint.
_INTEGERS = {
    "evidence_json": ("rank",),
    "category_metrics": ("position",),
    "channel_counts": ("position",),
    "tier_counts": ("position",),
    "opportunity_ranking": ("rank",),
    "top3_opportunities": ("rank",),
    "remaining_opportunities": ("rank",),
    "score_bands": ("rank",),
    "chart_series": ("pos",),
    "metrics_table": ("position",),
    "evidence_lines": ("rank", "line_no"),
    "evidence_package": ("rank",),
    "process_bullets": ("line_no",),
    "process_sections": ("section_no", "pos"),
    "parse_drafts": ("entries",),
    "numeric_tokens": ("token_no",),
    "report_limitations": ("line_no",),
    "parse_questions": ("entries",),
    "parse_analyses": ("entries",),
    "parse_narratives": ("entries",),
    "evidence_catalog": ("line_no",),
    "chat_context": ("analyses", "recommendations", "answers", "turns", "detailed_turns", "catalog_lines"),
    "stage_payloads": ("categories", "analyses", "recommendations", "answers", "catalog_lines"),
}


def _typed(name: str, final: str) -> str:
    casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in _INTEGERS.get(name, ()))
    return f"SELECT * REPLACE ({casts}) FROM ({final})" if casts else final


def _statement(final: str) -> str:
    """Put the needed common table expressions before ``final``."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in _CTES.items():
            if re.search(rf"\b{name}\b", text) and name not in needed and body is not text:
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(final)
    if not needed:
        return final
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_CTES[n]})" for n in needed) + "\n" + final


_FINAL = {
    # In delimited text an empty cell is a missing one.
    "scan_tickets": "SELECT * EXCLUDE (unreadable) REPLACE (nullif(description, '') AS description) FROM raw_tickets",
    "tickets_csv_roundtrip": "SELECT * FROM tickets",
    "ticket_view": """
        SELECT company_id, count(*) AS ticket_count, min(created_at) AS first_ticket,
               max(created_at) AS last_ticket FROM tickets GROUP BY company_id""",
    "scan_companies": """
        SELECT id, short_name || ' Support Services' AS name, 'Online services' AS industry,
               'Support desk for ' || short_name AS description, headquarters, support_team_size,
               'Monday-Friday, 08:00-18:00' AS support_hours, first_day AS reporting_period_start,
               last_day AS reporting_period_end, 'Derived from benchmark tables.' AS disclaimer,
               CASE WHEN region_key <> 3 THEN tickets_seen END AS ticket_count,
               CASE WHEN region_key % 2 = 1 THEN 'Benchmark' END AS demo_status
        FROM companies""",
    "company_contract": """
        SELECT id AS company_id, CASE WHEN region_key <> 3 THEN tickets_seen ELSE 3000 END AS ticket_count,
               CASE WHEN region_key % 2 = 1 THEN 'Benchmark' ELSE 'Preloaded fictional demo' END AS demo_status,
               array_to_string(list_filter([CASE WHEN headquarters IS NULL THEN 'headquarters missing' END,
                   CASE WHEN support_team_size <= 0 THEN 'support_team_size not positive' END],
                   lambda v: v IS NOT NULL), '; ') AS violations
        FROM companies""",
    "scan_process_docs": "SELECT batch_id, company_id, text, text = '' AS is_empty FROM process_docs",
    "unknown_companies": """
        SELECT company_id, count(*) AS requests
        FROM (SELECT company_id FROM tickets UNION ALL SELECT source FROM documents)
        WHERE company_id NOT IN (SELECT company_id FROM region_ids) GROUP BY company_id""",
    "evidence_json": """
        SELECT company_id, total_ticket_count, rank, category, automation_score,
               array_to_string(lines, '; ') AS facts
        FROM ranked JOIN facts USING (company_id, category, rank) JOIN overall USING (company_id)""",
    "dq_row_violations": """
        SELECT company_id, created_at, description, ticket_id, array_to_string(violations, '; ') AS violations
        FROM judged_tickets WHERE len(violations) > 0""",
    "dq_duplicate_keys": "SELECT * FROM duplicates",
    "dq_unknown_category": """
        SELECT company_id, category, count(*) AS rows FROM raw_tickets
        WHERE category NOT IN (SELECT category FROM factors) GROUP BY company_id, category""",
    "dq_report": """
        SELECT company_id, check_no, "check", findings FROM (
            SELECT company_id, unnest([1, 2, 3, 4, 5, 6]) AS check_no,
                   unnest(['unreadable', 'empty', 'missing values', 'duplicate ticket_id', 'invalid rows',
                           'numeric text column']) AS "check",
                   unnest([coalesce(j.unreadable, 0), CASE WHEN j.n IS NULL THEN 1 ELSE 0 END, coalesce(j.missing, 0),
                           coalesce(d.n, 0), coalesce(j.invalid, 0), coalesce(j.numbers, 0)]) AS findings
            FROM (SELECT company_id FROM region_ids UNION ALL SELECT 'no tickets')
            LEFT JOIN (SELECT company_id, count(*) AS n,
                              count(*) FILTER (len(list_filter(violations, lambda v: v LIKE '%: missing')) > 0) AS missing,
                              count(*) FILTER (len(list_filter(violations, lambda v: v NOT LIKE '%: missing' AND v NOT LIKE 'row:%')) > 0) AS invalid,
                              count(unreadable) AS unreadable,
                              bool_and(coalesce(regexp_full_match(ticket_id, '[0-9.]+'), FALSE))::BIGINT
                              + bool_and(coalesce(regexp_full_match(category, '[0-9.]+'), FALSE))::BIGINT
                              + bool_and(coalesce(regexp_full_match(description, '[0-9.]+'), FALSE))::BIGINT
                              + bool_and(coalesce(regexp_full_match(channel, '[0-9.]+'), FALSE))::BIGINT
                              + bool_and(coalesce(regexp_full_match(customer_tier, '[0-9.]+'), FALSE))::BIGINT AS numbers
                       FROM judged_tickets GROUP BY company_id) j USING (company_id)
            LEFT JOIN (SELECT company_id, CAST(sum(occurrences - 1) AS BIGINT) AS n
                       FROM duplicates GROUP BY company_id) d USING (company_id))""",
    "normalized_tickets": """
        SELECT company_id, ticket_id, t_time AS created_at, category, description,
               t_minutes AS resolution_minutes, t_flag AS escalated, channel, customer_tier
        FROM judged_tickets WHERE len(violations) = 0""",
    "overall_metrics": "SELECT * FROM overall",
    "category_metrics": "SELECT * FROM metrics",
    "category_share": "SELECT * FROM shares",
    "volume_ratio": """
        SELECT company_id, category, CAST(ticket_count AS DOUBLE) / maximum_category_count AS volume_ratio FROM shares""",
    "escalation_rate": "SELECT company_id, category, escalation_rate FROM metrics",
    "channel_counts": """
        SELECT company_id, channel AS value, count(*) AS ticket_count,
               row_number() OVER (PARTITION BY company_id ORDER BY count(*) DESC, channel) AS position
        FROM tickets GROUP BY company_id, channel""",
    "tier_counts": """
        SELECT company_id, customer_tier AS value, count(*) AS ticket_count,
               row_number() OVER (PARTITION BY company_id ORDER BY count(*) DESC, customer_tier) AS position
        FROM tickets GROUP BY company_id, customer_tier""",
    "support_summary": """
        SELECT company_id,
               CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(channel) = 0 THEN 'channel'
                    WHEN grouping(customer_tier) = 0 THEN 'customer_tier' ELSE 'company' END AS level,
               coalesce(category, channel, customer_tier) AS value, count(*) AS ticket_count,
               CAST(sum(CAST(resolution_minutes AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS average_resolution_minutes,
               CAST(sum(CAST(resolution_minutes AS DECIMAL(18,6))) AS DOUBLE) / 60 AS total_handling_hours,
               avg(CAST(escalated AS INTEGER)) AS escalation_rate
        FROM tickets
        GROUP BY GROUPING SETS ((company_id), (company_id, category), (company_id, channel), (company_id, customer_tier))""",
    "registry_audit": "SELECT * FROM overall WHERE company_id IN (SELECT company_id FROM region_ids WHERE region_key % 2 = 0)",
    "score_in_sql": "SELECT company_id, category, automation_score, explanation FROM ranked",
    "factor_join": """
        SELECT company_id, category, count(*) AS ticket_count, any_value(repetitiveness) AS repetitiveness,
               any_value(process_consistency) AS process_consistency,
               bool_or(repetitiveness IS NOT NULL) AS has_factors
        FROM raw_tickets LEFT JOIN factors USING (category) GROUP BY company_id, category""",
    "automation_score": "SELECT company_id, category, automation_score FROM scored",
    "opportunity_ranking": "SELECT company_id, category, ticket_count, automation_score, rank FROM ranked",
    "opportunity_explanations": "SELECT company_id, category, explanation FROM ranked",
    "highest_volume": """
        SELECT company_id, category, ticket_count FROM shares
        QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY ticket_count DESC, category DESC) = 1""",
    "highest_automation": "SELECT company_id, category, automation_score FROM ranked WHERE rank = 1",
    "overview_argmax": """
        SELECT company_id,
               first(category ORDER BY ticket_count DESC, category) AS volume_category,
               max(ticket_count) AS volume_count,
               first(category ORDER BY automation_score DESC, ticket_count DESC, category) AS score_category,
               max(automation_score) AS top_score
        FROM scored GROUP BY company_id""",
    "top3_opportunities": "SELECT company_id, rank, category, automation_score FROM ranked WHERE rank <= 3",
    "remaining_opportunities": "SELECT company_id, rank, category, automation_score FROM ranked WHERE rank > 3",
    "score_bands": f"""
        SELECT company_id, rank, {_title("category")} AS category_title,
               printf('%.1f', automation_score) AS score_text,
               CASE WHEN automation_score >= 75 THEN 'Strong opportunity'
                    WHEN automation_score >= 55 THEN 'Moderate opportunity' ELSE 'Limited opportunity' END AS band,
               'Volume ' || format('{{:,}}', ticket_count) || ' · Avg. resolution '
                   || printf('%.1f', average_resolution_minutes) || ' min · Escalation '
                   || printf('%.1f', escalation_rate * 100) || '%' AS figures,
               explanation[1:len(explanation) - 1] AS rationale
        FROM ranked""",
    "sorted_tickets": "SELECT * FROM tickets ORDER BY created_at, ticket_id",
    "chart_series": f"""
        SELECT company_id, chart, pos, {_title("category")} AS label, value,
               CAST(pos AS DOUBLE) / greatest(n - 1, 1) AS gradient_pos,
               CASE WHEN chart = 'score' THEN CAST(108 AS DOUBLE) ELSE top * CAST(1.22 AS DOUBLE) END AS axis_max
        FROM (SELECT *, row_number() OVER (PARTITION BY company_id, chart ORDER BY value DESC, category) - 1 AS pos,
                     count(*) OVER (PARTITION BY company_id, chart) AS n,
                     max(value) OVER (PARTITION BY company_id, chart) AS top
              FROM (SELECT company_id, category, 'volume' AS chart, CAST(ticket_count AS DOUBLE) AS value FROM scored
                    UNION ALL SELECT company_id, category, 'hours', total_handling_hours FROM scored
                    UNION ALL SELECT company_id, category, 'score', automation_score FROM scored))""",
    "metrics_table": f"""
        SELECT company_id, position, {_title("category")} AS category_title, ticket_count, category_percentage,
               average_resolution_minutes, total_handling_hours, escalation_rate * 100 AS escalation_percentage,
               automation_score
        FROM scored""",
    "headline_cards": f"""
        SELECT company_id, unnest([1, 2, 3, 4, 5]) AS card_no,
               unnest(['Total tickets', 'Handling hours', 'Escalation rate', 'Highest-volume category',
                       'Top automation opportunity']) AS label,
               unnest([format('{{:,}}', total_ticket_count), format('{{:,.1f}}', total_handling_hours),
                       printf('%.1f', overall_escalation_rate * 100) || '%', {_title("vc")}, {_title("sc")}]) AS value,
               unnest(['All recorded tickets', 'Recorded resolution effort', 'Share requiring escalation',
                       format('{{:,}}', vn) || ' tickets', printf('%.1f', sn) || ' out of 100']) AS support
        FROM overall JOIN (
            SELECT company_id, first(category ORDER BY ticket_count DESC, category) AS vc,
                   max(ticket_count) AS vn,
                   first(category ORDER BY automation_score DESC, ticket_count DESC, category) AS sc,
                   max(automation_score) AS sn
            FROM scored GROUP BY company_id) USING (company_id)""",
    "company_caption": """
        SELECT id AS company_id,
               CASE WHEN region_key % 2 = 1 THEN 'Benchmark' ELSE 'Preloaded fictional demo' END
               || ' · Online services · ' || strftime(first_day, '%b %Y') || '–' || strftime(last_day, '%b %Y')
               || ' · ' || format('{:,}', CASE WHEN region_key <> 3 THEN tickets_seen ELSE 3000 END)
               || ' tickets' AS caption
        FROM companies""",
    "evidence_lines": """
        SELECT company_id, category, rank, unnest(range(6)) AS line_no, unnest(lines) AS line FROM facts""",
    "evidence_package": """
        SELECT company_id, rank, category, ticket_count, category_percentage, average_resolution_minutes,
               ranked.total_handling_hours, escalation_rate, automation_score,
               ranked.explanation AS deterministic_explanation,
               array_to_string(lines, '; ') AS allowed_numeric_evidence,
               total_ticket_count, overall.total_handling_hours AS overall_handling_hours, overall_escalation_rate
        FROM ranked JOIN facts USING (company_id, category, rank) JOIN overall USING (company_id)""",
    "evidence_row_free": """
        SELECT batch_id, company_id, found::INTEGER AS markers_found, found = 0 AS row_free
        FROM (SELECT batch_id, company_id, contains(text, 'ticket_id')::INT + contains(text, 'created_at')::INT
                     + contains(text, 'TKT-')::INT
                     + (SELECT count(*) FROM (SELECT DISTINCT props FROM base_events) p WHERE contains(d.text, p.props)) AS found
              FROM process_docs d)""",
    "evidence_isolation": """
        SELECT batch_id, d.company_id, r.company_id AS foreign_id
        FROM process_docs d JOIN region_ids r ON r.company_id <> d.company_id AND contains(d.text, r.company_id)""",
    "evidence_checksum": """
        SELECT batch_id, refined, batch_id % 37 <> 4 AS unchanged
        FROM reports JOIN (SELECT batch_id FROM completeness WHERE ok) USING (batch_id)""",
    "process_bullets": """
        SELECT batch_id, company_id, line_no, 'Process documentation — ' || raw[3:] AS line
        FROM doc_lines WHERE raw LIKE '- **%'""",
    "process_sections": r"""
        SELECT batch_id, company_id, section_no, line_no - head_no AS pos, section,
               regexp_extract(raw, '^- \*\*(.+?):\*\*\s*(.*)$', 1) AS label,
               regexp_extract(raw, '^- \*\*(.+?):\*\*\s*(.*)$', 2) AS text
        FROM (SELECT *, count(*) FILTER (raw LIKE '## %') OVER w - 1 AS section_no,
                     last_value(CASE WHEN raw LIKE '## %' THEN lower(trim(raw[4:])) END IGNORE NULLS) OVER w AS section,
                     last_value(CASE WHEN raw LIKE '## %' THEN line_no END IGNORE NULLS) OVER w AS head_no
              FROM doc_lines WINDOW w AS (PARTITION BY batch_id ORDER BY line_no))
        WHERE regexp_matches(raw, '^- \*\*(.+?):\*\*\s*(.*)$') AND section IS NOT NULL""",
    "evidence_catalog": "SELECT batch_id, line_no, line FROM catalog",
    "read_documents": "SELECT batch_id, text, text = '' AS is_empty FROM process_docs",
    "parse_drafts": """
        SELECT batch_id, CASE WHEN batch_id % 19 = 1 OR batch_id % 23 = 1 OR batch_id % 29 = 1 THEN 'malformed' ELSE 'ok' END AS status,
               CASE WHEN NOT (batch_id % 19 = 1 OR batch_id % 23 = 1 OR batch_id % 29 = 1) THEN count(*) END AS entries
        FROM rec_base WHERE stage = 0 GROUP BY batch_id""",
    "parse_questions": """
        SELECT batch_id, CASE WHEN bad THEN 'malformed' ELSE 'ok' END AS status, CASE WHEN NOT bad THEN n END AS entries
        FROM (SELECT batch_id, coalesce(n, 0) AS n,
                     batch_id % 19 = 1 OR batch_id % 23 = 1 OR (batch_id % 29 = 1 AND n IS NOT NULL) AS bad
              FROM docs LEFT JOIN (SELECT batch_id, count(*) AS n FROM question_drafts GROUP BY 1) USING (batch_id))""",
    "parse_analyses": """
        SELECT batch_id, CASE WHEN batch_id % 19 = 1 OR batch_id % 23 = 1 OR batch_id % 29 = 1 THEN 'malformed' ELSE 'ok' END AS status,
               CASE WHEN NOT (batch_id % 19 = 1 OR batch_id % 23 = 1 OR batch_id % 29 = 1) THEN count(*) END AS entries
        FROM analyses GROUP BY batch_id""",
    "parse_narratives": """
        SELECT batch_id, CASE WHEN batch_id % 19 = 1 OR batch_id % 23 = 1 OR batch_id % 29 = 1 THEN 'malformed' ELSE 'ok' END AS status,
               CASE WHEN NOT (batch_id % 19 = 1 OR batch_id % 23 = 1 OR batch_id % 29 = 1) THEN len(limits) END AS entries
        FROM narratives""",
    "parse_chat_answers": """
        SELECT batch_id, turn, CASE WHEN (batch_id + turn) % 11 = 1 OR (batch_id + turn) % 13 = 1
                                    THEN 'malformed' ELSE 'ok' END AS status FROM chat_answers""",
    "parse_findings": """
        SELECT kind, batch_id, CAST(NULL AS BIGINT) AS turn, '$' AS path, 'OBJECT' AS expected, CAST(NULL AS VARCHAR) AS found
        FROM (SELECT kind, batch_id FROM draft_lists UNION ALL SELECT 'narrative', batch_id FROM narratives) WHERE batch_id % 19 = 1
        UNION ALL SELECT kind, batch_id, NULL, kind, 'ARRAY', NULL FROM draft_lists WHERE batch_id % 23 = 1 AND batch_id % 19 <> 1
        UNION ALL SELECT 'narrative', batch_id, NULL, unnest(['executive_summary', 'limitations']), unnest(['STRING', 'ARRAY']), NULL
                  FROM narratives WHERE batch_id % 23 = 1 AND batch_id % 19 <> 1
        UNION ALL SELECT kind, batch_id, NULL, kind || '[' || i || '].' || first_field, 'STRING', 'ARRAY'
                  FROM (SELECT *, unnest(range(n)) AS i FROM draft_lists) WHERE batch_id % 29 = 1 AND batch_id % 23 <> 1 AND batch_id % 19 <> 1
        UNION ALL SELECT 'narrative', batch_id, NULL, 'executive_summary', 'STRING', 'ARRAY'
                  FROM narratives WHERE batch_id % 29 = 1 AND batch_id % 23 <> 1 AND batch_id % 19 <> 1
        UNION ALL SELECT 'chat answer', batch_id, turn, 'assumptions', 'ARRAY', NULL FROM chat_answers WHERE (batch_id + turn) % 11 = 1
        -- A comma before the end of a list that was empty: no JSON at all.
        UNION ALL SELECT 'chat answer', batch_id, turn, CASE WHEN cited = [] THEN '$' ELSE 'evidence_used[0]' END,
                         CASE WHEN cited = [] THEN 'OBJECT' ELSE 'STRING' END, CASE WHEN cited <> [] THEN 'ARRAY' END
                  FROM chat_answers WHERE (batch_id + turn) % 13 = 1 AND (batch_id + turn) % 11 <> 1""",
    "draft_contract": """
        SELECT batch_id, count(*) AS entries,
               count(*) FILTER (batch_id % 43 = 0 OR batch_id % 47 = 0 OR batch_id % 53 = 0 OR flow = '') AS broken_entries,
               count(*) <= 3 AND count(*) FILTER (batch_id % 43 = 0 OR batch_id % 47 = 0 OR batch_id % 53 = 0 OR flow = '') = 0 AS ok
        FROM rec_base WHERE stage = 0 AND NOT (batch_id % 19 = 1 OR batch_id % 23 = 1 OR batch_id % 29 = 1) GROUP BY batch_id""",
    "question_contract": """
        SELECT batch_id, count(*) AS entries,
               count(*) FILTER (NOT regexp_full_match(question_id, '[a-z0-9_-]+') OR length(rationale) < 10) AS broken_entries,
               count(*) <= 3 AND count(*) FILTER (NOT regexp_full_match(question_id, '[a-z0-9_-]+')
                                                  OR length(rationale) < 10) = 0 AS ok
        FROM question_drafts WHERE NOT (batch_id % 19 = 1 OR batch_id % 23 = 1 OR batch_id % 29 = 1) GROUP BY batch_id""",
    "question_entries": """
        SELECT batch_id, pos, question_id, coalesce(required, FALSE) AS required
        FROM question_drafts WHERE NOT (batch_id % 19 = 1 OR batch_id % 23 = 1 OR batch_id % 29 = 1)""",
    "analysis_contract": """
        SELECT batch_id, count(*) AS entries, count(*) FILTER ((batch_id + pos) % 47 = 0) AS broken_entries,
               count(*) FILTER ((batch_id + pos) % 47 = 0) = 0 AS ok
        FROM analyses WHERE NOT (batch_id % 19 = 1 OR batch_id % 23 = 1 OR batch_id % 29 = 1) GROUP BY batch_id""",
    "narrative_contract": """
        SELECT batch_id, CASE WHEN batch_id % 71 = 0 THEN 'executive_summary' ELSE '' END AS broken
        FROM narratives WHERE NOT (batch_id % 19 = 1 OR batch_id % 23 = 1 OR batch_id % 29 = 1)""",
    "chat_answer_contract": """
        SELECT batch_id, turn, CASE WHEN (batch_id + turn) % 17 = 1 THEN 'answer' ELSE '' END AS broken
        FROM chat_answers WHERE (batch_id + turn) % 11 <> 1 AND (batch_id + turn) % 13 <> 1""",
    "turn_contract": """
        SELECT conv_id, turn, 'role' AS broken FROM conversations WHERE role NOT IN ('user', 'assistant')""",
    "verify_recommendations": "SELECT batch_id, pos, company_id, category, verdict FROM rec_steps",
    "verify_refined": "SELECT batch_id, pos, company_id, category, verdict FROM rec_refined",
    "recommendation_issues": f"""
        SELECT batch_id, company_id, pos, {_ISSUE_CASE} AS issue FROM rec_steps WHERE verdict <> 'accepted'""",
    "batch_gate": """
        SELECT batch_id, count(*) FILTER (verdict = 'accepted') AS accepted,
               count(*) FILTER (verdict <> 'accepted') AS rejected, bool_or(verdict = 'accepted') AS ok
        FROM rec_steps GROUP BY batch_id""",
    "verify_questions": "SELECT batch_id, pos, company_id, question_id, verdict, issue FROM question_verdicts",
    "clarification_answers": "SELECT * FROM answer_verdicts",
    "verify_chat_answers": r"""
        SELECT batch_id, turn, company_id, verdict, CASE verdict
            WHEN 'blank question' THEN 'Chat question must not be empty'
            WHEN 'outside' THEN 'The chat response referenced evidence outside the verified audit context.'
            WHEN 'neither' THEN 'The chat response supplied neither verified evidence nor an explicit information gap.'
            WHEN 'unlabelled' THEN 'The chat response included an assumption without a source label.'
            WHEN 'number' THEN 'The chat response included a numeric claim without canonical evidence.'
            WHEN 'guarantee' THEN 'The chat response claimed an unsupported guarantee.' END AS issue
        FROM (SELECT a.*, CASE
                WHEN question = '' THEN 'blank question'
                WHEN EXISTS (SELECT 1 FROM (SELECT unnest(a.cited) AS l) WHERE l NOT IN
                             (SELECT c.line FROM catalog c WHERE c.batch_id = a.batch_id)) THEN 'outside'
                WHEN len(cited) = 0 AND NOT (kind = 3 AND batch_id % 4 < 3) THEN 'neither'
                WHEN kind = 3 AND batch_id % 2 = 0 THEN 'unlabelled'
                WHEN len(list_filter(regexp_extract_all(answer, '\d[\d,]*(?:\.\d+)?%?(?:/\d+)?'),
                         lambda t: NOT contains(array_to_string(cited, ' '), t))) > 0 THEN 'number'
                WHEN contains(lower(answer), 'guarantee') THEN 'guarantee'
                ELSE 'accepted' END AS verdict
              FROM chat_answers a JOIN (SELECT batch_id FROM completeness WHERE ok) USING (batch_id))""",
    "numeric_tokens": r"""
        SELECT doc_id, unnest(range(len(t))) AS token_no, unnest(t) AS token
        FROM (SELECT doc_id, regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?%?(?:/\d+)?') AS t FROM documents)""",
    "bounded_history": """
        SELECT conv_id, turn, role, text AS content FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6""",
    "process_coverage": "SELECT * FROM coverage",
    "report_limitations": """
        SELECT batch_id, refined, unnest(range(len(limits))) AS line_no, unnest(limits) AS line
        FROM reports JOIN (SELECT batch_id FROM completeness WHERE ok) USING (batch_id)""",
    "staged_issues": f"""
        SELECT batch_id, 1 AS stage_no, 'recommendations' AS stage, pos, {_ISSUE_CASE} AS issue
        FROM rec_steps WHERE verdict <> 'accepted'
        UNION ALL
        SELECT batch_id, 2, 'questions', pos, issue FROM question_verdicts WHERE issue IS NOT NULL""",
    "result_complete": "SELECT * FROM completeness",
    "chat_context": "SELECT * FROM context_figures",
    # Each stage with the batches that reach it, and the figures of the parts in its payload.
    "stage_payloads": """
        SELECT batch_id, company_id, stage_no, stage, turn, CASE WHEN stage_no <> 3 THEN 5 END AS categories,
               CASE WHEN stage_no NOT IN (2, 3) THEN md5(text) END AS documentation_md5,
               CASE WHEN stage_no NOT IN (1, 3) THEN analyses END AS analyses,
               CASE WHEN stage_no > 2 THEN recommendations END AS recommendations,
               CASE WHEN stage_no > 3 THEN md5(summary) END AS summary_md5,
               CASE WHEN stage_no > 4 THEN answers END AS answers,
               CASE WHEN stage_no = 6 THEN catalog_lines END AS catalog_lines,
               CASE WHEN stage_no = 6 THEN question END AS user_question, TRUE AS has_rules
        FROM (
            SELECT 1 AS stage_no, 'process analysis' AS stage, NULL::BIGINT AS turn, NULL AS question, batch_id,
                   NULL AS recommendations, NULL AS summary, NULL AS answers, NULL AS catalog_lines
            FROM completeness WHERE evidence
            UNION ALL
            SELECT 2, 'recommendations', NULL, NULL, batch_id, NULL, NULL, NULL, NULL
            FROM completeness WHERE evidence AND process_analysis
            UNION ALL
            SELECT 3, 'executive report', NULL, NULL, batch_id, n, NULL, NULL, NULL
            FROM completeness JOIN accepted_counts USING (batch_id) WHERE evidence AND process_analysis
            UNION ALL
            SELECT 4, 'clarification questions', NULL, NULL, batch_id, n, n.summary, NULL, NULL
            FROM completeness JOIN accepted_counts USING (batch_id) JOIN narratives n USING (batch_id)
            WHERE evidence AND process_analysis AND report
            UNION ALL
            SELECT 5, 'refinement', NULL, NULL, batch_id, a.n, n.summary, f.answers, NULL
            FROM context_figures f JOIN accepted_counts a USING (batch_id) JOIN narratives n USING (batch_id)
            WHERE f.answers > 0
            UNION ALL
            SELECT 6, 'chat', turn, question, batch_id, f.recommendations, p.summary, f.answers, f.catalog_lines
            FROM context_figures f JOIN reports p USING (batch_id)
            JOIN (SELECT batch_id, turn, question FROM chat_answers WHERE question <> '') USING (batch_id))
        JOIN (SELECT batch_id, company_id, text FROM process_docs) USING (batch_id)
        LEFT JOIN (SELECT batch_id, count(*) AS analyses FROM analyses GROUP BY 1) USING (batch_id)""",
}

_FINAL["ticket_file_findings"] = """
    SELECT company_id, CASE WHEN region_key = 2 THEN 'wrong header' ELSE 'ok' END AS verdict,
           CASE WHEN region_key = 2 THEN 'missing channel' ELSE '' END AS detail, 1::BIGINT AS files,
           CASE WHEN region_key = 2 THEN 0 ELSE n END AS tickets
    FROM region_ids JOIN (SELECT company_id, count(*) AS n FROM raw_tickets GROUP BY company_id) USING (company_id)
    UNION ALL SELECT company_id, 'cut', 'the last row lacks cells', 1, 0 FROM region_ids WHERE region_key = 3
    UNION ALL SELECT company_id, 'empty', 'no content', 1, 0 FROM region_ids WHERE region_key = 4"""
_FINAL["ticket_intake"] = f"""
    SELECT * FROM ({_FINAL["dq_report"]}) WHERE company_id <> 'no tickets'
    UNION ALL
    SELECT company_id, CASE WHEN len(violations) = 0 THEN 7 ELSE 8 END,
           CASE WHEN len(violations) = 0 THEN 'kept' ELSE 'set aside' END, count(*)
    FROM judged_tickets GROUP BY company_id, len(violations) = 0
    UNION ALL
    SELECT 'all companies', 9, unnest(['rows', 'set_aside', 'unreadable', 'missing', 'invalid']),
           unnest([count(*), count(*) FILTER (len(violations) > 0), count(unreadable),
                   count(*) FILTER (len(list_filter(violations, lambda v: v LIKE '%: missing')) > 0),
                   count(*) FILTER (len(list_filter(violations, lambda v: v NOT LIKE '%: missing' AND v NOT LIKE 'row:%')) > 0)])
    FROM judged_tickets"""
_FINAL["evidence_changes"] = """
    SELECT batch_id, 'process_documentation' AS part, 'line ' || len(string_split(text, chr(10))) AS name, 'added' AS change
    FROM process_docs WHERE batch_id % 37 = 4
    UNION ALL SELECT batch_id, 'process_documentation', 'line 0', 'changed' FROM process_docs WHERE batch_id % 41 = 3
    UNION ALL SELECT batch_id, 'categories', 'view', 'changed' FROM process_docs WHERE company_id = 'asia'"""
# The maintained audit ends where the audit of all tickets at once does.
_FINAL["maintained_audit"] = _FINAL["support_summary"]

ORACLES: dict[str, str] = {name: _statement(_typed(name, sql)) for name, sql in _FINAL.items()}
