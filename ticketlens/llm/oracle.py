"""DuckDB statements for the registered operators that SQL can express.

They follow the definitions, not the jobs: recursion, rows per window, rows per bit.
"""

from __future__ import annotations

from ticketlens.llm import centroids, license_scan, mixing, quality_rules, queries, secrets, sharding

_SPACES = "[\\x20\\x09-\\x0D]+"
_WORD = "[^\\x20\\x09-\\x0D]"


def _weights(name: str, given: dict[str, int]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in given.items())
    return f"CASE {name} {cases} ELSE 1 END" if cases else "1"


def _quality_rules() -> str:
    rules = quality_rules.RULES
    values = " UNION ALL ".join(
        f"SELECT rid, lang, source, base_failed, '{r.name}' AS rule, CAST({r.value.replace(' DIV ', ' // ')} AS BIGINT) AS value FROM counted"
        for r in rules
    )
    tail = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN {r.tail}" for r in rules) + " END"
    reach = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN {r.reach}" for r in rules) + " END"
    low = ", ".join(f"'{r.name}'" for r in rules if r.low)
    prior = quality_rules.PRIOR * quality_rules.UNIT
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), parts AS (
  SELECT *, list_filter(regexp_split_to_array(text, '{_SPACES}'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM texts
), starts AS (
  SELECT rid, unnest(range(1, len(words) - 6)) AS pos,
         unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS eight
  FROM parts WHERE len(words) >= 8
), windows AS (
  SELECT rid, pos, count(*) OVER (PARTITION BY rid, eight) AS times FROM starts
), covered AS (
  SELECT rid, sum(n) AS n_repeat_words FROM (
    SELECT rid, least(8, pos - lag(pos, 1, pos - 8) OVER (PARTITION BY rid ORDER BY pos)) AS n FROM windows WHERE times > 1
  ) GROUP BY rid
), counts AS (
  SELECT rid, doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
         length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS n_capitals,
         length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM parts LEFT JOIN covered USING (rid)
), counted AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
), measured AS ({values}
), binned AS (
  SELECT *, (value >> greatest(length(bin(value)) - 7, 0)::BIGINT) << greatest(length(bin(value)) - 7, 0)::BIGINT AS bucket
  FROM measured WHERE NOT base_failed
), own AS (
  SELECT lang, source, rule, bucket, count(*) AS n FROM binned GROUP BY ALL
), by_lang AS (
  SELECT lang, rule, bucket, {prior} * n // sum(n) OVER (PARTITION BY lang, rule) AS weight
  FROM (SELECT lang, rule, bucket, sum(n) AS n FROM own GROUP BY ALL)
), by_rule AS (
  SELECT rule, bucket, {prior} * n // sum(n) OVER (PARTITION BY rule) AS weight
  FROM (SELECT rule, bucket, sum(n) AS n FROM own GROUP BY ALL)
), names AS (
  SELECT DISTINCT lang, source, rule FROM own
), blended AS (
  SELECT lang, source, rule, bucket, sum(weight) AS weight FROM (
    SELECT lang, source, rule, bucket, {quality_rules.UNIT} * n AS weight FROM own
    UNION ALL SELECT n.lang, n.source, n.rule, bucket, weight FROM names n JOIN by_lang b ON n.lang IS NOT DISTINCT FROM b.lang AND n.rule = b.rule
    UNION ALL SELECT lang, source, n.rule, bucket, weight FROM names n JOIN by_rule b ON n.rule = b.rule
  ) GROUP BY ALL
), ranked AS (
  SELECT *, {tail} AS tail, sum(weight) OVER (PARTITION BY lang, source, rule ORDER BY bucket) AS upto,
         sum(weight) OVER (PARTITION BY lang, source, rule) AS total
  FROM blended
), quantiles AS (
  SELECT lang, source, rule, {reach} AS reach,
         min(bucket) FILTER (upto * 1000 >= total * (1000 - tail)) AS bottom,
         min(bucket) FILTER (upto * 2 >= total) AS middle,
         min(bucket) FILTER (upto * 1000 >= total * tail) AS top
  FROM ranked GROUP BY lang, source, rule
), fences AS (
  SELECT lang, source, rule, CASE WHEN rule IN ({low}) THEN bottom - reach * (middle - bottom) - {quality_rules.SLACK} ELSE 0 END AS low,
         top + reach * (top - middle) + {quality_rules.SLACK} AS high
  FROM quantiles
), judged AS (
  SELECT m.rid, m.value < f.low OR m.value > f.high AS broken
  FROM measured m JOIN fences f ON m.rule = f.rule AND m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
), verdicts AS (SELECT rid, bool_or(broken) AS broken FROM judged GROUP BY rid)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(broken, FALSE) AS kept
FROM counted LEFT JOIN verdicts USING (rid)"""


def _placed(kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one pattern: the pieces between matches give the places."""
    return f"""
  SELECT rid, '{kind}' AS kind, start, stop FROM (
    SELECT rid, i, length(array_to_string(gaps[1:i], '')) + length(array_to_string(whole[1:i - 1], '')) AS start,
           length(array_to_string(gaps[1:i], '')) + length(array_to_string(whole[1:i], '')) AS stop, part[i] AS part
    FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
      SELECT rid, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS whole,
             regexp_extract_all(text, '{pattern}', {group}) AS part
      FROM texts WHERE regexp_matches(text, '{pattern}')))
  ) WHERE length(part) >= {least}"""


def _secrets() -> str:
    quoted = secrets.ASSIGN.replace("'", "''")
    base = " UNION ALL ".join(
        (
            _placed("assign", quoted, 1, secrets.ASSIGN_LEAST),
            _placed("access", "AKIA[A-Z0-9]+", 0, 20),
            _placed("hex", "[0-9a-f]+", 0, 24),
        )
    )
    steps = []
    for i, c in enumerate(secrets.CLASSES):
        run = f"{c.run}{{{c.least},}}"
        needs = " AND ".join(f"regexp_matches(candidate, '{n}')" for n in c.needs)
        allowed = " OR ".join(f"regexp_matches(candidate, '{a}')" for a in secrets.ALLOWED_WHOLE)
        steps.append(f"""candidates{i} AS (
  SELECT rid, start, substr(text, start + 1, stop - start) AS candidate FROM ({_placed("entropy", run, 0, c.least)})
  JOIN texts USING (rid)
), cut{i} AS (
  SELECT rid, start, regexp_split_to_array(candidate, '{secrets.ALLOWED_PART}') AS parts,
         regexp_extract_all(candidate, '{secrets.ALLOWED_PART}') AS between
  FROM candidates{i} WHERE ({needs}) AND NOT ({allowed})
), pieces{i} AS (
  SELECT rid, start + length(array_to_string(parts[1:k - 1], '')) + length(array_to_string(between[1:k - 1], '')) AS start, parts[k] AS candidate
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM cut{i})
), windows{i} AS (
  SELECT rid, start, candidate, unnest(range(0, length(candidate) - {c.window} + 1)) AS pos FROM pieces{i}
), sums{i} AS (
  SELECT rid, start, pos, sum(CAST(round({secrets.SCALE} * n * log2(n)) AS BIGINT)) AS total FROM (
    SELECT rid, start, pos, letter, count(*) AS n FROM (
      SELECT rid, start, pos, unnest(string_split(substr(candidate, pos + 1, {c.window}), '')) AS letter FROM windows{i}
    ) GROUP BY ALL
  ) GROUP BY rid, start, pos
), merged{i} AS (
  SELECT rid, 'entropy' AS kind, start + min(pos) AS start, start + max(pos) + {c.window} AS stop FROM (
    SELECT *, sum(opens) OVER (PARTITION BY rid, start ORDER BY pos) AS island FROM (
      SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY rid, start ORDER BY pos) <= {c.window} THEN 0 ELSE 1 END AS opens
      FROM sums{i} WHERE total <= {c.most()}
    )
  ) GROUP BY rid, start, island
)""")
    swept = " UNION ".join(f"SELECT * FROM merged{i}" for i in range(len(secrets.CLASSES)))
    steps.append(f"""found AS (
  SELECT * FROM base UNION ALL
  SELECT m.* FROM ({swept}) m WHERE NOT EXISTS (
    SELECT 1 FROM base b WHERE b.rid = m.rid AND b.start <= m.start AND b.stop >= m.stop)
)""")
    order = "start, list_position(['assign', 'access', 'hex', 'entropy'], kind), stop"
    named = "kind || ':' || start || ':' || stop"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({base}),
{", ".join(steps)}, listed AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg({named}, ',' ORDER BY {order}) FILTER (kind <> 'entropy') AS base,
         string_agg({named}, ',' ORDER BY {order}) AS spans
  FROM found GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (rid)"""


def _sharding() -> str:
    return f"""
WITH RECURSIVE bits AS (
  SELECT byte, list_reduce(list_prepend(byte, range(0, 8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS value
  FROM range(0, 256) r(byte)
), checks AS (SELECT list(value ORDER BY byte) AS table_of FROM bits),
texts AS (
  SELECT row_number() OVER () AS rid, doc_id, strlen(coalesce(text, '')) + 1 AS size,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT)),
             lambda c, b: xor(c >> 8, table_of[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, checks
), walk(rid, state, pos) AS (
  SELECT rid, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616, 0::BIGINT FROM texts
  UNION ALL
  SELECT rid, state, CAST(floor((pos + 1)::DOUBLE * (2147483648::DOUBLE / ((state // 8589934592) + 1)::DOUBLE)) AS BIGINT) FROM (
    SELECT rid, (state * {sharding.MULTIPLIER}::HUGEINT + 1) % 18446744073709551616 AS state, pos FROM walk WHERE pos <= {queries.SHARDS}
  )
), places AS (
  SELECT rid, max(pos) FILTER (pos < {queries.SHARDS}) AS shard, max(pos) FILTER (pos <= {queries.SHARDS}) AS grown FROM walk GROUP BY rid
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       grown::INTEGER AS grown_shard
FROM texts JOIN places USING (rid)"""


def _mixing() -> str:
    def name(level: str) -> str:
        return f"""'"{level}":' || coalesce('"' || {level} || '"', 'null')"""

    number = "try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) AS INTEGER)"
    domains = "[" + ", ".join(f"'{d}'" for d in queries.DOMAINS) + "]"

    def level(into: str, nodes: str, family: str, node: str) -> str:
        # The level pos which a family's budget is used up is found by filling its nodes one after another.
        return f"""{into}_order AS (
  SELECT *, row_number() OVER (PARTITION BY {family} ORDER BY capacity::DOUBLE / weight::DOUBLE, {node}) AS turn,
         sum(weight) OVER (PARTITION BY {family}) AS weights
  FROM {nodes} WHERE weight > 0
), {into}_steps AS (
  SELECT *, coalesce(sum(capacity) OVER (PARTITION BY {family} ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS below,
         sum(weight) OVER (PARTITION BY {family} ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS above
  FROM {into}_order
), {into}_full AS (
  SELECT *, below * weight + capacity::HUGEINT * above <= given::HUGEINT * weight AS is_full FROM {into}_steps
), {into}_rest AS (
  SELECT *, given - coalesce(sum(CASE WHEN is_full THEN capacity END) OVER (PARTITION BY {family}), 0)::HUGEINT AS rest,
         sum(CASE WHEN NOT is_full THEN weight END) OVER (PARTITION BY {family})::HUGEINT AS open
  FROM {into}_full
), {into}_part AS (
  SELECT *, CASE WHEN is_full THEN capacity::HUGEINT ELSE rest * weight // open END AS part,
         CASE WHEN is_full THEN -1::HUGEINT ELSE rest * weight % open END AS fraction
  FROM {into}_rest
), {into} AS (
  SELECT *, (part + CASE WHEN NOT is_full AND
      row_number() OVER (PARTITION BY {family} ORDER BY fraction DESC, {node})
      <= rest - coalesce(sum(CASE WHEN NOT is_full THEN part END) OVER (PARTITION BY {family}), 0)
    THEN 1 ELSE 0 END)::BIGINT AS budget
  FROM {into}_part
)"""

    tree = ", ".join(
        (
            "domain_nodes AS (SELECT in_domain, sum(capacity)::BIGINT AS capacity, max(weight_domain) AS weight,"
            " (SELECT least(sum(capacity), sum(tokens)) FROM leaves)::BIGINT AS given, 0 AS root FROM leaves GROUP BY in_domain)",
            level("domain_level", "domain_nodes", "root", "in_domain"),
            "lang_nodes AS (SELECT l.in_domain, in_lang, sum(l.capacity)::BIGINT AS capacity, max(weight_lang) AS weight, any_value(budget) AS given"
            " FROM leaves l JOIN domain_level d USING (in_domain) GROUP BY l.in_domain, in_lang)",
            level("lang_level", "lang_nodes", "in_domain", "in_lang"),
            "source_nodes AS (SELECT l.in_lang, leaf, tokens, l.capacity, weight_source AS weight, budget AS given"
            " FROM leaves l JOIN lang_level USING (in_lang))",
            level("source_level", "source_nodes", "in_lang", "leaf"),
        )
    )
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source,
         coalesce({domains}[{number} % {len(queries.DOMAINS)} + 1], 'other') AS domain,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACES}'), lambda x: x <> '')) + 1 AS tokens
  FROM documents
), named AS (
  SELECT *, '{{' || {name('domain')} || '}}' AS in_domain, '{{' || {name('domain')} || ',' || {name('lang')} || '}}' AS in_lang,
         '{{' || {name('domain')} || ',' || {name('lang')} || ',' || {name('source')} || '}}' AS leaf,
         {_weights('domain', queries.DOMAIN_WEIGHTS)} AS weight_domain, {_weights('lang', queries.LANG_WEIGHTS)} AS weight_lang,
         {_weights('source', queries.SOURCE_WEIGHTS)} AS weight_source
  FROM texts
), leaves AS (
  SELECT in_domain, in_lang, leaf, weight_domain, weight_lang, weight_source, sum(tokens)::BIGINT AS tokens,
         (sum(tokens) * {mixing.EPOCHS})::BIGINT AS capacity
  FROM named GROUP BY ALL
), {tree}, plan AS (
  SELECT leaf, coalesce(budget, 0) AS budget, coalesce(budget, 0) // tokens AS epochs, coalesce(budget, 0) % tokens AS rest
  FROM (SELECT l.leaf, l.tokens, s.budget FROM leaves l LEFT JOIN source_level s USING (leaf))
), drawn AS (
  SELECT n.*, budget, epochs, rest, md5('{mixing.SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM named n JOIN plan USING (leaf)
), ids AS (
  SELECT leaf, draw, coalesce(sum(sum(tokens)) OVER (PARTITION BY leaf ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM drawn GROUP BY leaf, draw
)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, budget AS leaf_budget,
       epochs + CASE WHEN start < rest THEN 1 ELSE 0 END AS copies
FROM drawn JOIN ids USING (leaf, draw)"""


def _centroids() -> str:
    """Every round computes all distances from scratch."""
    whole = f"list_transform(embedding, lambda c: CAST(floor({centroids.SCALE} * CAST(c AS DOUBLE)) AS BIGINT))"
    parts = []
    for at in range(centroids.ROUNDS + 1):
        parts.append(f"""near{at} AS MATERIALIZED (
  SELECT rid, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM (
    SELECT v.rid, m.c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS distance FROM cells v JOIN centres{at} m USING (j) GROUP BY v.rid, m.c
  ) GROUP BY rid
)""")
        if at < centroids.ROUNDS:
            parts.append(f"""centres{at + 1} AS MATERIALIZED (
  SELECT c, j, coalesce(f.x, m.x) AS x FROM centres{at} m LEFT JOIN (
    SELECT n.c, v.j, CAST((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
    FROM near{at} n JOIN cells v USING (rid) GROUP BY n.c, v.j
  ) f USING (c, j)
)""")
    last = centroids.ROUNDS
    return f"""
WITH fit AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, {whole} AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), cells AS MATERIALIZED (
  SELECT rid, unnest(range(1, 65)) AS j, unnest(x) AS x FROM fit
), chosen AS (
  SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x FROM fit
), centres0 AS MATERIALIZED (
  SELECT c, unnest(range(1, 65)) AS j, unnest(x) AS x FROM chosen WHERE c < {centroids.CLUSTERS}
), {", ".join(parts)}, names AS (
  SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM centres{last} GROUP BY c
)
SELECT vec_id, c::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM near{last} JOIN fit USING (rid) JOIN names USING (c)"""


def _licenses() -> str:
    def rows(values: list[tuple]) -> str:
        return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in values)

    cut = "list_filter(regexp_split_to_array(translate({}, '" + license_scan.UPPER + "', '" + license_scan.LOWER + "'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    run = license_scan.RUN
    templates = rows([(i, t.label, t.least, t.text) for i, t in enumerate(license_scan.TEMPLATES)])
    return f"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, {cut.format("coalesce(text, '')")} AS words FROM documents
), phrases AS (
  SELECT label, string_split(phrase, ' ') AS p FROM (VALUES {rows([(v, k) for k, v in license_scan.PHRASES.items()])}) t(label, phrase)
), places AS (
  SELECT rid, label, unnest(list_filter(range(0, len(words)), lambda i: words[i + 1:i + len(p)] = p)) AS place FROM texts, phrases
), base AS (
  SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
         list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY rid
), templates AS MATERIALIZED (
  SELECT tid, label, least, {cut.format("body")} AS words FROM (VALUES {templates}) t(tid, label, least, body)
), template_runs AS (
  SELECT tid, unnest(range(0, len(words) - {run - 1})) AS t,
         unnest(list_transform(range(0, len(words) - {run - 1}), lambda i: array_to_string(words[i + 1:i + {run}], ' '))) AS run FROM templates
), text_runs AS (
  SELECT rid, unnest(range(0, len(words) - {run - 1})) AS p,
         unnest(list_transform(range(0, len(words) - {run - 1}), lambda i: array_to_string(words[i + 1:i + {run}], ' '))) AS run
  FROM texts WHERE len(words) >= {run}
), votes AS MATERIALIZED (
  SELECT rid, tid, t, p - t AS diagonal FROM text_runs JOIN template_runs USING (run)
), diagonals AS (
  SELECT *, coalesce(diagonal - lag(diagonal) OVER w > {license_scan.GAP}, FALSE)::INTEGER AS new
  FROM (SELECT DISTINCT rid, tid, diagonal FROM votes) WINDOW w AS (PARTITION BY rid, tid ORDER BY diagonal)
), candidates AS (
  SELECT *, sum(new) OVER (PARTITION BY rid, tid ORDER BY diagonal) AS candidate FROM diagonals
), covered AS (
  SELECT rid, tid, candidate, t + k AS t, min(diagonal) AS diagonal
  FROM votes JOIN candidates USING (rid, tid, diagonal), (SELECT unnest(range(0, {run})) AS k) GROUP BY ALL
), spans AS (
  SELECT rid, tid, candidate, count(*) AS n, max(t + diagonal) - min(t + diagonal) + 1 AS long FROM covered GROUP BY ALL
), stands AS (
  SELECT rid, label, n::DOUBLE / greatest(len(words), long)::DOUBLE AS similarity
  FROM spans JOIN templates USING (tid) WHERE n::DOUBLE / greatest(len(words), long)::DOUBLE >= least
), found AS (
  SELECT rid, list(label) AS labels, max(similarity) AS similarity FROM stands GROUP BY rid
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(similarity, 0.0) END::DOUBLE AS score
FROM texts LEFT JOIN base b USING (rid) LEFT JOIN found f USING (rid)"""


ORACLES: dict[str, str] = {
    "op1_quality_rules": _quality_rules(),
    "op4_secrets": _secrets(),
    "op6_sharding": _sharding(),
    "op8_mixing": _mixing(),
    "op12_centroids": _centroids(),
    "op13_licenses": _licenses(),
}
