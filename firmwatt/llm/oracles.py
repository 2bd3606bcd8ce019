"""DuckDB SQL of the queries that SQL can express, with its own literals."""

from __future__ import annotations

OP3 = r"""
WITH words AS (
    SELECT doc_id, lang, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
    SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
    FROM words, unnest(range(1, len(w) - 1)) AS t(i)
), twice AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), repeats AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, unnest([0, 1, 2]) AS t(k) GROUP BY doc_id
), lines AS (
    SELECT doc_id, count(*) AS n_lines, count(DISTINCT l) AS n_distinct
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), s AS (
    SELECT doc_id, lang AS stratum, len(w) AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_lines - n_distinct, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines, length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS n_caps
    FROM words LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id)
), judged AS (
    SELECT doc_id, stratum, unnest([
        {'rule': 'symbols', 'value': CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END},
        {'rule': 'dup_lines', 'value': CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END},
        {'rule': 'repeats', 'value': CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END},
        {'rule': 'caps', 'value': CASE WHEN word_chars > 0 THEN n_caps * 1000 // word_chars ELSE 0 END},
        {'rule': 'long_words', 'value': CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END - 5000},
        {'rule': 'short_words', 'value': 5000 - CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END}
    ], recursive := true) FROM s
), good AS (
    SELECT j.* FROM judged j JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id)
), grid AS (
    SELECT DISTINCT floor(10 * pow(2, k / 4.0))::BIGINT AS cutoff FROM range(45) AS t(k)
), counted AS (
    SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (WHERE value >= cutoff) AS k
    FROM good, grid GROUP BY ALL
), tail AS (
    SELECT stratum, rule, cutoff, sum(exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END
        - CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1) END + i * ln(0.05 / 6) + (n - i) * ln(1 - 0.05 / 6))) AS p
    FROM counted, unnest(range(0, k + 1)) AS t(i) GROUP BY ALL
), chosen AS (
    SELECT stratum, rule, min(cutoff) AS cutoff FROM tail
    WHERE p <= 0.05 / (6 * (SELECT count(DISTINCT coalesce(stratum, '?')) FROM good)) GROUP BY ALL
), bad AS (
    SELECT DISTINCT doc_id FROM judged j JOIN chosen c
    ON j.rule = c.rule AND j.stratum IS NOT DISTINCT FROM c.stratum AND j.value >= c.cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM s
"""

OP6 = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number
    FROM sized GROUP BY source
), weighted AS (
    SELECT *, [3, 1, 2][(number % 3 + 1)::INT] AS weight, sum(source_size) OVER () AS everything FROM sources
), levels AS (
    SELECT *, (1.5 * everything - coalesce(sum(2 * source_size) OVER b, 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
    FROM weighted
    WINDOW b AS (ORDER BY source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stopped AS (
    SELECT *, level * weight >= 2 * source_size AS stops,
        max(CASE WHEN level * weight < 2 * source_size THEN level END) OVER () AS common
    FROM levels
), targets AS (
    SELECT source, number, source_size, round(1.5 * everything / 16)::BIGINT AS blocks,
        CASE WHEN stops OR common IS NULL THEN 2.0 * source_size ELSE common * weight END::DOUBLE AS target
    FROM stopped
), source_seats AS (
    SELECT number, count(*) AS quota FROM (
        SELECT number, blocks, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, number) AS r
        FROM targets, unnest(range(0, blocks)) AS t(i) WHERE target > 0
    ) WHERE r <= blocks GROUP BY number
), ruled AS (
    SELECT t.*, coalesce(quota, 0) AS quota, greatest(1, ceil(source_size / 1000000))::BIGINT AS shards
    FROM targets t LEFT JOIN source_seats USING (number)
), placed AS (
    SELECT doc_id, size, number, source_size, target, quota,
        ('0x' || substr(md5('mix-1/shard:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % shards AS shard,
        md5('mix-1/order:' || coalesce(doc_id::VARCHAR, 'null')) AS place
    FROM sized s JOIN ruled r ON s.source IS NOT DISTINCT FROM r.source
), shards AS (
    SELECT number, shard, sum(size)::BIGINT AS words, any_value(quota) AS quota, ceil(sum(size) / 16)::BIGINT AS row_blocks
    FROM placed GROUP BY ALL
), shard_seats AS (
    SELECT number, shard, count(*) AS seats FROM (
        SELECT number, shard, quota,
            row_number() OVER (PARTITION BY number ORDER BY words / (2 * i + 1) DESC, shard) AS r
        FROM shards, unnest(range(0, quota)) AS t(i) WHERE words > 0
    ) WHERE r <= quota GROUP BY ALL
), runs AS (
    SELECT number, shard, words, row_blocks, least(coalesce(seats, 0), 2 * row_blocks) AS seats,
        ('0x' || substr(md5('mix-1/start:' || number || ':' || shard), 1, 8))::BIGINT % greatest(1, row_blocks) AS first
    FROM shards LEFT JOIN shard_seats USING (number, shard)
), lined AS (
    SELECT p.*, words, row_blocks, first, CASE WHEN row_blocks > 0 THEN seats // row_blocks ELSE 0 END AS times,
        CASE WHEN row_blocks > 0 THEN seats % row_blocks ELSE 0 END AS extra,
        coalesce(sum(size) OVER (PARTITION BY p.number, p.shard ORDER BY place, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo
    FROM placed p JOIN runs r ON p.number = r.number AND p.shard = r.shard
)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target, (times * size
    + greatest(0, least(lo + size, least((first + extra) * 16, words)) - greatest(lo, first * 16))
    + greatest(0, least(lo + size, (first + extra - row_blocks) * 16) - lo))::BIGINT AS taken
FROM lined
"""


OP1 = r"""
WITH RECURSIVE urls AS (
    SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), rules(action, rule_host, rule_path) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
        ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), ruled AS (
    SELECT page_id, host, path, html, (
        SELECT arg_max({'rule': rule_host || rule_path, 'action': action}, length(rule_host || rule_path)) FROM rules
        WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    ) AS found FROM urls
), hosts AS (
    SELECT host, count(*) AS pages, count(*) FILTER (WHERE found.action = 'allow') AS allowed,
        count(*) FILTER (WHERE found.action = 'block') AS blocked
    FROM ruled GROUP BY host
), links AS (
    SELECT src, dst, count(*) AS pages FROM (
        SELECT host AS src, unnest(list_distinct(regexp_extract_all(lower(coalesce(html, '')),
            '(?is)\b(?:href|src)\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)', 1))) AS dst FROM urls
    ) WHERE src != '' AND src != dst GROUP BY ALL
), walks AS (
    SELECT 'trust' AS kind, src, dst, pages / sum(pages) OVER (PARTITION BY src) AS share FROM links
    UNION ALL
    SELECT 'distrust', dst, src, pages / sum(pages) OVER (PARTITION BY dst) FROM links
), terms(k, kind, host, mass) AS (
    SELECT 0, kind, host, 0.15 * mass::DOUBLE FROM (
        SELECT 'trust' AS kind, host, allowed AS mass FROM hosts UNION ALL SELECT 'distrust', host, blocked FROM hosts
    ) WHERE mass > 0
    UNION ALL
    SELECT k + 1, t.kind, w.dst, sum(t.mass * w.share) * 0.85
    FROM terms t JOIN walks w ON t.kind = w.kind AND t.host = w.src WHERE k < 400 GROUP BY k, t.kind, w.dst
), scores AS (
    SELECT host, round(sum(CASE WHEN kind = 'trust' THEN mass ELSE 0 END), 6) AS trust,
        round(sum(CASE WHEN kind = 'distrust' THEN mass ELSE 0 END), 6) AS distrust
    FROM terms GROUP BY host
), ranked AS (
    SELECT host, pages, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM hosts LEFT JOIN scores USING (host)
)
SELECT page_id, host, path, found.rule AS rule, coalesce(found.action, CASE WHEN host != '' AND distrust > 2 * trust
    AND distrust >= round(0.25 * 0.15 * pages, 6) THEN 'block' ELSE 'allow' END) AS verdict, trust, distrust
FROM ruled JOIN ranked USING (host)
"""

OP10 = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text
    FROM conversations
), numbered AS (
    SELECT *, row_number() OVER w AS nth,
        (coalesce(sum(strlen(text) + strlen(speaker) + 64) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            // 524288)::BIGINT AS part
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text)
), firsts AS (
    SELECT conv_id, part, min(nth) AS first FROM numbered GROUP BY ALL
), lines AS (
    SELECT conv_id, part, nth, speaker, text, true AS own FROM numbered
    UNION ALL
    SELECT f.conv_id, f.part, 0, 'system', arg_max(n.text, n.nth), false FROM firsts f JOIN numbered n
    ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND n.nth < f.first AND n.speaker = 'system' GROUP BY f.conv_id, f.part
), views AS (
    SELECT l.*, me FROM lines l JOIN (SELECT DISTINCT conv_id, speaker AS me FROM turns WHERE speaker != 'system') v
    ON l.conv_id IS NOT DISTINCT FROM v.conv_id
), rendered AS (
    SELECT *, '<|im_start|>' || CASE WHEN speaker = me THEN 'assistant' WHEN speaker = 'system' THEN 'system'
        ELSE 'user name=' || speaker END || chr(10) AS head, text || '<|im_end|>' AS body FROM views
), placed AS (
    SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, part, me
        ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS start FROM rendered
)
SELECT conv_id, part, me AS speaker, string_agg(head || body || chr(10), '' ORDER BY nth) AS text,
    coalesce(string_agg(start || '-' || (start + length(body)), ',' ORDER BY nth) FILTER (WHERE speaker = me), '') AS mask,
    count_if(own)::INT AS n_turns
FROM placed GROUP BY conv_id, part, me
"""


OP12 = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
), drawn AS (
    SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
        ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d FROM units
), cut AS (
    SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90
            THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
        array_to_string(u[greatest(a, b) + 1:], '') AS suffix FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form != 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM cut
"""

OP13 = r"""
WITH numbered AS (
    SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), postings AS (
    SELECT row, doc_id, term, count(*)::BIGINT AS tf FROM numbered GROUP BY ALL
), lengths AS (
    SELECT row, sum(tf)::BIGINT AS n FROM postings GROUP BY row
), totals AS (
    SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term, docs
), items AS (
    SELECT DISTINCT item_row, item_id, term FROM (
        SELECT row_number() OVER () AS item_row, item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
), scored AS (
    SELECT item_row, item_id, row, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
    FROM items JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (row), totals GROUP BY ALL
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST) AS rank
    FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": OP1,
        "op10_chat": OP10,
        "op12_fill_in_middle": OP12,
        "op13_interval_search": OP13,
        "op3_quality_rules": OP3,
        "op6_mixing": OP6,
    }
