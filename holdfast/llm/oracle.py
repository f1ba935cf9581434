"""DuckDB SQL for the queries whose method SQL can express, written from their contracts."""

OP8 = r"""
WITH sized AS (
    SELECT doc_id, source,
        coalesce(doc_id::VARCHAR, '') || ':' || coalesce(source, '') || ':'
            || md5(coalesce(text, '')) AS key,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents
),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
    FROM sums
),
levels AS (
    SELECT *,
        ((SELECT sum(source_size) FROM sums)
            - coalesce(sum(3 * source_size) OVER (
                ORDER BY 3.0 * source_size / weight, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(weight) OVER (
            ORDER BY 3.0 * source_size / weight, source NULLS LAST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
    FROM weighed
),
chosen AS (
    SELECT min_by(level, 3.0 * source_size / weight) AS level
    FROM levels WHERE level * weight <= 3 * source_size
),
wanted AS (
    SELECT source, source_size,
        least(3.0::DOUBLE * source_size, coalesce(chosen.level, 0) * weight)::DOUBLE AS target
    FROM weighed, chosen
)
SELECT doc_id, size, source_size, target,
    (size * (floor(rate) + (draw < rate - floor(rate))::INT))::BIGINT AS taken
FROM (
    SELECT sized.doc_id, size, source_size, target,
        CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        (('0x' || substr(md5('mixing:' || key), 1, 8))::UBIGINT
            / 4294967296.0::DOUBLE) AS draw
    FROM sized JOIN wanted ON sized.source IS NOT DISTINCT FROM wanted.source
)
"""

OP5 = r"""
WITH parts AS (
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
    FROM pages
),
named AS (
    SELECT *, string_split(host, '.') AS l,
        array_to_string(string_split(host, '.')[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk',
            'gov.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.jp', 'com.br', 'co.in',
            'co.za') AS long
    FROM parts
),
placed AS (
    SELECT *, array_to_string(l[(CASE WHEN long THEN -3 ELSE -2 END):], '.') AS domain,
        array_to_string(l[(CASE WHEN long THEN -2 ELSE -1 END):], '.') AS suffix
    FROM named
),
outcomes AS (
    SELECT doc_id, (quality = 1 AND coalesce(toxic, 0) <> 1)::INT AS good
    FROM labels WHERE quality IS NOT NULL
),
hosts AS (
    SELECT host, domain, suffix, coalesce(sum(good), 0)::DOUBLE AS good, count(good)::DOUBLE AS n
    FROM placed LEFT JOIN outcomes ON page_id = doc_id GROUP BY ALL
),
domains AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM hosts GROUP BY ALL),
suffixes0 AS (SELECT suffix, sum(good) AS good, sum(n) AS n FROM domains GROUP BY ALL),
whole AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM domains),
suffixes1 AS (SELECT s.*, mean FROM suffixes0 s, whole),
alike1 AS (
    SELECT least(greatest(coalesce(
        sum(n * power(good / n - mean, 2) / (mean * (1 - mean)) - 1) / nullif(sum(n - 1), 0),
        0), 1e-4), 0.5) AS alike FROM suffixes1 WHERE n > 0
),
suffixes AS (
    SELECT s.*, (good + mean * (1 / alike - 1)) / (n + (1 / alike - 1)) AS posterior
    FROM suffixes1 s, alike1
),
domains1 AS (
    SELECT d.*, s.posterior AS mean FROM domains d JOIN suffixes s USING (suffix)
),
alike2 AS (
    SELECT least(greatest(coalesce(
        sum(n * power(good / n - mean, 2) / (mean * (1 - mean)) - 1) / nullif(sum(n - 1), 0),
        0), 1e-4), 0.5) AS alike FROM domains1 WHERE n > 0
),
domains2 AS (
    SELECT d.*, (good + mean * (1 / alike - 1)) / (n + (1 / alike - 1)) AS posterior
    FROM domains1 d, alike2
),
hosts1 AS (SELECT h.*, d.posterior AS mean FROM hosts h JOIN domains2 d USING (domain)),
alike3 AS (
    SELECT least(greatest(coalesce(
        sum(n * power(good / n - mean, 2) / (mean * (1 - mean)) - 1) / nullif(sum(n - 1), 0),
        0), 1e-4), 0.5) AS alike FROM hosts1 WHERE n > 0
),
posteriors AS (
    SELECT host, good + mean * (1 / alike - 1) AS a,
        n - good + (1 - mean) * (1 / alike - 1) AS b
    FROM hosts1, alike3
),
bounds AS (
    SELECT host,
        a / (a + b) + 2.0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound
    FROM posteriors
),
rules(rule, verdict, rhost, rpath) AS (
    VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
        ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
        ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
),
fitting AS (
    SELECT host, path, max_by({'rule': rule, 'verdict': verdict}, length(rule)) AS said
    FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
        ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
    GROUP BY host, path
)
SELECT page_id, p.host, p.path, said.rule AS rule,
    coalesce(said.verdict, CASE WHEN bound < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p JOIN bounds b ON p.host = b.host
    LEFT JOIN fitting f ON p.host = f.host AND p.path = f.path
"""

OP9 = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL VALUES
        (-7, 0, 'user', '\### Assistant: </turn> ok'),
        (-7, 1, 'assistant', '\### Assistant: </turn> ok')
),
counted AS (
    SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
        row_number() OVER w - 1 AS n
    FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
),
placed AS (
    SELECT *,
        coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY n
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
        (sum(tokens) OVER (PARTITION BY conv_id))::BIGINT AS total,
        coalesce(max(tokens) FILTER (WHERE n = 0 AND role = 'system')
            OVER (PARTITION BY conv_id), 0) AS system
    FROM counted
),
stretched AS (SELECT *, greatest(1024 - greatest(system, 256), 1) AS stretch FROM placed),
cut AS (
    SELECT *, n = 0 AND role = 'system' AS opening,
        before // stretch * 2 + (before % stretch + tokens > greatest(stretch, 1024 - system))::INT
            AS own,
        CASE WHEN n = 0 AND role = 'system' THEN (total - 1) // stretch
            ELSE least((total - 1) // stretch, (before + 256) // stretch) END * 2 + 1 AS upto
    FROM stretched
),
each AS (SELECT *, unnest(range(own, greatest(own, upto) + 1)) AS part FROM cut),
windows AS (
    SELECT conv_id, part, min(before) FILTER (part = own) AS first,
        least(256, 1024 - sum(tokens) FILTER (part = own)
            - coalesce(sum(tokens) FILTER (part > own AND opening), 0)) AS room
    FROM each GROUP BY ALL HAVING count(*) FILTER (part = own) > 0
),
sizes AS (
    SELECT e.conv_id,
        sum(9 + length(n::VARCHAR) + 8 + 1 + 1 + 8 + CASE WHEN part > own THEN 7 ELSE 0 END
            + 2 * length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '"', ''))
            + 2 * length(text) - length(replace(replace(text, '\', ''), '<', ''))
        )::BIGINT AS formatted_chars
    FROM each e JOIN windows w USING (conv_id, part)
    WHERE part = own OR opening OR first - before <= room
    GROUP BY e.conv_id
),
texts AS (
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), ''))
            AS loss_sha256
    FROM counted GROUP BY conv_id
)
SELECT t.*, formatted_chars FROM texts t JOIN sizes USING (conv_id)
"""

OP10 = r"""
WITH payloads AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
        sha1(coalesce(html, '')) AS hex
    FROM pages
),
digits AS (
    SELECT *, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + ((('0x' || substr(hex, 1 + 10 * (i // 8)::INT, 10))::UBIGINT
                >> (35 - 5 * (i % 8))::UBIGINT) & 31)::INT, 1)), '') AS payload_digest
    FROM payloads
),
chiefs AS (
    SELECT hex, max(page_id) AS chief FROM digits WHERE payload_bytes >= 0 GROUP BY hex
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id IS DISTINCT FROM chief AND chief IS NOT NULL THEN 'revisit'
        ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM chief THEN chief END AS refers_to
FROM digits LEFT JOIN chiefs USING (hex)
"""

# The standard reflected CRC-32, bit by bit, of the bytes of a number's decimal text.
_CRC = """xor(4294967295::BIGINT, list_reduce(
    list_concat([4294967295::BIGINT],
                list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda crc, b: list_reduce(
        list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, _: xor(x >> 1, (x & 1) * 3988292384::BIGINT))))"""

OP13 = f"""
WITH said AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                       coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM said)),
rebuilt AS (
  SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY s.n) AS depth,
         role, text
  FROM convs c JOIN said s
    ON (s.conv_id = c.base AND s.n <= h) OR (s.conv_id = c.conv_id AND s.n > h)),
paths AS (
  SELECT conv_id, depth, length(text) AS chars,
    list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY depth) AS path
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
prefixes AS (
  SELECT conv_id, depth, chars, sha256(path::VARCHAR) AS node,
         CASE WHEN depth > 0 THEN sha256(path[:-2]::VARCHAR) END AS parent,
         depth = max(depth) OVER (PARTITION BY conv_id) AS is_last
  FROM paths),
nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth,
         any_value(chars) AS chars, count(*) AS n_convs, min(conv_id) AS conv_id,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_last), '')
           AS ids
  FROM prefixes GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes GROUP BY parent),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node)),
subtrees AS (
  SELECT p.node, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves,
         sum((u.n_convs - 1) * u.chars)::BIGINT AS saved_tokens
  FROM whole u JOIN prefixes p ON p.conv_id = u.conv_id AND p.depth <= u.depth
  GROUP BY p.node)
SELECT v.conv_id, v.depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children,
       n_leaves, saved_tokens, sha256(v.ids) AS ends_sha256
FROM whole v JOIN subtrees USING (node) LEFT JOIN nodes up ON up.node = v.parent"""
