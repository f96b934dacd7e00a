"""SQL of the queries that SQL can express."""

from __future__ import annotations

from cohortspark.llm.licenses import LOWER, RULES, SENTENCE_END, SENTENCES, UPPER

OP2 = r"""
WITH texts AS (
    SELECT doc_id, row_number() OVER () AS r,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), items AS (
    SELECT item_id, least(13, len(words)) AS size, words FROM (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
        FROM benchmark)
    WHERE len(words) > 0
), windows AS (
    SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS win
    FROM items, unnest(range(1, len(words) - size + 2)) AS t(i)
), sizes AS (SELECT DISTINCT size FROM windows), wins AS (SELECT DISTINCT size, win FROM windows
), places AS (
    SELECT r, i, size, array_to_string(words[i:i + size - 1], ' ') AS win
    FROM texts, sizes, unnest(range(1, len(words) - size + 2)) AS t(i)
), found AS (SELECT r, i, size, win FROM places JOIN wins USING (size, win)
), hit AS (
    SELECT r, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, size)) AS t(k) GROUP BY r
), named AS (
    SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (
        SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name
        FROM found JOIN windows USING (size, win) WHERE item_id IS NOT NULL)
    GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM texts LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

OP5 = """
WITH parts AS (
    SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
    FROM pages
), ruled AS (
    SELECT *, CASE
        WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%'
            THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%'
            THEN 'example.com/en/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/'
    END AS rule
    FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN list_has_any(string_split(host, '.'),
        ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""

OP9 = """
WITH rows AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
        sha1(coalesce(html, '')) AS hex
    FROM pages
), classes AS (
    SELECT hex, max(page_id) AS largest FROM rows GROUP BY hex
), bits AS (
    SELECT hex, array_to_string(list_transform(string_split(hex, ''),
        lambda c: lpad(bin(strpos('123456789abcdef', c)), 4, '0')), '') AS bits
    FROM classes
), names AS (
    SELECT hex, array_to_string(list_transform(range(0, 32), lambda i:
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(0, 5), lambda k:
            CAST(bits[5 * i + k + 1] AS INTEGER) * (1 << CAST(4 - k AS INTEGER))))::INTEGER]), '')
        AS payload_digest
    FROM bits
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM rows JOIN classes USING (hex) JOIN names USING (hex)
"""


def _op3() -> str:
    """The licence scan: a step of SQL for each rule."""

    def fits(known: str) -> str:
        return f"starts_with(s, '{known[:-1]}')" if known.endswith("*") else f"s = '{known}'"

    cases = " ".join(f"WHEN {fits(known)} THEN '{name}'" for name, known in SENTENCES)
    steps = []
    for n, (name, ids) in enumerate(RULES):
        chain = "".join(f",{i}," for i in ids)
        steps.append(
            f"step{n} AS (SELECT *, replace(l{n}, '{chain}', '/') AS l{n + 1}, "
            f"contains(l{n}, '{chain}') AS f{n} FROM {'ids' if n == 0 else f'step{n - 1}'})"
        )
    distinct = list(dict.fromkeys(name for name, _ in RULES))
    held = ", ".join(
        "CASE WHEN "
        + " OR ".join(f"f{n}" for n, (other, _) in enumerate(RULES) if other == name)
        + f" THEN '{name}' END"
        for name in distinct
    )
    return f"""
WITH sentences AS (
    SELECT doc_id, list_transform(string_split_regex(coalesce(text, ''), '{SENTENCE_END}'), lambda s:
        trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))) AS all_of
    FROM documents
), named AS (
    SELECT doc_id, list_filter(list_transform(all_of, lambda s: CASE {cases} END), lambda x: x IS NOT NULL) AS ids
    FROM sentences
), ids AS (
    SELECT *, CASE WHEN len(ids) > 0 THEN ',' || array_to_string(list_transform(ids, lambda x: x || ','), ',')
        ELSE '' END AS l0
    FROM named
), {", ".join(steps)}
SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
    coalesce(concat_ws(',', {held}), '') AS licenses,
    coalesce(array_to_string(list_filter(string_split_regex(l{len(RULES)}, '[,/]+'), lambda x: x <> ''), ','), '')
        AS unused
FROM step{len(RULES) - 1}
"""


OP3 = _op3()


def _op11(k: int = 16, rounds: int = 3, dimensions: int = 64) -> str:
    """All distances of each round, long: one row for each vector, centroid and dimension."""
    parts = [
        f"""kept AS MATERIALIZED (
    SELECT vec_id, row_number() OVER () AS r,
        list_transform(embedding, lambda x: CAST(floor({dimensions} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE len(embedding) = {dimensions}
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}
), parts AS MATERIALIZED (
    SELECT r, unnest(q) AS v, unnest(range({dimensions})) AS d FROM kept
), start AS (
    SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept
), c0 AS MATERIALIZED (SELECT c, d, v AS m FROM parts JOIN start USING (r) WHERE c < {k})"""
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""d{n} AS (
    SELECT r, c, CAST(sum((v - m) * (v - m)) AS BIGINT) AS distance FROM parts JOIN c{n} USING (d) GROUP BY r, c
), a{n} AS MATERIALIZED (
    SELECT r, c, distance FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1
)"""
        )
        if n < rounds:
            parts.append(
                f"""s{n} AS (
    SELECT c, d, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM parts JOIN a{n} USING (r) GROUP BY c, d
), c{n + 1} AS MATERIALIZED (
    SELECT c, d, CASE WHEN n IS NULL THEN m ELSE (s - ((s % n) + n) % n) // n END AS m
    FROM c{n} LEFT JOIN s{n} USING (c, d)
)"""
            )
    return f"""
WITH {", ".join(parts)}, digests AS (
    SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c
)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance,
    CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN a{rounds} USING (r) JOIN digests USING (c)
"""


OP11 = _op11()

ORACLES: dict[str, str] = {
    "op2_decontamination": OP2,
    "op3_license_scan": OP3,
    "op5_url_filter": OP5,
    "op9_warc": OP9,
    "op11_centroids": OP11,
}
