"""The contracts of conversation repair and spelling variants as DuckDB SQL, by other means than the operators'."""

from __future__ import annotations

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
PLACES = ("", "s", "u", "a")
#: crc32 of a text whose characters are below U+0800, from a table made of eight shifts a byte.
CRC_TABLE = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_of)"""


def crc(text: str) -> str:
    """An expression for the crc32 of an SQL text; needs crc_of in scope."""
    points = f"list_transform(string_split({text}, ''), lambda c: CAST(unicode(c) AS BIGINT))"
    data = f"flatten(list_transform({points}, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 | (p >> 6), 128 | (p & 63)] END))"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295)"


def moves(kind: int) -> str:
    """What a row of a kind (initial, fault) does: structs of place before, place after, cost, edits."""
    initial, fault = "sua"[kind // 3 : kind // 3 + 1], kind % 3
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for q in range(4):
        reach, todo = {q: (0, "")}, [q]
        for x in todo:
            for role in "ua":
                to = NEXT.get((PLACES[x], role))
                if to and PLACES.index(to) not in reach:
                    reach[PLACES.index(to)] = (reach[x][0] + 3, reach[x][1] + "I")
                    todo.append(PLACES.index(to))
        for x, (cost, edits) in reach.items():
            offers = [(x, cost + 4, edits + "D")]
            if fault != 1:
                more = cost + 3 * (fault == 2)
                offers += [(PLACES.index(NEXT[PLACES[x], initial]), more, edits + "K")] if (PLACES[x], initial) in NEXT else []
                offers += [(PLACES.index(NEXT[PLACES[x], r]), more + 3, edits + "R") for r in "ua" if (PLACES[x], r) in NEXT]
            for to, c, w in offers:
                best[q, to] = min(best.get((q, to), (c, w)), (c, w))
    return "[" + ", ".join(f"{{'q': {q}, 'p': {p}, 'c': {c}, 'w': '{w}'}}" for (q, p), (c, w) in sorted(best.items())) + "]"


BLANK = r"[\x20\x09-\x0D]"
CONVERSATIONS = rf"""
WITH {CRC_TABLE},
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM kinds, range(2) twice(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS nth FROM damaged),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?]{BLANK}*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY nth) AS before FROM placed),
gathered AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (nth > 1 AND concat(before, substr(role, 1, 1)) NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'k': CASE substr(role, 1, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END * 3 + CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 2 ELSE 1 END, 's': CAST([] AS VARCHAR[])}} ORDER BY nth) AS steps,
    list(role ORDER BY nth) AS roles, list(text ORDER BY nth) AS texts FROM judged GROUP BY conv_id),
ways AS (SELECT [{", ".join(moves(k) for k in range(12))}] AS way),
parsed AS (SELECT * EXCLUDE (steps, way), list_reduce(list_prepend({{'k': 0, 's': ['00000000', NULL, NULL, NULL]}}, steps), lambda a, x: {{'k': 0, 's': list_transform([0, 1, 2, 3], lambda p:
    list_min(list_transform(list_filter(way[x.k + 1], lambda m: m.p = p AND a.s[m.q + 1] IS NOT NULL), lambda m: concat(printf('%08d', CAST(a.s[m.q + 1][1:8] AS INTEGER) + m.c), a.s[m.q + 1][9:], m.w))))}}).s AS s FROM gathered, ways),
chosen AS (SELECT * EXCLUDE (s), list_min(list_filter([s[1], CASE WHEN s[2] IS NOT NULL THEN concat(printf('%08d', CAST(s[2][1:8] AS INTEGER) + 6), s[2][9:], 'II') END,
    CASE WHEN s[3] IS NOT NULL THEN concat(printf('%08d', CAST(s[3][1:8] AS INTEGER) + 3), s[3][9:], 'I') END, s[4]], lambda e: e IS NOT NULL)) AS way FROM parsed),
edited AS (SELECT *, CAST(way[1:8] AS BIGINT) AS cost, way[9:] AS audit, regexp_extract_all(way[9:], 'I*[DKR]') AS parts, regexp_extract(way[9:], 'I*$') AS tail FROM chosen),
lined AS (SELECT *, list_concat(flatten(list_transform(range(1, len(parts) + 1), lambda i: list_filter(list_transform(string_split(parts[i], ''), lambda e:
    CASE e WHEN 'I' THEN {{'own': NULL, 'text': ''}} WHEN 'K' THEN {{'own': roles[i], 'text': texts[i]}} WHEN 'R' THEN {{'own': NULL, 'text': texts[i]}} END), lambda e: e IS NOT NULL))),
    list_transform(range(len(tail)), lambda i: {{'own': NULL, 'text': ''}})) AS said FROM edited),
hashed AS (SELECT *, sha256(array_to_string(list_transform(range(1, len(said) + 1), lambda i: concat(coalesce(said[i].own, CASE WHEN (i - CASE WHEN starts_with(coalesce(said[1].own, ''), 's') THEN 1 ELSE 0 END) % 2 = 1
    THEN 'user' ELSE 'assistant' END), ':', said[i].text)), chr(10))) AS sha FROM lined)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
    coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN hashed h ON c.conv_id IS NOT DISTINCT FROM h.conv_id"""

SPELLING = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counts AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashes AS (SELECT run, n, {crc("concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run)")} AS h FROM counts, crc),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM hashes)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gone AS MATERIALIZED (SELECT word, n, k, concat(substr(word, 1, k), substr(word, k + 2)) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM gone a JOIN gone b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM gone a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM gone a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({{'m': -m, 'other': other}}) AS b FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 5 * w.n THEN b.other END AS form, CASE WHEN -b.m >= 5 * w.n THEN -b.m END AS form_n FROM words w LEFT JOIN best USING (word)),
chains AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chains c ON c.word = f.word JOIN forms e ON e.word = c.at AND e.form IS NULL"""
