"""The same questions in DuckDB SQL, for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"

MIX = rf"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) + 1 AS tokens,
           coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(md5(text), '-') AS k
    FROM documents),
src AS (SELECT source, sum(tokens)::BIGINT AS t FROM docs GROUP BY source),
tot AS (SELECT sum(t)::DOUBLE AS total, count(*) AS n, min(t) AS least FROM src),
flat AS (
    SELECT 0 AS i, 0.0::DOUBLE AS lo, 4.0::DOUBLE AS hi
    UNION ALL
    SELECT i + 1, CASE WHEN fits THEN lo ELSE mid END, CASE WHEN fits THEN mid ELSE hi END
    FROM (SELECT i, lo, hi, mid, ln(sum(pow(t / total, mid))) - mid * sum(pow(t / total, mid) * ln(t / total)) / sum(pow(t / total, mid))
                 <= 0.95 * ln(n) AS fits
          FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid FROM flat WHERE i < 40), src, tot GROUP BY i, lo, hi, mid, n)),
often AS (
    SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
    UNION ALL
    SELECT i + 1, CASE WHEN fits THEN lo ELSE mid END, CASE WHEN fits THEN mid ELSE hi END
    FROM (SELECT i, lo, hi, mid, pow(least / total, mid - 1) / sum(pow(t / total, mid)) <= 4 AS fits
          FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid FROM often WHERE i < 40), src, tot GROUP BY i, lo, hi, mid, least, total)),
power AS (SELECT round(greatest((SELECT hi FROM flat WHERE i = 40), (SELECT hi FROM often WHERE i = 40)), 9) AS e),
norm AS (SELECT sum(pow(t::DOUBLE, e)) AS z FROM src, power),
plan AS (
    SELECT source, t, w, quota, quota // t AS passes, quota % t AS rest
    FROM (SELECT source, t, pow(t::DOUBLE, e) / z AS w, floor(round(pow(t::DOUBLE, e) / z * total, 3))::BIGINT AS quota FROM src, power, norm, tot)),
placed AS (
    SELECT d.*, p.w, p.quota, p.passes, p.rest,
           ('0x' || substr(md5('7:' || passes || ':' || k), 1, 15))::BIGINT AS place,
           (('0x' || substr(md5('block:' || k), 1, 15))::BIGINT) % 4096 AS block
    FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
ordered AS (
    SELECT *, ('0x' || substr(md5('7:' || passes || ':' || block || ':' || coalesce(source, '-')), 1, 15))::BIGINT AS block_order FROM placed),
running AS (
    SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY block_order, block, place RANGE UNBOUNDED PRECEDING) AS upto FROM ordered)
SELECT doc_id, source, tokens AS mix_tokens, round(w, 9) AS mix_weight, quota AS mix_quota,
       unnest(range(passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS mix_pass
FROM running
"""

SHARDS = """
WITH bits AS (
    SELECT list_transform(range(0, 256), lambda i: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
               lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS crcs),
keyed AS (
    SELECT doc_id, text, coalesce(strlen(text), 0) + 1 AS size, coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, -1) AS h, hex(text) AS body
    FROM documents),
placed AS (
    SELECT *, sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS below, sum(size) OVER () AS total FROM keyed),
cut AS (SELECT *, ((below * 8) // total)::INT AS shard FROM placed)
SELECT doc_id, size,
       xor(list_reduce(range(0, size - 1), lambda c, i: xor(c >> 8, crcs[xor(c & 255, ('0x' || substr(body, 2 * i + 1, 2))::BIGINT) + 1]), 4294967295),
           4294967295) AS text_crc32,
       'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM cut, bits
"""

TOP_PRODUCTS = """
WITH good AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
    FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def licence_scan(source: str = "documents") -> str:
    """One CTE per rule: each uses up its identifiers and adds its licence."""
    from basketflow.llm.licence_rules import MARKERS, RULES, SENTENCES

    def marked(text: str) -> str:
        return "(" + " OR ".join(f"contains({text}, '{m}')" for m in MARKERS) + ")"

    plain = r"regexp_replace(lower(text), '\r\n?', chr(10), 'g')"
    plain = rf"regexp_replace({plain}, '(?m)^[ \t]*[#*/%;!<>-]+[ \t]*', '', 'g')"
    plain = rf"regexp_replace({plain}, '\n[ \t]*(?:\n[ \t]*)+', chr(1), 'g')"
    plain = rf"regexp_replace({plain}, '[\t\n\x0b\f ]+', ' ', 'g')"
    plain = rf"regexp_replace({plain}, 'copy of the license at:? ?\x01 ?(https?://)', 'copy of the license at \1', 'g')"
    plain = rf"regexp_replace({plain}, ' ?\x01 ?', chr(10) || chr(10), 'g')"
    # signs inside known sentences are set aside while texts are cut
    for start, sign, end, mark in (("spdx-license-identifier", ":", " ", 2), ("mozilla public license, v", ".", " 2", 3), ("without any warranty", ";", " without even ", 4)):
        plain = f"replace({plain}, '{start}{sign}{end}', '{start}' || chr({mark}) || '{end}')"
    ids = ", ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN '{name}' END" for name, p in SENTENCES)
    steps = []
    for i, (name, sequence) in enumerate(RULES):
        text = "".join(f"<{x}>" for x in sequence)
        steps.append(
            f"r{i + 1} AS (SELECT doc_id, ids, replace(rest, '{text}', '|') AS rest, "
            f"CASE WHEN contains(rest, '{text}') AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names FROM r{i})"
        )
    return rf"""
WITH cut AS (SELECT doc_id, string_split_regex({plain}, '[.;:!?]+(?: |$)|\n\n') AS parts FROM {source} WHERE {marked("lower(text)")}),
found AS (
    SELECT doc_id, flatten(list_transform(list_filter(list_transform(parts, lambda p: replace(replace(replace(trim(p), chr(2), ':'), chr(3), '.'), chr(4), ';')), lambda s: {marked("s")}),
           lambda s: list_filter([{ids}], lambda x: x IS NOT NULL))) AS ids FROM cut),
r0 AS (SELECT doc_id, ids, list_aggregate(list_transform(ids, lambda x: '<' || x || '>'), 'string_agg', '') AS rest, []::VARCHAR[] AS names
       FROM found WHERE len(ids) > 0),
{", ".join(steps)}
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(names, ',') AS licences,
       (length(rest) - length(replace(rest, '<', '')))::INT AS unmatched
FROM r{len(RULES)}
"""

# Licence headers as files carry them: known sentences with signs inside, and notices in several sentences.
HEADERS = (
    "// SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: Apache-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy was not distributed, obtain one.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published; "
    "either version 2 of the License, or (at your option) any later version.\nIt is distributed in the hope that it will be useful, "
    "but WITHOUT ANY WARRANTY; without even the implied warranty of fitness. See the GNU General Public License for more details.",
    "Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License.\n"
    "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n"
    "Software distributed under the License is distributed on an 'AS IS' BASIS.",
)


def headed_documents() -> str:
    """The documents, each below one of HEADERS, by its id."""
    lists = ", ".join("'" + h.replace("'", "''") + "'" for h in HEADERS)
    return f"(SELECT doc_id, [{lists}][doc_id % {len(HEADERS)} + 1] || chr(10) || chr(10) || coalesce(text, '') AS text FROM documents)"


PAGE_RECORDS = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
           lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (5 * i + 1)::INT, 5))::INT >> b) & 31) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM g
"""

LINE_TEMPLATES = """
WITH raw AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
line AS (SELECT DISTINCT text, list_transform(list_filter(string_split_regex(l, '[\\x09-\\x0D\\x20]+'), lambda t: t <> ''),
                lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
         FROM (SELECT text, unnest(string_split(text, chr(10))) AS l FROM raw)),
good AS (SELECT text, tokens, len(tokens) AS n, array_to_string(tokens[1:3], ' ') AS head FROM line WHERE len(tokens) >= 3),
leaf AS (SELECT n, head FROM good GROUP BY n, head HAVING count(DISTINCT text) >= 5),
known AS (SELECT g.* FROM good g JOIN leaf USING (n, head)),
lines AS (SELECT n, head, tokens, count(*) AS weight FROM known GROUP BY n, head, tokens),
each AS (SELECT n, head, tokens, weight, unnest(range(1, n + 1)) AS place FROM lines),
held AS (SELECT n, head, tokens, weight, place, tokens[place] AS token FROM each),
often AS (SELECT n, head, place, token FROM held GROUP BY n, head, place, token HAVING sum(weight) >= 5),
shaped AS (
    SELECT h.n, h.head, h.tokens, string_agg(CASE WHEN o.token IS NULL THEN '<*>' ELSE h.token END, ' ' ORDER BY h.place) AS template
    FROM held h LEFT JOIN often o ON h.n = o.n AND h.head = o.head AND h.place = o.place AND h.token = o.token
    GROUP BY h.n, h.head, h.tokens HAVING count(o.token) >= 0.5 * h.n),
recurring AS (SELECT template FROM shaped s JOIN known k ON s.n = k.n AND s.head = k.head AND s.tokens = k.tokens
              GROUP BY template HAVING count(DISTINCT k.text) >= 5),
gone AS (SELECT DISTINCT tokens FROM shaped JOIN recurring USING (template)),
placed AS (
    SELECT text, i, string_split(text, chr(10))[i] AS l
    FROM (SELECT text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM raw)),
marked AS (
    SELECT text, i, l, list_transform(list_filter(string_split_regex(l, '[\\x09-\\x0D\\x20]+'), lambda t: t <> ''),
                lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens FROM placed),
done AS (
    SELECT text, count(*) AS lines, count(g.tokens) AS lines_dropped,
           coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (g.tokens IS NULL), '') AS kept
    FROM marked m LEFT JOIN gone g ON m.tokens = g.tokens GROUP BY text)
SELECT d.doc_id, coalesce(lines, 0)::INT AS lines, coalesce(lines_dropped, 0)::INT AS lines_dropped, md5(kept) AS kept_md5
FROM documents d LEFT JOIN done USING (text)
"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CASES = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

TERM_SEARCH = rf"""
WITH d AS (SELECT doc_id, terms, len(terms)::BIGINT AS size
           FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_CASES}), '{_TERMS}') AS terms FROM documents) WHERE len(terms) > 0),
c AS (SELECT count(*)::BIGINT AS documents, sum(size)::BIGINT AS total FROM d),
q AS (SELECT item_id, term, count(*)::BIGINT AS times
      FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_CASES}), '{_TERMS}')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, size, term, count(*)::BIGINT AS tf
      FROM (SELECT doc_id, size, unnest(terms) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term, documents),
s AS (SELECT q.item_id, p.doc_id,
             sum(q.times * w.weight * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.size * c.documents) // c.total))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0)
SELECT item_id, place::INT AS rank, doc_id, score FROM r WHERE place <= 10
"""

SPELLING_GROUPS = rf"""
WITH RECURSIVE bits AS (
    SELECT list_transform(range(0, 256), lambda i: list_reduce([0, 1, 2, 3, 4, 5, 6, 7],
               lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS crcs),
runs AS (SELECT doc_id, run, count(*) AS n, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS body
         FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_CASES}), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
         WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (
    SELECT run, n, xor(list_reduce(range(0, length(body) // 2), lambda c, i: xor(c >> 8, crcs[xor(c & 255, ('0x' || substr(body, 2 * i + 1, 2))::BIGINT) + 1]),
                                   4294967295), 4294967295) AS h FROM runs, bits),
words AS (
    SELECT word, sum(n)::BIGINT AS n
    FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, n, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM near GROUP BY word, n),
forms AS (SELECT word, n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM best),
way AS (
    SELECT word, word AS root, 0 AS steps FROM words
    UNION ALL SELECT way.word, forms.form, steps + 1 FROM way JOIN forms ON forms.word = way.root WHERE forms.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, steps) AS root FROM way GROUP BY word)
SELECT w.word, f.form, e.root, w.n, coalesce(f.n_near, 0)::BIGINT AS n_near, f.form_n
FROM words w JOIN ends e USING (word) LEFT JOIN forms f USING (word)
"""
