"""DuckDB SQL for the queries that SQL can express.

Not here: pseudonyms (keyed hash), language ID and quality scores (Spark's hashes), packing (token ids), the source mix
(seeded order by Spark's hash). Their tests hold them against brute-force versions, round trips and held-out accuracy.
"""

from __future__ import annotations

from watchloom.llm import license_rules as L
from watchloom.llm import url_equivalence as U
from watchloom.llm.queries import URL_RULES

GAP = r"[\x20\x09-\x0D]+"
LOWER = f"'{U.UPPER}', '{U.LOWER}'"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _licenses() -> str:
    known, sequences = L.known_parts(L.SENTENCES)
    table = "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in known.items()) + "}"
    find = lambda s: f"m[trim(regexp_replace(lower({s}), '[^a-z0-9]+', ' ', 'g'))]"
    each = lambda lines: f"list_filter(list_transform({lines}, lambda y: {find('y')}), lambda z: z IS NOT NULL)"
    titles = " ".join(
        f"WHEN len(l) > {n} AND {find(f"array_to_string(l[{n + 1}:], ' ')")} IS NOT NULL THEN list_append({each(f'l[:{n}]')}, {find(f"array_to_string(l[{n + 1}:], ' ')")})" for n in range(1, L.TITLES + 1)
    )
    ids = "',' || array_to_string(p, ',,') || ','"
    for seq, ident in sequences:
        ids = f"replace({ids}, {_text(L.sequence_text(seq))}, {_text(f',{ident},')})"
    steps, found = [], []
    for k, (name, seq) in enumerate(L.RULES):
        steps.append(f"contains(s{k}, {_text(L.sequence_text(seq))}) AS h{k}, replace(s{k}, {_text(L.sequence_text(seq))}, ',|,') AS s{k + 1}")
        before = "".join(f" AND NOT h{j}" for j in range(k) if (L.RULES[j][0] == name or name == L.FALLBACK))
        found.append(f"CASE WHEN h{k}{before} THEN '{name}' END")
    listed = lambda s: f"array_to_string(list_filter(string_split({s}, ','), lambda x: x <> '' AND x <> '|'), ',')"
    return f"""WITH cuts AS (SELECT row_number() OVER () AS d, doc_id, string_split_regex(regexp_replace(regexp_replace(chr(10) || replace(coalesce(text, ''), chr(13), ''), {_text(L.SIGNS)}, chr(10), 'g'), {_text(L.COPYRIGHT)}, '\\1' || chr(10), 'g'), {_text(L.BOUNDARY)}) AS c FROM documents),
    one AS (SELECT d, {table} AS m, unnest(c) AS s, unnest(range(len(c))) AS i FROM cuts),
    lines AS (SELECT d, i, m, s, string_split(s, chr(10)) AS l FROM one),
    told AS (SELECT d, i, CASE WHEN {find("s")} IS NOT NULL THEN [{find("s")}] {titles} ELSE {each("l")} END AS p FROM lines),
    doc AS (SELECT d, flatten(list(p ORDER BY i)) AS p FROM told WHERE len(p) > 0 GROUP BY d),
    complete AS (SELECT d, list_filter(string_split({ids}, ','), lambda x: x <> '' AND NOT contains(x, '/')) AS w FROM doc),
    base AS (SELECT doc_id, CASE WHEN len(w) > 0 THEN ',' || array_to_string(w, ',,') || ',' ELSE '' END AS s0 FROM cuts LEFT JOIN complete USING (d)),
    ruled AS (SELECT doc_id, {", ".join(steps)}, s0 AS ids FROM base)
    SELECT doc_id, concat_ws(',', {", ".join(found)}) AS licenses, {listed("ids")} AS sentence_ids, {listed(f"s{len(L.RULES)}")} AS leftover FROM ruled"""


ESCAPE = r"'([<\[])(~*)(/?s>|/?INST\]|/?<SYS>>|<SYS>>|</SYS>>|\|)', '\1~\2\3', 'g'"

CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(10 + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), {ESCAPE})) + length(regexp_replace(text, {ESCAPE}))) AS BIGINT) - count(*) AS formatted_chars
 FROM c GROUP BY conv_id"""


def _urls() -> str:
    fits = lambda h, p: " ".join(
        f"WHEN ({h} = '{r.host}' OR {h} LIKE '%.{r.host}') AND starts_with({p}, '{r.path}') THEN '{r.verdict} {r.name}'" for r in sorted(URL_RULES, key=lambda r: -len(r.name))
    )
    parts = lambda u: f"translate(regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^/?#]*'), {LOWER})", lambda u: f"regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^/?#]*([^?#]*)', 1)"
    host, path = parts
    rest = lambda u: f"regexp_extract(substr({u}, instr({u}, '://') + 3), '^[^/?#]*([^#]*)', 1)"
    key = lambda u: f"CASE WHEN instr({u}, '://') > 0 THEN {host(u)} || CASE WHEN {rest(u)} = '' THEN '/' ELSE {rest(u)} END END"
    tags = lambda outer, inner: f"list_transform(regexp_extract_all(html, {_text(outer)}), lambda x: regexp_extract(x, {_text(inner)}, 1))"
    return rf"""WITH RECURSIVE p AS (SELECT page_id, html, url, CASE WHEN instr(url, '://') > 0 THEN {host("url")} ELSE '' END AS host, CASE WHEN instr(url, '://') > 0 THEN {path("url")} ELSE '' END AS path, {key("url")} AS k FROM pages),
    t0 AS (SELECT host, path, k, regexp_replace(unnest(list_concat({tags(U.LINK, U.HREF)}, {tags(U.REFRESH, U.TARGET)})), '^(\./)+', '') AS t FROM p),
    t AS (SELECT host, path, k, t FROM t0 WHERE t <> '' AND NOT starts_with(t, '#') AND NOT regexp_matches(t, '(^|/)\.\.?(/|$)') AND (NOT regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\-]*:') OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\-]*://'))),
    a AS (SELECT k AS u, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'http://' || host || t
      WHEN starts_with(t, '?') THEN 'http://' || host || CASE WHEN path = '' THEN '/' ELSE path END || t ELSE 'http://' || host || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^.*/') END || t END AS target FROM t),
    e0 AS (SELECT u, {key("target")} AS v FROM a), e AS (SELECT u, v FROM e0 WHERE u IS NOT NULL AND v IS NOT NULL UNION SELECT v, u FROM e0 WHERE u IS NOT NULL AND v IS NOT NULL),
    r AS (SELECT u AS n, u AS m FROM e UNION SELECT r.n, e.v FROM r JOIN e ON r.m = e.u),
    f AS (SELECT n, min(m) AS component, bool_or(coalesce(CASE {fits("translate(regexp_extract(m, '^[^/?#]*'), " + LOWER + ")", "regexp_extract(m, '^[^/?#]*([^?#]*)', 1)")} END, '') LIKE 'block%') AS blocked FROM r GROUP BY n),
    j AS (SELECT page_id, host, path, k, CASE {fits("host", "path")} END AS hit FROM p)
    SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule, coalesce(split_part(hit, ' ', 1), CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, component FROM j LEFT JOIN f ON f.n = j.k"""


NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {LOWER}), '{GAP}'), lambda x: x <> '') AS w FROM documents),
 g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
 n AS (SELECT doc_id, len(g) AS n FROM g), s AS (SELECT doc_id, hash(unnest(g)) AS h FROM g),
 meets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
 link AS (SELECT a, b FROM meets JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
 e AS (SELECT a, b FROM link UNION SELECT b, a FROM link), r AS (SELECT a AS n, a AS m FROM e UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a), c AS (SELECT n, min(m) AS component_id FROM r GROUP BY n),
 cls AS (SELECT doc_id, CASE WHEN len(g) > 0 THEN min(doc_id) OVER (PARTITION BY list_sort(g)) ELSE doc_id END AS class_id FROM g)
 SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(component_id, n.doc_id) AS component_id, coalesce(component_id, n.doc_id) = n.doc_id AS kept, class_id FROM n LEFT JOIN c ON c.n = n.doc_id JOIN cls USING (doc_id)"""

TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
 SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": _licenses(), "op3_chat_trees": CHAT, "op4_url_filter": _urls(), "op6_near_duplicates": NEAR, "op10_nra_topk": TOPK}
