"""DuckDB SQL for the queries of this package that SQL can express, written independently of the operators.

The SQL compares everything with everything where the operators search: windows of words as strings, all pairs of
texts that share a shingle, all places of a template.
"""

from __future__ import annotations

from lectern.llm.common import LOWER, UPPER, WORD
from lectern.llm.licenses import PASSAGES, PHRASES

WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"


def grams(source: str, key: str, size: str) -> str:
    """(key, place, gram) of all runs of ``size`` words of the list w."""
    return f"SELECT {key}, s, array_to_string(w[s:s + {size} - 1], ' ') AS g FROM {source}, unnest(range(1, len(w) - {size} + 2)) AS u(s) WHERE len(w) > 0"


DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {WORDS} AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), 10) AS k FROM b),
iw AS (SELECT DISTINCT item, k, g FROM ({grams("sized", "item, k", "k")})),
asked AS (SELECT r, w, k FROM d CROSS JOIN (SELECT DISTINCT k FROM iw)),
dw AS ({grams("asked", "r, k", "k")}),
hits AS (SELECT DISTINCT r, s, dw.k AS k, item FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + k)) AS u(p) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN found USING (r)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
n AS (SELECT row_number() OVER (ORDER BY text) AS id, text, {WORDS} AS w FROM texts),
c AS (SELECT id, g, count(*) AS n FROM ({grams("n", "id", "least(len(w), 5)")}) GROUP BY id, g),
total AS (SELECT id, sum(n) AS n FROM c GROUP BY id),
pairs AS (SELECT x.id AS a, y.id AS b, sum(least(x.n, y.n)) AS shared FROM c x JOIN c y ON x.g = y.g AND x.id < y.id GROUP BY x.id, y.id),
links AS (SELECT a, b FROM pairs JOIN total s ON s.id = a JOIN total t ON t.id = b WHERE CAST(shared AS DOUBLE) / CAST(s.n + t.n - shared AS DOUBLE) >= 0.8),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, root) AS (SELECT id, id FROM n WHERE len(w) > 0 UNION SELECT edges.b, reach.root FROM reach JOIN edges ON edges.a = reach.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
named AS (SELECT doc_id, root FROM documents d LEFT JOIN n ON n.text = d.text LEFT JOIN roots ON roots.id = n.id)
SELECT doc_id, CASE WHEN root IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY root) END AS class_id FROM named
"""

_phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
_passages = ", ".join(f"({i}, '{label}', string_split('{text}', ' '))" for i, (label, text, _) in enumerate(PASSAGES))
_keys = ", ".join(f"({i}, '{phrase}', {(' ' + text + ' ').partition(' ' + phrase + ' ')[0].count(' ')})" for i, (_, text, phrases) in enumerate(PASSAGES) for phrase in phrases)

LICENSES = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS} AS w FROM documents),
phrases(phrase, label, k) AS (VALUES {_phrases}),
asked AS (SELECT r, w, phrase, label, k FROM d CROSS JOIN phrases),
base AS (SELECT r, s, label FROM ({grams("asked", "r, phrase, label", "k")}) WHERE g = phrase),
based AS (SELECT r, count(*) AS n_base, min(s) - 1 AS first_word, max(s) - 1 AS last_word FROM base GROUP BY r),
t(t, label, w) AS (VALUES {_passages}),
keys(t, key, start) AS (VALUES {_keys}),
tw AS (SELECT t, p - 1 AS pos, w[p] AS word FROM t, unnest(range(1, len(w) + 1)) AS u(p)),
dw AS (SELECT r, p - 1 AS i, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(p) WHERE w[p] IN (SELECT word FROM tw)),
df AS (SELECT word, count(DISTINCT r) AS n FROM dw GROUP BY word),
weights AS (SELECT word, ln((SELECT count(*) + 1 FROM d) / CAST(coalesce(n, 0) + 1 AS DOUBLE)) + CAST(0.1 AS DOUBLE) AS weight FROM (SELECT DISTINCT word FROM tw) LEFT JOIN df USING (word)),
shown AS (SELECT r, ' ' || array_to_string(w, ' ') || ' ' AS norm FROM d),
gated AS (SELECT r, t FROM shown, keys WHERE contains(norm, ' ' || key || ' ') GROUP BY r, t HAVING count(*) = (SELECT count(*) FROM keys k WHERE k.t = keys.t)),
mine AS (SELECT r, t, word, row_number() OVER (PARTITION BY r, t ORDER BY weight DESC, pos) AS k FROM (SELECT r, t, word, weight, min(pos) AS pos FROM gated JOIN tw USING (t) JOIN weights USING (word) WHERE EXISTS (SELECT 1 FROM dw WHERE dw.r = gated.r AND dw.word = tw.word) GROUP BY r, t, word, weight)),
rare AS (SELECT r, t, word, count(*) OVER (PARTITION BY r, t) AS n FROM mine WHERE k <= 6),
offsets AS (SELECT rare.r AS r, rare.t AS t, i - pos AS place FROM rare JOIN tw ON tw.t = rare.t AND tw.word = rare.word JOIN dw ON dw.r = rare.r AND dw.word = rare.word GROUP BY rare.r, rare.t, i - pos HAVING count(*) >= ceil(any_value(n) * 0.75)),
keyed AS (SELECT o.r, o.t, place FROM offsets o JOIN keys k ON k.t = o.t JOIN d ON d.r = o.r WHERE array_to_string(d.w[place + k.start + 1:place + k.start + len(string_split(key, ' '))], ' ') = key AND place + k.start >= 0 GROUP BY o.r, o.t, place HAVING count(*) = (SELECT count(*) FROM keys x WHERE x.t = o.t)),
totals AS (SELECT t, sum(weight) AS total FROM tw JOIN weights USING (word) GROUP BY t),
shares AS (SELECT k.r AS r, k.t AS t, place, round(sum(weight) / any_value(total), 9) AS share FROM keyed k JOIN tw ON tw.t = k.t JOIN dw ON dw.r = k.r AND dw.word = tw.word AND dw.i = place + tw.pos JOIN weights ON weights.word = tw.word JOIN totals ON totals.t = k.t GROUP BY k.r, k.t, place),
good AS (SELECT r, label FROM shares JOIN t USING (t) WHERE share >= 0.75),
own AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM good) GROUP BY r),
best AS (SELECT r, max(share) AS score FROM shares GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, CAST(0 AS DOUBLE)) AS score
FROM d LEFT JOIN based USING (r) LEFT JOIN own USING (r) LEFT JOIN every USING (r) LEFT JOIN best USING (r)
"""


#: Segments of a path at which the SQL stops; no path of the tables has more.
DEPTH = 5
#: The contract's figures: children from which a node is variable, of fewer pages each than so many; standard errors; pseudo-labels.
FANOUT, SUPPORT, APART, PRIOR = 12, 4, "CAST(2.58 AS DOUBLE)", "CAST(4 AS DOUBLE)"


def _named(source: str, part: str, wildcard: str, needs: str) -> str:
    """Each child's own name, or the wildcard, by windows over its siblings."""
    one, other = "CAST(labelled AS DOUBLE)", "CAST(sum(labelled) OVER v - labelled AS DOUBLE)"
    p = "((sum(good) OVER v + 1) / CAST(sum(labelled) OVER v + 2 AS DOUBLE))"
    apart = f"labelled > 0 AND {other} > 0 AND {needs} AND abs(good / {one} - (sum(good) OVER v - good) / {other}) > {APART} * sqrt({p} * (1 - {p}) * (1 / {one} + 1 / {other}))"
    variable = f"count(*) OVER v >= {FANOUT} AND sum(n) OVER v < {SUPPORT} * count(*) OVER v"
    return f"SELECT *, CASE WHEN count(*) OVER v = 1 OR (NOT ({variable}) AND coalesce({apart}, false)) THEN child ELSE {wildcard} END AS name FROM {source} WINDOW v AS (PARTITION BY {part})"


def _level(k: int) -> str:
    """The prefix of every leaf after segment k."""
    return f"""
c{k} AS (SELECT host, prefix, shape[{k + 1}] AS child, regexp_replace(shape[{k + 1}], '[0-9]+', '#', 'g') AS grp, sum(n) AS n, sum(labelled) AS labelled, sum(good) AS good FROM l{k} WHERE len(shape) > {k} GROUP BY ALL),
g{k} AS ({_named(f"c{k}", "host, prefix, grp", "grp", f"n >= {SUPPORT}")}),
b{k} AS (SELECT host, prefix, name AS child, sum(n) AS n, sum(labelled) AS labelled, sum(good) AS good FROM g{k} GROUP BY ALL),
m{k} AS (SELECT g.host, g.prefix, g.child, b.name FROM g{k} g JOIN ({_named(f"b{k}", "host, prefix", "'*'", "true")}) b ON b.host = g.host AND b.prefix = g.prefix AND b.child = g.name),
l{k + 1} AS (SELECT l.host AS host, l.shape AS shape, n, labelled, good, CASE WHEN m.name IS NULL THEN l.prefix ELSE l.prefix || '/' || m.name END AS prefix
  FROM l{k} l LEFT JOIN m{k} m ON m.host = l.host AND m.prefix = l.prefix AND m.child = l.shape[{k + 1}])"""


def urls(rules: list[tuple[str, str]]) -> str:
    def case(give: int) -> str:
        out = []
        for rule in sorted(rules, key=lambda r: -len(r[1])):
            host, _, path = rule[1].partition("/")
            out.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule[give]}'")
        return f"CASE {' '.join(out)} END"

    return f"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
split AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS shape FROM q),
shaped AS (SELECT page_id, host, path, shape FROM split),
known AS (SELECT doc_id AS id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality IS NULL AND toxic = 0 THEN NULL WHEN toxic IS NULL AND quality = 1 THEN NULL WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
l0 AS (SELECT host, shape, count(*) AS n, count(good) AS labelled, coalesce(sum(good), 0) AS good, '' AS prefix FROM shaped LEFT JOIN known ON page_id = id GROUP BY host, shape),
{",".join(_level(k) for k in range(DEPTH))},
overall AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(good) / CAST(sum(labelled) AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS share FROM l0),
trees AS (SELECT host, shape, labelled, good, CASE WHEN prefix = '' THEN '/' ELSE prefix END AS template FROM l{DEPTH}),
pure AS (SELECT host, template, (sum(good) + {PRIOR} * any_value(share)) / (sum(labelled) + {PRIOR}) AS purity FROM trees CROSS JOIN overall GROUP BY host, template),
judged AS (SELECT page_id, s.host AS host, path, t.template AS template, purity, {case(1).replace("host", "s.host")} AS rule, {case(0).replace("host", "s.host")} AS said
  FROM shaped s JOIN trees t ON t.host = s.host AND t.shape = s.shape JOIN pure ON pure.host = t.host AND pure.template = t.template)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, purity FROM judged
"""
