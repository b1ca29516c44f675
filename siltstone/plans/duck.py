"""The registered queries as DuckDB SQL over the same tables, written from the definitions, not from the Spark plans."""

from __future__ import annotations

TOKEN = r"'[a-z0-9]+|[\x{3400}-\x{9fff}]|[^ ]+'"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"regexp_extract_all({norm(x)}, {TOKEN})"


def compact(x: str) -> str:
    return f"replace({norm(x)}, ' ', '')"


def ascii_(x: str) -> str:
    return f"regexp_replace({norm(x)}, '[^a-z0-9]', '', 'g')"


def rounded(factor: float, least: int, w: str = "w") -> str:
    return f"greatest({float(least)}::DOUBLE, floor({w} * {factor!r}::DOUBLE + 0.5::DOUBLE))"


def features(parts: str) -> str:
    """CTEs from parts(doc_ord, scope, w, text, url) to raw(doc_ord, ft, term, s): all channels' summed scores, capped."""
    prefixes = " UNION ALL ".join(f"SELECT doc_ord, 1 AS ft, substr(t, 1, {k}) AS term, {rounded(0.4, 6)} AS s FROM tk WHERE regexp_full_match(t, '[a-z0-9]+') AND length(t) >= {k}" for k in (2, 3, 4))
    wholes = " UNION ALL ".join(f"SELECT doc_ord, 1, substr(joined, 1, {k}), {rounded(0.56, 6)} FROM fld WHERE length(joined) BETWEEN 3 AND 32 AND length(joined) >= {k}" for k in (2, 3, 4))
    widths = " UNION ALL ".join(
        f"SELECT doc_ord, scope, w, pos, {k} AS width, {' || '.join(f't{i}' if i else 't' for i in range(k))} AS joined, {' AND '.join(f'length(t{i}) >= 2' for i in range(1, k)) or 'true'} AS valid, {rounded(1.02 - (k - 1) * 0.16, 8)} AS s FROM tk" + (f" WHERE t{k - 1} IS NOT NULL" if k > 1 else "")
        for k in (1, 2, 3)
    )
    return f"""
parts AS ({parts}),
fld0 AS (SELECT doc_ord, scope, w, url, {tokens("text")} AS toks FROM parts WHERE text <> ''),
fld AS (SELECT *, array_to_string(list_filter(toks, lambda x: regexp_full_match(x, '[a-z0-9]+')), '') AS joined, array_to_string(toks, '') AS whole FROM fld0 WHERE NOT url),
tk0 AS (SELECT doc_ord, scope, w, url, unnest(toks) AS t, generate_subscripts(toks, 1) AS pos FROM fld0),
tk AS (SELECT *, lead(t) OVER one AS t1, lead(t, 2) OVER one AS t2 FROM tk0 WINDOW one AS (PARTITION BY doc_ord, scope ORDER BY pos)),
wins AS ({widths}),
firsts AS (SELECT * FROM wins WHERE length(joined) BETWEEN 3 AND 12 QUALIFY row_number() OVER (PARTITION BY doc_ord, scope, joined ORDER BY pos, width) = 1),
emis AS (
  SELECT doc_ord, 0 AS ft, t AS term, w AS s FROM tk WHERE length(t) >= 2
  UNION ALL {prefixes} UNION ALL {wholes}
  UNION ALL SELECT doc_ord, 2, joined, {rounded(1.28, 0)} FROM fld WHERE length(joined) BETWEEN 3 AND 32
  UNION ALL SELECT doc_ord, 3, whole, {rounded(1.08, 0)} FROM fld WHERE length(whole) BETWEEN 3 AND 32
  UNION ALL SELECT doc_ord, 3, joined, s FROM firsts WHERE width > 1 AND valid AND length(joined) >= 5
  UNION ALL SELECT DISTINCT doc_ord, 4, t || t1, s FROM (SELECT DISTINCT doc_ord, scope, t, t1, {rounded(0.22, 4)} AS s FROM tk WHERE NOT url AND regexp_full_match(t, '[\\x{{3400}}-\\x{{9fff}}]') AND regexp_full_match(t1, '[\\x{{3400}}-\\x{{9fff}}]'))
  UNION ALL SELECT doc_ord, 5, unnest([substr(joined, i, 2) for i in range(1, length(joined))]), {rounded(0.16, 4)} FROM fld WHERE length(joined) BETWEEN 3 AND 12),
raw AS (SELECT doc_ord, ft, term, least(sum(s), 65535::DOUBLE) AS s FROM emis GROUP BY ALL)"""


DOCS = """docs0 AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_ord, CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title, text AS body, source, lang FROM documents)"""
PARTS = "SELECT doc_ord, 0 AS scope, 5.0::DOUBLE AS w, title AS text, false AS url FROM docs0 UNION ALL SELECT doc_ord, 1, 1.0, body, false FROM docs0 UNION ALL SELECT doc_ord, 2, 1.0, source, false FROM docs0 UNION ALL SELECT doc_ord, 3, 120.0, lang, false FROM docs0"
BODY = r"regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')"
PAGES = f"docs0 AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS doc_ord, CAST(page_id AS VARCHAR) AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, {BODY} AS body, url AS link FROM pages)"
PAGE_PARTS = "SELECT doc_ord, 0 AS scope, 5.0::DOUBLE AS w, title AS text, false AS url FROM docs0 UNION ALL SELECT doc_ord, 1, 1.0, body, false FROM docs0 UNION ALL SELECT doc_ord, 2, 1.0, link, true FROM docs0"
GOODS = "docs0 AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS doc_ord, CAST(p_partkey AS VARCHAR) AS id, p_name, p_brand, p_type FROM part)"
GOOD_PARTS = "SELECT doc_ord, 0 AS scope, 5.0::DOUBLE AS w, p_name AS text, false AS url FROM docs0 UNION ALL SELECT doc_ord, 1, 3.0, p_brand, false FROM docs0 UNION ALL SELECT doc_ord, 2, 1.0, p_type, false FROM docs0"

#: Single deletions of a term, in order.
ONE = "list_filter([substr({t}, 1, i) || substr({t}, i + 2) for i in range(0, length({t}))], lambda x: x <> '')"


def deleted(t: str) -> str:
    """The distinct strings of one deletion, or of up to two for six characters, each single one followed by its own at later places."""
    one = f"list_transform(range(0, length({t})), lambda i: substr({t}, 1, i) || substr({t}, i + 2))"
    two = f"flatten(list_transform(range(0, length({t})), lambda i: list_concat([substr({t}, 1, i) || substr({t}, i + 2)], list_transform(range(i, length({t}) - 1), lambda j: substr(substr({t}, 1, i) || substr({t}, i + 2), 1, j) || substr(substr({t}, 1, i) || substr({t}, i + 2), j + 2)))))"
    return f"CASE WHEN length({t}) >= 6 THEN {ordered(two)} ELSE {ordered(one)} END"


def ordered(items: str) -> str:
    """Distinct non-empty strings of a list in order of their first places."""
    return f"list_transform([{items}], lambda l: list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i))[1]"


def osa(a: str, b: str) -> str:
    """Edit distance with transpositions of neighbours: the rows of the edit matrix, each folded from the two before it.

    Within a row, a cell is the least over the cells to its left of that one's own value, before insertions, and the way from there.
    """
    i = "x[1][1]"
    own = f"least(s[2][j + 1] + 1, s[2][j] + CASE WHEN substr({a}, {i}, 1) = substr({b}, j, 1) THEN 0 ELSE 1 END, CASE WHEN {i} > 1 AND j > 1 AND substr({a}, {i}, 1) = substr({b}, j - 1, 1) AND substr({a}, {i} - 1, 1) = substr({b}, j, 1) THEN s[1][j - 1] + 1 END)"
    row = f"list_transform([list_concat([{i}], list_transform(range(1, length({b}) + 1), lambda j: {own}))], lambda c: list_transform(range(0, len(c)), lambda j: j + list_min(list_transform(c[1:j + 1], lambda v, k: v - k + 1))))[1]"
    return f"list_reduce(list_concat([[CAST([] AS BIGINT[]), range(0, length({b}) + 1)]], list_transform(range(1, length({a}) + 1), lambda i: [[i]])), lambda s, x: [s[2], {row}])[2][-1]"


def index(docs: str = DOCS, parts: str = PARTS, signal: tuple[str, ...] = ("title", "body", "source"), stored: tuple[str, ...] = ("title", "source", "lang")) -> str:
    """CTEs of an index of docs0: feats, postings, sigs and the deletions dels; 5 is the greatest weight of a field."""
    said, rest = f"concat_ws(' ', {', '.join(signal)})", ", ".join(stored)
    return f"""WITH {docs},{features(parts)},
total AS (SELECT count(*) AS n FROM docs0),
counted AS (SELECT ft, term, count(*) AS df, max(s) AS top FROM raw GROUP BY ft, term),
feats AS (SELECT c.* FROM counted c, total WHERE NOT ((ft IN (1, 4, 5) AND df > floor(n * 0.4::DOUBLE)) OR (ft = 3 AND df > greatest(16, floor(n * 0.08::DOUBLE))))),
postings AS (SELECT r.ft, r.term, r.doc_ord, CAST(floor(r.s) AS BIGINT) AS score FROM raw r JOIN feats f ON f.ft = r.ft AND f.term = r.term),
sig AS (SELECT *, CASE WHEN sa = '' THEN sc ELSE sa END AS signal_ascii FROM (SELECT *, substr({compact(said)}, 1, 2048) AS sc, substr({ascii_(said)}, 1, 2048) AS sa FROM docs0)),
sigs AS (SELECT *, sc AS signal_compact, {compact(f"concat_ws(' ', sc, {rest})")} AS gate_compact, {ascii_(f"concat_ws(' ', signal_ascii, {rest})")} AS gate_ascii FROM sig),
able AS (SELECT ft, term, df FROM feats WHERE ft IN (0, 2) AND regexp_full_match(term, '[a-z0-9]{{3,14}}') AND top >= 5),
dels AS (SELECT unnest({deleted("term")}) AS deletion, * FROM able)"""


INDEX = index()


def values(texts: list[str]) -> str:
    quoted = ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts))
    return f"queries(query_id, text) AS (VALUES {quoted})"


def analyzed(texts: list[str]) -> str:
    """CTEs to qt: the queries of two characters, with tokens and joins."""
    return f"""{values(texts)},
q0 AS (SELECT query_id, trim(text) AS text FROM queries WHERE length(trim(text)) >= 2),
q1 AS (SELECT query_id, {tokens("text")} AS toks, {compact("text")} AS compact, {ascii_("text")} AS joined FROM q0),
qq AS (SELECT *, list_filter(toks, lambda x: length(x) >= 2) AS longs FROM q1 WHERE compact <> ''),
qt AS (SELECT *, list_filter(longs, lambda x, i: list_position(longs, x) = i) AS terms, list_filter(toks, lambda x: regexp_full_match(x, '[a-z0-9]+'))[-1] AS last FROM qq)"""


OVERLAP = "len(list_intersect({a}, {b})) / greatest(len(list_distinct({a})), len(list_distinct({b})), 1)::DOUBLE"


def grams_of(x: str, k: int) -> str:
    return f"[substr({x}, i, {k}) for i in range(1, length({x}) - {k} + 2)]"


def near(weak: str) -> str:
    """CTEs from a table like qt to fuzzy: the indexed terms near its queries' terms, by deletions they share."""
    overlap = OVERLAP.format(a=grams_of("term", 2), b=grams_of("word", 2))
    return f"""calls AS (
  SELECT query_id, 0 AS call, CASE WHEN joined <> '' THEN joined ELSE compact END AS word FROM {weak} WHERE length(CASE WHEN joined <> '' THEN joined ELSE compact END) >= 3
  UNION ALL SELECT query_id, 1, last FROM {weak} WHERE last <> joined AND length(last) >= 3),
listed AS (SELECT *, list_concat([word], {deleted("word")}) AS own FROM calls),
wanted AS (SELECT query_id, call, word, unnest(own) AS deletion, generate_subscripts(own, 1) - 1 AS del_ord FROM listed),
met AS (SELECT w.query_id, w.call, w.word, d.ft, d.term, d.df, min(w.del_ord) AS del_ord FROM wanted w JOIN dels d USING (deletion) GROUP BY ALL),
close AS (
  SELECT *, CASE WHEN length(term) > 6 THEN 2 ELSE 1 END AS most, {osa("term", "word")} AS distance FROM met
  WHERE abs(length(term) - length(word)) <= 2 AND substr(term, 1, 1) = substr(word, 1, 1) AND {overlap} >= 0.34::DOUBLE),
fuzzy AS (SELECT *, row_number() OVER (PARTITION BY query_id, call ORDER BY del_ord, ft, term) AS rank FROM close WHERE distance <= most QUALIFY rank <= 12)"""


def searching(texts: list[str], made: str = INDEX, limit: int = 10, ratio: float = 0.18, keep: str = "true", prefilter: str = "true", rescore: str = "cents / 100.0::DOUBLE") -> str:
    """CTEs of the whole search up to hits(query_id, rank, id, score, doc_ord), fuzzy and the rest on the way."""
    pool = max(3 * limit, 24)
    anchors = [
        "SELECT query_id, 2 * i AS ord, 0 AS ft, t AS term, 100 AS mult, list_position(terms, t) - 1 AS bit, 2 AS pts FROM long",
        "SELECT query_id, 2 * i + 1, 1, t, 72, list_position(terms, t) - 1, 1 FROM long",
        "SELECT query_id, 1000000, 3, compact, 110, -1, 1 FROM qq WHERE length(compact) >= 3",
        "SELECT query_id, 1000001, 2, joined, 125, -1, 2 FROM qq WHERE length(joined) >= 3",
        "SELECT query_id, 1000002, 1, joined, 88, -1, 1 FROM qq WHERE length(joined) >= 3",
        "SELECT query_id, 1000003, 3, joined, 108, -1, 1 FROM qq WHERE length(joined) >= 3",
    ]
    return f"""{made}, {analyzed(texts)},
long AS (SELECT q.query_id, q.terms, unnest(q.longs) AS t, generate_subscripts(q.longs, 1) - 1 AS i FROM qt q),
anchors AS ({" UNION ALL ".join(anchors)}),
direct AS (SELECT a.query_id, sum(a.pts) AS direct FROM anchors a JOIN feats f ON f.ft = a.ft AND f.term = a.term GROUP BY 1),
weak AS (SELECT * FROM qt WHERE query_id NOT IN (SELECT query_id FROM direct WHERE direct >= 2)),
noise AS (
  SELECT query_id, 2000000 + 2 * (i - 1) AS ord, 5 AS ft, substr(compact, i, 2) AS term, 17 AS mult FROM (SELECT *, unnest(range(1, length(compact))) AS i FROM weak WHERE length(compact) BETWEEN 2 AND 24)
  UNION ALL SELECT query_id, 2000001 + 2 * (i - 1), 4, substr(compact, i, 2), 28 FROM (SELECT *, unnest(range(1, length(compact))) AS i FROM weak WHERE length(compact) BETWEEN 2 AND 24)
  UNION ALL SELECT query_id, 2500000 + i - 1, 5, substr(joined, i, 2), 22 FROM (SELECT *, unnest(range(1, length(joined))) AS i FROM weak WHERE length(joined) >= 3)),
{near("weak")},
probes AS (
  SELECT query_id, ord, ft, term, mult, bit, true AS anchor FROM anchors UNION ALL SELECT query_id, ord, ft, term, mult, -1, false FROM noise
  UNION ALL SELECT query_id, 3000000 + 1000 * call + rank, ft, term, CASE WHEN distance = 1 THEN 64 ELSE 42 END, -1, true FROM fuzzy),
touched AS (
  SELECT p.query_id, x.doc_ord, CAST(sum(x.score * p.mult) AS BIGINT) AS e2, bool_or(p.anchor) AS anchored, list_distinct(list(p.bit)) AS bits, min(p.ord) AS first
  FROM probes p JOIN postings x ON x.ft = p.ft AND x.term = p.term GROUP BY 1, 2),
nears AS (SELECT query_id, list(term) AS near FROM fuzzy GROUP BY 1),
strong AS (SELECT q.query_id, list_filter(list_concat(longs, [compact], CASE WHEN length(joined) >= 3 THEN [joined] ELSE [] END, coalesce(near, [])), lambda a: length(a) >= 2) AS strong FROM qt q LEFT JOIN nears USING (query_id)),
gated AS (
  SELECT t.*, s.* EXCLUDE (doc_ord), q.toks, q.terms, q.compact, q.joined FROM touched t JOIN sigs s USING (doc_ord) JOIN qt q USING (query_id) JOIN strong USING (query_id)
  WHERE ({prefilter}) AND (anchored OR len(list_filter(strong, lambda a: contains(s.gate_compact, a) OR contains(s.gate_ascii, a))) > 0)),
boosted AS (
  SELECT *, e2 + CASE WHEN length(compact) >= 3 AND contains(signal_compact, compact) THEN 10000 ELSE 0 END + CASE WHEN length(joined) >= 3 AND contains(signal_ascii, joined) THEN 12500 ELSE 0 END AS b2,
    len(terms) AS n, len(list_filter(terms, lambda t: list_contains(bits, list_position(terms, t) - 1) OR contains(signal_compact, t) OR contains(signal_ascii, t))) AS covered FROM gated),
scored AS (
  SELECT *, CASE WHEN len(toks) <= 1 OR n < 2 THEN b2 * 100 WHEN covered = n THEN b2 * 160 + 2000000 WHEN n >= 3 AND covered >= n - 1 THEN b2 * 118 + 600000
    WHEN covered = 0 THEN b2 * 40 WHEN n >= 3 AND covered = 1 THEN b2 * 70 ELSE b2 * 100 END AS e4 FROM boosted),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY e4 DESC, first, doc_ord) AS place FROM scored),
cand AS (SELECT *, (e4 + 50) // 100 AS cents FROM pool WHERE place <= {pool} AND ({keep})),
again AS (SELECT *, {rescore} AS score FROM cand),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM again),
hits AS (SELECT CAST(query_id AS BIGINT) AS query_id, rank, id, score, doc_ord FROM ranked WHERE (rank = 1 OR score >= greatest(0.0::DOUBLE, top * {ratio!r}::DOUBLE)) AND rank <= {limit})"""


def search(texts: list[str], **options) -> str:
    return f"{searching(texts, **options)} SELECT query_id, rank, id AS doc_id, score FROM hits"


def corrected(texts: list[str]) -> str:
    """Each query as it was meant, beside the corrections of its calls."""
    return f"""{searching(texts)},
corrections AS (SELECT query_id, call, word, term, distance FROM fuzzy QUALIFY row_number() OVER (PARTITION BY query_id, call ORDER BY distance, df DESC, rank) = 1),
pieces AS (SELECT query_id, trim(text) AS text, regexp_extract_all(trim(text), '[A-Za-z0-9]+|[^A-Za-z0-9]+') AS parts FROM queries),
each AS (SELECT query_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i FROM pieces),
swapped AS (SELECT e.query_id, e.i, coalesce(arg_min(c.term, c.call), any_value(e.piece)) AS piece FROM each e LEFT JOIN corrections c ON c.query_id = e.query_id AND c.word = lower(e.piece) AND c.word <> c.term GROUP BY 1, 2),
rebuilt AS (SELECT query_id, string_agg(piece, '' ORDER BY i) AS said FROM swapped GROUP BY 1)
SELECT CAST(p.query_id AS BIGINT) AS query_id, CASE WHEN lower(said) <> lower(text) THEN said END AS corrected_query, call, word AS "from", term AS "to", distance
FROM pieces p LEFT JOIN rebuilt r ON r.query_id = p.query_id LEFT JOIN corrections c ON c.query_id = p.query_id"""


ESCAPED = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"


def marked(source: str, key: str, before: str, after: str) -> str:
    """CTEs from source(key, text, spans) to html(key, html), character by character; spans: inclusive [start, end] pairs from 0."""
    inside = "len(list_filter(spans, lambda s: s[1] <= i AND i <= s[2])) > 0"
    return f"""flags AS (SELECT {key}, text, list_transform(range(0, length(text)), lambda i: {inside}) AS flag FROM {source}),
html AS (SELECT {key}, array_to_string(list_transform(range(1, length(text) + 1), lambda i:
  CASE WHEN flag[i] AND (i = 1 OR NOT flag[i - 1]) THEN '{before}' ELSE '' END || {ESCAPED.format(x="substr(text, i, 1)")} || CASE WHEN flag[i] AND (i = length(text) OR NOT flag[i + 1]) THEN '{after}' ELSE '' END), '') AS html FROM flags)"""


def wanted(x: str) -> str:
    """What to look for of a query, as a list of (needle) in order."""
    bigrams = f"CASE WHEN length({compact(x)}) BETWEEN 2 AND 24 THEN list_filter({grams_of(compact(x), 2)}, lambda g: regexp_matches(g, '[\\x{{3400}}-\\x{{9fff}}]')) ELSE [] END"
    every = f"list_filter(list_concat(list_filter({tokens(x)}, lambda t: length(t) >= 2), {bigrams}, [{ascii_(x)}, {compact(x)}]), lambda t: length(t) >= 2)"
    keyed = f"list_transform([{every}], lambda l: list_transform(list_filter(l, lambda t, i: list_position(l, t) = i), lambda t, i: {{'n': -length(t), 'i': i, 't': t}}))[1]"
    return f"list_transform(list_sort({keyed}), lambda k: k.t)"


def highlighted(texts: list[str]) -> str:
    """Hits with the places of their queries' needles in the stored fields, and the first field that has any."""
    return f"""{searching(texts)},
asked AS (SELECT query_id, {wanted("text")} AS needles FROM queries),
fielded AS (
  SELECT h.query_id, h.rank, h.id, f, field, coalesce(CASE WHEN f = 1 THEN d.title ELSE d.source END, '') AS text, a.needles
  FROM hits h JOIN docs0 d USING (doc_ord) JOIN asked a USING (query_id), (VALUES (1, 'title'), (2, 'source')) v(f, field)),
looked AS (SELECT *, unnest(needles) AS needle, generate_subscripts(needles, 1) AS turn FROM fielded),
split AS (SELECT *, string_split(lower(text), needle) AS parts FROM looked),
placed AS (SELECT *, unnest(range(1, len(parts))) AS k FROM split),
found AS (
  SELECT query_id, rank, id, f, field, turn, k, CAST(list_sum(list_transform(parts[1:k], lambda p: length(p))) + (k - 1) * length(needle) AS BIGINT) AS a, length(needle) AS n
  FROM placed QUALIFY row_number() OVER (PARTITION BY query_id, rank, f ORDER BY turn, k) <= 12),
grouped AS (SELECT *, a + n - 1 AS b, CASE WHEN a > max(a + n - 1) OVER (PARTITION BY query_id, rank, f ORDER BY a, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM found),
islands AS (SELECT *, sum(new) OVER (PARTITION BY query_id, rank, f ORDER BY a, n) AS island FROM grouped),
ranges AS (SELECT query_id, rank, f, field, island, min(a) AS a, max(b) AS b FROM islands GROUP BY ALL),
by_field AS (SELECT query_id, rank, f, field, list([a, b] ORDER BY a) AS spans, string_agg('{{"start":' || a || ',"end":' || b || '}}', ',' ORDER BY a) AS told FROM ranges GROUP BY 1, 2, 3, 4),
leads AS (SELECT query_id, rank, min(f) AS f, '[' || string_agg('{{"field":"' || field || '","ranges":[' || told || ']}}', ',' ORDER BY f) || ']' AS matches FROM by_field GROUP BY 1, 2),
chosen AS (SELECT x.query_id, x.rank, x.id, x.text, coalesce(b.spans, []) AS spans, coalesce(m.matches, '[]') AS matches FROM fielded x LEFT JOIN leads m USING (query_id, rank) LEFT JOIN by_field b ON b.query_id = x.query_id AND b.rank = x.rank AND b.f = x.f WHERE x.f = coalesce(m.f, 1)),
{marked("chosen", "query_id, rank", '<em class="hit">', "</em>")}
SELECT query_id, rank, id, html, matches FROM chosen JOIN html USING (query_id, rank)"""


def fixed(n: str, digits: int) -> str:
    """A number with so many decimals, halves up."""
    scaled = f"CAST(floor({n} * {10**digits} + 0.5::DOUBLE) AS BIGINT)"
    return f"(({scaled} // {10**digits}) || '.' || lpad(CAST({scaled} % {10**digits} AS VARCHAR), {digits}, '0'))"


def channel(*ftypes: int) -> str:
    return f"{INDEX} SELECT ft AS ftype, term, doc_ord, score FROM postings WHERE ft IN ({', '.join(map(str, ftypes))})"


STATS = "SELECT (SELECT n FROM total) AS docs, count(*) AS features, CAST(sum(df) AS BIGINT) AS postings, (SELECT count(DISTINCT deletion) FROM dels) AS correction_deletes FROM feats"


def queries() -> dict[str, str]:
    from siltstone.plans import registry as R

    han = ", ".join(f"({i}, '{t}')" for i, t in enumerate(R.HAN_TEXTS))
    turns = "SELECT conv_id * 100000 + turn AS doc_ord, 0 AS scope, 1.0::DOUBLE AS w, text, false AS url FROM conversations"
    suggested = ", ".join(f"({i}, '{t}')" for i, t in enumerate(R.SUGGESTED))
    needles = ", ".join(f"({i}, {t.split(' ')!r})" for i, t in enumerate([*R.SINGLE, *R.MULTI]))
    truth = f"SELECT CAST(q.query_id AS BIGINT) AS query_id, d.doc_id FROM documents d, (VALUES {needles}) q(query_id, needles) WHERE len(list_filter(needles, lambda x: NOT contains(lower(d.text), lower(x)))) = 0"
    esc = lambda x: ESCAPED.format(x=x)
    overlap = OVERLAP.format(a="a", b="b")
    mistyped = ", ".join(f"({i}, '{t}')" for i, t in enumerate(R.MISTYPED))
    spans = f"[{', '.join(f'[{a}, {b}]' for a, b in R.MARKED)}]"
    turned = f"turns AS (SELECT conv_id || '-' || turn AS turn_id, coalesce(text, '') AS text, {spans} AS spans FROM conversations)"
    pct = lambda p: f"list_sort(list(value))[least(count(*), greatest(1, CAST(floor({p / 100!r}::DOUBLE * count(*)) AS BIGINT) + 1))]"
    return {
        "normalize_documents": f"SELECT doc_id, {norm('text')} AS normalized FROM documents",
        "tokenize_documents": f"SELECT doc_id, array_to_string(toks, '|') AS tokens, len(toks) AS n_tokens FROM (SELECT doc_id, {tokens('text')} AS toks FROM documents)",
        "compact_join": f"SELECT doc_id, {compact('text')} AS compact FROM documents",
        "ascii_join": f"SELECT doc_id, {ascii_('text')} AS ascii FROM documents",
        "collapse_whitespace": r"SELECT page_id, trim(regexp_replace(html, '\s+', ' ', 'g')) AS collapsed FROM pages",
        "token_classes": f"SELECT doc_id, len(list_filter(toks, lambda x: regexp_full_match(x, '[a-z0-9]+'))) AS n_ascii, len(list_filter(toks, lambda x: regexp_full_match(x, '[\\x{{3400}}-\\x{{9fff}}]'))) AS n_han FROM (SELECT doc_id, {tokens('text')} AS toks FROM documents)",
        "token_bigrams": f"SELECT p_partkey, array_to_string(list_concat({grams_of('x', 2)}, {grams_of('x', 3)}), '|') AS grams FROM (SELECT p_partkey, lower(p_name) AS x FROM part)",
        "bigram_overlap_parts": f"SELECT p_partkey, round({overlap}, 6) AS overlap FROM (SELECT p_partkey, {grams_of('lower(p_name)', 2)} AS a, {grams_of('lower(p_type)', 2)} AS b FROM part)",
        "delete_variants": f"SELECT p_partkey, array_to_string({ordered(ONE.format(t='p_brand'))}, '|') AS one, array_to_string({deleted('p_brand')}, '|') AS two FROM part",
        "osa_distance_parts": f"SELECT p_partkey, CAST(least({osa('a', 'b')}, 61) AS INTEGER) AS distance FROM (SELECT p_partkey, lower(p_type) AS a, lower(p_name) AS b FROM part)",
        "format_units": f"""SELECT p_partkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN {fixed('n / 1024.0::DOUBLE', 1)} || ' KB' ELSE {fixed('n / 1048576.0::DOUBLE', 2)} || ' MB' END AS size,
            CASE WHEN ms >= 100 THEN {fixed('ms', 1)} WHEN ms >= 10 THEN {fixed('ms', 2)} ELSE {fixed('ms', 3)} END || ' ms' AS time,
            1 + CAST(sq >= 128 AS BIGINT) + CAST(sq >= 16384 AS BIGINT) + CAST(sq >= 2097152 AS BIGINT) + CAST(sq >= 268435456 AS BIGINT) + CAST(sq >= 34359738368 AS BIGINT) AS varint
            FROM (SELECT p_partkey, p_partkey * 977 AS n, p_partkey / 8.0::DOUBLE AS ms, p_partkey * p_partkey AS sq FROM part)""",
        "value_kinds": "SELECT o_orderkey, o_orderstatus || ' ' || o_orderpriority AS mapped, CASE WHEN o_totalprice > 150000 THEN 'true' ELSE 'false' END AS flagged FROM orders",
        "field_value_text": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || ' ' || o_orderstatus || ' ' || o_orderpriority AS joined, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS whole FROM orders",
        "escape_html": f"SELECT page_id, {esc('html')} AS escaped FROM pages",
        "exact_postings": channel(0),
        "prefix_postings": channel(1),
        "signal_features": channel(2),
        "compact_joins": channel(3),
        "ascii_bigrams": channel(5),
        "window_joins": f"WITH {features(turns)} SELECT doc_ord, term, CAST(s AS BIGINT) AS score FROM raw WHERE ft = 3",
        "han_bigrams": f"WITH {features(f'SELECT doc_ord, 0 AS scope, 100.0::DOUBLE AS w, text, false AS url FROM (VALUES {han}) v(doc_ord, text)')} SELECT CAST(doc_ord AS BIGINT) AS doc_ord, term, CAST(s AS BIGINT) AS score FROM raw WHERE ft = 4",
        "doc_signals": f"{INDEX} SELECT doc_ord, id, signal_compact, signal_ascii FROM sigs",
        "gate_signals": f"{INDEX} SELECT doc_ord, gate_compact, gate_ascii FROM sigs",
        "df_prune": f"{INDEX} SELECT ft AS ftype, count(*) AS features, max(df) AS top_df FROM feats GROUP BY ft",
        "index_manifest": f"{INDEX} {STATS}",
        "pages_index": f"{index(PAGES, PAGE_PARTS, ('title', 'body'), ('title', 'link'))} {STATS}",
        "pack_manifest": f"SELECT 'goods' AS name, * FROM ({index(GOODS.replace('p_type FROM part', f'substr(p_type, 1, 8) AS p_type FROM (SELECT * FROM part ORDER BY p_partkey LIMIT {R.PACKED})'), GOOD_PARTS, ('p_name', 'p_brand', 'p_type'), ('p_name', 'p_brand', 'p_type'))} {STATS}) UNION ALL SELECT 'pages', * FROM ({index(PAGES, PAGE_PARTS, ('title', 'body'), ('title', 'link'))} {STATS})",
        "correction_deletes": f"{INDEX} SELECT deletion, ft AS ftype, term, df FROM dels",
        "docs_listing": f"WITH {DOCS} SELECT doc_ord, id, title, source, lang AS tags FROM docs0",
        "index_round_trip": search([*R.SINGLE, *R.TYPOS]),
        "search_single": search(R.SINGLE),
        "search_multi_token": search(R.MULTI),
        "search_joined": search(R.JOINED),
        "search_prefix": search(R.PREFIXES),
        "search_bigram_fallback": search(R.FALLBACK),
        "search_filtered": search(R.SINGLE, keep="lang = 'en'"),
        "search_prefiltered": search(R.SINGLE, prefilter="lang = 'en'"),
        "search_rescored": search(R.SINGLE, rescore="cents / 100.0::DOUBLE + doc_ord % 7 * 10"),
        "search_limited": search([*R.SINGLE, *R.MULTI], limit=3, ratio=0.5),
        "search_fuzzy": search(R.TYPOS),
        "search_gibberish": f"{searching(R.GIBBERISH)} SELECT CAST(q.query_id AS BIGINT) AS query_id, count(h.id) AS hits FROM queries q LEFT JOIN hits h USING (query_id) GROUP BY 1",
        "parts_search": search(R.GOODS, made=index(GOODS, GOOD_PARTS, ("p_name", "p_brand", "p_type"), ("p_name", "p_brand", "p_type"))),
        "fuzzy_candidates": f'{INDEX}, {analyzed(R.TYPOS)}, {near("qt")} SELECT CAST(query_id AS BIGINT) AS query_id, call, word AS "from", ft AS ftype, term, df, del_ord, distance, rank FROM fuzzy',
        "did_you_mean": corrected(R.TYPOS),
        "suggest_fuzzy": f"""{INDEX}, asked AS (SELECT query_id, p, CASE WHEN length(p) >= 6 THEN 2 ELSE 1 END AS most FROM (VALUES {mistyped}) v(query_id, p)),
            e AS (SELECT term, df FROM feats WHERE ft = 0),
            begun AS (SELECT query_id, term, df, row_number() OVER (PARTITION BY query_id ORDER BY term = p DESC, df DESC, length(term), term) AS rank FROM e, asked WHERE starts_with(term, p) QUALIFY rank <= 8),
            close AS (SELECT query_id, term, df, most, least({osa("substr(term, 1, length(p))", "p")}, {osa("substr(term, 1, length(p) + 1)", "p")}) AS distance FROM e, asked
              WHERE query_id NOT IN (SELECT query_id FROM begun) AND length(p) >= 3 AND substr(term, 1, 1) = substr(p, 1, 1) AND length(term) >= length(p) - 1),
            best AS (SELECT query_id, term, df, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, df DESC, term) AS rank FROM close WHERE distance <= most QUALIFY rank <= 8)
            SELECT CAST(query_id AS BIGINT) AS query_id, rank, term, df AS doc_frequency, 'prefix' AS kind, CAST(NULL AS INTEGER) AS distance FROM begun
            UNION ALL SELECT query_id, rank, term, df, 'fuzzy', CAST(distance AS INTEGER) FROM best""",
        "highlight_hits": highlighted([*R.SINGLE, *R.MULTI]),
        "render_ranges": f"WITH {turned}, {marked('turns', 'turn_id', '<mark>', '</mark>')} SELECT turn_id, '0-2,4-10,30-31' AS merged, html FROM html",
        "highlight_segments": f"""WITH {turned}, chars AS (SELECT turn_id, text, i, len(list_filter(spans, lambda s: s[1] <= i AND i <= s[2])) > 0 AS highlighted FROM (SELECT *, unnest(range(0, length(text))) AS i FROM turns)),
            turned AS (SELECT *, CASE WHEN highlighted <> lag(highlighted) OVER (PARTITION BY turn_id ORDER BY i) THEN 1 ELSE 0 END AS new FROM chars),
            pieces AS (SELECT *, sum(new) OVER (PARTITION BY turn_id ORDER BY i) AS piece FROM turned)
            SELECT turn_id, CAST(piece AS INTEGER) AS piece, highlighted, substr(any_value(text), min(i) + 1, max(i) - min(i) + 1) AS text FROM pieces GROUP BY turn_id, piece, highlighted
            UNION ALL SELECT turn_id, 0, false, '' FROM turns WHERE text = ''""",
        "highlight_needles": f"SELECT item_id, array_to_string({wanted('text')}, ' ') AS needles FROM benchmark",
        "rewrite_queries": r"SELECT conv_id * 100000 + turn AS query_id, CASE WHEN lower(r) <> lower(trim(text)) THEN r END AS corrected_query FROM (SELECT *, array_to_string([CASE WHEN lower(p) = 'the' THEN 'that' ELSE p END for p in regexp_extract_all(trim(text), '[A-Za-z0-9]+|[^A-Za-z0-9]+')], '') AS r FROM conversations)",
        "suggest_prefix": f"{INDEX} SELECT CAST(query_id AS BIGINT) AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY term = p DESC, df DESC, length(term), term) AS rank, term, df AS doc_frequency, 'prefix' AS kind, CAST(NULL AS INTEGER) AS distance FROM feats, (VALUES {suggested}) v(query_id, p) WHERE ft = 0 AND regexp_full_match(p, '[a-z0-9]+') AND starts_with(term, p) QUALIFY rank <= 8",
        "substring_truth": truth,
        "recall_at_10": f"WITH hits AS ({search([*R.SINGLE, *R.MULTI])}), truth AS ({truth}), m AS (SELECT query_id, least(count(*), 10) AS m FROM truth GROUP BY 1) SELECT m.query_id, round(count(t.doc_id) / m.m::DOUBLE, 6) AS recall FROM m LEFT JOIN hits h ON h.query_id = m.query_id AND h.rank <= m.m LEFT JOIN truth t ON t.query_id = h.query_id AND CAST(t.doc_id AS VARCHAR) = h.doc_id GROUP BY m.query_id, m.m",
        "latency_statistics": f"SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS stddev, round({pct(50)}, 6) AS p50, round({pct(95)}, 6) AS p95, round({pct(99)}, 6) AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type",
        "latency_ring": "SELECT event_id, list_sort(r)[CAST(floor(0.5::DOUBLE * (len(r) - 1)) AS BIGINT) + 1] AS p50 FROM (SELECT event_id, list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS r FROM events)",
        "token_jaccard": f"SELECT doc_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE END, 6) AS jaccard FROM (SELECT doc_id, {tokens('text')} AS a, {tokens('split_part(text, chr(10), 1)')} AS b FROM documents)",
    }
