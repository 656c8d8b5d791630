"""DuckDB counterparts of the queries that SQL can express, written from the results' definitions."""

from __future__ import annotations

from tickloom.llm import quality_rules as rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _reach(links: str, nodes: str) -> str:
    """CTEs ``both`` and ``low``: the smallest node reachable over undirected ``links(x, y)``."""
    return f"""both_ways AS (SELECT x, y FROM {links} UNION ALL SELECT y, x FROM {links}),
reach(node, other) AS (SELECT id, id FROM {nodes} UNION SELECT r.node, b.y FROM reach r JOIN both_ways b ON b.x = r.other),
low AS (SELECT node, min(other) AS low FROM reach GROUP BY node),
degree AS (SELECT x AS node, count(*) AS n FROM both_ways GROUP BY x)"""


def archives() -> str:
    # Base32 of the digest: five hexadecimal digits at a time are four letters.
    letters = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {} + 1, 1)"
    group = " || ".join(letters.format(f"((('0x' || substr(h, i, 5))::bigint >> {shift}) & 31)::int") for shift in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, strlen(html)::bigint AS payload_bytes, array_to_string(list_transform([1, 6, 11, 16, 21, 26, 31, 36], lambda i: {group}), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to, NULL::varchar AS error
FROM p JOIN f USING (h)"""


def jaccard() -> str:
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 5 * c >= 4 * (p.n + q.n - c)),
ids AS (SELECT doc_id AS id FROM documents),
{_reach("links", "ids")}
SELECT id AS doc_id, low AS class_id, coalesce(n, 0)::bigint AS n_links, id = low AS kept
FROM ids JOIN low ON low.node = id LEFT JOIN degree ON degree.node = id"""


def vectors() -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::double[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.id AS x, b.id AS y FROM good a JOIN good b ON a.id < b.id AND len(a.e) = len(b.e)
          WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.9),
ids AS (SELECT id FROM v),
{_reach("links", "ids")}
SELECT id AS vec_id, coalesce(n, 0)::bigint AS n_links, low AS component_id, id = low AS kept
FROM ids JOIN low ON low.node = id LEFT JOIN degree ON degree.node = id"""


def quality() -> str:
    p = len(rules.FEATURES)
    lower = [(i, j) for i in range(p) for j in range(i + 1)]
    symbols = "".join(rules.SYMBOLS)

    def grid(value: str) -> str:
        return f"floor(({value}) * {rules.UNIT} + 0.5)::bigint"

    z: list[str] = []
    for i in range(p):
        rest = f"x{i} / {rules.UNIT} - m{i}" + "".join(f" - l{i}{j} * z{j}" for j in range(i))
        z.append(f"({rest}) / l{i}{i} AS z{i}")

    def distance(source: str) -> str:
        """Forward substitution, one z after the other."""
        for k, step in enumerate(z):
            source = f"SELECT *, {step} FROM ({source}) d{k}"
        return f"SELECT *, 0.0::double + " + " + ".join(f"z{k} * z{k}" for k in range(p)) + f" AS distance FROM ({source}) d"

    ctes = [
        f"t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents)",
        """win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM t)""",
        "often AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1)",
        "rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM often, range(5) r(k) GROUP BY doc_id)",
        r"ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t)",
        f"""base AS (SELECT t.doc_id, lang, source, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars,
  (length(text) - length(translate(text, '{symbols}', '')))::bigint AS n_symbols, (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines,
  coalesce(rep.n, 0)::bigint AS n_repeat_words FROM t JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id))""",
        f"""st AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  {grid("4.0::double * ln((word_chars + 1.0::double) / greatest(n_words, 1)::double)")} AS x0, {grid("ln(1.0::double + 100.0::double * n_symbols / greatest(word_chars, 1))")} AS x1,
  {grid("ln(1.0::double + 20.0::double * n_dup_lines / greatest(n_words, 1)::double)")} AS x2, {grid("ln(1.0::double + 5.0::double * n_repeat_words / greatest(n_words, 1)::double)")} AS x3,
  coalesce('=' || lang, '-') AS lk, coalesce('=' || source, '-') AS sk FROM base)""",
        "g AS (SELECT lk, sk, count(*) AS n FROM st WHERE NOT base_failed GROUP BY ALL)",
        f"gl AS (SELECT *, sum(CASE WHEN n < {rules.MIN_GROUP} THEN n ELSE 0 END) OVER (PARTITION BY lk) AS nl FROM g)",
        f"gp AS (SELECT lk, sk, n, CASE WHEN n >= {rules.MIN_GROUP} THEN lk || '|' || sk WHEN nl >= {rules.MIN_GROUP} THEN lk || '|*' ELSE '*|*' END AS pool FROM gl)",
        f"pools AS (SELECT lk, sk, pool FROM gp QUALIFY sum(n) OVER (PARTITION BY pool) >= {rules.MIN_GROUP})",
        "vec AS (SELECT pool, x0, x1, x2, x3 FROM st JOIN pools USING (lk, sk) WHERE NOT base_failed)",
        "e0 AS (SELECT pool, " + ", ".join(f"quantile_cont(x{i}, 0.5) / {rules.UNIT} AS m{i}" for i in range(p)) + ", "
        + ", ".join(f"{1.0 if i == j else 0.0}::double AS l{i}{j}" for i, j in lower) + " FROM vec GROUP BY pool)",
    ]
    sums = ", ".join([f"sum(x{i}) AS s{i}" for i in range(p)] + [f"sum(x{i} * x{j}) AS q{i}{j}" for i, j in lower])
    upper_sums = ", ".join([f"sum(s{i}) AS s{i}" for i in range(p)] + [f"sum(q{i}{j}) AS q{i}{j}" for i, j in lower])
    for k in range(rules.STEPS + 1):
        ctes.append(f"d{k + 1} AS ({distance(f'SELECT * FROM vec JOIN e{k} USING (pool)')})")
        ctes.append(f"b{k + 1} AS (SELECT pool, floor(log2(distance + 1e-6) * 16.0) AS bin, count(*) AS n, {sums} FROM d{k + 1} GROUP BY ALL)")
        ctes.append(f"""h{k + 1} AS (SELECT pool, sum(n) AS n, {upper_sums} FROM (SELECT *, sum(n) OVER (PARTITION BY pool ORDER BY bin) - n AS before_bin, sum(n) OVER (PARTITION BY pool) AS every FROM b{k + 1}) y
  WHERE before_bin < every * {rules.SUBSET} GROUP BY pool)""")
        means = ", ".join(f"s{i}::double / n / {rules.UNIT} AS m{i}" for i in range(p))
        source = f"SELECT *, {means} FROM h{k + 1}"
        cov = ", ".join(f"q{i}{j}::double / n / {rules.UNIT * rules.UNIT} - m{i} * m{j} + {rules.FLOOR if i == j else 0.0} AS c{i}{j}" for i, j in lower)
        source = f"SELECT *, {cov} FROM ({source}) u"
        for j in range(p):
            own = f"c{j}{j}" + "".join(f" - l{j}{m} * l{j}{m}" for m in range(j))
            source = f"SELECT *, sqrt(greatest({own}, {rules.FLOOR / 2})) AS l{j}{j} FROM ({source}) v{j}"
            for i in range(j + 1, p):
                off = f"c{i}{j}" + "".join(f" - l{i}{m} * l{j}{m}" for m in range(j))
                source = f"SELECT *, ({off}) / l{j}{j} AS l{i}{j} FROM ({source}) w{i}{j}"
        ctes.append(f"e{k + 1} AS MATERIALIZED (SELECT pool, {', '.join(f'm{i}' for i in range(p))}, {', '.join(f'l{i}{j}' for i, j in lower)} FROM ({source}) f)")
    joined = distance(f"SELECT * FROM st LEFT JOIN (SELECT * FROM pools JOIN e{rules.STEPS + 1} USING (pool)) e USING (lk, sk)")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(distance <= {rules.CUTOFF}, true) AS kept FROM ({joined}) r"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, a bit at a time."""
    bits = f"list_transform(range(0, 8 * length({text})), lambda k: (ascii(substr({text}, k // 8 + 1, 1)) >> (k % 8)) & 1)"
    return f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384), 4294967295::bigint), 4294967295)"


def chats() -> str:
    code = lambda t: f"replace(replace(replace({t}, '\\', '\\\\'), '#', '\\#'), '</', '<\\/')"
    return f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t.turn, t.role, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM r),
c AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS spoken,
        coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss,
        sum(length('### ' || url_encode(role) || ': ' || {code('text')} || '</turn>') + 1) AS formatted,
        string_agg(role, ',' ORDER BY i) AS roles, bool_and(role IN ('system', 'user', 'assistant')) AS usual FROM o GROUP BY conv_id)
SELECT conv_id, CASE WHEN roles IN ('user,assistant', 'system,user,assistant') AND draw = 0 THEN 'prompt'
         WHEN roles IN ('user,assistant', 'system,user,assistant') AND draw = 1 THEN 'instruction'
         WHEN usual AND draw = 2 THEN 'shared' WHEN draw = 3 THEN 'dialog' ELSE 'messages' END AS layout,
       n::bigint AS n_turns, sha256(spoken) AS turns_sha256, length(loss)::bigint AS loss_chars, sha256(loss) AS loss_sha256, formatted::bigint AS formatted_chars
FROM (SELECT *, {_crc32("conv_id::varchar")} % 5 AS draw FROM c)"""


def trie() -> str:
    return f"""WITH r AS MATERIALIZED (SELECT conv_id, strlen(coalesce(text, '')) AS b, md5(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) AS g, turn
  FROM conversations WHERE conv_id IS NOT NULL),
o AS MATERIALIZED (SELECT conv_id, b, g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS i FROM r),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32("conv_id::varchar")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM r)),
u AS (SELECT c.conv_id, 0 AS part, i, b, g FROM c JOIN o ON o.conv_id = base AND i <= h UNION ALL SELECT c.conv_id, 1, i, b, g FROM c JOIN o ON o.conv_id = c.conv_id AND i > h),
s AS MATERIALIZED (SELECT conv_id, b, g, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d FROM u),
p AS MATERIALIZED (SELECT conv_id, d, b, md5(string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c),
q AS MATERIALIZED (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS up, lead(k) OVER (PARTITION BY conv_id ORDER BY d) IS NULL AS last FROM p),
n AS MATERIALIZED (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, min(b) AS b, min(up) AS up, coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (last), '') AS ends FROM q GROUP BY d, k),
m AS MATERIALIZED (SELECT up AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
w AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN m USING (d, k)),
t AS (SELECT a.d, a.k, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.b) AS saved FROM w JOIN p a ON a.conv_id = w.conv_id AND a.d <= w.d GROUP BY a.d, a.k)
SELECT w.conv_id, w.d::bigint AS depth, x.conv_id AS parent_conv_id, w.n_convs::bigint AS n_convs, w.n_children::bigint AS n_children, n_leaves::bigint AS n_leaves,
       saved::bigint AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN t USING (d, k) LEFT JOIN w x ON x.d = w.d - 1 AND x.k = w.up"""


def manifest(source_levels: int = 14, top_levels: int = 10) -> str:
    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::varchar) || ':' || {c} END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def up(nodes: str, paths: str, levels: int) -> list[str]:
        """CTEs that fold ``nodes(t, i, n, h)`` and lift ``paths(rid, t, i, n, acc, f)`` level by level; a finished tree stays."""
        out = []
        for k in range(levels):
            out.append(f"""{nodes}{k + 1} AS MATERIALIZED (SELECT t, i // 3 AS i, (n + 2) // 3 AS n, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM {nodes}{k} GROUP BY t, i // 3, n),
{paths}{k + 1} AS MATERIALIZED (SELECT rid, p.t, p.i // 3 AS i, (p.n + 2) // 3 AS n, p.acc || coalesce(string_agg(q.h, '' ORDER BY q.i) FILTER (q.i <> p.i), '') AS acc,
    CASE WHEN p.n = 1 THEN p.f ELSE sha256(coalesce(string_agg(q.h, '' ORDER BY q.i) FILTER (q.i < p.i), '') || p.f || coalesce(string_agg(q.h, '' ORDER BY q.i) FILTER (q.i > p.i), '')) END AS f
  FROM {paths}{k} p JOIN {nodes}{k} q ON q.t = p.t AND q.i // 3 = p.i // 3 GROUP BY rid, p.t, p.i, p.n, p.acc, p.f)""")
        return out

    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, *, CASE WHEN {_crc32("coalesce(doc_id, 0)::varchar")} % 2 = 0 AND doc_id IS NOT NULL THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
l AS MATERIALIZED (SELECT rid, doc_id, coalesce('=' || source, '') AS t, {leaf('text')} AS leaf, {leaf('changed')} AS f FROM d),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM l),
a0 AS MATERIALIZED (SELECT t, i, n, leaf AS h FROM o), p0 AS MATERIALIZED (SELECT rid, t, i, n, '' AS acc, f FROM o),
{", ".join(up("a", "p", source_levels))},
b0 AS MATERIALIZED (SELECT 0 AS t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n, h, t AS src FROM a{source_levels}),
r0 AS MATERIALIZED (SELECT rid, 0 AS t, b0.i, b0.n, acc, f FROM p{source_levels} p JOIN b0 ON b0.src = p.t),
{", ".join(up("b", "r", top_levels))}
SELECT doc_id, leaf, a.h AS subroot, b.h AS root, sha256(r.acc) AS proof_sha256, r.f AS folded_root, r.f = b.h AS verified
FROM o JOIN a{source_levels} a USING (t) JOIN r{top_levels} r USING (rid) CROSS JOIN b{top_levels} b"""
