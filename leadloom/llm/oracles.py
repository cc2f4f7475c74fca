"""SQL twins of the operators' queries, for DuckDB: plain definitions, without the methods.

None for op3, op6, op7 and op9 (models, tokenizers, keyed permutations and chains are
beyond SQL) and op4 (its placement is one of many that the law allows); tests
compare these with brute force, round trips or held-out accuracy."""

from __future__ import annotations

from .mixing import DIMENSIONS, TOPICS, Mix
from .quality_rules import CLASSES, N_CLASSES, Divergence

_SPACE = r"[ \x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{_SPACE}'), lambda w: w <> '')"


def _op1() -> str:
    rule = Divergence()
    vocabulary = rule.vocabulary
    count = lambda x, p: f"len(regexp_extract_all({x}, '{p.replace(chr(39), chr(39) * 2)}'))"
    rest = "regexp_replace(t, '[a-z \\x09-\\x0D]+', '', 'g')"
    classes = ", ".join(f"{count('rest', p)}" for p in CLASSES.values())
    words = ", ".join(f"len(list_filter(w, lambda x: x = '{v}'))" for v in vocabulary)
    n = len(vocabulary) + 1
    blend = lambda a, b: f"list_transform(list_zip({a}, {b}), lambda z: (z[1] + z[2]) / 2)"
    return f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {_words('text')} AS w FROM documents),
 cut AS (SELECT *, {rest} AS rest, length(array_to_string(w, '')) AS word_chars, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \\x09-\\x0D]')) AS lines FROM base),
 windows AS (SELECT r, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM base)),
 twice AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
 repeats AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM twice GROUP BY r),
 counted AS (SELECT *, [{classes}] AS cc, [{words}] AS wc FROM cut),
 hist AS (SELECT *, list_concat(list_concat([length(t) - length(rest) - (length(t) - word_chars), length(t) - word_chars], cc), [length(rest) - list_sum(cc)])::DOUBLE[] AS ch, list_append(wc, len(w) - list_sum(wc))::DOUBLE[] AS wh FROM counted),
 good AS (SELECT hist.* FROM hist LEFT JOIN repeats USING (r) WHERE lang IS NOT NULL AND len(w) >= 20 AND 100 * coalesce(repeats.n, 0) <= 30 * len(w)),
 refs AS (SELECT lang, list_transform(range(1, {N_CLASSES + 1}), lambda i: list_sum(list_transform(chs, lambda x: x[i]))) AS rc, list_transform(range(1, {n + 1}), lambda i: list_sum(list_transform(whs, lambda x: x[i]))) AS rw FROM (SELECT lang, list(ch) AS chs, list(wh) AS whs FROM good GROUP BY lang HAVING count(*) >= greatest({rule.min_reference_docs}, ceil({rule.min_reference_share} * (SELECT count(*) FROM good))))),
 shares AS (SELECT lang, list_transform(rc, lambda x: x / list_sum(rc)) AS rc, list_transform(rw, lambda x: x / list_sum(rw)) AS rw FROM refs),
 joined AS (SELECT hist.*, list_transform(ch, lambda x: x / greatest(list_sum(ch), 1)) AS pc, list_transform(wh, lambda x: x / greatest(list_sum(wh), 1)) AS pw, rc, rw, coalesce(repeats.n, 0) AS n_repeat FROM hist LEFT JOIN shares USING (lang) LEFT JOIN repeats USING (r)),
 own AS (SELECT *, CASE WHEN rc IS NOT NULL THEN {_distance('pc', 'rc')} END AS oc, CASE WHEN rw IS NOT NULL THEN {_distance('pw', 'rw')} END AS ow FROM joined),
 near AS (SELECT r, min({_distance('pc', 's.rc')}) AS nc, min({_distance('pw', 's.rw')}) AS nw, min({_distance('pc', blend('joined.rc', 's.rc'))}) AS bc, min({_distance('pw', blend('joined.rw', 's.rw'))}) AS bw FROM joined CROSS JOIN shares s GROUP BY r),
 far AS (SELECT own.*, CASE WHEN lang IS NULL THEN nc WHEN oc <= {rule.max_char_distance} THEN oc WHEN oc IS NOT NULL THEN least(oc, bc) END AS dc, CASE WHEN lang IS NULL THEN nw WHEN ow <= {rule.max_word_distance} THEN ow WHEN ow IS NOT NULL THEN least(ow, bw) END AS dw FROM own LEFT JOIN near USING (r)),
 told AS (SELECT doc_id, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, {count('t', CLASSES['symbol'])}::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat::BIGINT AS n_repeat_words,
  len(w) < 20 OR 100 * n_repeat > 30 * len(w) AS base_failed, CASE WHEN length(t) >= {rule.min_chars} THEN round(dc, 6) END AS char_distance, CASE WHEN len(w) >= {rule.min_words} THEN round(dw, 6) END AS word_distance FROM far)
SELECT *, NOT base_failed AND coalesce(char_distance, 0) <= {rule.max_char_distance} AND coalesce(word_distance, 0) <= {rule.max_word_distance} AS kept FROM told"""


def _distance(p: str, q: str) -> str:
    half = lambda a: f"CASE WHEN z[{a}] > 0 THEN z[{a}] * log2(z[{a}] / ((z[1] + z[2]) / 2)) ELSE 0 END"
    return f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: ({half(1)} + {half(2)}) / 2))))"


def _op2() -> str:
    mix = Mix()
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{k}'" for k, p in TOPICS.items()) + " ELSE 'prose' END"
    ctes = [f"sizes AS (SELECT doc_id, source, lang, {topic} AS topic, len({_words('text')})::BIGINT AS tokens FROM documents)"]
    ctes.append("cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS cell_tokens FROM sizes GROUP BY ALL)")
    for d in DIMENSIONS:
        ctes.append(f"m_{d} AS (SELECT {d}, pow(sum(cell_tokens)::DOUBLE, {mix.temper}) AS m FROM cells GROUP BY {d} HAVING sum(cell_tokens) > 0)")
        ctes.append(f"t_{d} AS (SELECT {d}, m / (SELECT sum(m) FROM m_{d}) AS target FROM m_{d})")
    targets = ", ".join(f"coalesce(t_{d}.target, 0) AS target_{d}" for d in DIMENSIONS)
    joins = " ".join(f"LEFT JOIN t_{d} ON cells.{d} IS NOT DISTINCT FROM t_{d}.{d}" for d in DIMENSIONS)
    ctes.append(f"s0 AS MATERIALIZED (SELECT cells.*, {targets}, cell_tokens::DOUBLE AS share FROM cells {joins})")
    step, before, misses = 0, "false", ""
    for n in range(mix.rounds):
        for d in DIMENSIONS:
            there = f"sum(share) OVER (PARTITION BY {d})"
            ctes.append(f"s{step + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {before} THEN share WHEN {there} > 0 THEN share * target_{d} / {there} ELSE 0 END AS share) FROM s{step})")
            step += 1
        misses = " UNION ALL ".join(f"SELECT abs(sum(share) - first(target_{d})) AS miss FROM s{step} GROUP BY {d}" for d in DIMENSIONS)
        ctes.append(f"done{n} AS MATERIALIZED (SELECT {before} OR coalesce(max(miss), 0) <= {mix.tolerance} AS done FROM ({misses}))")
        before = f"(SELECT done FROM done{n})"
    ctes.append(f"fit AS (SELECT *, CASE WHEN cell_tokens > 0 THEN share / cell_tokens ELSE 0 END AS ratio FROM s{step})")
    ctes.append("steps AS (SELECT floor(log2(ratio) * 4) AS step, sum(cell_tokens) AS t FROM fit WHERE ratio > 0 GROUP BY 1)")
    ctes.append("above AS (SELECT step, sum(t) OVER (ORDER BY step DESC) / (SELECT sum(t) FROM steps) AS share FROM steps)")
    ctes.append(f"scale AS (SELECT coalesce(pow(2.0, min(step) FILTER (WHERE share <= {mix.whole}) / 4), pow(2.0, (max(step) + 1) / 4)) AS most FROM above)")
    ctes.append(f"told AS (SELECT source, lang, topic, round(share, 9) AS weight, round(least(1.0, ratio / (SELECT most FROM scale)), 9) AS probability, round((SELECT coalesce(max(miss), 0) FROM ({misses})), 9) AS miss FROM fit)")
    same = " AND ".join(f"sizes.{d} IS NOT DISTINCT FROM told.{d}" for d in DIMENSIONS)
    draw = f"('0x' || substr(md5('{mix.seed}' || doc_id), 1, 13))::BIGINT::DOUBLE / {16**13}.0"
    return f"WITH {', '.join(ctes)} SELECT sizes.*, weight, probability, miss, coalesce({draw} < probability, false) AS sampled FROM sizes LEFT JOIN told ON {same}"


_OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

def _near(sets: str, percent: int, kept: str = "") -> str:
    """Components of documents whose sets of shingles (an expression over the words w) are similar enough."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
 sets AS (SELECT doc_id, {sets} AS s FROM d),
 one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
 pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS k FROM one a JOIN one b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM pairs WHERE 100 * k >= {percent} * (n + m - k)),
 sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
 least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, component_id{kept} FROM sets JOIN least USING (doc_id)"""


_OP8 = _near("CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END", 80, ", sets.doc_id = component_id AS kept")
_OP11 = _near("CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END", 90)

_OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
 w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS i FROM n)),
 f AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g HAVING count(*) > 1),
 r AS (SELECT w.doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY w.doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM w JOIN f USING (g) WHERE m < w.doc_id),
 runs AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r) GROUP BY doc_id, k),
 gaps AS (SELECT runs.*, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS p FROM runs),
 cut AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * p + 1, 2 * (s - p)), '' ORDER BY s) AS head FROM gaps JOIN n USING (doc_id) GROUP BY doc_id)
SELECT n.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM n LEFT JOIN cut USING (doc_id)"""


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 u AS (SELECT r, lang, source, unnest(w) AS term FROM d),
 kept AS (SELECT lang, term, count(*) AS n FROM u GROUP BY ALL HAVING count(DISTINCT r) >= 3),
 v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, term, count(*) AS n FROM u JOIN kept USING (lang, term) GROUP BY ALL),
 t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
 grid AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(t.total, 0) + v.v) AS p, 1 + 1000000000::HUGEINT * (kept.n + 1) // (v.n + v.v) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN t ON g.lang = t.lang AND g.source = t.source),
 sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
 terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM grid WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms)) WHERE part = 'pair' OR rank <= 200"""

# The CRC32 of n bytes is linear over bits: bit b of the byte that k others follow adds u(8k + 8 - b) by exclusive
# or, where u(0) = 1 and each u follows from the one before; the register's 32 first bits add to that.
_OP13 = f"""
WITH RECURSIVE all_texts AS (SELECT 'd' AS part, row_number() OVER () AS r, {_LOW} AS t FROM documents UNION ALL SELECT 'b', row_number() OVER (), {_LOW} FROM benchmark),
 d AS (SELECT part, r, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM all_texts),
 f AS (SELECT part, r, unnest(w) AS x FROM d UNION ALL SELECT part, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d
  UNION ALL SELECT part, r, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM d),
 once AS (SELECT x, hex(encode(x)) AS h, strlen(x) AS n FROM (SELECT DISTINCT x FROM f)),
 u(j, v) AS (SELECT 0, 1::BIGINT UNION ALL SELECT j + 1, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END::BIGINT) FROM u WHERE j < 8 * (SELECT max(n) FROM once)),
 bytes AS (SELECT x, n - 1 - i AS k, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT AS c FROM (SELECT x, h, n, unnest(range(n)) AS i FROM once)),
 used AS (SELECT k, c, bit_xor(v) AS v FROM (SELECT k, c, unnest(range(8)) AS b FROM (SELECT DISTINCT k, c FROM bytes WHERE c > 0)) JOIN u ON j = 8 * k + 8 - b AND (c >> b) & 1 = 1 GROUP BY ALL),
 seeds AS (SELECT n, bit_xor(coalesce(v, 1::BIGINT << (b - 8 * n)::INT)) AS v FROM (SELECT n, unnest(range(32)) AS b FROM (SELECT DISTINCT n FROM once)) LEFT JOIN u ON j = 8 * n - b GROUP BY n),
 crcs AS (SELECT x, n, bit_xor(v) AS v FROM bytes JOIN used USING (k, c) JOIN once USING (x) GROUP BY ALL),
 buckets AS (SELECT x, xor(xor(crcs.v, seeds.v), 4294967295::BIGINT) % 10000 AS bucket FROM crcs JOIN seeds USING (n)),
 counts AS (SELECT bucket, count(*) FILTER (part = 'd') AS s, count(*) FILTER (part = 'b') AS t FROM f JOIN buckets USING (x) GROUP BY bucket),
 gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000))))::BIGINT AS gain FROM counts),
 weights AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN buckets USING (x) JOIN gains USING (bucket) WHERE part = 'd' GROUP BY r),
 noise AS (SELECT row_number() OVER () AS r, doc_id, floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS g FROM documents),
 told AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + g AS score, len(w) >= 20 AS fit FROM noise JOIN d ON part = 'd' AND d.r = noise.r LEFT JOIN weights ON weights.r = noise.r),
 places AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place FROM told)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 5 * (SELECT count(*) FROM told WHERE fit) // 100 THEN place END AS rank FROM places"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1(), "op2_mixing": _op2(), "op5_topk": _OP5, "op8_minhash": _OP8, "op10_suffixes": _OP10, "op11_jaccard_join": _OP11, "op12_divergence": _OP12, "op13_resampling": _OP13}
