"""The registered queries in DuckDB's SQL, written independently of the Spark plans."""

from __future__ import annotations

from ..operators.lsh import seeds

# The delimiter classes in RE2's dialect.
WORD = r"[|$*\s\x{000b}\x{00a0}\"''\-+=,;:«»{}()<>\[\].?¿!¡–“”‘’]+"
SENT = r"[|.?¿!¡]+"
GARBAGE = r"[`;\[\]|,.\"''{}?)(=\-><*:#%&/\\]"

BASE = rf"""
corpus AS MATERIALIZED (
  SELECT CASE lang WHEN 'en' THEN 'src' ELSE 'trg' END AS side, doc_id AS doc, CAST(doc_id % 30 AS INT) AS day_idx,
         unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE lang IN ('en', 'fr')),
sent0 AS (
  SELECT side, doc, day_idx, line_no, unnest(range(len(regexp_split_to_array(line, '{SENT}')))) AS sent_no,
         unnest(regexp_split_to_array(line, '{SENT}')) AS sent FROM corpus),
sent1 AS (SELECT * EXCLUDE (sent), sent, regexp_split_to_array(sent, '{WORD}') AS ws FROM sent0),
sent AS MATERIALIZED (
  SELECT side, doc, day_idx, line_no, sent_no, sent,
         [lower(trim(x)) FOR x IN CASE WHEN ws[-1] = '' THEN ws[1:len(ws)-1] ELSE ws END] AS toks FROM sent1),
tok AS MATERIALIZED (
  SELECT side, doc, day_idx, line_no, sent_no, unnest(range(len(toks))) AS pos, unnest(toks) AS tok FROM sent),
counts AS MATERIALIZED (SELECT side, tok AS stem, count(*) AS n FROM tok WHERE tok <> '' GROUP BY ALL),
vocab AS MATERIALIZED (
  SELECT * FROM counts WHERE NOT regexp_matches(stem, '{GARBAGE}') AND NOT regexp_matches(stem, '[0-9]') AND length(stem) > 2),
top AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n DESC, stem) AS rn FROM vocab),
dict AS MATERIALIZED (
  SELECT a.stem AS src, b.stem AS trg, a.rn FROM top a JOIN top b ON a.rn = b.rn WHERE a.side = 'src' AND b.side = 'trg' AND a.rn <= 500),
totals AS MATERIALIZED (SELECT side, max(n) AS max_n, sum(n) AS total_n FROM vocab GROUP BY side),
sources AS MATERIALIZED (SELECT side, stem, n FROM top WHERE side = 'src' AND rn <= 20),
targets AS MATERIALIZED (SELECT side, stem, n FROM vocab WHERE side = 'trg' AND n > 5)
"""

CONTEXT = """,
stems AS MATERIALIZED (SELECT * FROM sources UNION ALL SELECT * FROM targets),
cwords AS MATERIALIZED (
  SELECT v.* FROM vocab v WHERE (side = 'src' AND stem IN (SELECT src FROM dict)) OR (side = 'trg' AND stem IN (SELECT trg FROM dict))),
ctx AS MATERIALIZED (
  SELECT a.side, a.tok AS stem, b.tok AS ctx, CAST(count(*) AS DOUBLE) AS ctx_n, CAST(max(w.n) AS DOUBLE) AS corp_n
  FROM tok a JOIN stems s ON a.side = s.side AND a.tok = s.stem
  JOIN tok b ON a.side = b.side AND a.doc = b.doc AND a.line_no = b.line_no AND a.sent_no = b.sent_no AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 2
  JOIN cwords w ON w.side = b.side AND w.stem = b.tok GROUP BY 1, 2, 3),
proj AS MATERIALIZED (
  SELECT c.side, c.stem, d.trg AS ctx, c.ctx_n, c.corp_n FROM ctx c JOIN dict d ON c.ctx = d.src WHERE c.side = 'src'),
both_ctx AS (SELECT side, stem, ctx, ctx_n, corp_n FROM proj UNION ALL SELECT side, stem, ctx, ctx_n, corp_n FROM ctx WHERE side = 'trg')
"""


def weighted(weight: str, source: str = "both_ctx") -> str:
    value = {"binary": "1.0::DOUBLE", "count": "c.ctx_n", "idf": "c.ctx_n * (ln(t.max_n / c.corp_n) + 1)"}[weight]
    return f""",
wctx AS MATERIALIZED (SELECT c.side, c.stem, c.ctx, max({value}) AS w FROM {source} c JOIN totals t USING (side) GROUP BY 1, 2, 3),
nrm AS MATERIALIZED (SELECT side, stem, sum(w * w) AS nn FROM wctx GROUP BY 1, 2),
dots AS MATERIALIZED (
  SELECT a.stem AS src, b.stem AS trg, sum(a.w * b.w) AS dot, sum(b.w * b.w) AS shared
  FROM wctx a JOIN wctx b ON a.ctx = b.ctx WHERE a.side = 'src' AND b.side = 'trg' GROUP BY 1, 2),
pairs AS MATERIALIZED (
  SELECT d.*, x.nn AS n1, y.nn AS n2 FROM dots d JOIN nrm x ON x.side = 'src' AND x.stem = d.src JOIN nrm y ON y.side = 'trg' AND y.stem = d.trg)
"""


SCORE = {
    "cosine": "CASE WHEN sqrt(n1 * n2) <> 0 THEN dot / sqrt(n1 * n2) ELSE 0 END",
    "dice": "CASE WHEN shared + n1 <> 0 THEN 2 * dot / (shared + n1) ELSE 0 END",
    "dice_cosine": "CASE WHEN sqrt(n1 * shared) * (n1 + shared) <> 0 THEN dot * dot / (sqrt(n1 * shared) * (n1 + shared)) ELSE 0 END",
    "product": "dot",
}


def scored(weight: str, kind: str, source: str = "both_ctx") -> str:
    return weighted(weight, source) + f", raw_scores AS (SELECT src, trg, {SCORE[kind]} AS score FROM pairs), context_scores AS MATERIALIZED (SELECT src, trg, round(score, 9) AS score FROM raw_scores)\n"


TIME = """,
stems2 AS MATERIALIZED (SELECT * FROM sources UNION ALL SELECT * FROM targets),
bins AS (SELECT day_idx AS bin FROM corpus WHERE side = 'src' INTERSECT SELECT day_idx FROM corpus WHERE side = 'trg'),
tdist AS MATERIALIZED (
  SELECT t.side, t.tok AS stem, t.day_idx AS bin, CAST(count(*) AS DOUBLE) AS v FROM tok t JOIN stems2 s ON s.side = t.side AND s.stem = t.tok
  WHERE t.day_idx IN (SELECT bin FROM bins) GROUP BY 1, 2, 3),
tum AS MATERIALIZED (SELECT side, stem, bin // 3 AS bin, sum(v) AS v FROM tdist GROUP BY 1, 2, 3),
tnorm AS MATERIALIZED (SELECT side, stem, bin, v / sum(v) OVER (PARTITION BY side, stem) AS v FROM tum),
tn AS MATERIALIZED (SELECT side, stem, sqrt(sum(v * v)) AS nn FROM tnorm GROUP BY 1, 2),
raw_time AS MATERIALIZED (
  SELECT d.src, d.trg, d.dot / (x.nn * y.nn) AS score FROM (
    SELECT a.stem AS src, b.stem AS trg, sum(a.v * b.v) AS dot FROM tnorm a JOIN tnorm b ON a.bin = b.bin
    WHERE a.side = 'src' AND b.side = 'trg' GROUP BY 1, 2) d
  JOIN tn x ON x.side = 'src' AND x.stem = d.src JOIN tn y ON y.side = 'trg' AND y.stem = d.trg),
time_scores AS MATERIALIZED (SELECT src, trg, round(score, 9) AS score FROM raw_time)
"""

# DuckDB's levenshtein counts bytes. Words hold no capitals and no digits, so these stand for the other letters, one each.
ODD = """,
odd AS MATERIALIZED (
  SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS f, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 1, count(*)::INT) AS t
  FROM (SELECT DISTINCT unnest(string_split(stem, '')) AS c FROM vocab) WHERE unicode(c) > 127)
"""


def lev(a: str, b: str) -> str:
    one, two = (f"translate({x}, (SELECT f FROM odd), (SELECT t FROM odd))" for x in (a, b))
    return f"levenshtein({one}, {two})"


PLAIN = "translate({}, 'éèêàçùôîâ', 'eeeacuoia')"
EDIT = ODD + f""",
edit_scores AS MATERIALIZED (
  SELECT s.stem AS src, t.stem AS trg, CAST({lev("s.stem", "t.stem")} AS DOUBLE) AS score FROM sources s, targets t)
"""


def ranked(name: str, scores: str, keep: int = 10, where: str = "true", order: str = "DESC", keys: str = "src") -> str:
    better = ">" if order == "DESC" else "<"
    return f""",
{name}_cut AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score {order}, trg) AS rn FROM {scores} WHERE {where}) WHERE rn <= {keep}),
{name} AS MATERIALIZED (
  SELECT {", ".join("a." + k.strip() for k in keys.split(","))}, a.trg, a.score,
    (SELECT count(*) FROM {name}_cut b WHERE {" AND ".join(f"b.{k.strip()} = a.{k.strip()}" for k in keys.split(","))} AND b.score {better} a.score)
    + ((SELECT count(*) FROM {name}_cut b WHERE {" AND ".join(f"b.{k.strip()} = a.{k.strip()}" for k in keys.split(","))} AND b.score = a.score) + 1) / 2.0 AS rk
  FROM {name}_cut a)
"""


CONTEXT_RANK = CONTEXT + scored("idf", "cosine") + ranked("r_ctx", "context_scores", where="score > 0")
TIME_ALL = TIME + """,
time_all AS MATERIALIZED (SELECT s.stem AS src, t.stem AS trg, coalesce(x.score, 0) AS score
  FROM sources s CROSS JOIN targets t LEFT JOIN time_scores x ON x.src = s.stem AND x.trg = t.stem)
"""
TIME_RANK = TIME_ALL + ranked("r_time", "time_all")
EDIT_RANK = EDIT + ranked("r_edit", "edit_scores", order="ASC")
FUSED = CONTEXT_RANK + TIME_RANK + EDIT_RANK + """,
every AS (SELECT src, trg, rk FROM r_ctx UNION ALL SELECT src, trg, rk FROM r_time UNION ALL SELECT src, trg, rk FROM r_edit),
fused AS MATERIALIZED (SELECT src, trg, round(sum(1 / rk) / 3, 9) AS score FROM every GROUP BY 1, 2)
""" + ranked("r_mrr", "fused")

PHRASE = rf""",
psent AS MATERIALIZED (
  SELECT side, doc, day_idx, line_no, sent_no, sent, [x FOR x IN regexp_split_to_array(lower(sent), '\s+') IF x <> ''] AS toks,
         [length(x) FOR x IN regexp_extract_all(trim(sent), '\s+')] AS gaps FROM (
    SELECT side, doc, day_idx, line_no, unnest(range(len(m))) AS sent_no, unnest(m) AS sent FROM (
      SELECT side, doc, day_idx, line_no, regexp_extract_all(trim(line), '[^.?¿!¡]*[.?¿!¡]+|[^.?¿!¡]+$') AS m FROM corpus))),
starts AS (SELECT *, unnest(range(len(toks))) AS pos FROM psent),
spans0 AS (SELECT *, unnest(range(1, 1 + least(3, len(toks) - pos))) AS n_tok FROM starts),
spans AS MATERIALIZED (
  SELECT side, doc, day_idx, line_no, sent_no, pos, n_tok, array_to_string(toks[pos + 1 : pos + n_tok], ' ') AS phrase,
         gaps[pos] AS gap_before, gaps[pos + n_tok] AS gap_after, pos AS p0 FROM spans0),
pcounts AS MATERIALIZED (SELECT side, phrase, n_tok, count(*) AS n FROM spans GROUP BY ALL),
pmap AS (
  SELECT phrase, n, n_tok, unnest(range(n_tok)) AS i, unnest(string_split(phrase, ' ')) AS w FROM pcounts WHERE side = 'src'),
ptab AS MATERIALIZED (
  SELECT phrase AS src, string_agg(d.trg, ' ' ORDER BY i) AS trg, n, n_tok FROM pmap JOIN dict d ON d.src = pmap.w
  GROUP BY phrase, n, n_tok HAVING count(*) = n_tok ORDER BY n DESC, phrase LIMIT 200),
listed AS MATERIALIZED (SELECT DISTINCT 'src' AS side, src AS phrase FROM ptab UNION SELECT DISTINCT 'trg', trg FROM ptab)
"""

CWORDS = """,
cwords AS MATERIALIZED (
  SELECT v.* FROM vocab v WHERE (side = 'src' AND stem IN (SELECT src FROM dict)) OR (side = 'trg' AND stem IN (SELECT trg FROM dict)))
"""

PHRASE_CONTEXT = rf""",
found AS MATERIALIZED (SELECT s.* FROM spans s JOIN listed l ON l.side = s.side AND l.phrase = s.phrase),
ptoks AS (SELECT side, doc, line_no, sent_no, unnest(range(len(toks))) AS tpos, unnest(toks) AS t FROM psent
          WHERE (side, doc, line_no, sent_no) IN (SELECT DISTINCT side, doc, line_no, sent_no FROM found)),
pw0 AS (SELECT side, doc, line_no, sent_no, tpos, [x FOR x IN regexp_split_to_array(t, '{WORD}') IF x <> ''] AS ws FROM ptoks),
pw1 AS (SELECT side, doc, line_no, sent_no, tpos, unnest(range(len(ws))) AS k, unnest(ws) AS w FROM pw0),
pw AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY side, doc, line_no, sent_no ORDER BY tpos, k) AS ix FROM pw1),
near AS (
  SELECT side, doc, line_no, sent_no, pos, n_tok, phrase, w FROM (
    SELECT f.*, pw.w, row_number() OVER (PARTITION BY f.side, f.doc, f.line_no, f.sent_no, f.pos, f.n_tok ORDER BY pw.ix DESC) AS r
    FROM found f JOIN pw ON f.side = pw.side AND f.doc = pw.doc AND f.line_no = pw.line_no AND f.sent_no = pw.sent_no AND pw.tpos < f.pos AND pw.tpos >= f.pos - 60) WHERE r <= 2
  UNION ALL
  SELECT side, doc, line_no, sent_no, pos, n_tok, phrase, w FROM (
    SELECT f.*, pw.w, row_number() OVER (PARTITION BY f.side, f.doc, f.line_no, f.sent_no, f.pos, f.n_tok ORDER BY pw.ix) AS r
    FROM found f JOIN pw ON f.side = pw.side AND f.doc = pw.doc AND f.line_no = pw.line_no AND f.sent_no = pw.sent_no AND pw.tpos >= f.pos + f.n_tok AND pw.tpos <= f.pos + 60) WHERE r <= 2),
pctx AS MATERIALIZED (
  SELECT n.side, n.phrase AS stem, n.w AS ctx, CAST(count(*) AS DOUBLE) AS ctx_n, CAST(max(c.n) AS DOUBLE) AS corp_n
  FROM near n JOIN cwords c ON c.side = n.side AND c.stem = n.w GROUP BY 1, 2, 3),
pboth AS (
  SELECT c.side, c.stem, d.trg AS ctx, c.ctx_n, c.corp_n FROM pctx c JOIN dict d ON c.ctx = d.src WHERE c.side = 'src'
  UNION ALL SELECT side, stem, ctx, ctx_n, corp_n FROM pctx WHERE side = 'trg'),
pwctx AS MATERIALIZED (SELECT c.side, c.stem, c.ctx AS dim, max(c.ctx_n * (ln(t.max_n / c.corp_n) + 1)) AS v FROM pboth c JOIN totals t USING (side) GROUP BY 1, 2, 3)
"""

PHRASE_TIME = """,
ptime AS MATERIALIZED (
  SELECT s.side, s.phrase, s.day_idx AS bin, CAST(count(*) AS DOUBLE) AS v FROM spans s JOIN listed l ON l.side = s.side AND l.phrase = s.phrase GROUP BY 1, 2, 3),
ptum AS (SELECT side, phrase, bin // 3 AS dim, sum(v) AS v FROM ptime GROUP BY 1, 2, 3),
pvec AS MATERIALIZED (SELECT side, phrase AS stem, dim, v / sum(v) OVER (PARTITION BY side, phrase) AS v FROM ptum)
"""

LINKS = """,
linked AS MATERIALIZED (
  SELECT src, trg, unnest(string_split(src, ' ')) AS a, unnest(string_split(trg, ' ')) AS b, unnest(range(n_tok)) AS i FROM ptab)
"""


def pair_cosine(name: str, vectors: str, pairs: str) -> str:
    return f""",
{name} AS MATERIALIZED (
  SELECT p.src, p.trg, coalesce((SELECT sum(x.v * y.v) FROM {vectors} x JOIN {vectors} y ON x.dim = y.dim
      WHERE x.side = 'src' AND x.stem = p.src AND y.side = 'trg' AND y.stem = p.trg)
    / (sqrt((SELECT sum(v * v) FROM {vectors} WHERE side = 'src' AND stem = p.src)) * sqrt((SELECT sum(v * v) FROM {vectors} WHERE side = 'trg' AND stem = p.trg))), 0) AS score
  FROM (SELECT DISTINCT src, trg FROM {pairs}) p)
"""


FEATURES = PHRASE + CWORDS + PHRASE_CONTEXT + PHRASE_TIME + LINKS + pair_cosine("f_ctx", "pwctx", "ptab") + pair_cosine("f_time", "pvec", "ptab")
LEXICAL = FEATURES + ", tokpairs AS (SELECT a AS src, b AS trg FROM linked)" + pair_cosine("t_ctx", "pwctx", "tokpairs") + pair_cosine("t_time", "pvec", "tokpairs") + """,
lex AS MATERIALIZED (
  SELECT p.src, p.trg, avg(c.score) AS lex_context, avg(t.score) AS lex_time FROM ptab p
  LEFT JOIN (SELECT l.* FROM linked l WHERE l.a IN (SELECT phrase FROM listed WHERE side = 'src') AND l.b IN (SELECT phrase FROM listed WHERE side = 'trg')) l ON l.src = p.src AND l.trg = p.trg
  LEFT JOIN t_ctx c ON c.src = l.a AND c.trg = l.b LEFT JOIN t_time t ON t.src = l.a AND t.trg = l.b GROUP BY 1, 2)
"""
LEX_EDIT = ODD + f""",
ledit AS MATERIALIZED (
  SELECT src, trg, sum(2 * CASE WHEN {PLAIN.format("a")} <> a THEN {lev(PLAIN.format("a"), "b")} ELSE {lev("a", "b")} END) / sum(2 * (length(a) + length(b)) / 2.0) AS lex_edit FROM linked
  GROUP BY 1, 2)
"""

ORDER = PHRASE + """,
occ AS MATERIALIZED (SELECT s.* FROM spans s JOIN listed l ON l.side = s.side AND l.phrase = s.phrase),
rel AS (
  SELECT a.side, a.doc, a.line_no, a.sent_no, a.pos, a.n_tok, a.phrase, b.phrase AS ctx_phrase, b.n_tok AS o_n, b.pos AS o_pos,
    CASE WHEN b.pos + b.n_tok = a.pos AND a.gap_before = 1 THEN 'before'
         WHEN a.pos + a.n_tok = b.pos AND a.gap_after = 1 THEN 'after'
         WHEN a.side = 'trg' AND ((b.pos + b.n_tok <= a.pos AND a.pos - b.pos - b.n_tok <= 2) OR (a.pos + a.n_tok <= b.pos AND b.pos - a.pos - a.n_tok <= 2)) THEN 'disc' END AS rel
  FROM occ a JOIN occ b ON a.side = b.side AND a.doc = b.doc AND a.line_no = b.line_no AND a.sent_no = b.sent_no AND abs(a.pos - b.pos) <= 8),
pick AS (SELECT *, row_number() OVER (PARTITION BY side, doc, line_no, sent_no, pos, n_tok, rel ORDER BY o_n DESC, o_pos) AS r FROM rel WHERE rel IS NOT NULL),
pord AS MATERIALIZED (SELECT side, phrase, rel, ctx_phrase, count(*) AS n FROM pick WHERE r = 1 GROUP BY ALL)
"""
ORDER_SCORES = ORDER + """,
tcnt AS MATERIALIZED (
  SELECT phrase AS trg, ctx_phrase AS t, sum(n) FILTER (rel = 'before') AS kb, sum(n) FILTER (rel = 'after') AS ka, sum(n) FILTER (rel = 'disc') AS kd
  FROM pord WHERE side = 'trg' GROUP BY 1, 2),
ev AS MATERIALIZED (
  SELECT p.src, p.trg, s.rel, sum(coalesce(kb, 0))::DOUBLE AS kb, sum(coalesce(ka, 0))::DOUBLE AS ka, sum(coalesce(kd, 0))::DOUBLE AS kd
  FROM ptab p JOIN pord s ON s.side = 'src' AND s.phrase = p.src JOIN ptab q ON q.src = s.ctx_phrase JOIN tcnt c ON c.trg = p.trg AND c.t = q.trg GROUP BY 1, 2, 3),
osc AS MATERIALIZED (
  SELECT p.src, p.trg, b.kb / nullif(b.kb + b.ka + b.kd, 0) AS b_mono, b.ka / nullif(b.kb + b.ka + b.kd, 0) AS b_swap, b.kd / nullif(b.kb + b.ka + b.kd, 0) AS b_disc,
    a.ka / nullif(a.kb + a.ka + a.kd, 0) AS a_mono, a.kb / nullif(a.kb + a.ka + a.kd, 0) AS a_swap, a.kd / nullif(a.kb + a.ka + a.kd, 0) AS a_disc
  FROM ptab p LEFT JOIN ev b ON b.src = p.src AND b.trg = p.trg AND b.rel = 'before' LEFT JOIN ev a ON a.src = p.src AND a.trg = p.trg AND a.rel = 'after')
"""

def lsh(vectors: str, keys: str = "side, stem", name: str = "sgn") -> str:
    """The sign of each of 256 projections of the vectors (keys, f, v)."""
    return f""",
{name}_h AS (
  SELECT f, b, list_reduce(list_prepend(s::BIGINT, [unicode(c)::BIGINT FOR c IN regexp_extract_all(f, '.')]), LAMBDA h, c: (h * 33 + c) % 4294967296) AS h
  FROM (SELECT DISTINCT f FROM {vectors}), (SELECT unnest(range(256)) AS b, unnest({seeds()}) AS s)),
{name}_i AS (SELECT f, b, (CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END) % 100000 AS i FROM {name}_h),
{name}_g AS MATERIALIZED (
  SELECT f, b, sqrt(-2 * ln(((i * 48271 + 11) % 2147483647 + 1) / 2147483648.0::DOUBLE)) * cos(2 * pi() * (((i * 69621 + 7) % 2147483647) / 2147483647.0::DOUBLE)) AS g FROM {name}_i),
{name} AS MATERIALIZED (SELECT {keys}, b, sum(w.v * x.g) > 0 AS bit FROM {vectors} w JOIN {name}_g x USING (f) GROUP BY {keys}, b)
"""


def packed(name: str) -> str:
    """Four words of 64 bits in hexadecimal digits, highest first, of each (side, stem)."""
    return f""",
{name}_digits AS (SELECT side, stem, b // 64 AS word, (b % 64) // 4 AS place, sum(CASE WHEN bit THEN 1 << (b % 4) ELSE 0 END)::INT AS digit FROM {name} GROUP BY ALL),
{name}_packed AS MATERIALIZED (SELECT side, stem, string_agg(substr('0123456789ABCDEF', digit + 1, 1), '' ORDER BY word, place DESC) AS sig FROM {name}_digits GROUP BY 1, 2)
"""


LSH = ", wvec AS (SELECT side, stem, ctx AS f, w AS v FROM wctx)" + lsh("wvec")
DUMPED = ", cvec AS (SELECT side, stem, ctx AS f, ctx_n AS v FROM pctx), tvec AS (SELECT side, stem, dim::VARCHAR AS f, v FROM pvec)" + lsh("cvec", name="csg") + packed("csg") + lsh("tvec", name="tsg") + packed("tsg")
ORDER_LSH = ORDER + """,
ovec AS MATERIALIZED (
  SELECT side, rel, phrase AS stem, ctx_phrase AS f, n::DOUBLE AS v FROM pord WHERE side = 'trg'
  UNION ALL SELECT o.side, o.rel, o.phrase, t.trg, sum(o.n)::DOUBLE FROM pord o JOIN (SELECT DISTINCT src, trg FROM ptab) t ON t.src = o.ctx_phrase WHERE o.side = 'src' GROUP BY ALL)
""" + lsh("ovec", "side, rel, stem") + """,
combos AS (SELECT * FROM (VALUES ('b_mono', 'before', 'before'), ('b_swap', 'before', 'after'), ('b_disc', 'before', 'disc'), ('a_mono', 'after', 'after'), ('a_swap', 'after', 'before'), ('a_disc', 'after', 'disc')) c(name, r1, r2)),
apart AS MATERIALIZED (
  SELECT p.src, p.trg, c.name, round(greatest(0, cos(pi() * sum(CASE WHEN coalesce(x.bit, false) <> coalesce(y.bit, false) THEN 1 ELSE 0 END) / 256.0)), 6) AS score
  FROM (SELECT DISTINCT src, trg FROM ptab) p CROSS JOIN combos c CROSS JOIN (SELECT unnest(range(256)) AS b) bits
  LEFT JOIN sgn x ON x.side = 'src' AND x.rel = c.r1 AND x.stem = p.src AND x.b = bits.b LEFT JOIN sgn y ON y.side = 'trg' AND y.rel = c.r2 AND y.stem = p.trg AND y.b = bits.b GROUP BY 1, 2, 3)
"""

NEWS = r"""
news AS MATERIALIZED (
  SELECT page_id, CASE page_id % 8
    WHEN 0 THEN 'http://www.bbc.co.uk/russian/08' || lpad((page_id % 12 + 1)::VARCHAR, 2, '0') || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') || '_p' || page_id || '.shtml'
    WHEN 1 THEN 'http://www1.voanews.com/persian/news/a-2010-' || (page_id % 12 + 1) || '-' || (page_id % 28 + 1) || '-' || page_id || '.html'
    WHEN 2 THEN 'http://www.voanews.com/urdu/news/T-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') || 'Apr09-' || page_id || '.html'
    WHEN 3 THEN 'http://lenta.ru/news/2010/' || lpad((page_id % 12 + 1)::VARCHAR, 2, '0') || '/' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') || '/r' || page_id
    WHEN 4 THEN 'http://www.dw-world.de/dw/article/' || page_id
    WHEN 5 THEN 'http://news.bbc.co.uk/hi/english/world/' || page_id || '.stm'
    WHEN 6 THEN 'http://www.inform.kz/x' || page_id ELSE url END AS url,
    page_id % 3 AS segment_id, page_id * 1000 AS fetched,
    CASE WHEN page_id % 8 = 7 THEN lower(regexp_extract(regexp_extract(html, '(?i)<html[^>]*>'), '(?i)\slang\s*=\s*"*([^\s=">]+)"*', 1)) END AS own_lang,
    (CASE page_id % 8 WHEN 4 THEN 'Deutsche Welle | ' || (page_id % 28 + 1) || '.' || (page_id % 12 + 1) || '.2010 '
      WHEN 5 THEN 'Saturday, ' || (page_id % 28 + 1) || ' January 2008, 19:10 GMT '
      WHEN 6 THEN lpad((page_id % 28 + 1)::VARCHAR, 2, '0') || '.' || lpad((page_id % 12 + 1)::VARCHAR, 2, '0') || '.2010 / 13:58 ' ELSE '' END)
      || trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\s\x{000b}]+', ' ', 'g')) AS content
  FROM pages),
told AS MATERIALIZED (
  SELECT *, CASE page_id % 8 WHEN 0 THEN 'ru' WHEN 1 THEN 'fa' WHEN 2 THEN 'ur' WHEN 3 THEN 'ru' WHEN 4 THEN 'de' WHEN 5 THEN 'en' WHEN 6 THEN 'kk' ELSE own_lang END AS lang,
    epoch_ms(CASE page_id % 8
      WHEN 0 THEN make_timestamp(2008, page_id % 12 + 1, page_id % 28 + 1, 0, 0, 0.0) WHEN 1 THEN make_timestamp(2010, page_id % 12 + 1, page_id % 28 + 1, 0, 0, 0.0)
      WHEN 2 THEN make_timestamp(2009, 4, page_id % 28 + 1, 0, 0, 0.0) WHEN 3 THEN make_timestamp(2010, page_id % 12 + 1, page_id % 28 + 1, 0, 0, 0.0)
      WHEN 4 THEN make_timestamp(2010, page_id % 12 + 1, page_id % 28 + 1, 0, 0, 0.0) WHEN 5 THEN make_timestamp(2008, 1, page_id % 28 + 1, 19, 10, 0.0)
      WHEN 6 THEN make_timestamp(2010, page_id % 12 + 1, page_id % 28 + 1, 13, 58, 0.0) END) AS modified FROM news)
"""
PAGES = r"""
pv AS MATERIALIZED (
  SELECT page_id, url, page_id % 3 AS segment_id, page_id * 1000 AS fetched, html,
    trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\s\x{000b}]+', ' ', 'g')) AS content,
    array_to_string([trim(regexp_replace(regexp_extract(a, 'href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1, 'i'), '^["'']|["'']$', '', 'g')) || ' ' ||
      trim(regexp_replace(regexp_replace(a, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) FOR a IN regexp_extract_all(html, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)[^>]*>.*?</a\s*>')], chr(10)) AS links,
    nullif(lower(regexp_extract(regexp_extract(html, '(?i)<html[^>]*>'), '(?i)\slang\s*=\s*"*([^\s=">]+)"*', 1)), '') AS lang FROM pages)
"""
MERGED = PAGES + """,
every_page AS (
  SELECT page_id, url, segment_id, fetched, lang, content FROM pv
  UNION ALL SELECT page_id, url, segment_id, fetched + 500, 'xx', CASE WHEN page_id % 4 = 0 THEN content || ' new' ELSE content END FROM pv WHERE page_id % 2 = 0),
merged AS MATERIALIZED (
  SELECT e.url, e.segment_id, e.fetched, p.page_id, length(p.html) AS size, p.links, coalesce(p.lang, CASE WHEN e.page_id % 2 = 0 THEN 'xx' END) AS lang, e.content FROM (
    SELECT *, row_number() OVER (PARTITION BY url, content ORDER BY fetched, segment_id) AS r FROM every_page) e JOIN pv p ON p.url = e.url WHERE r = 1)
"""
DETECT = """
fw AS (SELECT * FROM (VALUES {values}) t(lang, w)),
dwords AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS w FROM documents),
hits AS (SELECT d.doc_id, f.lang, count(*) AS n FROM dwords d JOIN fw f ON f.w = d.w GROUP BY 1, 2),
grid AS (SELECT d.doc_id, l.lang, coalesce(h.n, 0) AS n FROM documents d CROSS JOIN (SELECT DISTINCT lang FROM fw) l LEFT JOIN hits h ON h.doc_id = d.doc_id AND h.lang = l.lang),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang DESC) AS r FROM grid)
"""

PROFILES = """
plain AS (SELECT doc_id, lang, trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')) AS t FROM documents),
padded AS (SELECT doc_id, lang, ' ' || t || ' ' AS t FROM plain WHERE t <> ''),
chars AS (SELECT doc_id, string_split(t, '') AS c FROM padded),
opened AS (SELECT doc_id, unnest([c[i] FOR i IN range(1, len(c) + 1)] || [c[i] || c[i + 1] FOR i IN range(1, len(c))] || [c[i] || c[i + 1] || c[i + 2] FOR i IN range(1, len(c) - 1)]) AS g FROM chars),
grams AS MATERIALIZED (
  SELECT doc_id, g, count(*) AS n FROM opened GROUP BY 1, 2),
learnt AS (SELECT lang, g, sum(n) AS n FROM grams JOIN padded USING (doc_id) WHERE lang IS NOT NULL AND {learnt} GROUP BY 1, 2),
profile AS MATERIALIZED (SELECT * FROM (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) AS rk FROM learnt) WHERE rk <= 300),
own AS MATERIALIZED (SELECT * FROM (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) AS rk FROM grams) WHERE rk <= 300),
far AS (
  SELECT o.doc_id, l.lang, sum(coalesce(abs(p.rk - o.rk), 300))::BIGINT AS distance, count(*) AS k
  FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.g = o.g GROUP BY 1, 2),
nearest AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) AS r, lead(distance) OVER (PARTITION BY doc_id ORDER BY distance, lang) AS second FROM far),
told AS (SELECT doc_id, lang, distance, k >= 20 AND 50 * (coalesce(second, 1099511627776) - distance) >= distance AS reliable FROM nearest WHERE r = 1)
"""


SOURCES = "sources AS MATERIALIZED (SELECT side, stem, n FROM top WHERE side = 'src' AND rn <= 20)"
BINNED = """us AS (SELECT stem, n, row_number() OVER (ORDER BY n DESC, stem) AS rn, count(*) OVER () AS c FROM vocab WHERE side = 'src' AND n > 3 AND n <= 10000),
            bn AS (SELECT *, (rn - 1) // (c // 4) AS bin FROM us WHERE (rn - 1) // (c // 4) < 4),
            binned AS MATERIALIZED (SELECT stem, n, bin::INT AS bin FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(stem), stem) AS k FROM bn) WHERE k <= least(40, c) // 4),
            sources AS MATERIALIZED (SELECT 'src' AS side, stem, n FROM binned)"""
TARGETS = "targets AS MATERIALIZED (SELECT side, stem, n FROM vocab WHERE side = 'trg' AND n > 5)"
GIVEN_SOURCES = "sources AS MATERIALIZED (SELECT side, stem, n FROM vocab WHERE side = 'src' AND stem IN (SELECT src FROM dict WHERE rn % 3 = 1))"
GIVEN_TARGETS = "targets AS MATERIALIZED (SELECT side, stem, n FROM vocab WHERE side = 'trg' AND stem IN (SELECT trg FROM dict WHERE rn % 2 = 0))"


def draw(*columns: str) -> str:
    return f"md5(concat_ws(chr(1), '1', {', '.join(columns)}))"


def share(*columns: str) -> str:
    """In millionths."""
    return f"(('0x' || substr({draw(*columns)}, 1, 8))::BIGINT % 1000000)"


def sql(*ctes: str, select: str) -> str:
    return "WITH " + "".join(ctes) + "\n" + select


def full_size(query: str, sources: int, keep: int) -> str:
    """A ranking's SQL with more sources and candidates."""
    return query.replace(SOURCES, SOURCES.replace("rn <= 20", f"rn <= {sources}")).replace("rn <= 10)", f"rn <= {keep})")


def all_sql() -> dict[str, str]:
    from ..operators.detect import FUNCTION_WORDS

    values = ", ".join(f"('{lang}', '{w}')" for lang, ws in FUNCTION_WORDS.items() for w in ws.split())
    classes = "SELECT side, {stem} AS stem, array_to_string(list_sort(list(DISTINCT stem)), ' ') AS words, sum(n)::BIGINT AS n FROM vocab GROUP BY 1, 2"
    out = {
        "vocab_counts": sql(BASE, select="SELECT side, stem, n FROM counts"),
        "vocab_filtered": sql(BASE, select="SELECT side, stem, n FROM vocab WHERE n > 5"),
        "vocab_native_script": sql(BASE, select="SELECT side, stem, n FROM vocab WHERE NOT regexp_matches(stem, '[a-zA-Z]')"),
        "vocab_without_stop_words": sql(BASE, select="SELECT side, stem, n FROM top WHERE rn > 50 AND n > 5"),
        "prefix_classes": sql(BASE, select=classes.format(stem="stem[1:5]")),
        "suffix_classes": sql(BASE, select=classes.format(stem="CASE WHEN length(stem) < 5 THEN stem ELSE stem[length(stem)-4:] END")),
        "max_token_counts": sql(BASE, select="SELECT side, max_n, total_n::BIGINT AS total_n FROM totals"),
        "sentence_split": sql(BASE, select="SELECT side, doc, line_no::INT AS line_no, count(*) AS sentences, sum(len(toks))::BIGINT AS words FROM (SELECT * FROM sent WHERE len(toks) > 0 AND NOT (len(toks) = 1 AND toks[1] = '')) GROUP BY 1, 2, 3"),
        "phrase_sentences": sql(BASE, PHRASE, select="SELECT side, doc, count(*) AS sentences, sum(len(toks))::BIGINT AS tokens FROM psent WHERE len(toks) > 0 GROUP BY 1, 2"),
        "ngrams": sql(BASE, PHRASE, select="SELECT side, phrase, n_tok::INT AS n_tok, n FROM pcounts"),
        "phrase_counts": sql(BASE, PHRASE, select="SELECT side, phrase, n_tok::INT AS n_tok, n FROM pcounts WHERE (side, phrase) IN (SELECT side, phrase FROM listed)"),
        "dict_resolved": sql(BASE, select="SELECT max(stem) FILTER (side = 'src') AS src, max(stem) FILTER (side = 'trg') AS trg, max(n) FILTER (side = 'src') AS src_n, max(n) FILTER (side = 'trg') AS trg_n FROM top WHERE rn <= 500 GROUP BY rn HAVING count(*) = 2"),
        "dict_pruned": sql(BASE, select="SELECT src, count(*) AS translations FROM (SELECT src, trg FROM dict UNION ALL SELECT a.src, b.trg FROM dict a JOIN dict b ON b.rn = a.rn + 1 WHERE a.rn % 3 = 0) GROUP BY src HAVING count(*) < 2"),
        "dict_retain": sql(BASE, select="SELECT src, trg FROM dict WHERE src IN (SELECT stem FROM sources)"),
        "dict_remove": sql(BASE, select="SELECT src, trg FROM dict WHERE src NOT IN (SELECT stem FROM sources)"),
        "dict_coverage": sql(BASE, select="SELECT count(*) AS types, count(d.src) AS covered_types, sum(n)::BIGINT AS tokens, sum(CASE WHEN d.src IS NOT NULL THEN n END)::BIGINT AS covered_tokens FROM vocab v LEFT JOIN dict d ON d.src = v.stem WHERE side = 'src'"),
        "dict_identity": sql(BASE, select="SELECT stem AS src, stem AS trg FROM vocab GROUP BY stem HAVING count(DISTINCT side) = 2"),
        "induction_sources": sql(BASE, select="SELECT n, stem FROM sources"),
        "context_counts": sql(BASE, CONTEXT, select="SELECT side, stem, ctx, ctx_n, corp_n FROM ctx"),
        "context_positions": sql(BASE, CONTEXT, select="""SELECT a.side, a.tok AS stem, b.tok || '|s:' || (b.pos - a.pos) AS ctx, CAST(count(*) AS DOUBLE) AS ctx_n
            FROM tok a JOIN sources s ON a.side = s.side AND a.tok = s.stem JOIN tok b ON a.side = b.side AND a.doc = b.doc AND a.line_no = b.line_no AND a.sent_no = b.sent_no AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 2
            JOIN cwords w ON w.side = b.side AND w.stem = b.tok GROUP BY 1, 2, 3"""),
        "context_pruned": sql(BASE, CONTEXT, select="SELECT side, stem, ctx, ctx_n FROM (SELECT *, row_number() OVER (PARTITION BY side, stem ORDER BY ctx_n DESC, ctx) AS r FROM ctx) WHERE r <= 5"),
        "context_projected": sql(BASE, CONTEXT, weighted("idf"), select="SELECT stem, ctx, round(w, 6) AS w FROM wctx WHERE side = 'src'"),
        "context_sizes": sql(BASE, PHRASE, CWORDS, PHRASE_CONTEXT, select="""SELECT src, trg, (SELECT count(*) FROM pwctx WHERE side = 'src' AND stem = src) AS src_ctx, (SELECT count(*) FROM pwctx WHERE side = 'trg' AND stem = trg) AS trg_ctx,
            (SELECT count(*) FROM pwctx a JOIN pwctx b ON a.dim = b.dim WHERE a.side = 'src' AND a.stem = src AND b.side = 'trg' AND b.stem = trg) AS shared FROM ptab"""),
        "rank_context": sql(BASE, CONTEXT_RANK, select="SELECT src, trg, score, rk FROM r_ctx"),
        "rank_time": sql(BASE, TIME_RANK, select="SELECT src, trg, score, rk FROM r_time"),
        "rank_edit": sql(BASE, EDIT_RANK, select="SELECT src, trg, score, rk FROM r_edit"),
        "rank_mrr": sql(BASE, FUSED, select="SELECT src, trg, score, rk FROM r_mrr"),
        "rank_best": sql(BASE, CONTEXT_RANK, select="SELECT src, arg_min(trg, struct_pack(rk := rk, trg := trg)) AS trg, max(score) AS score FROM r_ctx GROUP BY src"),
        "rerank_time": sql(BASE, CONTEXT_RANK, TIME_ALL, """, re AS MATERIALIZED (SELECT c.src, c.trg, t.score FROM r_ctx c JOIN time_scores t ON t.src = c.src AND t.trg = c.trg)""" + ranked("r_re", "re", keep=100000), select="SELECT src, trg, score, rk FROM r_re"),
        "rank_dump": sql(BASE, CONTEXT_RANK, select="SELECT r.src, r.score, CASE WHEN max(d.src) IS NOT NULL THEN '* ' ELSE '' END || string_agg(r.trg, ' ' ORDER BY r.trg) AS line FROM r_ctx r LEFT JOIN dict d ON d.src = r.src AND d.trg = r.trg GROUP BY 1, 2"),
        "accuracy_at_k": sql(BASE, CONTEXT_RANK, """, gold AS (SELECT r.src, min(CASE WHEN d.trg IS NOT NULL THEN r.rk END) AS b FROM r_ctx r LEFT JOIN dict d ON d.src = r.src AND d.trg = r.trg WHERE r.src IN (SELECT src FROM dict) GROUP BY 1),
            ks AS (SELECT unnest([1, 5, 10, 20, 30, 40, 50, 60, 80, 100, 200, 300, 400, 500]) AS k)""", select="SELECT k::INT AS k, round(100 * avg(CASE WHEN b <= k THEN 1.0 ELSE 0.0 END), 2) AS accuracy, count(*) AS in_dict FROM gold, ks GROUP BY k"),
        "freq_bins": sql(BASE, """, us AS (SELECT stem, n, row_number() OVER (ORDER BY n DESC, stem) AS rn, count(*) OVER () AS c FROM vocab WHERE side = 'src' AND n > 3 AND n <= 10000),
            bn AS (SELECT *, (rn - 1) // (c // 4) AS bin FROM us WHERE (rn - 1) // (c // 4) < 4)""", select="SELECT stem, n, bin::INT AS bin FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5(stem), stem) AS k FROM bn) WHERE k <= least(40, c) // 4"),
        "freq_bands": sql(BASE, select="SELECT stem, n, floor((n - 5) / ((105 - 5) / 10.0))::BIGINT + 1 AS band FROM vocab WHERE side = 'src' AND n >= 5 AND n < 105"),
        "rank_by_bin": sql(BASE.replace(SOURCES, BINNED), CONTEXT, scored("idf", "cosine"), ", bs AS MATERIALIZED (SELECT b.bin, s.* FROM context_scores s JOIN binned b ON b.stem = s.src)" + ranked("r_bin", "bs", where="score > 0", keys="bin, src"), select="SELECT bin, src, trg, score, rk FROM r_bin"),
        "time_bins": sql(BASE, TIME, select="SELECT side, stem, bin, v FROM tdist"),
        "time_rebin_tumbling": "SELECT user_id::VARCHAR AS stem, (date_diff('day', DATE '2024-01-01', ts::DATE) // 3)::INT AS bin, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2",
        "time_rebin_sliding": """WITH d AS (SELECT user_id::VARCHAR AS stem, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS bin, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2),
            x AS (SELECT *, max(bin) OVER (PARTITION BY stem) AS last FROM d), e AS (SELECT stem, v, last, unnest(range(greatest(0, bin - 2), bin + 1)) AS j FROM x)
            SELECT stem, j::INT AS bin, sum(v) AS v FROM e WHERE j <= greatest(0, last - 2) GROUP BY 1, 2""",
        "time_normalized": """WITH d AS (SELECT user_id::VARCHAR AS stem, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS bin, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2)
            SELECT stem, bin, round(v / sum(v) OVER (PARTITION BY stem), 9) AS v FROM d""",
        "time_guards": """WITH d AS (SELECT user_id AS u, date_diff('day', DATE '2024-01-01', ts::DATE) AS bin FROM events GROUP BY 1, 2)
            SELECT 'tumbling 3' AS "window", false AS refused, count(*) AS bins FROM (SELECT DISTINCT u, bin // 3 FROM d)
            UNION ALL SELECT w, true, (SELECT count(*) FROM d) FROM (SELECT unnest(['tumbling 0', 'sliding -1', 'tumbling normalised', 'sliding normalised']) AS w)""",
        "time_align": sql(BASE, TIME, select="SELECT side, count(DISTINCT bin) AS bins, sum(v) AS v FROM tdist WHERE bin IN (SELECT bin FROM bins) GROUP BY side"),
        "time_merge": "SELECT bin, stem, sum(CASE WHEN bin >= 10 AND bin < 15 THEN 2 ELSE 1 END)::DOUBLE AS v FROM (SELECT date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS bin, (user_id % 10)::VARCHAR AS stem FROM events) GROUP BY 1, 2",
        "score_time_cosine": sql(BASE, TIME, select="SELECT src, trg, round(score, 6) AS score FROM raw_time"),
        "score_edit": sql(BASE, EDIT, select="SELECT src, trg, score FROM edit_scores"),
        "score_edit_translit": sql(BASE, ODD, select=f"""SELECT s.stem AS src, t.stem AS trg, (CASE WHEN {PLAIN.format("s.stem")} <> s.stem THEN {lev(PLAIN.format("s.stem"), "t.stem")} ELSE {lev("s.stem", PLAIN.format("t.stem"))} END)::DOUBLE AS score FROM sources s, targets t"""),
        "score_tokens": sql(BASE, CONTEXT, scored("idf", "cosine"), TIME, ODD, select=f"""SELECT s.stem AS src, t.stem AS trg, coalesce(c.score, 0) AS lex_context, coalesce(x.score, 0) AS lex_time, round({lev("s.stem", "t.stem")} / ((length(s.stem) + length(t.stem)) / 2.0), 9) AS lex_edit
            FROM sources s CROSS JOIN targets t LEFT JOIN context_scores c ON c.src = s.stem AND c.trg = t.stem LEFT JOIN time_scores x ON x.src = s.stem AND x.trg = t.stem"""),
        "context_projected_prob": sql(BASE, CONTEXT, PROB, select="SELECT stem, ctx, round(ctx_n, 6) AS ctx_n, round(corp_n, 6) AS corp_n FROM pproj"),
        "score_s1_prob": sql(BASE, CONTEXT, PROB, scored("idf", "cosine", "pboth_ctx"), select="SELECT src, trg, round(score, 6) AS score FROM raw_scores"),
        "phrase_table_subset": sql(BASE, PHRASE, select="SELECT src, trg FROM ptab WHERE src IN (SELECT stem FROM sources)"),
        "phrase_single_tokens": sql(BASE, PHRASE, select="SELECT DISTINCT src FROM ptab WHERE n_tok = 1"),
        "phrase_context": sql(BASE, PHRASE, CWORDS, PHRASE_CONTEXT, select="SELECT side, stem, ctx, ctx_n, corp_n FROM pctx"),
        "phrase_time": sql(BASE, PHRASE, PHRASE_TIME, select="SELECT side, phrase, bin, v FROM ptime"),
        "phrase_features": sql(BASE, FEATURES, select="SELECT p.src, p.trg, round(c.score, 6) AS ph_context, round(t.score, 6) AS ph_time FROM ptab p JOIN f_ctx c USING (src, trg) JOIN f_time t USING (src, trg)"),
        "lex_features": sql(BASE, LEXICAL, select="SELECT src, trg, round(lex_context, 6) AS lex_context, round(lex_time, 6) AS lex_time FROM lex"),
        "lex_edit": sql(BASE, PHRASE, LINKS, LEX_EDIT, select="SELECT src, trg, round(lex_edit, 6) AS lex_edit FROM ledit"),
        "phrase_table_text": sql(BASE, LEXICAL, LEX_EDIT, select="""SELECT p.src || ' ||| ' || p.trg || ' ||| ' || printf('%.6f %.6f %.6f %s %s %.6f', 2.718, c.score, t.score, CASE WHEN l.lex_context IS NULL THEN '0' ELSE printf('%.6f', l.lex_context) END,
            CASE WHEN l.lex_time IS NULL THEN '0' ELSE printf('%.6f', l.lex_time) END, e.lex_edit) AS line FROM ptab p JOIN f_ctx c USING (src, trg) JOIN f_time t USING (src, trg) JOIN lex l USING (src, trg) JOIN ledit e USING (src, trg)"""),
        "phrase_order_counts": sql(BASE, ORDER, select="SELECT side, phrase, rel, ctx_phrase, n FROM pord"),
        "phrase_order_pruned": sql(BASE, ORDER, select="""SELECT side, phrase, rel, ctx_phrase FROM (SELECT o.*, row_number() OVER (PARTITION BY o.side, o.phrase, o.rel ORDER BY c.n, o.ctx_phrase) AS r
            FROM pord o JOIN pcounts c ON c.side = o.side AND c.phrase = o.ctx_phrase) WHERE r <= 3"""),
        "order_scores": sql(BASE, ORDER_SCORES, select="SELECT src, trg, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("b_mono", "b_swap", "b_disc", "a_mono", "a_swap", "a_disc")) + " FROM osc"),
        "reordering_table_text": sql(BASE, ORDER_SCORES, select="SELECT src || ' ||| ' || trg || ' ||| ' || " + " || ' ' || ".join(f"CASE WHEN {c} IS NULL THEN '0.333333' ELSE printf('%.8f', {c}) END" for c in ("b_mono", "b_swap", "b_disc", "a_mono", "a_swap", "a_disc")) + " AS line FROM osc"),
        "lsh_signatures": sql(BASE, CONTEXT, weighted("idf"), LSH, select="SELECT side, stem, string_agg(CASE WHEN bit THEN '1' ELSE '0' END, '' ORDER BY b) AS bits FROM sgn GROUP BY 1, 2"),
        "lsh_cosine": sql(BASE, CONTEXT, weighted("idf"), LSH, select="""SELECT a.stem AS src, b.stem AS trg, round(greatest(0, cos(pi() * sum(CASE WHEN a.bit <> b.bit THEN 1 ELSE 0 END) / 256.0)), 6) AS score
            FROM sgn a JOIN sgn b ON a.b = b.b WHERE a.side = 'src' AND b.side = 'trg' GROUP BY 1, 2"""),
        "order_scores_lsh": sql(BASE, ORDER_LSH, select="SELECT src, trg, " + ", ".join(f"max(score) FILTER (name = '{c}') AS {c}" for c in ("b_mono", "b_swap", "b_disc", "a_mono", "a_swap", "a_disc")) + " FROM apart GROUP BY 1, 2"),
        "signature_dump": sql(BASE, PHRASE, CWORDS, PHRASE_CONTEXT, PHRASE_TIME, DUMPED, select="SELECT side, stem, c.sig AS context, t.sig AS time FROM csg_packed c FULL JOIN tsg_packed t USING (side, stem)"),
        "vocab_with_context": sql(BASE, CONTEXT, select="SELECT side, stem, n FROM vocab JOIN (SELECT DISTINCT side, stem FROM ctx) USING (side, stem)"),
        "vocab_with_time": sql(BASE, TIME, select="SELECT side, stem, n FROM vocab WHERE (side, stem) IN (SELECT side, stem FROM tdist)"),
        "vocab_collected": sql(BASE, select="SELECT side, stem FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY stem) AS r FROM counts WHERE length(stem) > 2) WHERE r <= 1000"),
        "vocab_without_top": sql(BASE, select="SELECT side, stem, n FROM top WHERE rn > 30 AND n > 5"),
        "context_pruned_by_corpus": sql(BASE, CONTEXT, select="SELECT side, stem, ctx, corp_n FROM (SELECT *, row_number() OVER (PARTITION BY side, stem ORDER BY corp_n DESC, ctx) AS r FROM ctx) WHERE r <= 5"),
        "ranking_band": sql(BASE, CONTEXT_RANK, select="SELECT src, trg, score, rk FROM r_ctx WHERE score BETWEEN 0.2 AND 0.6"),
        "random_candidate": sql(BASE, CONTEXT_RANK, select=f"SELECT src, arg_min(trg, struct_pack(h := {draw('src', 'trg')}, trg := trg)) AS trg, arg_min(score, struct_pack(h := {draw('src', 'trg')}, trg := trg)) AS score FROM r_ctx GROUP BY src"),
        "vocab_sampled": sql(BASE, select=f"SELECT side, stem, n FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY {draw('stem')}, stem) AS r FROM vocab) WHERE r <= 100"),
        "dict_split": sql(BASE, select=f"SELECT src, trg, CASE WHEN {share('src')} < 300000 THEN 'one' ELSE 'other' END AS part FROM dict"),
        "phrase_order_sampled": sql(BASE, ORDER, select=f"SELECT side, phrase, rel, ctx_phrase, n FROM pord WHERE {share('side', 'phrase', 'rel', 'ctx_phrase')} < 250000"),
        "phrase_targets": sql(BASE, PHRASE, select="SELECT DISTINCT trg FROM ptab WHERE src IN (SELECT stem FROM sources)"),
        "accuracy_by_bin_all": sql(BASE.replace(SOURCES, BINNED), FUSED, """, r_all AS MATERIALIZED (SELECT 'time' AS ranking, src, trg, rk FROM r_time UNION ALL SELECT 'context', src, trg, rk FROM r_ctx
            UNION ALL SELECT 'edit', src, trg, rk FROM r_edit UNION ALL SELECT 'fused', src, trg, rk FROM r_mrr),
            gold AS (SELECT r.ranking, b.bin, r.src, min(CASE WHEN d.trg IS NOT NULL THEN r.rk END) AS b FROM r_all r JOIN binned b ON b.stem = r.src LEFT JOIN dict d ON d.src = r.src AND d.trg = r.trg WHERE r.src IN (SELECT src FROM dict) GROUP BY 1, 2, 3),
            ks AS (SELECT unnest([1, 5, 10, 20, 30, 40, 50, 60, 80, 100, 200, 300, 400, 500]) AS k)""", select="SELECT ranking, bin, k::INT AS k, round(100 * avg(CASE WHEN b <= k THEN 1.0 ELSE 0.0 END), 2) AS accuracy, count(*) AS in_dict FROM gold, ks GROUP BY ranking, bin, k"),
        "page_properties": """WITH p AS (SELECT url, 0 AS dataset, 'size' AS key, length(html)::VARCHAR AS value FROM pages UNION ALL SELECT url, 1, 'size', '0' FROM pages UNION ALL SELECT url, 1, 'again', page_id::VARCHAR FROM pages WHERE page_id % 2 = 0
            UNION ALL SELECT url, 1, 'again', '' FROM pages), f AS (SELECT *, rank() OVER (PARTITION BY url, key ORDER BY dataset) AS r FROM p WHERE value <> '')
            SELECT url, key, array_to_string(list_sort(list(value)), ' ') AS "values" FROM f WHERE r = 1 GROUP BY 1, 2""",
        "rank_given_lists": sql(BASE.replace(SOURCES, GIVEN_SOURCES).replace(TARGETS, GIVEN_TARGETS), CONTEXT_RANK, select="SELECT src, trg, score, rk FROM r_ctx"),
        "accuracy_by_bin": sql(BASE.replace(SOURCES, BINNED), CONTEXT, scored("idf", "cosine"), ", bs AS MATERIALIZED (SELECT b.bin, s.* FROM context_scores s JOIN binned b ON b.stem = s.src)" + ranked("r_bin", "bs", where="score > 0", keys="bin, src"), """, gold AS (SELECT r.bin, r.src, min(CASE WHEN d.trg IS NOT NULL THEN r.rk END) AS b FROM r_bin r LEFT JOIN dict d ON d.src = r.src AND d.trg = r.trg WHERE r.src IN (SELECT src FROM dict) GROUP BY 1, 2),
            ks AS (SELECT unnest([1, 5, 10, 20, 30, 40, 50, 60, 80, 100, 200, 300, 400, 500]) AS k)""", select="SELECT bin, k::INT AS k, round(100 * avg(CASE WHEN b <= k THEN 1.0 ELSE 0.0 END), 2) AS accuracy, count(*) AS in_dict, 'context' AS ranking FROM gold, ks GROUP BY bin, k"),
        "page_languages_filled": "WITH" + PROFILES.format(learnt="doc_id % 3 = 0") + """SELECT doc_id::VARCHAR AS url, unnest([1, 2])::INT AS segment_id, CASE WHEN d.doc_id % 3 = 0 THEN d.lang WHEN t.reliable THEN t.lang END AS lang FROM documents d LEFT JOIN told t USING (doc_id)""",
        "lang_profiles": "WITH" + PROFILES.format(learnt="doc_id % 4 <> 2") + "SELECT doc_id, t.lang, t.distance, coalesce(t.reliable, false) AS reliable FROM documents d LEFT JOIN told t USING (doc_id)",
        "pages_versions": "WITH" + PAGES + "SELECT url, segment_id, fetched, lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, md5(content) AS content_md5, 'size=' || length(html) || ',' || length(html) || ' characters' || CASE WHEN title <> '' THEN ';title=' || title ELSE '' END AS meta, links FROM pv WHERE content <> ''",
        "pages_merge": "WITH" + MERGED + "SELECT url, segment_id, fetched, lang, md5(content) AS content_md5, CASE WHEN page_id % 2 = 0 THEN 'again=yes;' ELSE '' END || 'crawl=first;size=' || size || ',' || size || ' characters' AS props, links FROM merged",
        "page_html_lang": "WITH" + PAGES + "SELECT url, lang FROM pv",
        "page_url_lang": "WITH" + NEWS + "SELECT url, CASE WHEN page_id % 8 = 7 THEN NULL ELSE lang END AS lang FROM told",
        "page_dates": "WITH" + NEWS + "SELECT url, lang, modified FROM told",
        "dated_corpus": "WITH" + NEWS + "SELECT lang, year(make_timestamp(modified * 1000))::INT AS year, make_timestamp(modified * 1000)::DATE::VARCHAR AS day, false AS rejected, modified, md5(string_agg(content, chr(10) ORDER BY content)) AS text_md5 FROM (SELECT DISTINCT lang, modified, content FROM told WHERE modified IS NOT NULL AND lang IS NOT NULL) GROUP BY lang, modified",
        "lang_stats": "WITH" + NEWS + r"SELECT coalesce(lang, 'none') AS lang, count(DISTINCT url) AS pages, count(*) AS versions, sum(len([x FOR x IN regexp_split_to_array(content, '[\s\x{000b}]+') IF x <> '']))::BIGINT AS words FROM told GROUP BY 1",
        "page_links": r"""SELECT url, count(*) AS links, count(DISTINCT target) AS targets FROM (SELECT url, regexp_extract(a, '(?i)href="([^"]*)"', 1) AS target FROM (SELECT url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="[^"]*"[^>]*>[^<]*</a>')) AS a FROM pages)) GROUP BY url""",
        "lang_detect": "WITH" + DETECT.format(values=values) + "SELECT a.doc_id, a.lang, (a.n >= 3 AND a.n >= 1.2 * b.n) AS reliable FROM ordered a JOIN ordered b USING (doc_id) WHERE a.r = 1 AND b.r = 2",
        "page_bbc_english": "SELECT page_id, page_id % 7 NOT IN (4, 5) AND page_id % 3 < 2 AS english FROM pages",
        "classes_met": sql(BASE, select=f"SELECT * FROM ({classes.format(stem='stem[1:5]')}) WHERE (side, stem) IN (SELECT side, stem[1:5] FROM vocab WHERE n > 20)"),
        "common_topics": sql(BASE, ", sl AS (SELECT rn, unnest(string_split(src, '')) AS x FROM dict), tl AS (SELECT rn, unnest(string_split(trg, '')) AS x FROM dict)", select="SELECT src, trg, count(t.x) AS common FROM dict JOIN sl USING (rn) LEFT JOIN tl t ON t.rn = dict.rn AND t.x = sl.x GROUP BY src, trg"),
        "json_trees": """SELECT event_id, (props->>'$.k')::BIGINT AS k, event_id % 7 AS tag, true AS on, -1::BIGINT AS wrong, '-' AS missing, 3 AS tags, 'VOID' AS second, 'OBJECT' AS kind,
            '["' || event_type || '",null,' || (event_id % 7) || ',[1]]' AS longer FROM events""",
        "json_fields": "SELECT event_id, (props->>'$.k')::BIGINT AS k, -1::BIGINT AS missing, to_json(struct_pack(id := event_id, type := event_type))::VARCHAR AS built FROM events",
    }
    for name, (weight, kind) in {"binary": ("binary", "cosine"), "s0": ("count", "cosine"), "s1": ("idf", "cosine"), "s2": ("idf", "dice"), "s3": ("idf", "dice_cosine"), "tfidf": ("idf", "product")}.items():
        out[f"score_{name}"] = sql(BASE, CONTEXT, scored(weight, kind), select="SELECT src, trg, round(score, 6) AS score FROM raw_scores")
    return out


PROB = """,
pdict AS MATERIALIZED (
  SELECT src, trg, 0.7::DOUBLE AS prob FROM dict UNION ALL SELECT a.src, b.trg, 0.3::DOUBLE FROM dict a JOIN dict b ON b.rn = a.rn + 1),
pproj AS MATERIALIZED (SELECT c.side, c.stem, d.trg AS ctx, c.ctx_n * d.prob AS ctx_n, c.corp_n * d.prob AS corp_n FROM ctx c JOIN pdict d ON c.ctx = d.src WHERE c.side = 'src'),
pboth_ctx AS (SELECT side, stem, ctx, ctx_n, corp_n FROM pproj UNION ALL SELECT side, stem, ctx, ctx_n, corp_n FROM ctx WHERE side = 'trg')
"""
