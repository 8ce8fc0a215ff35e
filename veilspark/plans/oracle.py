"""SQL of the queries, for DuckDB over the same tables."""

from __future__ import annotations

import re

from ..functions.text import PATTERNS, URL
from ..operators.detect import BASELINE
from ..operators.fairness import NAMES
from ..operators.pathredact import SYSTEM
from ..schema import BIO_LABELS, IDENTIFIER_TYPES, IDENTIFYING
from ..operators.stats import Z_ONE_SIDED, Z_TWO_SIDED

_TYPES = "(" + ", ".join(f"'{t}'" for t in IDENTIFYING) + ")"
_NAMES = "(" + ", ".join(f"'{t}'" for t in NAMES) + ")"

_PRED = "pred AS (SELECT DISTINCT span_id, doc_id, start_pos AS st, end_pos AS en, label AS lb, score AS sc FROM predicted_span)"
_RAW = "raw AS (SELECT doc_id, s.start_pos AS st, s.end_pos AS en, s.label AS lb, i FROM (SELECT doc_id, unnest(spans) AS s, generate_subscripts(spans, 1) AS i FROM documents) WHERE s IS NOT NULL AND s.end_pos > s.start_pos)"
#: Greedy overlap drop as a recursion over the spans of a document in order.
_KEPT = (
    _RAW
    + """, g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY st, en, i) AS rn FROM raw),
kall AS (
  SELECT doc_id, rn, st, en, lb, en AS last, true AS keep FROM g WHERE rn = 1
  UNION ALL
  SELECT g.doc_id, g.rn, g.st, g.en, g.lb, CASE WHEN g.st >= kall.last THEN g.en ELSE kall.last END, g.st >= kall.last FROM kall JOIN g ON g.doc_id = kall.doc_id AND g.rn = kall.rn + 1
), k AS (SELECT * FROM kall WHERE keep)"""
)
#: Gold rows of the identifying types with masked characters and the first overlapping prediction.
_GR = (
    _PRED
    + ", "
    + _KEPT
    + f""", mask AS (SELECT DISTINCT doc_id, unnest(range(greatest(0, st), en)) AS c FROM pred WHERE en > st AND lb IN {_TYPES}),
gk AS (SELECT * FROM k WHERE lb IN {_TYPES}),
gc AS (SELECT doc_id, rn, unnest(range(st, en)) AS c FROM gk),
gm AS (SELECT gc.doc_id, gc.rn, count(mask.c) AS masked FROM gc LEFT JOIN mask ON mask.doc_id = gc.doc_id AND mask.c = gc.c GROUP BY ALL),
gf AS (SELECT gk.doc_id, gk.rn, pred.lb AS found FROM gk JOIN pred ON pred.doc_id = gk.doc_id AND pred.st < gk.en AND pred.en > gk.st QUALIFY row_number() OVER (PARTITION BY gk.doc_id, gk.rn ORDER BY pred.st, pred.en, pred.lb, pred.sc) = 1),
gr AS (SELECT gk.doc_id, gk.rn, gk.st, gk.en, gk.lb, gm.masked, gf.found, gm.masked = gk.en - gk.st AS caught FROM gk JOIN gm USING (doc_id, rn) LEFT JOIN gf USING (doc_id, rn))"""
)
_OVER = """rawmask AS (SELECT DISTINCT doc_id, unnest(range(greatest(0, st), en)) AS c FROM raw),
pc AS (SELECT span_id, doc_id, st, en, lb, sc, unnest(range(st, en)) AS c FROM pred WHERE en > st),
ov AS (SELECT pc.span_id, pc.doc_id, pc.st, pc.en, pc.lb, pc.sc FROM pc LEFT JOIN rawmask r ON r.doc_id = pc.doc_id AND r.c = pc.c GROUP BY ALL HAVING count(r.c) = 0)"""
_PER_DOC = (
    _GR
    + ", "
    + _OVER
    + """, pd AS (
SELECT d.doc_id, coalesce(gold, 0) AS gold, coalesce(caught, 0) AS caught, coalesce(leaked, 0) AS leaked, coalesce(partly, 0) AS partly, coalesce(typed, 0) AS typed, coalesce(gold_chars, 0) AS gold_chars,
  coalesce(masked_chars, 0) AS masked_chars, coalesce(predicted, 0) AS predicted, coalesce(n_over, 0) AS n_over
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS gold, count(*) FILTER (caught) AS caught, count(*) FILTER (NOT caught) AS leaked, count(*) FILTER (NOT caught AND masked > 0) AS partly,
  count(*) FILTER (caught AND found = lb) AS typed, sum(en - st) AS gold_chars, sum(masked) AS masked_chars FROM gr GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS predicted FROM pred WHERE en > st GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_over FROM ov GROUP BY doc_id) USING (doc_id))"""
)
_GATE = (
    _PER_DOC
    + """, gd AS (SELECT doc_id, risk, risk_naive, expected_surviving_identifier_tokens AS expected, budget, forwarded FROM gate_decision WHERE risk IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY decided_at DESC NULLS LAST, risk DESC NULLS LAST, risk_naive DESC NULLS LAST, expected_surviving_identifier_tokens DESC NULLS LAST, budget DESC NULLS LAST) = 1),
gate AS (SELECT gd.*, pd.leaked > 0 AS leaked FROM gd JOIN pd USING (doc_id))"""
)
_ROWS = (
    _GR
    + """, fr AS (SELECT gr.doc_id, d.split, gr.lb, substring(d.text, gr.st + 1, gr.en - gr.st) AS surface, NOT gr.caught AS leaked FROM gr JOIN documents d USING (doc_id)
  WHERE d.text IS NOT NULL AND gr.st >= 0 AND gr.en <= length(d.text)),
fn AS (SELECT *, lower(trim(regexp_replace(surface, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' ')) AS key FROM fr),
tr AS (SELECT DISTINCT key FROM fn WHERE split = 'train'),
ev AS (SELECT fn.*, tr.key IS NOT NULL AS seen FROM fn LEFT JOIN tr USING (key) WHERE split IN ('dev', 'test'))"""
)
_STACK = _GATE + ", st AS (" + " UNION ALL ".join(f"SELECT doc_id, leaked, '{c}' AS statistic, {c} AS score FROM gate" for c in ("risk", "risk_naive", "expected")) + ")"
_AUC = (
    _STACK
    + """, rk AS (SELECT statistic, leaked, rank() OVER (PARTITION BY statistic ORDER BY score) + (count(*) OVER (PARTITION BY statistic, score) - 1) / 2.0 AS r FROM st WHERE score IS NOT NULL AND leaked IS NOT NULL),
a AS (SELECT statistic, count(*) AS n, count(*) FILTER (leaked) AS positives, sum(r) FILTER (leaked) AS r FROM rk GROUP BY statistic),
au AS (SELECT statistic, n, positives, CASE WHEN positives > 0 AND n > positives THEN (r - positives * (positives + 1) / 2.0) / (positives * (n - positives)::DOUBLE) END AS auc FROM a)"""
)
_BUDGETS = "[0.02, 0.045, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2, 0.3]::DOUBLE[]"
_RC = (
    _GATE
    + f""", rc AS (SELECT b AS budget, count(*) AS documents, count(*) FILTER (risk <= b) AS forwarded, count(*) FILTER (risk <= b AND leaked) AS leaks, count(*) FILTER (risk > b AND leaked) AS leaks_held
  FROM gate, (SELECT unnest({_BUDGETS}) AS b) GROUP BY b)"""
)
_BINS = (
    _GATE
    + """, o AS (SELECT *, row_number() OVER (ORDER BY risk, doc_id) AS rn, count(*) OVER () AS total FROM gate),
bins AS (SELECT (rn - 1) // greatest(1, total // 10) AS bin, count(*) AS n, round_even(avg(risk), 4) AS predicted, round_even(avg(leaked::INT::DOUBLE), 4) AS observed FROM o GROUP BY 1)"""
)
_REDACT = (
    _PRED
    + f""", rg AS (SELECT p.*, row_number() OVER (PARTITION BY doc_id ORDER BY st, en DESC, lb, sc) AS rn FROM pred p JOIN documents d USING (doc_id) WHERE en > st AND lb IN {_TYPES}),
rf AS (
  SELECT doc_id, rn, st AS cs, en AS ce, lb AS cl, 1 AS grp FROM rg WHERE rn = 1
  UNION ALL
  SELECT rg.doc_id, rg.rn, CASE WHEN rg.st >= rf.ce THEN rg.st ELSE rf.cs END, CASE WHEN rg.st >= rf.ce THEN rg.en ELSE greatest(rf.ce, rg.en) END, CASE WHEN rg.st >= rf.ce THEN rg.lb ELSE rf.cl END,
    CASE WHEN rg.st >= rf.ce THEN rf.grp + 1 ELSE rf.grp END FROM rf JOIN rg ON rg.doc_id = rf.doc_id AND rg.rn = rf.rn + 1
), rs AS (SELECT doc_id, cs AS st, ce AS en, cl AS lb FROM rf QUALIFY row_number() OVER (PARTITION BY doc_id, grp ORDER BY rn DESC) = 1),
rt AS (SELECT rs.doc_id, rs.st, least(rs.en, length(d.text)) AS en, rs.lb, substring(d.text, rs.st + 1, least(rs.en, length(d.text)) - rs.st) AS surface FROM rs JOIN documents d USING (doc_id)
  WHERE d.text IS NOT NULL AND rs.st >= 0 AND rs.st < length(d.text)),
r1 AS (SELECT *, lower(trim(surface, ' ')) AS key FROM rt),
r2 AS (SELECT *, min(st) OVER (PARTITION BY doc_id, lb, key) AS first FROM r1),
rn AS (SELECT doc_id, st, en, lb, surface, '[' || upper(lb) || '_' || dense_rank() OVER (PARTITION BY doc_id, lb ORDER BY first, key) || ']' AS ph FROM r2),
seg AS (SELECT rn.doc_id, rn.st, substring(d.text, coalesce(lag(rn.en) OVER w, 0) + 1, rn.st - coalesce(lag(rn.en) OVER w, 0)) || ph AS piece FROM rn JOIN documents d USING (doc_id) WINDOW w AS (PARTITION BY rn.doc_id ORDER BY rn.st)),
red AS (SELECT d.doc_id, coalesce(m.n, 0) AS n_spans, coalesce(m.v, 0) AS vault_size, CASE WHEN m.n IS NULL THEN d.text ELSE p.t || substring(d.text, m.e + 1) END AS redacted FROM documents d
  LEFT JOIN (SELECT doc_id, count(*) AS n, count(DISTINCT ph) AS v, max(en) AS e FROM rn GROUP BY doc_id) m USING (doc_id)
  LEFT JOIN (SELECT doc_id, string_agg(piece, '' ORDER BY st) AS t FROM seg GROUP BY doc_id) p USING (doc_id) WHERE d.text IS NOT NULL),
vault AS (SELECT doc_id, ph, arg_min(surface, st) AS surface FROM rn GROUP BY doc_id, ph)"""
)
_SPACES = "[ \\t\\n\\r\\f\\x0B]+"



#: Letters and digits as \w has them, white space as \s has it.
_W = r"\p{L}\p{N}_"
_WS = r" \t\n\r\f\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_O, _C = "chr(57344)", "chr(57345)"


def _classes(atom: str) -> str:
    inner = atom.startswith("[")
    return atom.replace(r"\w", _W if inner else f"[{_W}]").replace(r"\d", r"\p{Nd}").replace(r"\s", _WS if inner else f"[{_WS}]")


def _twice(pattern: str) -> str:
    """pattern for a text in which each character is written twice. The engine has no lookaround; with two copies one of them can stand for the neighbour a match looks at, and both matches beside a character get one."""
    out = []
    for atom in re.findall(r"\{\d+,?\d*\}|\[(?:\\.|[^\]\\])*\]|\\.|\(\?:|[()|?*+]|.", pattern):
        out.append(atom if atom[0] in "{()|?*+" else f"(?:{_classes(atom)}{{2}})")
    return "".join(out)


_EDGE, _EDGE_AFTER = f"(^|[^{_W}])", f"([^{_W}]|$)"


def _marked(pattern: str) -> tuple[str, str, int]:
    """(expression of the engine, its replacement with the match between sentinels, copies of each character)."""
    if pattern == BASELINE["credit_card_number"]:
        d, sep = r"(?:\p{Nd}{2})", "(?:[ -]{2})"
        return rf"{_EDGE}((?:{d}{sep}?){{12,18}})(?:({d}{sep})([{_W}])|({d}){_EDGE_AFTER})", r"\1O\2\3\5C\4\6", 2
    if pattern == BASELINE["api_key"]:
        a, x = "[A-Za-z0-9_]{2}", "(?:[A-Za-z0-9_-]{2})"
        return rf"(?:{_EDGE}({a})|([{_W}])(-{{2}}))({x}{{22,}})(?:({a}){_EDGE_AFTER}|(-{{2}})([{_W}]))", r"\1\3O\2\4\5\6\8C\7\9", 2
    body = re.sub(r"\(\?!.*?\)", "", pattern) if pattern == PATTERNS["ssn"] else pattern
    edges = {r"\b": _EDGE, r"(?<![\d\-])": r"(^|[^\p{Nd}-])", r"(?<![\w@])": f"(^|[^{_W}@])", r"(?<![\w>:/.])": f"(^|[^{_W}>:/.])"}, {r"\b": _EDGE_AFTER, r"(?![\d\-])": r"([^\p{Nd}-]|$)"}
    first = next((e for e in edges[0] if body.startswith(e)), "")
    body = body[len(first) :]
    last = next((e for e in edges[1] if body.endswith(e)), "")
    body = body[: len(body) - len(last)]
    if not first and not last:
        return f"()({''.join(_classes(a) for a in re.findall(r'\[(?:\\.|[^\]\\])*\]|\\.|.', body))})()", r"\1O\2C\3", 1
    return f"{edges[0].get(first, '()')}({_twice(body)}){edges[1].get(last, '()')}", r"\1O\2C\3", 2


def _found(name: str, pattern: str, source: str = "documents", text: str = "text") -> str:
    """CTE name (doc_id, st, en, surface): matches of pattern in the column text of source, with their places."""
    expr, new, copies = _marked(pattern)
    expr, new = expr.replace("'", "''"), "'" + new.replace("O", f"' || {_O} || '").replace("C", f"' || {_C} || '") + "'"
    written = "regexp_replace(txt, '(?s)(.)', '\\1\\1', 'g')" if copies == 2 else "txt"
    return f"""{name} AS (SELECT doc_id, ((e - length(part)) // {copies})::BIGINT AS st, (e // {copies})::BIGINT AS en, substring(txt, ((e - length(part)) // {copies} + 1)::BIGINT, (length(part) // {copies})::BIGINT) AS surface
  FROM (SELECT doc_id, txt, part, k, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM (SELECT doc_id, txt, unnest(parts) AS part, generate_subscripts(parts, 1) AS k
    FROM (SELECT doc_id, {text} AS txt, string_split(replace(regexp_replace({written.replace("txt", text)}, '{expr}', {new}, 'g'), {_C}, {_O}), {_O}) AS parts FROM {source} WHERE {text} IS NOT NULL) WHERE len(parts) > 1)) WHERE k % 2 = 0)"""


def _labelled(patterns: dict[str, str], conditions: dict[str, str]) -> str:
    """CTE hits (doc_id, st, en, lb, ord) of all patterns, and found, those left when overlaps are dropped, longest first."""
    parts = [_found(f"h_{k}", p) for k, p in patterns.items()]
    union = " UNION ALL ".join(f"SELECT doc_id, st, en, '{k}' AS lb, {i} AS ord FROM h_{k} WHERE {conditions.get(k, 'true')}" for i, k in enumerate(patterns))
    return ", ".join(parts) + f""", hits AS ({union}), hg AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY st, en DESC, ord, st) AS rn FROM hits WHERE en > st),
hall AS (SELECT doc_id, rn, st, en, lb, en AS last, true AS keep FROM hg WHERE rn = 1
  UNION ALL SELECT hg.doc_id, hg.rn, hg.st, hg.en, hg.lb, CASE WHEN hg.st >= hall.last THEN hg.en ELSE hall.last END, hg.st >= hall.last FROM hall JOIN hg ON hg.doc_id = hall.doc_id AND hg.rn = hall.rn + 1),
found AS (SELECT doc_id, st, en, lb FROM hall WHERE keep)"""


def _hits(pattern: str, condition: str = "true") -> str:
    return f"WITH {_found('h', pattern)} SELECT doc_id, count(*) AS n, string_agg(surface, '|' ORDER BY st) AS surfaces FROM h WHERE {condition} GROUP BY doc_id"


_DIGITS = "regexp_replace(surface, '[^0-9]', '', 'g')"
_LUHN = f"length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN ({_DIGITS})[-i]::INT ELSE (({_DIGITS})[-i]::INT * 2) % 10 + (({_DIGITS})[-i]::INT * 2) // 10 END)) % 10 = 0"
_IB = "upper(replace(surface, ' ', ''))"
_IBAN = f"length({_IB}) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(substring({_IB}, 5) || substring({_IB}, 1, 4), ''), lambda c: (CASE WHEN c BETWEEN 'A' AND 'Z' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)::BIGINT), lambda a, v: CASE WHEN v > 9 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END, 0::BIGINT) = 1"
_SSN = "NOT (surface LIKE '000%' OR surface LIKE '666%' OR surface LIKE '9%' OR surface LIKE '____00%' OR surface LIKE '%-0000')"
_SOUND = {"credit_card_number": _LUHN, "iban": _IBAN, "ssn": _SSN}
_VALIDATORS = _labelled(PATTERNS, _SOUND)
_BY_LABEL = "SELECT lb AS label, count(*) AS spans, sum(en - st)::BIGINT AS chars FROM found GROUP BY lb"
#: Tokens at white space of each text, numbered, with the stand-in scorer's posterior, and how many of their characters spans of any and of the identifying types hide.
_TOKENS = (
    _PRED
    + ", "
    + _found("tk0", r"[^\s]+")
    + f""", tk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY st) AS k, CASE WHEN contains(surface, '@') THEN 'email' WHEN regexp_matches(surface, '[0-9]{{2}}') THEN 'phone_number' ELSE 'name' END AS lb,
  1 / (1 + exp(-(-4.0::DOUBLE + 1.5 * (surface BETWEEN 'A' AND 'Z~' AND surface < '[')::INT + 2.0 * regexp_matches(surface, '[0-9]{{2}}')::INT + 4.0 * contains(surface, '@')::INT + 0.05::DOUBLE * least(en - st, 20)))) AS p FROM tk0),
hid AS (SELECT doc_id, c, max((lb IN {_TYPES})::INT) AS own FROM (SELECT doc_id, lb, unnest(range(greatest(0, st), en)) AS c FROM pred WHERE en > st) GROUP BY ALL),
tc AS (SELECT doc_id, k, unnest(range(st, en)) AS c FROM tk), tm AS (SELECT tc.doc_id, tc.k, count(hid.c) AS any_hidden, count(hid.c) FILTER (own = 1) AS own_hidden FROM tc LEFT JOIN hid USING (doc_id, c) GROUP BY ALL),
tt AS (SELECT tk.*, any_hidden < en - st AS left_any, coalesce(own_hidden, 0) < en - st AS left_own FROM tk JOIN tm USING (doc_id, k))"""
)
_STRIP = "trim(surface, '.,;:!?()[]\"' || chr(39))"
_NO_MODEL = (
    _TOKENS
    + f""", nm AS (SELECT d.doc_id, (length(d.text) - coalesce(h.n, 0))::BIGINT AS surviving_chars, coalesce(t.w, 0)::BIGINT AS surviving_words, coalesce(t.c, 0)::BIGINT AS surviving_capitalised, coalesce(t.g, 0)::BIGINT AS surviving_digit_runs, coalesce(s.n, 0)::BIGINT AS spans,
  (coalesce(t.c, 0) + coalesce(t.g, 0))::BIGINT AS capitals_and_digits FROM documents d
  LEFT JOIN (SELECT hid.doc_id, count(*) AS n FROM hid JOIN documents USING (doc_id) WHERE c < length(text) GROUP BY ALL) h USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS w, count(*) FILTER (regexp_full_match({_STRIP}, '[A-Z][a-z]{{1,20}}')) AS c, count(*) FILTER (regexp_matches({_STRIP}, '\\p{{Nd}}{{2}}')) AS g FROM tt WHERE left_any GROUP BY doc_id) t USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM pred GROUP BY doc_id) s USING (doc_id) WHERE d.text IS NOT NULL)"""
)


_MEASURES = ("gold", "caught", "leaked", "partly", "typed", "predicted", "over", "gold_chars", "masked_chars", "docs_with_gold", "docs_with_leak", "docs", "recall", "typed_recall", "doc_leak_rate", "over_rate", "masked_fraction")


def _ranked(rows: str, statistics: tuple[str, ...]) -> str:
    """statistic, auc, place of each statistic and its negation, over rows with `leaked`."""
    stacked = " UNION ALL ".join(f"SELECT leaked, '{c}' AS statistic, {c}::DOUBLE AS score FROM {rows}" for c in statistics)
    return f""", rs AS ({stacked}), rr AS (SELECT statistic, leaked, rank() OVER (PARTITION BY statistic ORDER BY score) + (count(*) OVER (PARTITION BY statistic, score) - 1) / 2.0 AS r FROM rs WHERE score IS NOT NULL),
ra AS (SELECT statistic, (sum(r) FILTER (leaked) - count(*) FILTER (leaked) * (count(*) FILTER (leaked) + 1) / 2.0) / (count(*) FILTER (leaked) * count(*) FILTER (NOT leaked))::DOUBLE AS auc FROM rr GROUP BY statistic HAVING count(*) FILTER (leaked) BETWEEN 1 AND count(*) - 1),
rb AS (SELECT statistic, round(auc, 9) AS auc FROM ra UNION ALL SELECT statistic || ' (negated)', round(1 - auc, 9) FROM ra) SELECT *, row_number() OVER (ORDER BY auc DESC, statistic) AS place FROM rb"""


#: Isotonic blocks by the max-min formula: the mean at i is the largest over beginnings j of the smallest over ends k of the mean from j to k; then blocks of 25 rows and more.
def _blocks() -> str:
    upper = _wilson("leaks", "n", Z_ONE_SIDED, "+")
    return (
        _GATE
        + f""", pr AS (SELECT *, row_number() OVER (ORDER BY x, leak) AS i FROM (SELECT expected::DOUBLE AS x, leaked::INT AS leak, count(*) AS n, sum(leaked::INT) AS y FROM gate WHERE expected IS NOT NULL AND leaked IS NOT NULL GROUP BY 1, 2)),
cu AS (SELECT *, sum(n) OVER (ORDER BY i) AS cn, sum(y) OVER (ORDER BY i) AS cy FROM pr),
jk AS (SELECT a.i AS j, b.i AS k, (b.cy - a.cy + a.y)::DOUBLE / (b.cn - a.cn + a.n)::DOUBLE AS m FROM cu a JOIN cu b ON b.i >= a.i),
sm AS (SELECT j, k AS i, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS m FROM jk), iso AS (SELECT i, max(m) AS g FROM sm GROUP BY i),
bl AS (SELECT dense_rank() OVER (ORDER BY g) AS b, max(x) AS x, sum(n) AS n, sum(y) AS y FROM iso JOIN cu USING (i) GROUP BY g),
mg AS (SELECT b, 1 AS grp, n AS sz FROM bl WHERE b = 1
  UNION ALL SELECT bl.b, CASE WHEN mg.sz < 25 THEN mg.grp ELSE mg.grp + 1 END, CASE WHEN mg.sz < 25 THEN mg.sz + bl.n ELSE bl.n END FROM mg JOIN bl ON bl.b = mg.b + 1),
gs AS (SELECT grp, sum(n) AS n FROM mg JOIN bl USING (b) GROUP BY grp), lg AS (SELECT max(grp) AS top FROM gs),
fb AS (SELECT CASE WHEN grp = top AND grp > 1 AND (SELECT n FROM gs WHERE grp = top) < 25 THEN grp - 1 ELSE grp END AS f, max(x) AS right_edge, sum(n)::BIGINT AS n, sum(y)::BIGINT AS leaks FROM mg JOIN bl USING (b), lg GROUP BY 1),
cb AS (SELECT row_number() OVER w - 1 AS block, right_edge, n, leaks, max((leaks + 0.5) / (n + 1)) OVER w AS p_hat, max(least(1, {upper})) OVER w AS p_upper FROM fb WINDOW w AS (ORDER BY right_edge, leaks / n ROWS UNBOUNDED PRECEDING))"""
    )


_DECISION = """risk <= budget AS forward, round(risk, 5) AS risk, round(naive, 5) AS risk_naive, round(expected::DECIMAL(18, 9), 4)::DOUBLE AS expected_surviving_identifier_tokens, budget, CASE WHEN risk <= budget THEN 'hosted_model' WHEN risk > budget THEN 'local_model' END AS route,
  CASE WHEN risk <= budget THEN printf('residual leak risk %.3f is within the %.3f budget', risk, budget) WHEN risk > budget THEN printf('residual leak risk %.3f exceeds the %.3f budget -- answering locally', risk, budget) END AS reason"""
_NAME = "regexp_replace(coalesce(source, 'none'), '[^A-Za-z0-9_.-]', '_', 'g')"
_PLANTED = f"""src AS (SELECT doc_id, text || chr(10) || 'see /srv/desk/in/' || {_NAME} || ', /srv/desk/out/' || {_NAME} || ' and /srv/desk2/in/' || {_NAME} || '; /opt/acme/' || {_NAME} || '/x.csv beside /opt/acme/' || {_NAME} || '/y.csv. Not /usr/bin/env, /tmp/' || {_NAME}
  || ', /opt/conda/bin, /run/x nor 12/34/5678, https://a.example/b/c or <in>/d/e; ' || chr(59000) || '/usr/share/desk/f' || chr(59001) || '.' AS t FROM documents WHERE text IS NOT NULL)"""


def _paths() -> str:
    """CTEs src (the texts with planted sentences; what stands for the two private characters there comes back afterwards) and pt (doc_id, st, en, surface, token)."""
    from ..operators.pathredact import PATH

    system = " OR ".join(f"surface = '{x}' OR starts_with(surface, '{x}/')" for x in SYSTEM)
    known = " ".join(f"WHEN surface = '{k}' OR starts_with(surface, '{k}/') THEN '{v}' || substring(surface, {len(k) + 1})" for k, v in (("/srv/desk/in", "<in>"), ("/srv/desk", "<desk>")))
    return f"""{_PLANTED}, {_found("ph", PATH, "src", "t")}, pt AS (SELECT *, CASE {known} WHEN {system} THEN surface
  ELSE '<other-' || substring(sha256(regexp_replace(surface, '/[^/]*$', '')), 1, 6) || '>/.../' || regexp_extract(surface, '[^/]*$') END AS token FROM ph)"""


def _wilson(k: str, n: str, z: float, side: str) -> str:
    p = f"({k}::DOUBLE / {n})"
    return f"(({p} + {z * z} / (2 * {n})) / (1 + {z * z} / {n}) {side} {z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4 * {n}::DOUBLE * {n})) / (1 + {z * z} / {n}))"


_LINES = f"""ln AS (SELECT DISTINCT doc_id, substring(sha1(x), 1, 16) AS h FROM (SELECT doc_id, trim(regexp_replace(x, '{_SPACES}', ' ', 'g'), ' ') AS x
  FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\f\\x1C\\x1D\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS x FROM documents WHERE text IS NOT NULL)) WHERE length(x) >= 8),
sz AS (SELECT doc_id, count(*) AS n FROM ln GROUP BY doc_id),
sk AS (SELECT doc_id, string_agg(h, ',' ORDER BY h) AS key FROM ln GROUP BY doc_id), cl AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS rep, count(*) OVER (PARTITION BY key) AS copies FROM sk),
rl AS (SELECT ln.* FROM ln JOIN cl USING (doc_id) WHERE rep = doc_id),
js AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM rl a JOIN rl b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
jac AS (SELECT a, b, shared, shared::DOUBLE / (x.n + y.n - shared) AS jaccard FROM js JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE shared >= 0.5 * (x.n + y.n - shared))"""

ORACLE: dict[str, str] = {
    "scan_gold_spans": "SELECT doc_id, (i - 1)::BIGINT AS i, s.start_pos::BIGINT AS start_pos, s.end_pos::BIGINT AS end_pos, s.label AS label FROM (SELECT doc_id, unnest(spans) AS s, generate_subscripts(spans, 1) AS i FROM documents) WHERE s IS NOT NULL",
    "spans_json_roundtrip": "SELECT doc_id, len(spans)::BIGINT AS n, coalesce(list_sum(list_transform(spans, lambda s: s.start_pos)), 0)::BIGINT AS starts FROM documents WHERE spans IS NOT NULL",
    "surfaces_projected": "SELECT p.span_id, substring(d.text, p.start_pos + 1, p.end_pos - p.start_pos) = p.text AS same, length(substring(d.text, p.start_pos + 1, p.end_pos - p.start_pos))::BIGINT AS n FROM (SELECT DISTINCT span_id, doc_id, start_pos, end_pos, text FROM predicted_span) p JOIN documents d USING (doc_id) WHERE d.text IS NOT NULL AND p.start_pos >= 0 AND p.end_pos > p.start_pos AND p.end_pos <= length(d.text)",
    "tail_split_dev": "SELECT doc_id, source FROM documents WHERE split = 'train' ORDER BY doc_id DESC LIMIT 2000",
    "head_slice": "SELECT doc_id, doc_type FROM documents ORDER BY doc_id LIMIT 800",
    "detect_email": _hits(PATTERNS["email"]),
    "detect_ipv4": _hits(PATTERNS["ipv4"]),
    "detect_card_luhn": _hits(PATTERNS["credit_card_number"], _LUHN),
    "detect_iban_mod97": _hits(PATTERNS["iban"], _IBAN),
    "detect_name_bigram": _hits(BASELINE["name"]),
    "detection_offsets": f"""WITH {_found("h", PATTERNS["email"])} SELECT surface, count(*) AS n, count(*) FILTER (substring(d.text, st + 1, en - st) = surface) AS at_offset FROM h JOIN documents d USING (doc_id) GROUP BY surface""",
    "gold_overlap_drop": f"WITH RECURSIVE {_KEPT} SELECT doc_id, st::BIGINT AS start_pos, en::BIGINT AS end_pos, lb AS label FROM k",
    "overlap_drop_longest_first": f"""WITH RECURSIVE {_PRED}, g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY st, en DESC, lb, sc, span_id) AS rn FROM pred WHERE en > st),
kall AS (SELECT doc_id, rn, st, en, lb, en AS last, true AS keep FROM g WHERE rn = 1
  UNION ALL SELECT g.doc_id, g.rn, g.st, g.en, g.lb, CASE WHEN g.st >= kall.last THEN g.en ELSE kall.last END, g.st >= kall.last FROM kall JOIN g ON g.doc_id = kall.doc_id AND g.rn = kall.rn + 1)
SELECT doc_id, st::BIGINT AS start_pos, en::BIGINT AS end_pos, lb AS label FROM kall WHERE keep""",
    "union_merge_priority": f"""WITH RECURSIVE {_PRED}, g AS (SELECT *, lb IN ('email', 'iban') AS pr, row_number() OVER (PARTITION BY doc_id ORDER BY st, en DESC, lb, sc) AS rn FROM pred WHERE en > st),
f AS (SELECT doc_id, rn, st AS cs, en AS ce, lb AS cl, sc AS cc, pr AS cp, 1 AS grp FROM g WHERE rn = 1
  UNION ALL SELECT g.doc_id, g.rn, CASE WHEN g.st < f.ce THEN f.cs ELSE g.st END, CASE WHEN g.st < f.ce THEN greatest(f.ce, g.en) ELSE g.en END,
    CASE WHEN g.st < f.ce AND NOT ((g.pr AND NOT f.cp) OR (g.pr = f.cp AND g.en - g.st > f.ce - f.cs)) THEN f.cl ELSE g.lb END, CASE WHEN g.st < f.ce THEN greatest(f.cc, g.sc) ELSE g.sc END,
    CASE WHEN g.st < f.ce AND NOT ((g.pr AND NOT f.cp) OR (g.pr = f.cp AND g.en - g.st > f.ce - f.cs)) THEN f.cp ELSE g.pr END, CASE WHEN g.st < f.ce THEN f.grp ELSE f.grp + 1 END
  FROM f JOIN g ON g.doc_id = f.doc_id AND g.rn = f.rn + 1)
SELECT doc_id, cs::BIGINT AS start_pos, ce::BIGINT AS end_pos, cl AS label, cc AS score FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, grp ORDER BY rn DESC) = 1""",
    "span_coverage": f"""WITH {_PRED}, {_RAW}, pc AS (SELECT DISTINCT doc_id, unnest(range(greatest(0, st), en)) AS c FROM pred WHERE en > st), gc AS (SELECT DISTINCT doc_id, unnest(range(greatest(0, st), en)) AS c FROM raw),
pi AS (SELECT doc_id, c, lag(c) OVER (PARTITION BY doc_id ORDER BY c) AS l FROM pc)
SELECT d.doc_id, coalesce(p.n, 0)::BIGINT AS pred_chars, coalesce(p.i, 0)::BIGINT AS intervals, coalesce(g.n, 0)::BIGINT AS gold_chars, coalesce(b.n, 0)::BIGINT AS covered FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (l IS NULL OR c > l + 1) AS i FROM pi GROUP BY doc_id) p USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gc GROUP BY doc_id) g USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gc JOIN pc USING (doc_id, c) GROUP BY doc_id) b USING (doc_id)""",
    "span_drop_audit": f"""WITH RECURSIVE {_KEPT}, km AS (SELECT DISTINCT doc_id, unnest(range(greatest(0, st), en)) AS c FROM k),
dr AS (SELECT r.* FROM raw r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = r.doc_id AND k.st = r.st AND k.en = r.en AND k.lb IS NOT DISTINCT FROM r.lb)),
dc AS (SELECT doc_id, i, lb, unnest(range(greatest(0, st), en)) AS c FROM dr), cv AS (SELECT dc.lb, count(*) AS c FROM dc JOIN km USING (doc_id, c) GROUP BY dc.lb)
SELECT dr.lb AS label, count(*) AS dropped, sum(en - st)::BIGINT AS chars, coalesce(any_value(cv.c), 0)::BIGINT AS covered FROM dr LEFT JOIN cv ON cv.lb IS NOT DISTINCT FROM dr.lb GROUP BY dr.lb""",
    "token_bio_islands": """WITH t AS (SELECT DISTINCT doc_id, start_pos AS st, end_pos AS en, label AS lb, score AS sc FROM predicted_span WHERE end_pos > start_pos),
b AS (SELECT *, lag(lb) OVER w IS NULL OR lag(lb) OVER w <> lb OR st - lag(en) OVER w > 1 AS br FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY st, en, lb, sc)),
i AS (SELECT *, sum(br::INT) OVER (PARTITION BY doc_id ORDER BY st, en, lb ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT doc_id, min(st)::BIGINT AS start_pos, max(en)::BIGINT AS end_pos, min(lb) AS label, round_even(min(sc), 4) AS score, count(*) AS tokens FROM i GROUP BY doc_id, g HAVING count(*) > 1""",
    "window_dedupe_max_posterior": """SELECT doc_id, start_pos::BIGINT AS start_pos, end_pos::BIGINT AS end_pos, score AS p_pii, label, score * 0.5 AS p_ident FROM predicted_span
QUALIFY row_number() OVER (PARTITION BY doc_id, start_pos, end_pos ORDER BY score DESC NULLS LAST, span_id, label DESC) = 1""",
    "token_windows": """WITH t AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: x <> ''))::BIGINT AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (1 + greatest(0, ceil((n - 384) / 288.0)))::BIGINT AS windows, (n + 96 * greatest(0, ceil((n - 384) / 288.0)))::BIGINT AS seen, n AS tokens FROM t WHERE n > 0""",
    "redact_documents": f"WITH RECURSIVE {_REDACT} SELECT doc_id, n_spans::BIGINT AS n_spans, vault_size::BIGINT AS vault_size, redacted FROM red",
    "vault_entries": f"WITH RECURSIVE {_REDACT} SELECT doc_id, ph, surface FROM vault",
    "placeholder_integrity": f"""WITH RECURSIVE {_REDACT}, q AS (SELECT demo_id, any_value(doc_id) AS doc_id, any_value(answer_as_returned) AS a FROM (SELECT DISTINCT demo_id, doc_id, answer_as_returned FROM demo_run) GROUP BY demo_id),
v AS (SELECT doc_id, list(DISTINCT ph) AS ph FROM vault GROUP BY doc_id),
x AS (SELECT demo_id, coalesce(v.ph, []) AS known, list_distinct(coalesce(regexp_extract_all(a, '\\[[A-Z0-9_]+_[0-9]+\\]'), [])) AS found FROM q LEFT JOIN v USING (doc_id))
SELECT demo_id AS row_id, len(known)::BIGINT AS expected, len(list_intersect(known, found))::BIGINT AS intact, (len(known) - len(list_intersect(known, found)))::BIGINT AS missing, (len(found) - len(list_intersect(known, found)))::BIGINT AS unknown,
  len(known) = len(list_intersect(known, found)) AND len(found) = len(list_intersect(known, found)) AS trustworthy FROM x""",
    "surviving_characters": f"""WITH {_PRED}, c AS (SELECT DISTINCT p.doc_id, unnest(range(greatest(0, st), least(en, length(d.text)))) AS c FROM pred p JOIN documents d USING (doc_id) WHERE en > st AND d.text IS NOT NULL)
SELECT d.doc_id, (length(d.text) - coalesce(n, 0))::BIGINT AS surviving_chars FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) USING (doc_id) WHERE d.text IS NOT NULL""",
    "naive_risk_check": "SELECT abs((1 - exp(-expected_surviving_identifier_tokens)) - risk_naive) < 1e-3 AS close, count(*) AS n FROM gate_decision WHERE risk_naive IS NOT NULL AND expected_surviving_identifier_tokens IS NOT NULL GROUP BY 1",
    "gate_routes": "SELECT risk <= budget AS recomputed, forwarded, route, count(*) AS n FROM (SELECT DISTINCT doc_id, risk, budget, forwarded, route, decided_at FROM gate_decision) GROUP BY ALL",
    "scorecard": f"""WITH RECURSIVE {_PER_DOC}, s AS (SELECT sum(gold)::BIGINT AS gold, sum(caught)::BIGINT AS caught, sum(leaked)::BIGINT AS leaked, sum(partly)::BIGINT AS partly, sum(typed)::BIGINT AS typed, sum(predicted)::BIGINT AS predicted,
  sum(n_over)::BIGINT AS "over", sum(gold_chars)::BIGINT AS gold_chars, sum(masked_chars)::BIGINT AS masked_chars, count(*) FILTER (gold > 0) AS docs_with_gold, count(*) FILTER (leaked > 0) AS docs_with_leak, count(*) AS docs FROM pd)
SELECT *, round_even(caught / nullif(gold, 0), 4) AS recall, round_even(typed / nullif(gold, 0), 4) AS typed_recall, round_even(docs_with_leak / nullif(docs_with_gold, 0), 4) AS doc_leak_rate, round_even("over" / nullif(predicted, 0), 4) AS over_rate,
  round_even(masked_chars / nullif(gold_chars, 0), 4) AS masked_fraction FROM s""",
    "per_type_scorecard": f"WITH RECURSIVE {_GR} SELECT lb AS label, count(*) AS gold, count(*) FILTER (NOT caught) AS leaked, count(*) FILTER (caught AND found = lb) AS typed, round_even(1 - count(*) FILTER (NOT caught) / count(*), 4) AS recall FROM gr GROUP BY lb",
    "over_redaction_anti_join": f"WITH {_PRED}, {_RAW}, {_OVER} SELECT lb AS label, count(*) AS n FROM ov GROUP BY lb",
    "doc_any_leak": f"WITH RECURSIVE {_PER_DOC} SELECT doc_id, gold::BIGINT AS gold, leaked::BIGINT AS leaked, leaked > 0 AS leak FROM pd",
    "gold_first_overlap": f"WITH RECURSIVE {_GR} SELECT lb AS label, found AS found_label, count(*) AS n FROM gr GROUP BY ALL",
    "label_rollup": "WITH x AS (SELECT coalesce(split, 'none') AS split, s.label AS label FROM (SELECT split, unnest(spans) AS s FROM documents) WHERE s.label IS NOT NULL) SELECT label, split, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT label, 'all', count(*) FROM x GROUP BY label",
    "vocab_two_way_diff": f"""WITH known AS (SELECT unnest([{", ".join(f"'{t}'" for t in IDENTIFIER_TYPES)}]) AS label), used AS (SELECT s.label AS label FROM (SELECT unnest(spans) AS s FROM documents) WHERE s.label IS NOT NULL UNION SELECT label FROM predicted_span WHERE label IS NOT NULL)
SELECT label, 'data only' AS side FROM used WHERE label NOT IN (SELECT label FROM known) UNION ALL SELECT label, 'vocabulary only' FROM known WHERE label NOT IN (SELECT label FROM used)""",
    "report_full_outer": f"""WITH {_PRED}, g AS (SELECT s.label AS label, count(*) AS gold FROM (SELECT unnest(spans) AS s FROM documents) WHERE s.label IS NOT NULL GROUP BY 1), p AS (SELECT lb AS label, count(*) AS predicted FROM pred WHERE lb IS NOT NULL GROUP BY 1)
SELECT label, gold, predicted, gold IS NOT DISTINCT FROM predicted AS same FROM g FULL JOIN p USING (label)""",
    "auc_by_statistic": f"WITH RECURSIVE {_AUC} SELECT statistic, n, positives, round(auc, 9) AS auc FROM au",
    "best_statistic_two_signs": f"WITH RECURSIVE {_AUC}, u AS (SELECT statistic, auc FROM au WHERE auc IS NOT NULL UNION ALL SELECT statistic || ' (negated)', 1 - auc FROM au WHERE auc IS NOT NULL) SELECT statistic, round(auc, 9) AS auc FROM u ORDER BY round(auc, 9) DESC, statistic LIMIT 1",
    "leak_rate_at_coverage": f"""WITH RECURSIVE {_GATE}, o AS (SELECT leaked, row_number() OVER (ORDER BY risk, doc_id) AS rn, count(*) OVER () AS total FROM gate),
c AS (SELECT unnest([0.1, 0.25, 0.5, 0.6365, 0.9]::DOUBLE[]) AS coverage) SELECT coverage, round_even(coverage * any_value(total), 0)::BIGINT AS k, count(*) FILTER (leaked AND rn <= round_even(coverage * total, 0)) AS leaks,
  round(count(*) FILTER (leaked AND rn <= round_even(coverage * total, 0)) / nullif(round_even(coverage * any_value(total), 0), 0), 9) AS leak_rate FROM o, c GROUP BY coverage""",
    "max_coverage_within_exposure": f"""WITH RECURSIVE {_GATE}, o AS (SELECT leaked, row_number() OVER (ORDER BY risk, doc_id) AS rn, sum(leaked::INT) OVER (ORDER BY risk, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM gate),
b AS (SELECT unnest([0, 1, 5, 20, 1000000000]::BIGINT[]) AS budget) SELECT budget, coalesce(min(rn) FILTER (cum > budget) - 1, (SELECT count(*) FROM gate))::BIGINT AS k FROM o, b GROUP BY budget""",
    "risk_coverage_budgets": f"""WITH RECURSIVE {_RC} SELECT *, documents - forwarded AS held, round_even(forwarded / documents, 4) AS coverage, round_even(leaks / nullif(forwarded, 0), 4) AS leak_rate, round_even(leaks_held / nullif(documents - forwarded, 0), 4) AS leak_rate_held,
  leaks / nullif(forwarded, 0) <= budget AS budget_respected FROM rc""",
    "random_gate_closed_form": f"""WITH RECURSIVE {_RC}, p AS (SELECT budget, forwarded, documents, (leaks + leaks_held) / documents AS p FROM rc)
SELECT budget, forwarded, round(p, 9) AS mean, round(CASE WHEN forwarded > 0 AND documents > 1 THEN sqrt(p * (1 - p) / forwarded * (documents - forwarded) / (documents - 1)) END, 9) AS sd FROM p""",
    "reliability_bins": f"WITH RECURSIVE {_BINS} SELECT bin::BIGINT AS bin, n, predicted, observed FROM bins",
    "ece": f"WITH RECURSIVE {_BINS} SELECT round_even(sum(n * abs(predicted - observed)) / sum(n), 4) AS ece, count(*) FILTER (predicted >= observed) AS conservative_bins, count(*) AS bins FROM bins",
    "wilson_by_lang": f"""WITH RECURSIVE {_PER_DOC}, r AS (SELECT lang, sum(gold)::BIGINT AS n, sum(leaked)::BIGINT AS k FROM pd JOIN documents USING (doc_id) WHERE lang IS NOT NULL GROUP BY lang)
SELECT lang, n, k, round(CASE WHEN n > 0 THEN greatest(0, {_wilson("k", "n", Z_TWO_SIDED, "-")}) END, 9) AS low, round(CASE WHEN n > 0 THEN least(1, {_wilson("k", "n", Z_TWO_SIDED, "+")}) END, 9) AS high,
  round(CASE WHEN n > 0 THEN least(1, {_wilson("k", "n", Z_ONE_SIDED, "+")}) ELSE 1 END, 9) AS upper FROM r""",
    "seen_unseen_split": f"WITH RECURSIVE {_ROWS} SELECT seen, count(*) AS n, count(*) FILTER (leaked) AS leaked FROM ev GROUP BY seen",
    "surface_buckets": f"""WITH RECURSIVE {_ROWS}, t AS (SELECT leaked, len(string_split(trim(regexp_replace(surface, '{_SPACES}', ' ', 'g'), ' '), ' ')) AS n, NOT regexp_matches(surface, '[^\\x00-\\x7F]') AS ascii FROM fr)
SELECT CASE WHEN n <= 1 THEN '1' WHEN n = 2 THEN '2' ELSE '3+' END AS bucket, ascii, count(*) AS n, count(*) FILTER (leaked) AS leaked FROM t GROUP BY 1, 2""",
    "deployment_projection": f"""WITH RECURSIVE {_ROWS}, a AS (SELECT count(*) AS spans, count(*) FILTER (leaked) AS leaks, count(*) FILTER (lb IN {_NAMES}) AS names, count(*) FILTER (lb IN {_NAMES} AND leaked) AS name_leaks, count(*) FILTER (lb IN {_NAMES} AND NOT seen) AS unseen,
  count(*) FILTER (lb IN {_NAMES} AND NOT seen AND leaked) AS unseen_leaks FROM ev)
SELECT *, round(leaks - name_leaks + names * (unseen_leaks / nullif(unseen, 0)), 6) AS projected_leaks, round(1 - (leaks - name_leaks + names * (unseen_leaks / nullif(unseen, 0))) / nullif(spans, 0), 6) AS projected_recall FROM a""",
    "posterior_flags": f"""WITH RECURSIVE {_GATE} SELECT count(*) AS documents, count(DISTINCT risk) AS distinct_risks, round(avg(risk), 9) AS mean, round(stddev_pop(risk), 9) AS sd,
  {", ".join(f"count(*) FILTER (expected >= {t}) AS flag_{str(t)[2:]}, count(*) FILTER (expected >= {t} AND leaked) AS leaks_{str(t)[2:]}" for t in (0.01, 0.05, 0.2))} FROM gate""",
    "latency_percentiles": """SELECT model, count(*) AS n, quantile_disc(took_seconds, 0.5) AS p50, quantile_disc(took_seconds, 0.9) AS p90, quantile_disc(took_seconds, 0.99) AS p99, median(took_seconds) AS median, min(took_seconds) AS least, max(took_seconds) AS most,
  round(avg(took_seconds), 9) AS mean FROM (SELECT DISTINCT answer_id, model, took_seconds FROM answer WHERE took_seconds IS NOT NULL AND model IS NOT NULL) GROUP BY model""",
    "throughput_thirds": """WITH a AS (SELECT answer_id, min(model) AS model, min(took_seconds) AS t FROM answer WHERE took_seconds IS NOT NULL AND model IS NOT NULL GROUP BY answer_id),
p AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY answer_id) AS rn, count(*) OVER (PARTITION BY model) AS total FROM a),
x AS (SELECT *, CASE WHEN rn <= total // 3 THEN 'first' WHEN rn > total - total // 3 THEN 'last' END AS part FROM p)
SELECT model, part, count(*) AS n, round(count(*) / nullif(sum(t), 0), 6) AS per_second FROM x WHERE part IS NOT NULL GROUP BY ALL""",
    "deploy_rates": "SELECT device_name, count(*) AS runs, sum(documents)::BIGINT AS documents, round(sum(characters) / sum(run_seconds), 3) AS chars_per_second FROM (SELECT DISTINCT run_id, device_name, documents, characters, run_seconds FROM deploy_cost WHERE run_seconds > 0) GROUP BY device_name",
    "exact_duplicates_sha": "WITH d AS (SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL), p AS (SELECT digest, min(doc_id) AS first_id, count(*) AS copies FROM d GROUP BY digest HAVING count(*) > 1) SELECT doc_id, digest, first_id, copies FROM d JOIN p USING (digest)",
    "near_duplicates_line_jaccard": f"""WITH {_LINES}, k AS (SELECT rep, any_value(copies) AS copies FROM cl GROUP BY rep) SELECT a, b, shared, round(jaccard, 6) AS jaccard, x.copies AS copies_a, y.copies AS copies_b FROM jac JOIN k x ON x.rep = a JOIN k y ON y.rep = b
UNION ALL SELECT rep, rep, n, 1.0, copies, copies FROM k JOIN sz ON sz.doc_id = rep WHERE copies > 1""",
    "top10_similarity": f"WITH {_LINES} SELECT a, b, round(jaccard, 6) AS jaccard FROM jac WHERE jaccard < 1 ORDER BY round(jaccard, 6) DESC, a, b LIMIT 10",
    "sloc_style_line_counts": "SELECT coalesce(split, 'none') AS split, count(*) AS lines FROM (SELECT split, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL) WHERE length(trim(x, ' ')) > 0 AND NOT starts_with(trim(x, ' '), '#') GROUP BY 1",
    "path_redaction": f"""WITH {_paths()}, g AS (SELECT p.doc_id, p.st, p.en, substring(t, (coalesce(lag(en) OVER w, 0) + 1)::BIGINT, (st - coalesce(lag(en) OVER w, 0))::BIGINT) || token AS piece FROM pt p JOIN src USING (doc_id) WINDOW w AS (PARTITION BY p.doc_id ORDER BY st)),
m AS (SELECT doc_id, string_agg(piece, '' ORDER BY st) AS head, max(en) AS e FROM g GROUP BY doc_id) SELECT doc_id, replace(replace(head || substring(t, (e + 1)::BIGINT), chr(59000), chr(57344)), chr(59001), chr(57345)) AS once, true AS stable FROM m JOIN src USING (doc_id)""",
    "decisions_per_day": "SELECT date_trunc('day', arrived_at)::TIMESTAMP AS window_start, route, count(*) AS decisions FROM (SELECT DISTINCT doc_id, route, arrived_at, decided_at FROM gate_decision WHERE arrived_at IS NOT NULL) GROUP BY 1, 2",
    "received_lag": "SELECT coalesce(channel, 'unknown') AS channel, count(*) AS n, sum(date_diff('second', date_trunc('second', received_at), date_trunc('second', loaded_at)))::BIGINT AS seconds FROM documents d LEFT JOIN intake_source i ON i.source = d.source WHERE received_at IS NOT NULL AND loaded_at IS NOT NULL GROUP BY 1",
    "detect_ipv6": _hits(PATTERNS["ipv6"]),
    "detect_ssn": _hits(PATTERNS["ssn"], _SSN),
    "extracted_urls": f"""WITH src AS (SELECT doc_id, text || chr(10) || 'see https://' || regexp_replace(coalesce(source, 'none'), '[^A-Za-z0-9.-]', '-', 'g') || '.example/a?b=1, or http://x.example.' AS t FROM documents WHERE text IS NOT NULL), {_found("h", URL, "src", "t")}
SELECT doc_id, count(*) AS n, string_agg(surface, '|' ORDER BY st) AS surfaces FROM h GROUP BY doc_id""",
    "validators_by_label": f"WITH RECURSIVE {_VALIDATORS} {_BY_LABEL}",
    "baseline_spans_by_label": f"WITH RECURSIVE {_labelled(BASELINE, {})} {_BY_LABEL}",
    "hybrid_union": f"""WITH RECURSIVE {_PRED}, {_VALIDATORS}, hu AS (SELECT doc_id, st, en, lb, sc, 0 AS src FROM pred JOIN documents USING (doc_id) WHERE text IS NOT NULL AND en > st UNION ALL SELECT doc_id, st, en, lb, 1.0, 1 FROM found),
u AS (SELECT *, lb IN ('credit_card_number', 'iban', 'email', 'ipv4', 'ipv6', 'ssn') AS pr, row_number() OVER (PARTITION BY doc_id ORDER BY st, en DESC, src, lb NULLS FIRST, sc NULLS FIRST) AS rn FROM hu),
f AS (SELECT doc_id, rn, st AS cs, en AS ce, lb AS cl, pr AS cp, 1 AS grp FROM u WHERE rn = 1
  UNION ALL SELECT u.doc_id, u.rn, CASE WHEN u.st < f.ce THEN f.cs ELSE u.st END, CASE WHEN u.st < f.ce THEN greatest(f.ce, u.en) ELSE u.en END,
    CASE WHEN u.st < f.ce AND NOT ((u.pr AND NOT f.cp) OR (u.pr = f.cp AND u.en - u.st > f.ce - f.cs)) THEN f.cl ELSE u.lb END,
    CASE WHEN u.st < f.ce AND NOT ((u.pr AND NOT f.cp) OR (u.pr = f.cp AND u.en - u.st > f.ce - f.cs)) THEN f.cp ELSE u.pr END, CASE WHEN u.st < f.ce THEN f.grp ELSE f.grp + 1 END
  FROM f JOIN u ON u.doc_id = f.doc_id AND u.rn = f.rn + 1),
m AS (SELECT cs, ce, cl FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, grp ORDER BY rn DESC) = 1) SELECT cl AS label, count(*) AS spans, sum(ce - cs)::BIGINT AS chars FROM m GROUP BY cl""",
    "snap_to_words": f"""WITH {_PRED}, x AS (SELECT span_id, d.text AS t, st, en, length(regexp_extract(substring(d.text, 1, st), '[A-Za-z0-9.@_+/#''&-]*$')) AS l, length(regexp_extract(substring(d.text, en + 1), '^[A-Za-z0-9.@_+/#''&-]*')) AS r
  FROM pred JOIN documents d USING (doc_id) WHERE d.text IS NOT NULL AND st >= 0 AND en > st AND en <= length(d.text))
SELECT span_id, (st - l)::BIGINT AS start_pos, (st - l + length(regexp_replace(substring(t, (st - l + 1)::BIGINT, (en + r - st + l)::BIGINT), '[.''-]+$', '')))::BIGINT AS end_pos FROM x""",
    "bio_encoding": f"""WITH RECURSIVE {_KEPT}, {_found("tk", r"[^\\s]+")}, b AS (SELECT tk.doc_id, tk.st, arg_min(k.lb, k.rn) AS lb, arg_min(k.st, k.rn) AS ks FROM tk LEFT JOIN k ON k.doc_id = tk.doc_id AND k.st < tk.en AND k.en > tk.st GROUP BY ALL),
l AS (SELECT CASE WHEN lb IN ({", ".join(f"'{t}'" for t in IDENTIFIER_TYPES)}) THEN CASE WHEN st <= ks THEN 'B-' ELSE 'I-' END || lb ELSE 'O' END AS label FROM b)
SELECT label, (list_position([{", ".join(f"'{t}'" for t in BIO_LABELS)}], label) - 1)::BIGINT AS label_id, count(*) AS tokens FROM l GROUP BY label""",
    "rehydrate_roundtrip": f"""WITH RECURSIVE {_REDACT}, ve AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -length(ph), ph) AS rn2 FROM vault),
rh AS (SELECT doc_id, 0::BIGINT AS k, redacted AS t FROM red UNION ALL SELECT rh.doc_id, rh.k + 1, replace(rh.t, ve.ph, ve.surface) FROM rh JOIN ve ON ve.doc_id = rh.doc_id AND ve.rn2 = rh.k + 1),
z AS (SELECT doc_id, arg_max(t, k) AS back FROM rh GROUP BY doc_id) SELECT doc_id, back = d.text AS same, length(back)::BIGINT AS n FROM z JOIN documents d USING (doc_id)""",
    "no_ml_statistics": f"WITH {_NO_MODEL} SELECT * FROM nm",
    "surviving_risk": f"""WITH {_TOKENS}, r AS (SELECT doc_id, count(*) AS tokens, count(*) FILTER (left_any) AS surviving, count(*) FILTER (left_own) AS surviving_redacted_only, coalesce(sum(0.9::DOUBLE * p) FILTER (left_any), 0) AS raw FROM tt GROUP BY doc_id)
SELECT d.doc_id, coalesce(tokens, 0)::BIGINT AS tokens, coalesce(surviving, 0)::BIGINT AS surviving, coalesce(surviving_redacted_only, 0)::BIGINT AS surviving_redacted_only, round(coalesce(raw, 0), 6) AS raw_risk, round(1 - exp(-coalesce(raw, 0)), 6) AS naive_risk FROM documents d LEFT JOIN r USING (doc_id) WHERE d.text IS NOT NULL""",
    "decoded_spans": f"""WITH {_TOKENS}, a AS (SELECT *, lag(lb) OVER w IS DISTINCT FROM lb OR lag(k) OVER w + 1 <> k AS br FROM tk WHERE p >= 0.12 WINDOW w AS (PARTITION BY doc_id ORDER BY k)), i AS (SELECT *, sum(br::INT) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM a)
SELECT doc_id, min(st)::BIGINT AS start_pos, max(en)::BIGINT AS end_pos, min(lb) AS label, round_even(min(p), 4) AS score, count(*) AS tokens FROM i GROUP BY doc_id, g""",
    "best_no_model_statistic": "WITH RECURSIVE " + _NO_MODEL + _PER_DOC.replace(_PRED, "", 1) + ", nl AS (SELECT nm.*, leaked > 0 AS leaked FROM nm JOIN pd USING (doc_id))" + _ranked("nl", ("surviving_chars", "surviving_words", "surviving_capitalised", "surviving_digit_runs", "spans", "capitals_and_digits")),
    "token_flags_auc": "WITH RECURSIVE " + _TOKENS + _PER_DOC.replace(_PRED, "", 1) + """, fl AS (SELECT d.doc_id, pd.leaked > 0 AS leaked, round(coalesce(sum(p) FILTER (left_any), 0), 6) AS posterior, count(*) FILTER (left_any) AS tokens, count(*) FILTER (left_any AND p > 0.01) AS flag_01, count(*) FILTER (left_any AND p > 0.05) AS flag_05, count(*) FILTER (left_any AND p > 0.2) AS flag_2
  FROM documents d JOIN pd USING (doc_id) LEFT JOIN tt USING (doc_id) WHERE d.text IS NOT NULL GROUP BY ALL)""" + _ranked("fl", ("posterior", "tokens", "flag_01", "flag_05", "flag_2")),
    "arm_reports": f"""WITH RECURSIVE {_AUC}, o AS (SELECT statistic, leaked, row_number() OVER w AS rn, sum(leaked::INT) OVER w AS cum, count(*) OVER (PARTITION BY statistic) AS total FROM st WINDOW w AS (PARTITION BY statistic ORDER BY score NULLS FIRST, doc_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT statistic, avg(leaked::INT::DOUBLE) AS p, count(*) AS n FROM o GROUP BY statistic),
c AS (SELECT statistic, c AS coverage, round_even(c * any_value(total), 0) AS k, count(*) FILTER (leaked AND rn <= round_even(c * total, 0)) AS leaks FROM o, (SELECT unnest([0.25, 0.6365]::DOUBLE[]) AS c) GROUP BY statistic, c),
e AS (SELECT statistic, x, coalesce(min(rn) FILTER (cum > x) - 1, any_value(total)) AS k FROM o, (SELECT unnest([5, 20]) AS x) GROUP BY statistic, x),
r AS (SELECT statistic, 'base_rate' AS measure, 0.0::DOUBLE AS "at", p AS value FROM b UNION ALL SELECT statistic, 'auc', 0.0, auc FROM au
  UNION ALL SELECT statistic, 'leaks', coverage, leaks::DOUBLE FROM c UNION ALL SELECT statistic, 'leak_rate', coverage, leaks / nullif(k, 0) FROM c UNION ALL SELECT statistic, 'random_rate', coverage, p FROM c JOIN b USING (statistic)
  UNION ALL SELECT statistic, 'random_sd', coverage, CASE WHEN k > 0 AND n > 1 THEN sqrt(p * (1 - p) / k * (n - k) / (n - 1)) END FROM c JOIN b USING (statistic) UNION ALL SELECT statistic, 'coverage_within', x::DOUBLE, k / n FROM e JOIN b USING (statistic))
SELECT statistic AS arm, measure, "at", round(value, 9) AS value FROM r""",
    "random_gate_samples": f"""WITH RECURSIVE {_GATE}, dr AS (SELECT seed, leaked, row_number() OVER (PARTITION BY seed ORDER BY ('0x' || substring(md5(doc_id::VARCHAR || ':' || seed::VARCHAR), 1, 13))::BIGINT, doc_id) AS rn, count(*) OVER (PARTITION BY seed) AS total FROM gate, (SELECT unnest(range(20)) AS seed)),
c AS (SELECT seed, c AS coverage, round_even(c * any_value(total), 0)::BIGINT AS k, count(*) FILTER (leaked AND rn <= round_even(c * total, 0)) AS leaks FROM dr, (SELECT unnest([0.25, 0.5, 0.6365]::DOUBLE[]) AS c) GROUP BY seed, c)
SELECT coverage, k, round(avg(leaks / nullif(k, 0)), 9) AS mean, round(stddev_pop(leaks / nullif(k, 0)), 9) AS sd FROM c GROUP BY ALL""",
    "fairness_contrasts": f"""WITH RECURSIVE {_ROWS}, q AS (SELECT lb, leaked, seen, lb IN {_NAMES} AS name, NOT regexp_matches(surface, '[^\\x00-\\x7F]') AS ascii, len(string_split(trim(regexp_replace(surface, '{_SPACES}', ' ', 'g'), ' '), ' ')) <= 1 AS single FROM ev),
fg AS (SELECT leaked, unnest([('C1', name, NOT name), ('C2', lb = 'last_name', lb = 'name'), ('C3', name AND NOT seen, name AND seen), ('C4', name AND NOT ascii, name AND ascii), ('C5', name AND single AND NOT seen, name AND single AND seen),
  ('C6', name AND single AND NOT ascii, name AND single AND ascii), ('C7', single AND lb = 'last_name', single AND lb = 'first_name')]) AS x FROM q),
n AS (SELECT x[1] AS contrast, count(*) FILTER (x[2]) AS an, count(*) FILTER (x[2] AND leaked) AS ak, count(*) FILTER (x[3]) AS bn, count(*) FILTER (x[3] AND leaked) AS bk FROM fg GROUP BY 1),
w AS (SELECT contrast, x, an - ak AS seen, -(lgamma(x + 1.0) + lgamma(an - x + 1.0) + lgamma(an - ak + bn - bk - x + 1.0) + lgamma(bk - an + ak + x + 1.0)) AS v FROM n, LATERAL (SELECT unnest(range(greatest(0, an - ak - bk), least(an, an - ak + bn - bk) + 1)) AS x)),
t AS (SELECT contrast, max(v) AS top, max(v) FILTER (x = seen) AS own FROM w GROUP BY contrast),
fi AS (SELECT contrast, least(1.0, sum(exp(v - top)) FILTER (v <= own + 1e-7) / sum(exp(v - top))) AS p FROM w JOIN t USING (contrast) GROUP BY contrast),
st AS (SELECT contrast, p, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, contrast) + 1) * p) AS s FROM fi), ho AS (SELECT contrast, p, max(s) OVER (ORDER BY p, contrast ROWS UNBOUNDED PRECEDING) AS h FROM st)
SELECT contrast, an, ak, bn, bk, round(1 - ak / nullif(an, 0), 6) AS recall_a, round(1 - bk / nullif(bn, 0), 6) AS recall_b, round((1 - ak / nullif(an, 0)) - (1 - bk / nullif(bn, 0)), 6) AS gap, round(p, 6) AS p_fisher, round(h, 6) AS p_holm FROM n JOIN ho USING (contrast)""",
    "calibrator_blocks": f"WITH RECURSIVE {_blocks()} SELECT block, right_edge, n, leaks, round(p_hat, 9) AS p_hat, round(p_upper, 9) AS p_upper FROM cb",
    "calibrated_decisions": f"""WITH RECURSIVE {_blocks()}, lk AS (SELECT doc_id, expected, arg_min(p_upper, block) AS risk FROM gate LEFT JOIN cb ON cb.right_edge >= expected GROUP BY ALL),
x AS (SELECT doc_id, expected, CASE WHEN expected IS NOT NULL THEN coalesce(risk, (SELECT arg_max(p_upper, block) FROM cb)) END AS risk, 1 - exp(-expected) AS naive, 0.12::DOUBLE AS budget FROM lk) SELECT doc_id, {_DECISION} FROM x""",
    "naive_decisions": f"""WITH x AS (SELECT doc_id, max(expected_surviving_identifier_tokens) AS expected, 1 - exp(-max(expected_surviving_identifier_tokens)) AS risk, 1 - exp(-max(expected_surviving_identifier_tokens)) AS naive, 0.3::DOUBLE AS budget FROM gate_decision WHERE expected_surviving_identifier_tokens IS NOT NULL GROUP BY doc_id) SELECT doc_id, {_DECISION} FROM x""",
    "gate_payloads": "SELECT doc_id, 'characters,identifiers_found,spans,redacted,vault_size,calibrated,decision' AS keys, length(text)::BIGINT AS characters FROM documents WHERE text IS NOT NULL",
    "report_drift": f"""WITH RECURSIVE {_PER_DOC}, s AS (SELECT split, sum(gold)::BIGINT AS gold, sum(caught)::BIGINT AS caught, sum(leaked)::BIGINT AS leaked, sum(partly)::BIGINT AS partly, sum(typed)::BIGINT AS typed, sum(predicted)::BIGINT AS predicted, sum(n_over)::BIGINT AS "over", sum(gold_chars)::BIGINT AS gold_chars,
  sum(masked_chars)::BIGINT AS masked_chars, count(*) FILTER (gold > 0) AS docs_with_gold, count(*) FILTER (leaked > 0) AS docs_with_leak, count(*) AS docs FROM pd JOIN documents USING (doc_id) WHERE split IN ('dev', 'test') GROUP BY split),
v AS (SELECT split, * EXCLUDE (split), round_even(caught / nullif(gold, 0), 4) AS recall, round_even(typed / nullif(gold, 0), 4) AS typed_recall, round_even(docs_with_leak / nullif(docs_with_gold, 0), 4) AS doc_leak_rate, round_even("over" / nullif(predicted, 0), 4) AS over_rate, round_even(masked_chars / nullif(gold_chars, 0), 4) AS masked_fraction FROM s),
u AS (SELECT split, unnest([{", ".join(f"{{'m': '{m}', 'v': \"{m}\"::DOUBLE}}" for m in _MEASURES)}]) AS x FROM v),
d AS (SELECT x.m AS measure, max(x.v) FILTER (split = 'dev') AS a, max(x.v) FILTER (split = 'test') AS b FROM u GROUP BY 1) SELECT measure, a, b, round(b - a, 6) AS delta, a IS NOT DISTINCT FROM b AS same FROM d""",
    "label_frequencies": "SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS place FROM (SELECT s.label AS label, count(*) AS n FROM (SELECT unnest(spans) AS s FROM documents) WHERE s.label IS NOT NULL GROUP BY 1)",
    "tail_tenth": "SELECT doc_id, source FROM documents WHERE split = 'train' QUALIFY row_number() OVER (ORDER BY doc_id) > count(*) OVER () - greatest(1, count(*) OVER () // 10)",
    "line_class_members": f"""WITH {_LINES}, l AS (SELECT rep, count(*) AS links FROM (SELECT a AS rep FROM jac UNION ALL SELECT b FROM jac) GROUP BY rep) SELECT doc_id, cl.rep, sz.n AS lines, coalesce(links, 0)::BIGINT AS links FROM cl JOIN sz USING (doc_id) LEFT JOIN l ON l.rep = cl.rep""",
    "path_leaks": f"WITH {_paths()} SELECT 'stored' AS stage, count(DISTINCT doc_id) AS leaking, count(*) AS paths FROM pt WHERE token <> surface HAVING count(*) > 0",
}
