"""The registry's questions in SQL, for an independent engine.

Keys match :data:`plumbob.plans.queries.QUERIES`. ``sample_rows`` has no SQL:
its result is random.
"""

from __future__ import annotations

from plumbob.functions.patterns import EMAIL_RULE
from plumbob.operators.images import BLUR_BELOW, OVEREXPOSED_ABOVE, UNDEREXPOSED_BELOW
from plumbob.operators.profile import ID_HINTS
from plumbob.operators.rules import DIMENSIONS
from plumbob.operators.score import DEFAULT_WEIGHTS, GRADES, SEVERITY_WEIGHTS
from plumbob.operators.semantic import DETECTORS, FALLBACK_CONFIDENCE, LEAST_SHARE
from plumbob.plans.queries import POLICIES, SMALL_TABLES, TEAM_WEIGHTS

DIRTY = """dirty AS (SELECT c_custkey,
  CASE WHEN c_custkey % 50 = 1 THEN c_custkey - 1 ELSE c_custkey END AS dup_key,
  CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'invalid'
       ELSE concat('user', CAST(c_custkey AS VARCHAR), '@example.com') END AS email,
  CASE WHEN c_custkey % 25 = 0 THEN -5 ELSE 18 + c_custkey % 62 END AS age,
  CASE WHEN c_custkey % 13 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS bal_text,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 40 = 0 THEN 99 WHEN c_custkey % 41 = 0 THEN NULL ELSE c_nationkey END AS nation_fk,
  CASE WHEN c_custkey % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE c_acctbal END AS bal_nan
FROM customer)"""

COLUMNS = ("c_custkey", "dup_key", "email", "age", "bal_text", "segment", "nation_fk", "bal_nan")
TEXT = ("email", "bal_text", "segment")
WHOLE = ("c_custkey", "dup_key", "age", "nation_fk")


TABLE_COLUMNS = {
    "benchmark": "item_id,text",
    "conversations": "conv_id,turn,role,text",
    "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment",
    "documents": "doc_id,text,lang,source,n_chars",
    "embeddings": "vec_id,embedding,label",
    "events": "event_id,ts,user_id,event_type,value,props",
    "labels": "doc_id,quality,toxic",
    "lineitem": "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate",
    "nation": "n_nationkey,n_name,n_regionkey",
    "orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
    "pages": "page_id,url,html",
    "part": "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice",
    "region": "r_regionkey,r_name",
    "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal",
}


def _clean(column: str) -> str:
    return f"(CASE WHEN isnan({column}) THEN NULL ELSE {column} END)" if column == "bal_nan" else column


# -- rule results ----------------------------------------------------------------


def _result(name, dimension, severity, counts, threshold=1.0) -> str:
    rate = "CASE WHEN t > 0 THEN CAST(p AS DOUBLE) / t ELSE 1.0 END"
    return (
        f"SELECT '{name}' AS rule_name, '{dimension}' AS dimension, '{severity}' AS severity, "
        f"CAST(p AS BIGINT) AS pass_count, CAST(t - p AS BIGINT) AS fail_count, CAST(t AS BIGINT) AS total_count, "
        f"round({rate}, 6) AS pass_rate, {rate} >= {threshold} AS passed, "
        f"CAST(1.0 AS DOUBLE) - round({rate}, 6) AS fail_rate FROM ({counts})"
    )


def _row(condition: str, source: str = "dirty") -> str:
    return f"SELECT count(*) FILTER (WHERE {condition}) AS p, count(*) AS t FROM {source}"


def _unique(columns: str, source: str = "dirty") -> str:
    return (
        f"SELECT coalesce(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END), 0) AS p, coalesce(sum(n), 0) AS t "
        f"FROM (SELECT count(*) AS n FROM {source} GROUP BY {columns})"
    )


def _foreign(column: str, other: str, source: str = "dirty") -> str:
    return _row(f"{column} IS NULL OR EXISTS (SELECT 1 FROM {other} AS o WHERE o.k = s.{column})", f"{source} AS s")


def _with(*selects: str, ctes: str = DIRTY) -> str:
    return f"WITH {ctes} " + " UNION ALL ".join(selects)


def _number(column: str) -> str:
    return f"TRY_CAST(trim({column}) AS DOUBLE)"


NATION = "(SELECT n_nationkey AS k FROM nation)"
_NAN_RANGE = "bal_nan IS NOT NULL AND NOT isnan(bal_nan) AND bal_nan >= 0"

_SET = (
    _result("null_check_email", "completeness", "high", _row("email IS NOT NULL"), 0.85),
    _result("null_check_segment", "completeness", "medium", _row("segment IS NOT NULL")),
    _result("null_check_bal_nan", "completeness", "critical", _row("NOT isnan(bal_nan)"), 0.95),
    _result("unique_check_dup_key", "uniqueness", "critical", _unique("dup_key")),
    _result("key_unique", "uniqueness", "high", _unique("c_custkey")),
    _result("range_check_age", "validity", "medium", _row("age BETWEEN 0 AND 120"), 0.9),
    _result("range_check_bal_text", "validity", "low", _row(f"{_number('bal_text')} >= 0")),
    _result("regex_check_email", "conformity", "high", _row(f"regexp_full_match(email, '{EMAIL_RULE}')"), 0.75),
    _result(
        "fk_check_segment",
        "integrity",
        "medium",
        _row("segment IS NULL OR segment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY', 'HOUSEHOLD')"),
    ),
    _result("nation", "integrity", "high", _foreign("nation_fk", NATION)),
)
# Position of each rule of the set in its configuration.
_SET_NO = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10)
_SET_CTES = (
    DIRTY
    + ", results AS ("
    + " UNION ALL ".join(f"SELECT {no} AS rule_no, r.* FROM ({sql}) AS r" for no, sql in zip(_SET_NO, _SET))
    + ")"
)


def _values(rows, names: str) -> str:
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows) + f") AS v({names})"


def _grade(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {low} THEN '{g}'" for g, low in GRADES) + " ELSE 'F' END"


def _scored(weights: str, rate: str = "avg(r.pass_rate)", by: str = "") -> str:
    """CTEs up to one row per weighted dimension."""
    key = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    return (
        f"{_SET_CTES}, raw_weights AS (SELECT * FROM {weights}), "
        f"weights AS (SELECT {key}dimension, CASE WHEN sum(weight) OVER ({over}) > 0 "
        f"AND abs(sum(weight) OVER ({over}) - 1) > 1e-6 THEN weight / sum(weight) OVER ({over}) ELSE weight END AS weight "
        f"FROM raw_weights), "
        f"dims AS (SELECT {key}w.dimension, w.weight, count(r.rule_name) AS rule_count, "
        f"count(*) FILTER (WHERE r.passed) AS pass_count, count(*) FILTER (WHERE NOT r.passed) AS fail_count, "
        f"coalesce({rate}, 1.0) AS rate, coalesce(string_agg(r.rule_name, ',' ORDER BY r.rule_no), '') AS rules "
        f"FROM weights AS w LEFT JOIN results AS r ON r.dimension = w.dimension GROUP BY {key}w.dimension, w.weight)"
    )


_DEFAULT = _values(DEFAULT_WEIGHTS.items(), "dimension, weight")
_SEVERITY = "CASE r.severity " + " ".join(f"WHEN '{s}' THEN CAST({w} AS DOUBLE)" for s, w in SEVERITY_WEIGHTS.items()) + " END"
_OVERALL = "round(CASE WHEN sum(weight) > 0 THEN sum(weight * rate) / sum(weight) ELSE 1.0 END, 6)"

# -- event history ----------------------------------------------------------------

_HISTORY = f"""days AS (SELECT event_type AS dataset, CAST(ts AS DATE) AS day,
  round(CAST(count(*) FILTER (WHERE value > 20) AS DOUBLE) / count(*), 6) AS validity,
  round(CAST(count(*) FILTER (WHERE user_id % 4 <> 0) AS DOUBLE) / count(*), 6) AS accuracy FROM events GROUP BY 1, 2),
history AS (SELECT dataset, day, validity, accuracy, round((validity * 2 + accuracy) / 3, 6) AS overall_score,
  {_grade("round((validity * 2 + accuracy) / 3, 6)")} AS grade FROM days),
long_scores AS (SELECT dataset, day, 'overall' AS dimension, overall_score AS score FROM history
  UNION ALL SELECT dataset, day, 'validity', validity FROM history
  UNION ALL SELECT dataset, day, 'accuracy', accuracy FROM history)"""

# -- near duplicates ----------------------------------------------------------------


def _near(distance: int) -> str:
    """Pairs from a table ``hashes(id, hi, lo)`` of 32-bit halves."""
    return f""", reps AS (SELECT hi, lo, min(id) AS rep FROM hashes GROUP BY hi, lo),
pairs AS (SELECT a.rep AS ra, b.rep AS rb, bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS d
  FROM reps AS a JOIN reps AS b ON a.rep < b.rep)
SELECT ra AS id_a, rb AS id_b, CAST(d AS BIGINT) AS distance FROM pairs WHERE d <= {distance}
UNION ALL SELECT r.rep, h.id, CAST(0 AS BIGINT) FROM hashes AS h JOIN reps AS r ON r.hi = h.hi AND r.lo = h.lo WHERE h.id <> r.rep"""


_BITS = "CAST(1 AS BIGINT) << CAST(({}) AS INTEGER)"
_SIGNS = """signs AS (SELECT vec_id,
  list_sum([CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS BIGINT) << i ELSE 0 END FOR i IN range(32)])::BIGINT AS lo,
  list_sum([CASE WHEN embedding[i + 33] > 0 THEN CAST(1 AS BIGINT) << i ELSE 0 END FOR i IN range(32)])::BIGINT AS hi
  FROM embeddings)"""


_ALIKE = _SIGNS.replace("signs AS", "all_signs AS") + """, signs AS (
  SELECT vec_id, hi, CASE WHEN vec_id % 3 = 0 THEN CAST(0 AS BIGINT) ELSE lo END AS lo FROM all_signs)"""


def _bit_halves(expr: str) -> tuple[str, str]:
    """The low and high halves of ``1 << expr``."""
    low = f"CASE WHEN {expr} < 32 THEN CAST(1 AS BIGINT) << CAST({expr} AS INTEGER) ELSE 0 END"
    high = f"CASE WHEN {expr} >= 32 THEN CAST(1 AS BIGINT) << CAST({expr} - 32 AS INTEGER) ELSE 0 END"
    return low, high


def _copies() -> str:
    l1, h1 = _bit_halves("(vec_id % 64)")
    l2, h2 = _bit_halves("(vec_id % 31)")
    l3, h3 = _bit_halves("(32 + vec_id % 29)")
    return f"""hashes AS (
SELECT vec_id * 10 AS id, hi, lo FROM signs
UNION ALL SELECT vec_id * 10 + 1, xor(hi, {h1}), xor(lo, {l1}) FROM signs
UNION ALL SELECT vec_id * 10 + 2, xor(xor(hi, {h2}), {h3}), xor(xor(lo, {l2}), {l3}) FROM signs
UNION ALL SELECT vec_id * 10 + 3, hi, lo FROM signs)"""


# -- images ------------------------------------------------------------------------

_IMAGES = """levels AS (SELECT vec_id, embedding, vec_id AS id, vec_id % 17 = 0 AS broken, 0 AS step FROM embeddings
  UNION ALL SELECT vec_id, embedding, vec_id + 1000000, false, 1 FROM embeddings),
images AS (SELECT id AS vec_id, broken, [greatest(0, least(255,
  CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 0.6) * 212) AS INTEGER) + step * (i % 4))) FOR i IN range(64)] AS g FROM levels),
px AS (SELECT vec_id, g, i // 8 AS r, i % 8 AS c, g[i + 1] AS v FROM images, range(64) AS t(i) WHERE NOT broken)"""

_HASHES = f"""{_IMAGES},
taps AS (SELECT t, s, s + 0.5 - (t + 0.5) * 0.25 AS x FROM range(32) AS a(t), range(8) AS b(s)
  WHERE s >= floor(greatest((t + 0.5) * 0.25 - 2.5, 0)) AND s < floor((t + 0.5) * 0.25 + 3.5)),
lanczos AS (SELECT t, s, CASE WHEN abs(x) >= 3 THEN 0.0 WHEN x = 0 THEN 1.0
  ELSE sin(pi() * x) / (pi() * x) * sin(pi() * x / 3) / (pi() * x / 3) END AS w FROM taps),
weights AS (SELECT t, s, w / sum(w) OVER (PARTITION BY t) AS w FROM lanczos),
wide AS (SELECT vec_id, r, t AS c, greatest(0, least(255, floor(sum(v * w) + 0.5))) AS v FROM px JOIN weights ON s = px.c GROUP BY vec_id, r, t),
grid AS (SELECT vec_id, t AS r, c, greatest(0, least(255, floor(sum(v * w) + 0.5))) AS v FROM wide JOIN weights ON s = wide.r GROUP BY vec_id, t, c),
cosines AS (SELECT u, x, cos(pi() * (2 * x + 1) * u / 64) * CASE WHEN u = 0 THEN sqrt(1 / 32.0) ELSE sqrt(2 / 32.0) END AS k
  FROM range(8) AS a(u), range(32) AS b(x)),
half AS (SELECT vec_id, u, c, sum(v * k) AS v FROM grid JOIN cosines ON x = grid.r GROUP BY vec_id, u, c),
low AS (SELECT vec_id, half.u AS u, k.u AS w, round(sum(v * k.k), 6) AS v FROM half JOIN cosines AS k ON k.x = half.c GROUP BY vec_id, half.u, k.u),
bits AS (SELECT vec_id, u * 8 + w AS i, CASE WHEN v > median(v) OVER (PARTITION BY vec_id) THEN 1 ELSE 0 END AS b FROM low),
digits AS (SELECT vec_id, i // 4 AS d, CAST(sum(b * (1 << CAST(3 - i % 4 AS INTEGER))) AS INTEGER) AS n FROM bits GROUP BY vec_id, i // 4)"""


def _image_profile() -> str:
    at = lambda r, c: f"g[({r}) * 8 + ({c}) + 1]"
    lap = (
        f"{at('greatest(r - 1, 0)', 'c')} + {at('least(r + 1, 7)', 'c')} + "
        f"{at('r', 'greatest(c - 1, 0)')} + {at('r', 'least(c + 1, 7)')} - 4 * v"
    )
    var = lambda x: f"(64 * sum({x} * {x}) - sum({x}) * sum({x})) / CAST(4096 AS DOUBLE)"
    return f"""WITH {_IMAGES}, lap AS (SELECT vec_id, v, {lap} AS l FROM px),
m AS (SELECT vec_id, {var("l")} AS blur, sum(v) / CAST(64 AS DOUBLE) AS mean, sqrt({var("v")}) AS std FROM lap GROUP BY vec_id),
all_images AS (SELECT i.vec_id, broken, coalesce(blur, 0) AS blur, coalesce(mean, 0) AS mean, coalesce(std, 0) AS std FROM images AS i LEFT JOIN m USING (vec_id))
SELECT concat('img-', CAST(vec_id AS VARCHAR)) AS path, CAST(CASE WHEN broken THEN 0 ELSE 8 END AS BIGINT) AS width,
CAST(CASE WHEN broken THEN 0 ELSE 8 END AS BIGINT) AS height, CAST(CASE WHEN broken THEN 0 ELSE 1 END AS BIGINT) AS channels,
broken AS is_corrupt, round(blur, 2) AS blur_score, NOT broken AND blur < {BLUR_BELOW} AS is_blurry,
round(mean, 2) AS exposure_mean, round(std, 2) AS exposure_std, NOT broken AND mean > {OVEREXPOSED_ABOVE} AS is_overexposed,
NOT broken AND mean < {UNDEREXPOSED_BELOW} AS is_underexposed, CASE WHEN broken THEN '' ELSE 'L' END AS color_mode,
CASE WHEN broken THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS aspect_ratio FROM all_images"""


# -- profiles ------------------------------------------------------------------------


def _column_counts() -> str:
    parts = []
    for c in COLUMNS:
        v = _clean(c)
        parts.append(
            f"SELECT '{c}' AS name, count(*) AS total_count, count(*) - count({v}) AS null_count, "
            f"round(100.0 * (count(*) - count({v})) / count(*), 2) AS null_pct, count(DISTINCT {v}) AS distinct_count, "
            f"round(100.0 * count(DISTINCT {v}) / count(*), 2) AS distinct_pct, CAST(min({v}) AS VARCHAR) AS min_value, "
            f"CAST(max({v}) AS VARCHAR) AS max_value, count(DISTINCT {v}) = count(*) AND count({v}) = count(*) AS is_unique FROM dirty"
        )
    return _with(*parts)


def _numeric(columns, source, moments=True) -> list[str]:
    out = []
    for c in columns:
        v = _clean(c)
        first = f"round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS std, " if moments else ""
        out.append(
            f"SELECT '{c}' AS name, {first}round(quantile_cont(CAST({v} AS DOUBLE), 0.5), 4) AS median, "
            f"round(quantile_cont(CAST({v} AS DOUBLE), 0.25), 4) AS p25, round(quantile_cont(CAST({v} AS DOUBLE), 0.75), 4) AS p75 FROM {source}"
        )
    return out


def _small(name: str, source: str, by: str, value: str) -> str:
    """Ranks in a sorted list; equal neighbours need no step."""
    parts = []
    for column, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)):
        at = f"({q} * (len(v) - 1))"
        low, high = f"v[CAST(floor({at}) AS INTEGER) + 1]", f"v[CAST(ceil({at}) AS INTEGER) + 1]"
        parts.append(f"round(CASE WHEN {low} = {high} OR {at} = floor({at}) THEN {low} ELSE {low} + ({high} - {low}) * ({at} - floor({at})) END, 4) AS {column}")
    grouped = f"SELECT CAST({value} AS DOUBLE) AS x FROM {source} GROUP BY {'ALL' if by == '1' else by}"
    listed = f"SELECT list(x ORDER BY x) AS v FROM ({grouped}) WHERE x IS NOT NULL"
    return f"SELECT '{name}' AS name, unnest(['counted', 'brackets']) AS way, {', '.join(parts)} FROM ({listed})"


def _text_profile(c: str) -> str:
    hashed = lambda kind, order: (
        f"(SELECT string_agg(sha256({kind}) || ':' || n, ' ' ORDER BY n DESC, {kind}) FROM ({order}) WHERE rank <= 3)"
    )
    return (
        f"SELECT '{c}' AS name, count(*) AS total_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, "
        f"max(length({c})) AS max_length, sha256(min({c})) AS least, {hashed('value', _top('documents', c))} AS top, "
        f"{hashed('pattern', _patterns('documents', c))} AS patterns FROM documents"
    )


def _full_profile() -> str:
    parts = []
    for c in TABLE_COLUMNS["lineitem"].split(","):
        text, number = c in ("l_returnflag", "l_linestatus"), c not in ("l_returnflag", "l_linestatus", "l_shipdate")
        quantile = lambda q: f"round(quantile_cont(CAST({c} AS DOUBLE), {q}), 4)" if number else "CAST(NULL AS DOUBLE)"
        moment = lambda f: f"round({f}({c}), 4)" if number else "CAST(NULL AS DOUBLE)"
        first = lambda field: f"(SELECT {field} FROM ({_top('lineitem', c)}) WHERE rank = 1)"
        shapes = f"(SELECT string_agg(pattern, ',' ORDER BY rank) FROM ({_patterns('lineitem', c)}))" if text else "''"
        parts.append(
            f"SELECT '{c}' AS name, count(*) AS total_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, "
            f"count(DISTINCT {c}) = count(*) AS is_unique, {moment('avg')} AS mean, {moment('stddev_samp')} AS std, "
            f"{quantile(0.5)} AS median, {quantile(0.25)} AS p25, {quantile(0.75)} AS p75, {first('value')} AS top_value, "
            f"{first('n')} AS top_count, (SELECT count(*) FROM ({_top('lineitem', c)})) AS top_values, {shapes} AS patterns FROM lineitem"
        )
    return " UNION ALL ".join(parts)


def _top(source: str, column: str) -> str:
    return (
        f"SELECT '{column}' AS name, rank, value, n FROM (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rank "
        f"FROM (SELECT CAST({column} AS VARCHAR) AS value, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1)) WHERE rank <= 10"
    )


def _patterns(source: str, column: str) -> str:
    shape = rf"regexp_replace(regexp_replace({column}, '\p{{L}}+', 'A+', 'g'), '\p{{Nd}}+', 'D+', 'g')"
    return (
        f"SELECT '{column}' AS name, rank, pattern, n, round(100.0 * n / sum(n) OVER (), 1) AS pct FROM "
        f"(SELECT pattern, n, row_number() OVER (ORDER BY n DESC, pattern) AS rank FROM "
        f"(SELECT {shape} AS pattern, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1)) WHERE rank <= 10"
    )


_STATS = (
    DIRTY
    + ", stats AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS col, count(*) AS total, count(*) - count({_clean(c)}) AS nulls, count(DISTINCT {_clean(c)}) AS distincts, "
        + (f"CAST(min({_clean(c)}) AS DOUBLE)" if c not in TEXT else "CAST(NULL AS DOUBLE)")
        + " AS low FROM dirty"
        for c in COLUMNS
    )
    + ")"
)


def _suggestion(condition: str, kind: str, severity: str, pattern="CAST(NULL AS VARCHAR)", low="CAST(NULL AS DOUBLE)") -> str:
    return f"SELECT col AS \"column\", '{kind}' AS type, {severity} AS severity, {pattern} AS pattern, {low} AS min_value FROM stats WHERE {condition}"


def _auto_rules() -> str:
    hinted = "(" + " OR ".join(f"contains(lower(col), '{h}')" for h in ID_HINTS) + ")"
    return f"WITH {_STATS} " + " UNION ALL ".join(
        (
            _suggestion("nulls > 0", "null_check", "CASE WHEN CAST(nulls AS DOUBLE) / total < 0.05 THEN 'high' ELSE 'medium' END"),
            _suggestion(f"{hinted} AND total > nulls AND distincts = total - nulls", "unique_check", "'high'"),
            _suggestion("low >= 0", "range_check", "'medium'", low="CAST(0 AS DOUBLE)"),
            _suggestion("contains(lower(col), 'email')", "regex_check", "'high'", pattern=f"'{EMAIL_RULE}'"),
        )
    )


# -- semantic types --------------------------------------------------------------------


def _hinted(hints) -> str:
    listed = ", ".join(f"'{h}'" for h in hints)
    return f"list_has_any(string_split_regex(lower(col), '[^a-z]+'), [{listed}])"


def _semantic() -> str:
    cells = [
        f"SELECT '{c}' AS col, {str(c in TEXT).lower()} AS is_text, {str(c in WHOLE).lower()} AS is_whole, "
        f"CAST({_clean(c)} AS VARCHAR) AS raw FROM dirty WHERE {_clean(c)} IS NOT NULL"
        for c in COLUMNS
    ]
    cells.append("SELECT 'page_id', false, true, CAST(page_id AS VARCHAR) FROM pages")
    cells.append("SELECT 'url', true, false, url FROM pages")
    shares = ", ".join(
        f"CAST(count(*) FILTER (WHERE regexp_full_match(v, '{d.pattern.replace(chr(39), chr(39) * 2)}')) AS DOUBLE) / count(*) AS s{i}"
        for i, d in enumerate(DETECTORS)
    )
    options = []
    for i, d in enumerate(DETECTORS):
        allowed = _hinted(d.hints) if d.needs_hint else f"(is_text OR {_hinted(d.hints)})"
        options.append(
            f"SELECT col, '{d.type}' AS type, '{d.pii}' AS pii, {i} AS pref, "
            f"round(s{i} * 0.9 + CASE WHEN {_hinted(d.hints)} THEN CAST(0.1 AS DOUBLE) ELSE 0 END, 4) AS conf "
            f"FROM m WHERE s{i} >= {LEAST_SHARE} AND {allowed}"
        )
    n, f = len(DETECTORS), FALLBACK_CONFIDENCE
    options += [
        f"SELECT col, 'numeric_id', 'none', {n}, CAST({f} AS DOUBLE) - CAST(0.1 AS DOUBLE) FROM m WHERE is_whole AND (distincts = total OR {_hinted(('id', 'key', 'custkey', 'number'))})",
        f"SELECT col, 'categorical', 'none', {n + 1}, CAST({f} AS DOUBLE) - CAST(0.2 AS DOUBLE) FROM m WHERE distincts <= 50 AND distincts * 2 <= total",
        f"SELECT col, 'free_text', 'none', {n + 2}, CAST({f} AS DOUBLE) - CAST(0.3 AS DOUBLE) FROM m WHERE is_text AND words >= 5",
        f"SELECT col, 'unknown', 'none', {n + 3}, CAST(0 AS DOUBLE) FROM m",
    ]
    return (
        f"WITH {DIRTY}, cells AS ({' UNION ALL '.join(cells)}), "
        rf"stripped AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS v FROM cells), "
        f"m AS (SELECT col, is_text, is_whole, count(*) AS total, count(DISTINCT raw) AS distincts, "
        rf"avg(len(regexp_extract_all(v, '\S+'))) AS words, {shares} FROM stripped GROUP BY col, is_text, is_whole), "
        f"options AS ({' UNION ALL '.join(options)}), "
        f"best AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY conf DESC, pref) AS place FROM options) "
        f"SELECT col AS column_name, type AS semantic_type, round(conf, 4) AS confidence, pii <> 'none' AS pii_detected, pii AS pii_category FROM best WHERE place = 1"
    )


def _redacted(column: str) -> str:
    """Mail addresses, addresses of machines and phone numbers by pattern; cards by their checksum."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    steps = (
        (r"[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+\.)+[A-Za-z]{2,}", "[EMAIL]"),
        (r"\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "[PHONE]"),
        *[(rf"(^|[^0-9A-Za-z.]){octet}\.{octet}\.{octet}\.{octet}($|[^0-9A-Za-z.]|\.$|\.[^0-9])", r"\1[IP]\6")] * 2,
    )
    for pattern, token in steps:
        column = f"regexp_replace({column}, '{pattern}', '{token}', 'g')"
    doubled = "list_sum([CASE WHEN (len(w) - i) % 2 = 1 THEN (2 * d) // 10 + (2 * d) % 10 ELSE d END FOR d, i IN [CAST(c AS INTEGER) FOR c IN string_split(w, '')]])"
    card = f"regexp_full_match(w, '[0-9]{{13,19}}') AND {doubled} % 10 = 0"
    return f"array_to_string([CASE WHEN {card} THEN '[CARD]' ELSE w END FOR w IN regexp_extract_all({column}, '[0-9A-Za-z]+|[^0-9A-Za-z]+')], '')"


# -- documents ---------------------------------------------------------------------------

_PAGES = r"""lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
numbered AS (SELECT doc_id, i AS page_number, l[i] AS text FROM lines, unnest(range(1, len(l) + 1)) AS t(i)),
judged AS (SELECT doc_id, page_number, text, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 50 AS native,
  CASE WHEN page_number % 2 = 0 THEN concat('scan ', text) ELSE '' END AS ocr FROM numbered),
pages_ AS (SELECT doc_id, page_number, native, CASE WHEN native OR ocr = '' THEN text ELSE ocr END AS text FROM judged)"""

_TABLES = r"""tables AS (SELECT doc_id,
  [string_split(regexp_replace(x, '^[A-Z]', ''), ' | ') FOR x IN list_filter(string_split(text, chr(10)), lambda y: contains(y, ' | '))] AS t FROM documents),
rows_ AS (SELECT doc_id, t[1] AS head, i - 2 AS row_no, t[i] AS cells FROM tables, unnest(range(2, len(t) + 1)) AS u(i)),
cells AS (SELECT doc_id, head, row_no, j - 1 AS column_no, cells[j] AS value FROM rows_, unnest(range(1, len(cells) + 1)) AS u(j))"""

# -- completions ---------------------------------------------------------------------------

_KEYS = """keyed AS (SELECT conv_id, turn, text, sha256('{"model":"stub","prompt":' || CAST(to_json(text) AS VARCHAR) || ',"schema":null,"attachments":null}') AS cache_key FROM conversations)"""
_WORDS = r"len(regexp_extract_all(text, '\S+'))"

_PARSED = """raw AS (SELECT conv_id, turn, role, text, (conv_id + turn) % 5 AS kind FROM conversations)"""


def _explanations() -> str:
    notes = {
        "null_check_email": ("email", "Null check on ''email''"),
        "null_check_segment": ("segment", "Null check on ''segment''"),
        "null_check_bal_nan": ("bal_nan", "Null check on ''bal_nan''"),
        "unique_check_dup_key": ("dup_key", "Uniqueness check on [''dup_key'']"),
        "key_unique": ("c_custkey", "Uniqueness check on [''c_custkey'']"),
        "range_check_age": ("age", "Range [0, 120] on ''age''"),
        "range_check_bal_text": ("bal_text", "Range [0, None] on ''bal_text''"),
        "regex_check_email": ("email", f"Regex ''{EMAIL_RULE}'' on ''email''"),
        "fk_check_segment": ("segment", "FK check: ''segment'' against 4 reference values"),
        "nation": ("nation_fk", "FK check: ''nation_fk'' against column ''n_nationkey''"),
    }
    limits = dict(zip(notes, (0.85, 1.0, 0.95, 1.0, 1.0, 0.9, 1.0, 0.75, 1.0, 1.0)))
    known = ", ".join(f"('{k}', '{c}', '{d}', '{limits[k]}')" for k, (c, d) in notes.items())
    return f"""WITH {_SET_CTES}, notes AS (SELECT * FROM (VALUES {known}) AS v(name, col, details, threshold))
SELECT rule_name, concat_ws(chr(10), 'A data quality rule failed. Explain why.', '',
  concat('rule: ', rule_name, ' (', dimension, ', ', severity, ')'), concat('column: ', col), concat('check: ', details),
  concat('pass rate: ', printf('%.4f', pass_rate), ', passed ', pass_count, ', failed ', fail_count, ' of ', total_count, ', threshold ', threshold),
  'context: customers', 'failing rows: []', '',
  'Answer in JSON with summary, root_cause, impact, suggested_fix, severity_assessment and tags.') AS prompt
FROM results JOIN notes ON name = rule_name WHERE NOT passed"""


_DTYPES = dict(zip(COLUMNS, ("bigint", "bigint", "string", "bigint", "string", "string", "int", "double")))


def _described() -> str:
    """CTE ``facts``: what the prompts say about each column of the dirty table."""
    parts = []
    for i, c in enumerate(COLUMNS):
        v = _clean(c)
        ranked = f"(SELECT list({{'value': value, 'count': n}} ORDER BY rank) FROM ({_top('(SELECT ' + v + ' AS ' + c + ' FROM dirty)', c)}))"
        text, number = c in TEXT, c not in TEXT
        shapes = f"(SELECT list(pattern ORDER BY rank) FROM ({_patterns('dirty', c)}))" if text else "CAST(NULL AS VARCHAR[])"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS name, '{_DTYPES[c]}' AS dtype, count(*) AS total, count(*) - count({v}) AS nulls, "
            f"round(100.0 * (count(*) - count({v})) / count(*), 2) AS null_pct, count(DISTINCT {v}) AS distincts, "
            f"round(100.0 * count(DISTINCT {v}) / count(*), 2) AS distinct_pct, "
            f"{f'min(length({c}))' if text else 'NULL'} AS shortest, {f'max(length({c}))' if text else 'NULL'} AS longest, "
            f"{f'avg({v})' if number else 'NULL'} AS mean, {f'stddev_samp({v})' if number else 'NULL'} AS std, "
            f"{ranked} AS top, {shapes} AS shapes FROM dirty"
        )
    return f"{DIRTY}, facts AS ({' UNION ALL '.join(parts)})"


def _classification_prompts() -> str:
    kinds = ", ".join([d.type for d in DETECTORS] + ["numeric_id", "categorical", "free_text"])
    shown = lambda c: f"coalesce(CAST({c} AS VARCHAR), 'n/a')"
    return f"""WITH {_described()} SELECT name AS column_name, concat_ws(chr(10), 'Which kind of data does this column hold?', '',
concat('column: ', name), concat('type: ', dtype), concat('nulls: ', nulls, ' of ', total, ' (', null_pct, '%)'),
concat('distinct: ', distincts, ' (', distinct_pct, '%)'), concat('length: ', {shown("shortest")}, ' to ', {shown("longest")}),
concat('top values: ', CAST(to_json(top[1:5]) AS VARCHAR)), concat('samples: ', CAST(to_json([t.value FOR t IN top]) AS VARCHAR)), '',
'Answer in JSON with semantic_type ({kinds} or another), confidence (0 to 1), pii_detected,',
'pii_category (none, low, medium, high, critical), pii_types, suggested_validation and rationale.') AS prompt FROM facts"""


def _proposal_prompt() -> str:
    line = (
        "concat('- ', name, ': type=', dtype, ', nulls=', nulls, '/', total, ' (', null_pct, '%), distinct=', distincts, ' (', distinct_pct, '%)', "
        "', unique=', CASE WHEN nulls = 0 AND distincts = total THEN 'true' ELSE 'false' END, "
        "CASE WHEN mean IS NULL THEN '' ELSE concat(', mean=', printf('%.2f', mean), ', std=', printf('%.2f', std)) END, "
        "CASE WHEN shortest IS NULL THEN '' ELSE concat(', length=', shortest, '..', longest) END, "
        "concat(', top=', CAST(to_json([t.value FOR t IN top[1:3]]) AS VARCHAR)), "
        "CASE WHEN shapes IS NULL THEN '' ELSE concat(', patterns=', CAST(to_json(shapes[1:3]) AS VARCHAR)) END)"
    )
    return f"""WITH {_described()}, head AS (SELECT count(*) AS total, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS dups FROM dirty)
SELECT 'customers' AS table_name, concat_ws(chr(10), 'Propose data quality rules for this table.', '',
concat('table: customers, rows: ', head.total, ', columns: 8, duplicate rows: ', dups), 'context: billing', '',
(SELECT string_agg({line}, chr(10) ORDER BY position) FROM facts), '',
'rule types and their params: null_check, unique_check, range_check (min_value, max_value),',
'regex_check (pattern), freshness_check (max_age_hours), foreign_key_check (reference_values)',
'Answer in JSON: rules, a list of rule_type, column, params, severity (critical, high, medium, low), dimension ({", ".join(DIMENSIONS)}), rationale, confidence (0 to 1).') AS prompt FROM head"""


def _manifest() -> str:
    return """files AS (SELECT concat(url, '#', CAST(page_id AS VARCHAR)) AS path, CAST(length(html) AS BIGINT) AS size_bytes FROM pages WHERE page_id % 9 <> 4),
manifest AS (SELECT concat(url, '#', CAST(page_id AS VARCHAR)) AS path, CAST(CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN length(html) + 1 ELSE length(html) END AS BIGINT) AS expected_bytes FROM pages WHERE page_id % 11 <> 3),
checked AS (SELECT coalesce(f.path, m.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'unexpected'
  WHEN expected_bytes <> size_bytes THEN 'size_mismatch' ELSE 'ok' END AS status, expected_bytes, size_bytes
  FROM files AS f FULL OUTER JOIN manifest AS m ON f.path = m.path)"""


def _failing() -> str:
    numbered = lambda name, condition: (
        f"SELECT '{name}' AS rule_name, rank, c_custkey, email FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS rank "
        f"FROM dirty WHERE {condition}) WHERE rank <= 5"
    )
    twice = lambda c: f"EXISTS (SELECT 1 FROM dirty AS d WHERE d.{c} IS NOT DISTINCT FROM dirty.{c} AND d.c_custkey <> dirty.c_custkey)"
    return _with(
        numbered("null_check_email", "email IS NULL"),
        numbered("unique_check_dup_key", twice("dup_key")),
        numbered("unique_check_email", "email IS NULL OR email IN (SELECT email FROM dirty GROUP BY email HAVING count(*) > 1)"),
        numbered("range_check_bal_text", f"NOT coalesce({_number('bal_text')} >= 0, false)"),
        numbered("fk_check_nation_fk", "nation_fk IS NOT NULL AND nation_fk NOT IN (SELECT n_nationkey FROM nation)"),
    )


_CELL_BYTES = (
    "count(c_custkey) * 8 + count(dup_key) * 8 + coalesce(sum(strlen(email)), 0) + count(age) * 8 + sum(strlen(bal_text)) "
    "+ coalesce(sum(strlen(segment)), 0) + count(nation_fk) * 4 + count(bal_nan) * 8"
)

_TRUTH = "truth AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_acctbal AS bal FROM customer WHERE c_custkey % 30 <> 7)"


def _accurate(key: str, condition: str) -> str:
    return _row(f"k IS NOT NULL AND coalesce({condition}, false)", f"dirty LEFT JOIN truth ON k = {key}")


def _close(tolerance: float) -> str:
    return f"CASE WHEN isnan(bal_nan) THEN bal IS NULL ELSE abs(bal_nan - bal) <= {tolerance} END"


ORACLE: dict[str, str] = {
    "scan_filter": "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'",
    "scan_count": "SELECT count(*) AS total_rows FROM lineitem WHERE l_discount >= CAST(0.05 AS DOUBLE) AND l_tax < CAST(0.04 AS DOUBLE)",
    "preview_rows": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100",
    "list_files": " UNION ALL ".join(
        f"SELECT '{t}.parquet' AS name, count(*) AS row_count, CAST({c.count(',') + 1} AS BIGINT) AS column_count, '{c}' AS columns FROM {t}"
        for t, c in TABLE_COLUMNS.items()
    ),
    "csv_source": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "flatten_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS e_props_k, event_type AS e_type FROM events",
    "dataset_registry": "SELECT 'customer' AS name, count(*) AS row_count FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'orders', count(*) FROM orders",
    "dataset_profile": f"""WITH {DIRTY} SELECT count(*) AS row_count, CAST(8 AS BIGINT) AS column_count,
count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicate_row_count,
CAST({_CELL_BYTES} AS BIGINT) AS memory_bytes,
round(100.0 * ({" + ".join(f"count(*) - count({_clean(c)})" for c in COLUMNS)}) / (count(*) * 8), 4) AS null_cell_pct FROM dirty""",
    "duplicate_rows": f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_row_count FROM (SELECT count(*) AS n FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_quantity % 2 = 1) GROUP BY {TABLE_COLUMNS['lineitem']})",
    "column_counts": _column_counts(),
    "numeric_stats": " UNION ALL ".join(
        _numeric(
            ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), "lineitem"
        )
    ),
    "quartiles_with_missing": _with(*_numeric(("age", "nation_fk", "bal_nan"), "dirty", moments=False)),
    "quartiles_small": " UNION ALL ".join(_small(*t) for t in SMALL_TABLES),
    "text_profile": " UNION ALL ".join(map(_text_profile, ("text", "source", "lang"))),
    "string_lengths": " UNION ALL ".join(
        f"SELECT '{c}' AS name, min(length({c})) AS min_length, max(length({c})) AS max_length, round(avg(length({c})), 2) AS avg_length FROM documents"
        for c in ("text", "lang", "source")
    ),
    "top_values": " UNION ALL ".join(
        [_top("part", c) for c in ("p_brand", "p_type", "p_size")] + [_top("events", c) for c in ("event_type", "user_id")]
    ),
    "value_patterns": _patterns("supplier", "s_name") + " UNION ALL " + _patterns("pages", "url"),
    "profile_view": " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, "
        f"count(DISTINCT {c}) = count(*) AS is_unique, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max, "
        + (f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std" if c != "s_name" else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std")
        + " FROM supplier"
        for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    ),
    "full_profile": _full_profile(),
    "auto_rules": _auto_rules(),
    "rule_null": _with(
        *(
            _result(f"null_check_{c}", "completeness", "high", _row(f"{_clean(c)} IS NOT NULL"))
            for c in ("email", "segment", "bal_nan", "age")
        )
    ),
    "rule_unique": _with(*(_result(f"unique_check_{c}", "uniqueness", "high", _unique(c)) for c in ("dup_key", "email", "c_custkey"))),
    "rule_unique_multi": _result(
        "unique_check_l_orderkey+l_linenumber", "uniqueness", "high", _unique("l_orderkey, l_linenumber", "lineitem"), 0.5
    ),
    "rule_range": _with(
        _result("range_check_age", "validity", "medium", _row("age BETWEEN 0 AND 120")),
        _result("range_check_bal_text", "validity", "medium", _row(f"{_number('bal_text')} >= 0")),
        _result("nan_guard", "validity", "medium", _row(_NAN_RANGE)),
        _result("age_max", "validity", "medium", _row("age <= 70"), 0.5),
    ),
    "rule_regex": _with(
        _result("regex_check_email", "conformity", "medium", _row(f"regexp_full_match(email, '{EMAIL_RULE}')")),
        _result("two_digits", "conformity", "medium", _row(r"regexp_full_match(bal_text, '-?\d+\.\d{1,2}')")),
        _result("format_check_email", "conformity", "medium", _row(r"regexp_full_match(email, '\+[1-9]\d{1,14}')")),
        _result("digits_of_number", "conformity", "medium", _row(r"regexp_full_match(CAST(age AS VARCHAR), '\d\d')")),
    ),
    "rule_fk_values": " UNION ALL ".join(
        (
            _result("fk_check_event_type", "integrity", "high", _row("event_type IN ('signup', 'click', 'view', 'purchase')", "events")),
            _result("enum_check_event_type", "validity", "medium", _row("event_type = 'click'", "events")),
            _result("nothing_allowed", "integrity", "high", _row("event_type IS NULL", "events")),
            _result("cast_check_props", "validity", "medium", _row("TRY_CAST(props AS BIGINT) IS NOT NULL", "events")),
            _result("cast_check_user_id", "validity", "medium", _row("TRY_CAST(user_id AS TINYINT) IS NOT NULL", "events")),
        )
    ),
    "rule_fk_long_list": _result(
        "fk_check_o_custkey", "integrity", "high", _row("o_custkey % 2 = 0 AND o_custkey BETWEEN 0 AND 2998", "orders")
    ),
    "rule_fk_table": _with(
        _result("fk_check_nation_fk", "integrity", "high", _foreign("nation_fk", NATION)),
        _result("fk_check_o_custkey", "integrity", "high", _foreign("o_custkey", "(SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)", "orders")),
    ),
    "rule_freshness": " UNION ALL ".join(
        (
            _result("freshness_check_ts", "timeliness", "high", _row("ts >= TIMESTAMP '2024-01-30 00:00:00'", "events")),
            _result("ten_days", "timeliness", "high", _row("ts >= TIMESTAMP '2024-01-21 00:00:00'", "events"), 0.3),
        )
    ),
    "rule_consistency": _result(
        "consistency_check_l_shipdate+o_orderdate",
        "consistency",
        "medium",
        _row("l_shipdate >= o_orderdate", "lineitem JOIN orders ON l_orderkey = o_orderkey"),
    ),
    "rule_consistency_pairs": _with(
        _result(
            "consistency_check_nation_fk+segment",
            "consistency",
            "medium",
            _row(
                "nation_fk IS NULL OR segment IS NULL OR EXISTS (SELECT 1 FROM customer AS c WHERE c.c_custkey % 3 = 0 "
                "AND c.c_nationkey = s.nation_fk AND c.c_mktsegment = s.segment)",
                "dirty AS s",
            ),
        )
    ),
    "rule_accuracy": _with(
        _result("accuracy_check_segment", "accuracy", "high", _accurate("c_custkey", "segment = seg")),
        _result("balance", "accuracy", "high", _accurate("c_custkey", _close(0.005))),
        _result("wide", "accuracy", "high", _accurate("dup_key", _close(100.0))),
        ctes=f"{DIRTY}, {_TRUTH}",
    ),
    "rule_set": _with(*_SET),
    "rule_skipped": "SELECT 'null_check_not_there' AS rule_name, 'missing column: not_there' AS reason, CAST(10 AS BIGINT) AS ran FROM customer GROUP BY 1, 2",
    "rule_by_dimension": f"WITH {_SET_CTES} SELECT dimension, count(*) AS rule_count, string_agg(rule_name, ',' ORDER BY rule_no) AS rule_names, CAST(sum(fail_count) AS BIGINT) AS fail_count FROM results GROUP BY dimension",
    "rule_report": f"WITH {_SET_CTES} SELECT CASE WHEN fail_count > 0 THEN 'failed' ELSE 'passed' END AS section, rule_name, fail_count, round(100.0 * fail_count / total_count, 4) AS fail_pct, passed FROM results",
    "failing_samples": _failing(),
    "dimension_scores": f"WITH {_scored(_DEFAULT)} SELECT dimension, weight, rule_count, pass_count, fail_count, round(rate, 6) AS pass_rate, round(weight * rate, 6) AS weighted_score, rules FROM dims",
    "dataset_score": f"WITH {_scored(_DEFAULT)}, o AS (SELECT {_OVERALL} AS overall_score FROM dims) SELECT overall_score, {_grade('overall_score')} AS grade, (SELECT count(*) FROM results) AS total_rules, (SELECT count(*) FROM results WHERE passed) AS total_passed, (SELECT count(*) FROM results WHERE NOT passed) AS total_failed FROM o",
    "score_views": f"WITH {_scored(_values([('completeness', 3), ('validity', 1)], 'dimension, weight'))}, o AS (SELECT {_OVERALL} AS overall_score FROM dims) SELECT overall_score, {_grade('overall_score')} AS grade, dimension, weight, round(rate, 6) AS pass_rate, round(weight * rate, 6) AS weighted_score FROM dims, o",
    "score_severity": f"WITH {_scored(_DEFAULT, f'CASE WHEN sum({_SEVERITY}) > 0 THEN sum(r.pass_rate * {_SEVERITY}) / sum({_SEVERITY}) ELSE avg(r.pass_rate) END')} SELECT dimension, round(rate, 6) AS pass_rate, round(weight * rate, 6) AS weighted_score FROM dims",
    "score_by_team": f"WITH {_scored(_values(TEAM_WEIGHTS, 'team, dimension, weight'), by='team')}, o AS (SELECT team, {_OVERALL} AS overall_score FROM dims GROUP BY team) SELECT team, overall_score, {_grade('overall_score')} AS grade, (SELECT count(*) FROM results) AS total_rules FROM o",
    "score_latest": f"WITH {_HISTORY} SELECT dataset, CAST(day AS VARCHAR) AS run_id, overall_score, grade FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY day DESC) AS place FROM history) WHERE place = 1",
    "score_history": f"WITH {_HISTORY} SELECT dataset, CAST(day AS VARCHAR) AS run_id, overall_score, grade FROM history WHERE dataset = 'click'",
    "score_drift": f"""WITH {_HISTORY}, steps AS (SELECT *, lag(score) OVER w AS previous, round(score - lag(score) OVER w, 6) AS change
FROM long_scores WINDOW w AS (PARTITION BY dataset, dimension ORDER BY day))
SELECT dataset, dimension, CAST(day AS VARCHAR) AS day, score, previous, change, coalesce(change, 0) <= CAST(-0.05 AS DOUBLE) AS dropped,
sum(CASE WHEN change < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, dimension ORDER BY day ROWS 1 PRECEDING) = 2 AS trend FROM steps""",
    "sla_gate": f"""WITH {_HISTORY}, latest AS (SELECT dataset, max(day) AS day FROM history GROUP BY dataset),
each AS (SELECT l.*, h.grade FROM long_scores AS l JOIN latest USING (dataset, day) JOIN history AS h USING (dataset, day)),
policies AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in p) + ")" for p in POLICIES)}) AS v(policy, ds, dim, min_grade, min_score, action)),
checked AS (SELECT policy, dataset, dimension, grade, score, action,
  (dimension <> 'overall' OR min_grade IS NULL OR grade <= min_grade) AND (min_score IS NULL OR score >= CAST(min_score AS DOUBLE)) AS met
  FROM each JOIN policies ON (ds IS NULL OR ds = dataset) AND (coalesce(dim, 'overall') = dimension OR (dim = '*' AND dimension IN ({", ".join(repr(d) for d in DIMENSIONS)}))))
SELECT policy, dataset, dimension, grade, score, met, CASE WHEN met THEN 'pass' ELSE action END AS action FROM checked""",
    "manifest_check": f"WITH {_manifest()} SELECT path, status, expected_bytes, size_bytes FROM checked",
    "manifest_result": f"""WITH {_manifest()} SELECT 'manifest_check' AS rule_name, 'integrity' AS dimension,
count(*) FILTER (WHERE status = 'ok') AS pass_count, count(*) FILTER (WHERE status <> 'ok') AS fail_count, count(*) AS total_count,
round(CAST(count(*) FILTER (WHERE status = 'ok') AS DOUBLE) / count(*), 6) AS pass_rate, count(*) FILTER (WHERE status = 'missing') AS missing,
count(*) FILTER (WHERE status = 'unexpected') AS unexpected, count(*) FILTER (WHERE status = 'size_mismatch') AS size_mismatch FROM checked""",
    "text_duplicates": "SELECT sha256(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "near_duplicates": f"WITH {_SIGNS}, {_copies()}{_near(3)}",
    "near_duplicates_crowded": f"WITH {_ALIKE}, {_copies()}{_near(3)}",
    "near_duplicates_8": f"WITH {_ALIKE}, {_copies()}{_near(8)}",
    "near_duplicates_12": f"WITH {_ALIKE}, {_copies()}{_near(12)}",
    "document_profile": rf"""WITH {_PAGES} SELECT doc_id, CASE WHEN bool_and(native) THEN 'native' WHEN NOT bool_or(native) THEN 'scanned' ELSE 'mixed' END AS doc_type,
count(*) AS page_count, CAST(sum(length(text)) AS BIGINT) AS total_chars, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS word_count,
count(*) FILTER (WHERE NOT native) AS ocr_page_count FROM pages_ GROUP BY doc_id""",
    "document_pages": f"WITH {_PAGES} SELECT doc_id, page_number, CASE WHEN native THEN 'native' ELSE 'scanned' END AS page_type, text, NOT native AS is_ocr FROM pages_ WHERE page_number IN (1, 2, 5000)",
    "table_cells": f"WITH {_TABLES} SELECT doc_id, row_no, column_no, CASE WHEN column_no >= len(head) OR head[column_no + 1] = '' THEN concat('col_', CAST(column_no AS VARCHAR)) ELSE head[column_no + 1] END AS header, value FROM cells",
    "semantic_types": _semantic(),
    "redact_edge_cases": """SELECT c_custkey, CASE c_custkey % 9
WHEN 0 THEN 'on 20' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-01-02 10:30' WHEN 1 THEN 'order ' || lpad(CAST(c_custkey AS VARCHAR), 20, '7')
WHEN 2 THEN '12-34-56-78-' || (10 + c_custkey % 90) || ' items' WHEN 3 THEN '1.2.3.4.' || c_custkey WHEN 4 THEN 'host ' || (256 + c_custkey) || '.1.1.1'
WHEN 5 THEN 'from [IP], by [EMAIL].' WHEN 6 THEN 'call [PHONE] [IP] or [PHONE]' WHEN 7 THEN 'not 4111 1111 1111 1112 but [CARD] [CARD]'
ELSE c_name || ' born 02.01.1990, [SSN]' END AS redacted FROM customer""",
    "redact_text": f"SELECT doc_id, sha256({_redacted('text')}) AS redacted_hash, length({_redacted('text')}) AS redacted_chars FROM documents",
    "explanation_prompts": _explanations(),
    "classification_prompts": _classification_prompts(),
    "proposal_prompt": _proposal_prompt(),
    "completion_cache": f"""WITH {_KEYS}, first_run AS (SELECT DISTINCT cache_key FROM keyed WHERE conv_id % 3 = 0)
SELECT conv_id, turn, cache_key, concat('{{"words": ', {_WORDS}, '}}') AS content, cache_key IN (SELECT cache_key FROM first_run) AS cached FROM keyed""",
    "completion_usage": f"""WITH {_KEYS}, once AS (SELECT DISTINCT cache_key, text FROM keyed)
SELECT 'stub' AS model, count(*) AS call_count, CAST(sum(length(text)) AS BIGINT) AS prompt_tokens, 12 * count(*) AS completion_tokens,
CAST(sum(length(text)) + 12 * count(*) AS BIGINT) AS total_tokens, round(sum(CAST(length(text) AS DOUBLE) * 0.001), 4) AS estimated_cost_usd FROM once""",
    "parse_response": f"""WITH {_PARSED} SELECT conv_id, turn, CASE WHEN kind IN (0, 1) THEN role END AS role,
CASE WHEN kind = 0 THEN CAST(length(text) AS VARCHAR) END AS n,
CASE kind WHEN 2 THEN '{{}}' WHEN 3 THEN concat('answer ', role) WHEN 4 THEN '{{"role": ' END AS text FROM raw""",
    "typed_answers": """SELECT concat(CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS column_name,
CASE WHEN turn % 3 = 0 THEN role ELSE 'unknown' END AS semantic_type, CASE WHEN turn % 3 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS confidence,
turn % 3 = 0 AS pii_detected, CASE WHEN turn % 3 = 1 THEN 'low' ELSE 'none' END AS pii_category,
CASE WHEN turn % 3 = 1 THEN 'a,b' ELSE '' END AS pii_types, CAST(NULL AS VARCHAR) AS suggested_validation, '' AS rationale FROM conversations""",
    "image_profile": _image_profile(),
    "image_hash": f"WITH {_HASHES} SELECT concat('img-', CAST(vec_id AS VARCHAR)) AS path, string_agg(substr('0123456789abcdef', n + 1, 1), '' ORDER BY d) AS phash FROM digits GROUP BY vec_id",
    "image_near_duplicates": f"""WITH {_HASHES}, hashes AS (SELECT vec_id AS id,
CAST(sum(CASE WHEN i < 32 THEN CAST(b AS BIGINT) << CAST(31 - i AS INTEGER) ELSE 0 END) AS BIGINT) AS hi,
CAST(sum(CASE WHEN i >= 32 THEN CAST(b AS BIGINT) << CAST(63 - i AS INTEGER) ELSE 0 END) AS BIGINT) AS lo FROM bits GROUP BY vec_id){_near(4)}""",
    "image_files": """WITH kinds AS (SELECT vec_id, vec_id % 17 = 0 AS broken, vec_id % 6 AS k, 1 + vec_id % 9 AS w, 1 + vec_id % 7 AS h FROM embeddings),
sized AS (SELECT *, h * (1 + CASE k WHEN 1 THEN 3 * w WHEN 2 THEN 4 * w WHEN 4 THEN (w + 7) // 8 ELSE w END) AS raw FROM kinds)
SELECT 'img-' || vec_id || '.bin' AS name, CASE WHEN broken THEN 'unknown' WHEN k = 5 THEN 'BMP' ELSE 'PNG' END AS format,
CASE WHEN broken THEN 0 ELSE w END AS width, CASE WHEN broken THEN 0 ELSE h END AS height,
CASE WHEN broken THEN 0 WHEN k IN (1, 5) THEN 3 WHEN k = 2 THEN 4 ELSE 1 END AS channels,
CASE WHEN broken THEN 8 WHEN k = 5 THEN 54 + h * ((3 * w + 3) // 4 * 4) ELSE 57 + CASE WHEN k = 3 THEN 24 ELSE 0 END + 11 + raw END AS file_size_bytes,
broken AS is_corrupt, CASE WHEN broken THEN '' ELSE ['L', 'RGB', 'RGBA', 'P', '1', 'RGB'][k + 1] END AS color_mode,
CASE WHEN broken THEN NULL WHEN k = 4 THEN 1 ELSE 8 END AS bit_depth,
CASE WHEN broken THEN 0::DOUBLE ELSE round(w::DOUBLE / h, 4) END AS aspect_ratio FROM sized""",
    "rule_fk_mixed_types": " UNION ALL ".join(
        _result(f"{kind}_{n}", dimension, severity, _row(f"p_partkey % 3 = 0 AND p_partkey < {3 * n}{extra}", "part"))
        for n in (10, 5000)
        for kind, dimension, severity, extra in (
            ("double", "integrity", "high", ""), ("decimal", "validity", "medium", ""), ("bigint", "integrity", "high", " AND p_partkey % 2 = 0"),
        )
    ),
    "rule_fk_decimal_key": " UNION ALL ".join(
        (
            _result("fk_check_wide_key", "integrity", "high", _row("p_partkey % 2 = 0", "part")),
            _result("accuracy_check_p_size", "accuracy", "high", _row("p_partkey % 2 = 0", "part")),
        )
    ),
    "failing_sample_json": f"""WITH {DIRTY}, bad AS (
  SELECT 'null_check_email' AS rule_name, * FROM dirty WHERE email IS NULL UNION ALL SELECT 'null_check_segment', * FROM dirty WHERE segment IS NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rule_name ORDER BY c_custkey) - 1 AS place FROM bad)
SELECT rule_name, place, '{{"c_custkey":' || c_custkey || ',"email":' || coalesce('"' || email || '"', 'null') || ',"segment":' || coalesce('"' || segment || '"', 'null') || '}}' AS row
FROM ranked WHERE place < 5""",
    "explanation_prompts_rows": f"""WITH {DIRTY}, bad AS (
  SELECT 'email' AS col, * FROM dirty WHERE email IS NULL UNION ALL SELECT 'segment', * FROM dirty WHERE segment IS NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY c_custkey) AS place FROM bad),
shown AS (SELECT col, string_agg('{{"c_custkey":' || c_custkey || ',"email":' || coalesce('"' || email || '"', 'null') || ',"segment":' || coalesce('"' || segment || '"', 'null') || '}}', ',' ORDER BY place) AS cells
  FROM ranked WHERE place <= 10 GROUP BY col),
counts AS (SELECT col, count(*) AS failed, (SELECT count(*) FROM dirty) AS total FROM bad GROUP BY col)
SELECT 'null_check_' || col AS rule_name, concat_ws(chr(10), 'A data quality rule failed. Explain why.', '',
  'rule: null_check_' || col || ' (completeness, high)', 'column: ' || col, 'check: Null check on ' || chr(39) || col || chr(39),
  'pass rate: ' || printf('%.4f', (total - failed) / total) || ', passed ' || (total - failed) || ', failed ' || failed || ' of ' || total || ', threshold 1.0',
  'failing rows: [' || cells || ']', '',
  'Answer in JSON with summary, root_cause, impact, suggested_fix, severity_assessment and tags.') AS prompt
FROM shown JOIN counts USING (col)""",
    "sample_summary": "SELECT least(count(*), 500) AS n_rows, least(count(*), 500) AS n_known, least(count(*), 500) AS n_distinct FROM orders",
    "rule_isolation": f"""WITH {DIRTY}, ran(rule_name, ok) AS (
  SELECT 'null_check_email', email IS NOT NULL FROM dirty
  UNION ALL SELECT 'bad_cast', coalesce(TRY_CAST(bal_text AS DOUBLE) > 0, false) FROM dirty
  UNION ALL SELECT 'zero_division', c_custkey % 4 <> 0 AND 100.0 / nullif(c_custkey % 4, 0) > 40 FROM dirty
  UNION ALL SELECT 'unique_check_c_custkey', true FROM dirty)
SELECT rule_name, 'ran' AS outcome, count(*) FILTER (ok) AS pass_count, count(*) FILTER (NOT ok) AS fail_count FROM ran GROUP BY rule_name
UNION ALL SELECT unnest(['unknown_column', 'raising', 'without_column']), 'skipped', NULL, NULL""",
    "rule_yaml_bad_entries": f"""WITH {DIRTY} SELECT 'good' AS rule_name, 'ran' AS outcome, count(*) FILTER (email IS NULL) AS fail_count FROM dirty
UNION ALL SELECT 'good_too', 'ran', 0 UNION ALL SELECT unnest(['bad_pattern', 'bad_type', 'bad_threshold']), 'skipped', NULL""",
    "csv_quoted": """SELECT c_custkey, 'a "' || c_mktsegment || '", b' AS said, CASE WHEN c_custkey % 3 = 0 THEN 'one' || chr(10) || c_name ELSE c_name END AS lines FROM customer
UNION ALL SELECT -1, 'row_count', CAST(count(*) AS VARCHAR) FROM customer""",
    "json_lines": "SELECT CAST(c_custkey AS BIGINT) AS k, c_name AS name FROM customer",
    "json_array": """SELECT CAST(c_custkey AS BIGINT) AS k, '}, {"' || c_name || chr(92) AS name, CAST(c_nationkey AS BIGINT) AS n FROM customer""",
    "json_object": "SELECT CAST(min(o_orderkey) AS BIGINT) AS k, min(o_orderpriority) AS name, count(*) AS n FROM orders",
    "in_memory_rows": """SELECT CAST(left(o_orderpriority, 1) AS BIGINT) AS k, (CASE WHEN n % 2 = 1 THEN n ELSE n / 2 END)::DOUBLE AS mixed, NULL AS none,
CASE WHEN left(o_orderpriority, 1) <> '1' THEN o_orderpriority END AS name FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""",
    "history_names": "SELECT d AS dataset, 'run' || o_orderstatus AS run_id, count(*) AS n FROM orders, unnest(['007', '7', '2024-01-01']) AS u(d) GROUP BY d, o_orderstatus",
    "sla_unscored": """WITH d AS (SELECT DISTINCT 'r' || o_custkey % 5 AS dataset FROM orders)
SELECT 'fresh' AS policy, dataset, 'timeliness' AS dimension, false AS met, 'block' AS action FROM d
UNION ALL SELECT 'valid', dataset, 'validity', true, 'pass' FROM d UNION ALL SELECT 'each', dataset, 'validity', true, 'pass' FROM d WHERE dataset = 'r1'""",
    "quality_run": f"WITH {_scored(_DEFAULT)}, o AS (SELECT {_OVERALL} AS overall_score FROM dims) SELECT 'customers' AS dataset, 'second' AS run_id, overall_score, {_grade('overall_score')} AS grade, (SELECT count(*) FROM results) AS total_rules, (SELECT count(*) FROM results WHERE passed) AS total_passed, CAST(2 AS BIGINT) AS runs FROM o",
    "weights_yaml": f"WITH {_scored(_values([('completeness', 2), ('uniqueness', 1.5), ('validity', 0.5), ('conformity', 0)], 'dimension, weight'))} SELECT dimension, round(weight, 6) AS weight, round(rate, 6) AS pass_rate, round(weight * rate, 6) AS weighted_score FROM dims",
    "custom_rule": _with(
        _result("even", "conformity", "medium", _row("c_custkey % 2 = 0")),
        _result("from_yaml", "conformity", "low", _row("age % 3 = 0"), 0.3),
        _result("multiple_check_nation_fk", "conformity", "high", _row("nation_fk % 1 = 0"), 0.5),
    ),
    "rule_added": _with(
        _result("null_check_email", "completeness", "high", _row("email IS NOT NULL")),
        _result("range_check_age", "validity", "medium", _row("age BETWEEN 18 AND 60")),
        _result("unique_check_dup_key", "uniqueness", "low", _unique("dup_key")),
    ),
    "rule_formats": " UNION ALL ".join(
        _result(f"format_check_{name}", "conformity", "medium", _row(condition, "customer"), 0.5)
        for name, condition in (
            ("e164", "c_custkey % 16 BETWEEN 1 AND 14"), ("iso_country2", "c_custkey % 3 = 0"), ("iso_country3", "c_custkey % 2 = 1"),
            ("iso_language", "c_custkey % 3 = 1"), ("iso_date", "c_custkey % 14 BETWEEN 1 AND 12 AND c_custkey % 33 BETWEEN 1 AND 31"),
            ("iso_datetime", "c_custkey % 30 < 24 AND c_custkey % 2 = 0"), ("uuid", "c_custkey % 2 = 1"), ("ipv4", "c_custkey % 300 <= 255"),
            ("email", "c_custkey % 4 <> 0"),
        )
    ),
    "typed_proposals": """WITH a AS (SELECT concat(conv_id, '-', turn) AS table_name, turn, role FROM conversations)
SELECT table_name, CAST(0 AS BIGINT) AS proposal_no, 'range_check' AS rule_type, role AS "column", '{"min_value":' || turn || '}' AS params, 'medium' AS severity,
'validity' AS dimension, '' AS rationale, CAST(0.5 AS DOUBLE) AS confidence FROM a WHERE turn % 3 = 0
UNION ALL SELECT table_name, 1, 'null_check', 'x', '{}', 'medium', 'validity', '', 0 FROM a WHERE turn % 3 = 0
UNION ALL SELECT table_name, 0, 'null_check', '', '{}', 'high', 'completeness', 'why', 0 FROM a WHERE turn % 3 = 1""",
    "typed_explanations": """WITH a AS (SELECT concat(conv_id, '-', turn) AS rule_name, turn % 2 = 0 AS even, role, length(text) AS n FROM conversations)
SELECT rule_name, CASE WHEN even THEN 'by ' || role ELSE 'No summary available.' END AS summary, CASE WHEN even THEN 'Unknown.' ELSE 'load' END AS root_cause,
CASE WHEN even THEN 'small' ELSE 'Unknown impact.' END AS impact, 'Manual review recommended.' AS suggested_fix, CASE WHEN even THEN '' ELSE 'low' END AS severity_assessment,
n AS affected_rows_estimate, CASE WHEN even THEN 'a,' || role ELSE '' END AS tags FROM a""",
    "proposals_yaml": _with(
        *(_result(f"null_check_{c}", "completeness", "medium", _row(f"{_clean(c)} IS NOT NULL")) for c in ("email", "segment", "bal_nan")),
        _result("null_check_nation_fk", "completeness", "high", _row("nation_fk IS NOT NULL")),
        _result("unique_check_c_custkey", "uniqueness", "high", _unique("c_custkey")),
        *(_result(f"range_check_{c}", "validity", "medium", _row(f"{c} >= 0")) for c in ("c_custkey", "dup_key", "nation_fk")),
        _result("regex_check_email", "conformity", "high", _row(f"regexp_full_match(email, '{EMAIL_RULE}')")),
    ),
    "classification_prompts_samples": f"""WITH {DIRTY} SELECT unnest([{', '.join(f"'{c}'" for c in COLUMNS)}]) AS column_name,
unnest([{', '.join({"segment": "(SELECT concat('samples: [', coalesce(CAST(to_json(arg_min_null(segment, c_custkey)) AS VARCHAR), 'null'), ']') FROM dirty)", "email": "(SELECT concat('samples: [', to_json(arg_max(email, c_custkey)), ',', to_json(arg_max(email, c_custkey)), ']') FROM dirty WHERE email IS NOT NULL)"}.get(c, "'samples: []'") for c in COLUMNS)}]) AS samples""",
    "completion_expiry": f"""WITH {_KEYS}, second_run AS (SELECT DISTINCT cache_key FROM keyed WHERE conv_id % 3 = 1),
first_run AS (SELECT DISTINCT cache_key FROM keyed WHERE conv_id % 3 = 0),
known AS (SELECT k.*, cache_key IN (SELECT cache_key FROM second_run) AND cache_key NOT IN (SELECT cache_key FROM first_run) AS cached FROM keyed AS k)
SELECT conv_id, turn, cached, CASE WHEN cached THEN '2024-01-20' ELSE '2024-02-10' END AS answered FROM known""",
}
