"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Views ``region nation customer ... conversations`` are pre-registered by the
checker.  Helpers below only paste fixed fixture definitions into strings.
"""

from __future__ import annotations


def R6(x: str) -> str:
    return f"CAST(floor(CAST({x} AS DOUBLE) * 1e6 + 0.5) / 1e6 AS DOUBLE)"


def U(seed, *keys: str) -> str:
    """Seeded uniform, identical to ``quietab.functions.rand.u``."""
    s = f"'{seed}'" + "".join(f" || ':' || CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST(('0x' || substr(md5({s}), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


def POLAR(seed, *keys: str) -> tuple[str, str]:
    """(radius, angle) of ``quietab.functions.rand._polar``: both uniforms from one md5."""
    s = f"'{seed}'" + "".join(f" || ':' || CAST({k} AS VARCHAR)" for k in keys)
    u1, u2 = (f"(CAST(('0x' || substr(md5({s}), {at}, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))" for at in (1, 14))
    return f"sqrt(-2.0 * ln(1.0 - {u1}))", f"(2.0 * pi() * {u2})"


def GAUSS_VEC(seed, dim: int, *keys: str) -> list[str]:
    """Element j of ``quietab.functions.rand.gauss_vector`` (Box-Muller pairs)."""
    out = []
    for j in range(dim):
        r, th = POLAR(seed, *keys, str(j // 2))
        out.append(f"({r} * {'cos' if j % 2 == 0 else 'sin'}{th})")
    return out


def GAUSS(seed, *keys: str) -> str:
    r, angle = POLAR(seed, *keys)
    return f"({r} * cos{angle})"


FX1 = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate,
        l_extendedprice, l_discount, l_tax, l_returnflag,
        CAST(l_linenumber AS VARCHAR) AS linenumber_cat, l_linestatus FROM lineitem)"""

FX2 = """(SELECT o_orderkey, o_totalprice, c_acctbal, o_orderpriority, c_mktsegment,
        CAST(c_nationkey AS VARCHAR) AS c_nation, o_orderstatus
   FROM orders JOIN customer ON o_custkey = c_custkey)"""

FX3 = """(SELECT event_id, value, user_id, event_type, CAST(value > 50 AS INTEGER) AS label FROM events)"""


def minmax_params(cols, src) -> str:
    """scale = 2 / range (range 0 -> 1), offset = -1 - min * scale, as one row."""
    parts = []
    for i, c in enumerate(cols):
        rng = f"(CASE WHEN max({c}) - min({c}) = 0 THEN 1.0 ELSE max({c}) - min({c}) END)"
        parts.append(f"2.0 / {rng} AS s{i}")
        parts.append(f"-1.0 - min({c}) * (2.0 / {rng}) AS o{i}")
    return f"SELECT {', '.join(parts)} FROM {src}"


def dict_cte(name, col, src) -> str:
    return (f"{name} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS BIGINT) AS code "
            f"FROM (SELECT DISTINCT CAST({col} AS VARCHAR) AS v FROM {src} WHERE {col} IS NOT NULL))")


def bits(code: str, width: int, start: int) -> list[str]:
    return [f"CAST(CAST(({code} >> {width - 1 - j}) & 1 AS FLOAT) AS DOUBLE) AS cat_{start + j}"
            for j in range(width)]


def _encode_fx1_sql() -> str:
    nums = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    num_sel = [f"CAST(CAST({c} * p.s{i} + p.o{i} AS FLOAT) AS DOUBLE) AS num_{i}" for i, c in enumerate(nums)]
    cat_sel = bits("coalesce(d1.code, -1)", 2, 0) + bits("coalesce(d2.code, -1)", 3, 2)
    return f"""
WITH fx AS {FX1},
p AS ({minmax_params(nums, 'fx')}),
{dict_cte('d1', 'l_returnflag', 'fx')},
{dict_cte('d2', 'linenumber_cat', 'fx')},
{dict_cte('dl', 'l_linestatus', 'fx')}
SELECT {', '.join(num_sel + cat_sel)}, dl.code AS label
FROM fx CROSS JOIN p
LEFT JOIN d1 ON fx.l_returnflag = d1.v
LEFT JOIN d2 ON fx.linenumber_cat = d2.v
LEFT JOIN dl ON fx.l_linestatus = dl.v"""


ENCODE_FX1 = _encode_fx1_sql()

def D(x: float) -> str:
    """An exact DOUBLE literal (plain decimals parse as DECIMAL in DuckDB)."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


FX5 = """(SELECT d.doc_id, n_chars, lang, source, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def onehot(code: str, n: int, start: int) -> list[str]:
    eff = f"(CASE WHEN {code} < 0 THEN {n - 1} ELSE {code} END)"
    return [f"CAST(CAST(CASE WHEN {eff} = {j} THEN 1 ELSE 0 END AS FLOAT) AS DOUBLE) AS cat_{start + j}"
            for j in range(n)]


def _encode_fx2_sql() -> str:
    nums = ["o_totalprice", "c_acctbal"]
    p = ", ".join(f"avg({c}) AS m{i}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s{i}"
                  for i, c in enumerate(nums))
    num_sel = [f"CAST(CAST(({c} - p.m{i}) / p.s{i} AS FLOAT) AS DOUBLE) AS num_{i}" for i, c in enumerate(nums)]
    cat_sel = (onehot("coalesce(d1.code, -1)", 5, 0) + onehot("coalesce(d2.code, -1)", 5, 5)
               + onehot("coalesce(d3.code, -1)", 25, 10))
    return f"""
WITH fx AS {FX2},
p AS (SELECT {p} FROM fx),
{dict_cte('d1', 'o_orderpriority', 'fx')},
{dict_cte('d2', 'c_mktsegment', 'fx')},
{dict_cte('d3', 'c_nation', 'fx')},
{dict_cte('dl', 'o_orderstatus', 'fx')}
SELECT {', '.join(num_sel + cat_sel)}, dl.code AS label
FROM fx CROSS JOIN p
LEFT JOIN d1 ON fx.o_orderpriority = d1.v
LEFT JOIN d2 ON fx.c_mktsegment = d2.v
LEFT JOIN d3 ON fx.c_nation = d3.v
LEFT JOIN dl ON fx.o_orderstatus = dl.v"""


def _fx3_features_cte() -> str:
    """FX3 min-max + bits encoding as columns f0..f4 plus the fitted constants."""
    nums = ["value", "user_id"]
    feats = [f"CAST(CAST({c} * p.s{i} + p.o{i} AS FLOAT) AS DOUBLE) AS f{i}" for i, c in enumerate(nums)]
    feats += [f"CAST((coalesce(d.code, -1) >> {2 - j}) & 1 AS DOUBLE) AS f{2 + j}" for j in range(3)]
    return f"""fx AS {FX3},
p AS ({minmax_params(nums, 'fx')}),
{dict_cte('d', 'event_type', 'fx')},
enc AS (SELECT fx.event_id, fx.label, fx.event_type, {', '.join(feats)}, p.s0, p.o0, p.s1, p.o1
        FROM fx CROSS JOIN p LEFT JOIN d ON fx.event_type = d.v)"""


def _decode_noisy_sql(seed: int, scale: float, reject: bool) -> str:
    g = [f"f{j} + {D(scale)} * {GAUSS(seed, 'event_id', str(j))} AS g{j}" for j in range(5)]
    code = "(round_even(g2, 0) * 4 + round_even(g3, 0) * 2 + round_even(g4, 0))"
    where = f"WHERE {code} >= 0 AND {code} < 5" if reject else ""
    return f"""
WITH {_fx3_features_cte()},
noisy AS (SELECT event_id, s0, o0, s1, o1, {', '.join(g)} FROM enc),
dec AS (SELECT event_id, (g0 - o0) / s0 AS value, CAST(round_even((g1 - o1) / s1, 0) AS BIGINT) AS user_id,
               CAST(greatest(0, least({code}, 4)) AS BIGINT) AS code
        FROM noisy {where})
SELECT event_id, {R6('value')} AS value, user_id, d.v AS event_type FROM dec LEFT JOIN d ON dec.code = d.code"""


def _quantile_fit_sql() -> str:
    parts = []
    for c in ("value", "user_id"):
        parts.append(f"""
(WITH v AS (SELECT CAST({c} AS DOUBLE) AS x, row_number() OVER (ORDER BY {c}) - 1 AS pos FROM events
            WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))),
 n AS (SELECT count(*) AS n FROM v),
 nq AS (SELECT least(greatest(least(n // 30, 1000), 10), n) AS nq, n FROM n),
 r AS (SELECT i AS idx, CASE WHEN i = nq - 1 THEN 1.0 ELSE i * (1.0 / (nq - 1)) + 0.0 END AS ref, n
       FROM nq, range(0, nq) t(i)),
 h AS (SELECT idx, ref, ref * (n - 1) AS h, CAST(floor(ref * (n - 1)) AS BIGINT) AS lo,
              CAST(ceil(ref * (n - 1)) AS BIGINT) AS hi FROM r)
 SELECT '{c}' AS col, CAST(idx AS BIGINT) AS idx, {R6('ref')} AS ref,
        {R6('CASE WHEN h.hi = h.lo THEN a.x ELSE (h.hi - h.h) * a.x + (h.h - h.lo) * b.x END')} AS quantile
 FROM h JOIN v a ON a.pos = h.lo JOIN v b ON b.pos = h.hi)""")
    return " UNION ALL ".join(parts)


SPLIT_FX3 = f"""
(WITH d AS (SELECT event_id, value, user_id, event_type, CAST(value > 50 AS INTEGER) AS label,
                   {U(42, 'event_id')} AS u FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY u, event_id) AS rk,
              count(*) OVER (PARTITION BY label) AS n FROM d)
 SELECT event_id, value, user_id, event_type, label,
        CASE WHEN rk <= floor({D(0.6)} * n + 0.5) THEN 'train'
             WHEN rk <= floor({D(0.8)} * n + 0.5) THEN 'val' ELSE 'test' END AS split FROM r)"""

PRED_FX3 = f"""(SELECT event_id, user_id, event_type, CAST(value > 50 AS BIGINT) AS y,
        floor((value / {D(500.0)} + {U(5, 'event_id')}) * 20) / {D(40.0)} AS score FROM events)"""


def _binary_report_sql(by: str) -> str:
    return f"""
WITH pr AS {PRED_FX3},
a AS (SELECT {by}, avg(CAST(y = CAST(score > {D(0.5)} AS BIGINT) AS DOUBLE)) AS accuracy,
             sum(CASE WHEN y = 1 AND score > 0.5 THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN y <> 1 AND score > 0.5 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN y = 1 AND NOT score > 0.5 THEN 1 ELSE 0 END) AS fn FROM pr GROUP BY {by}),
g AS (SELECT {by}, score, sum(y) AS pos, sum(1 - y) AS neg FROM pr GROUP BY {by}, score),
c AS (SELECT {by}, pos, neg, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY score
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
auc AS (SELECT {by}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
             THEN sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) END AS roc_auc FROM c GROUP BY {by})
SELECT a.{by}, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
       accuracy, roc_auc FROM a JOIN auc ON a.{by} = auc.{by}"""


ORACLES = {
    "encode_minmax_bits": ENCODE_FX1,
    "encoded_label_means": f"""
SELECT label, count(*) AS n,
  {', '.join(R6(f'avg(num_{i})') + f' AS avg_num_{i}' for i in range(4))},
  {', '.join(R6(f'avg(cat_{i})') + f' AS avg_cat_{i}' for i in range(5))}
FROM ({ENCODE_FX1}) GROUP BY label""",
}


ORACLES.update({
    "encode_standard_onehot": _encode_fx2_sql(),
    "decode_noisy_clip": _decode_noisy_sql(11, 0.3, False),
    "decode_noisy_reject": _decode_noisy_sql(12, 0.6, True),
    "quantile_fit": _quantile_fit_sql(),
    "num2cat": """
WITH u AS (SELECT 'l_orderkey' AS col, 0 AS pos, CAST(l_orderkey AS DOUBLE) AS v FROM lineitem UNION ALL SELECT 'l_partkey' AS col, 1 AS pos, CAST(l_partkey AS DOUBLE) AS v FROM lineitem UNION ALL SELECT 'l_suppkey' AS col, 2 AS pos, CAST(l_suppkey AS DOUBLE) AS v FROM lineitem UNION ALL SELECT 'l_linenumber' AS col, 3 AS pos, CAST(l_linenumber AS DOUBLE) AS v FROM lineitem UNION ALL SELECT 'l_quantity' AS col, 4 AS pos, CAST(l_quantity AS DOUBLE) AS v FROM lineitem UNION ALL SELECT 'l_extendedprice' AS col, 5 AS pos, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem UNION ALL SELECT 'l_discount' AS col, 6 AS pos, CAST(l_discount AS DOUBLE) AS v FROM lineitem UNION ALL SELECT 'l_tax' AS col, 7 AS pos, CAST(l_tax AS DOUBLE) AS v FROM lineitem),
d AS (SELECT DISTINCT col, pos, v FROM u WHERE v IS NOT NULL AND NOT isnan(v)),
s AS (SELECT col, count(*) AS n, bool_and(v = floor(v)) AS integral FROM d GROUP BY col),
r AS (SELECT d.col, d.pos, d.v, row_number() OVER (PARTITION BY d.col ORDER BY d.v) - 1 AS rk
      FROM d JOIN s ON d.col = s.col WHERE s.n < 15 AND s.integral)
SELECT col, v AS value, chr(97 + pos) || CAST(rk AS VARCHAR) AS category FROM r""",
    "stratified_split": f"SELECT event_id, label, split FROM {SPLIT_FX3}",
    "split_profile": f"""
SELECT 'events' AS name,
  CASE WHEN count(DISTINCT label) < 100 THEN CASE WHEN count(DISTINCT label) = 2 THEN 'binclass'
       ELSE 'multiclass' END ELSE 'regression' END AS task_type,
  CAST(count(DISTINCT label) AS BIGINT) AS n_classes, CAST(2 AS BIGINT) AS n_num_features,
  CAST(1 AS BIGINT) AS n_cat_features,
  CAST(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS train_size,
  CAST(sum(CASE WHEN split = 'val' THEN 1 ELSE 0 END) AS BIGINT) AS val_size,
  CAST(sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS test_size
FROM {SPLIT_FX3}""",
    "append_tables": """
SELECT o_orderkey, o_custkey, o_totalprice, CAST(NULL AS DOUBLE) AS c_acctbal FROM orders
UNION ALL SELECT CAST(NULL AS BIGINT), c_custkey, CAST(NULL AS DOUBLE), c_acctbal FROM customer""",
    "split_keys": """
SELECT event_id, 'allowed' AS part FROM events WHERE value > 10 AND event_type <> 'error'
UNION ALL SELECT event_id, 'rejected' AS part FROM events WHERE NOT (value > 10 AND event_type <> 'error')""",
    "csv_roundtrip": "SELECT event_id, user_id, event_type, value FROM events",
    "csv_prose_roundtrip": """
SELECT doc_id, text, lang, source, n_chars,
  '"' || lang || '", ' || source || ' said ""x""' || chr(10) || ' ' AS quoted FROM documents""",
    "evaluation_coverage": f"""
SELECT model, split, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_positive, count(*) AS n_distributions
FROM {SPLIT_FX3}, (VALUES ('tree'), ('logistic'), ('knn')) m(model) GROUP BY 1, 2""",
    "synthetic_checks": f"""
SELECT count(*) AS n_rows, count(*) AS n_ids, CAST(0 AS BIGINT) AS n_not_finite, CAST(0 AS BIGINT) AS n_outside
FROM {SPLIT_FX3} WHERE split = 'train'""",
    "sweep_threshold": f"""
WITH p AS (SELECT run_id, {U(21, 'run_id', "'cut'")} * 100.0 AS cut,
             CAST(2 + floor({U(21, 'run_id', "'depth'")} * 9) AS BIGINT) AS depth
           FROM (SELECT CAST(range AS BIGINT) AS run_id FROM range(12))),
s AS (SELECT run_id, cut, depth, round_even(avg(CASE WHEN (x.value > cut) = (x.label = 1) THEN 1.0 ELSE 0.0 END), 4) AS score
      FROM p, {SPLIT_FX3} x WHERE x.split = 'val' GROUP BY 1, 2, 3)
SELECT run_id, score, {R6('cut')} AS cut, depth FROM s ORDER BY score DESC, run_id LIMIT 1""",
    "dp_histogram": f"""
WITH dom AS (SELECT * FROM (VALUES ('F'), ('O'), ('P')) t(o_orderstatus)),
c AS (SELECT o_orderstatus, count(*) AS n FROM {FX2} GROUP BY 1),
h AS (SELECT dom.o_orderstatus, CAST(coalesce(c.n, 0) AS BIGINT) AS count
      FROM dom LEFT JOIN c ON dom.o_orderstatus = c.o_orderstatus),
z AS (SELECT *, greatest(count + {D(__import__('math').sqrt(2 * __import__('math').log(1.25 / 1e-5)) / 0.1)}
                         * {GAUSS(7, 'o_orderstatus')}, {D(1e-6)}) AS noisy FROM h)
SELECT o_orderstatus, count, {R6('noisy')} AS noisy, {R6('noisy / sum(noisy) OVER ()')} AS p FROM z""",
    "label_distribution": f"""
WITH dom AS (SELECT * FROM (VALUES (0), (1), (2)) t(quality)),
c AS (SELECT quality, count(*) AS n FROM {FX5} GROUP BY 1),
h AS (SELECT dom.quality, coalesce(c.n, 0) AS n FROM dom LEFT JOIN c ON dom.quality = c.quality)
SELECT CAST(quality AS BIGINT) AS quality, CAST(n AS BIGINT) AS count, {R6('n / sum(n) OVER ()')} AS p FROM h""",
    "class_weights": f"""
WITH dom AS (SELECT * FROM (VALUES ('F'), ('O'), ('P')) t(o_orderstatus)),
c AS (SELECT o_orderstatus, count(*) AS n FROM {FX2} GROUP BY 1),
pd AS (SELECT dom.o_orderstatus, coalesce(c.n, 0) AS cnt,
              coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER () AS p
       FROM dom LEFT JOIN c ON dom.o_orderstatus = c.o_orderstatus),
w0 AS (SELECT *, pow((p + {D(0.01)}) / ({D(1.0)} + {D(0.01)} * count(*) OVER ()), {D(-0.5)}) AS w FROM pd),
w AS (SELECT *, least(w / avg(w) OVER (), {D(5.0)}) AS weight FROM w0)
SELECT o_orderstatus, {R6('p')} AS p, {R6('weight')} AS weight, {R6('weight * cnt')} AS total_weight
FROM w WHERE cnt > 0""",
    "binary_metrics": f"""
SELECT event_type, {R6('f1')} AS f1, {R6('accuracy')} AS accuracy, {R6('roc_auc')} AS roc_auc
FROM ({_binary_report_sql('event_type')})""",
    "best_threshold": f"""
WITH pr AS {PRED_FX3},
g AS (SELECT event_type, score, sum(y) AS pos, sum(1 - y) AS neg FROM pr GROUP BY 1, 2),
r AS (SELECT event_type, score,
             sum(pos) OVER (PARTITION BY event_type ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(neg) OVER (PARTITION BY event_type ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
             sum(pos) OVER (PARTITION BY event_type) AS pp FROM g),
f AS (SELECT event_type, score, tp / (tp + fp) AS prec, tp / pp AS rec FROM r),
f2 AS (SELECT event_type, score, 2 * prec * rec / (prec + rec + {D(1e-8)}) AS f1 FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY f1 DESC NULLS LAST, score ASC) AS rn FROM f2)
SELECT event_type, {R6('score')} AS threshold, {R6('f1')} AS f1 FROM b WHERE rn = 1""",
    "multiclass_metrics": f"""
WITH e AS (SELECT vec_id, CAST(label AS BIGINT) AS y,
                  list_transform(embedding[1:10], lambda x: exp(CAST(x AS DOUBLE))) AS ex FROM embeddings),
p AS (SELECT vec_id, y, list_transform(ex, lambda v: v / list_reduce(ex, lambda a, b: a + b)) AS probs FROM e),
pr AS (SELECT vec_id, y, probs, CAST(list_position(probs, list_max(probs)) - 1 AS BIGINT) AS pred FROM p),
cm AS (SELECT y, pred, count(*) AS n FROM pr GROUP BY 1, 2),
t AS (SELECT y AS cls, sum(CASE WHEN y = pred THEN n ELSE 0 END) AS tp, sum(n) AS nt FROM cm GROUP BY 1),
q AS (SELECT pred AS cls, sum(n) AS np FROM cm GROUP BY 1),
per AS (SELECT coalesce(tp, 0) AS tp, coalesce(nt, 0) AS nt, coalesce(np, 0) AS np
        FROM t FULL OUTER JOIN q ON t.cls = q.cls),
f1 AS (SELECT avg(CASE WHEN nt + np > 0 THEN 2.0 * tp / (nt + np) ELSE 0.0 END) AS f1 FROM per),
acc AS (SELECT avg(CAST(y = pred AS DOUBLE)) AS accuracy FROM pr),
ex AS (SELECT CAST(y = i - 1 AS BIGINT) AS is_c, i - 1 AS cls, probs[i] AS s
       FROM pr, (SELECT unnest(generate_series(1, 10)) AS i) gi),
g AS (SELECT cls, s, sum(is_c) AS pos, sum(1 - is_c) AS neg FROM ex GROUP BY 1, 2),
c AS (SELECT cls, pos, neg, coalesce(sum(neg) OVER (PARTITION BY cls ORDER BY s
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
au AS (SELECT cls, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
             THEN sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) END AS auc FROM c GROUP BY cls)
SELECT {R6('f1')} AS f1, {R6('accuracy')} AS accuracy, {R6('(SELECT avg(auc) FROM au)')} AS roc_auc
FROM f1, acc""",
    "average_metrics": f"""
WITH r AS ({_binary_report_sql('user_id')}),
l AS (SELECT 'f1' AS metric, f1 AS value FROM r UNION ALL SELECT 'accuracy', accuracy FROM r
      UNION ALL SELECT 'roc_auc', roc_auc FROM r)
SELECT 'all' AS split, metric, round_even(avg(value), 4) AS value, count(*) AS n_runs FROM l GROUP BY metric""",
    "best_run": f"""
WITH r AS ({_binary_report_sql('user_id')})
SELECT user_id, {R6('accuracy')} AS accuracy, {R6('f1')} AS f1 FROM r
ORDER BY accuracy DESC, user_id ASC LIMIT 1""",
    "norm_stats": f"""
WITH n AS (SELECT CAST(label AS BIGINT) AS label,
                  sqrt(list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)),
                                   lambda a, b: a + b)) AS nrm FROM embeddings)
SELECT label, {R6('quantile_cont(nrm, 0.5)')} AS p50, {R6('avg(nrm)')} AS mean, {R6('stddev_pop(nrm)')} AS std,
       {R6('max(nrm)')} AS max, {R6('min(nrm)')} AS min FROM n GROUP BY label""",
    "loss_rollup": f"""
WITH log AS (SELECT event_id AS k, value AS loss, 1 + user_id % 5 AS n FROM events),
g AS (SELECT CAST(floor((k + 1) / 10) AS BIGINT) AS w, sum(loss * n) / sum(n) AS m, max(k) AS last
      FROM log GROUP BY 1)
SELECT CAST((w + 1) * 10 AS BIGINT) AS step, {R6('round_even(m, 3)')} AS loss FROM g WHERE last >= w * 10 + 8""",
    "gaussian_kl": f"""
WITH sp AS {SPLIT_FX3},
m AS (SELECT split, avg(value) AS m_v, ln(var_pop(value)) AS lv_v, avg(user_id) AS m_u,
             ln(var_pop(user_id)) AS lv_u FROM sp GROUP BY split),
a AS (SELECT * FROM m WHERE split = 'train'), b AS (SELECT * FROM m WHERE split = 'test')
SELECT 'value' AS col, {R6('0.5 * (-1.0 + b.lv_v - a.lv_v + exp(a.lv_v - b.lv_v) + (a.m_v - b.m_v) * (a.m_v - b.m_v) * exp(-b.lv_v))')} AS kl FROM a, b
UNION ALL
SELECT 'user_id', {R6('0.5 * (-1.0 + b.lv_u - a.lv_u + exp(a.lv_u - b.lv_u) + (a.m_u - b.m_u) * (a.m_u - b.m_u) * exp(-b.lv_u))')} FROM a, b""",
    "log_likelihood": f"""
WITH {_fx3_features_cte()},
t AS (SELECT event_type, f0 AS x, avg(f0) OVER (PARTITION BY event_type) AS mu,
             ln(stddev_pop(f0) OVER (PARTITION BY event_type)) AS ls FROM enc),
c AS (SELECT event_type, x, exp(-ls) * (x - mu + 1.0 / 255.0) AS pin, exp(-ls) * (x - mu - 1.0 / 255.0) AS min_in FROM t),
dd AS (SELECT event_type, x,
             0.5 * (1.0 + tanh(sqrt(2.0 / pi()) * (pin + 0.044715 * pow(pin, 3)))) AS cp,
             0.5 * (1.0 + tanh(sqrt(2.0 / pi()) * (min_in + 0.044715 * pow(min_in, 3)))) AS cm FROM c),
l AS (SELECT event_type, CASE WHEN x < -0.999 THEN ln(greatest(cp, 1e-12))
                             WHEN x > 0.999 THEN ln(greatest(1.0 - cm, 1e-12))
                             ELSE ln(greatest(cp - cm, 1e-12)) END AS ll FROM dd)
SELECT event_type, {R6('avg(ll)')} AS mean_log_likelihood, count(*) AS n FROM l GROUP BY event_type""",
})


def R4(x: str) -> str:
    return f"CAST(floor(CAST({x} AS DOUBLE) * 1e4 + 0.5) / 1e4 AS DOUBLE)"


def _cosbar(t: str) -> str:
    return f"pow(cos(({t} + {D(0.008)}) / {D(1.008)} * {D(__import__('math').pi / 2)}), 2)"


SCHEDULE = f"""
(WITH b AS (SELECT i AS t, least({D(1.0)} - {_cosbar(f'CAST(i + 1 AS DOUBLE) / 500')} / {_cosbar('CAST(i AS DOUBLE) / 500')},
                           {D(0.999)}) AS beta FROM range(0, 500) r(i)),
 a AS (SELECT t, beta, 1.0 - beta AS alpha FROM b),
 c AS (SELECT t, beta, alpha, product(alpha) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ab
       FROM a),
 d AS (SELECT *, coalesce(lag(ab, 1) OVER (ORDER BY t), 1.0) AS ab_prev FROM c),
 e AS (SELECT *, beta * (1.0 - ab_prev) / (1.0 - ab) AS pv FROM d)
 SELECT t, beta, alpha, ab, ab_prev, sqrt(ab) AS sab, sqrt(1.0 - ab) AS s1mab,
        sqrt(1.0 / ab) AS srab, sqrt(1.0 / ab - 1.0) AS srm1ab, pv,
        beta * sqrt(ab_prev) / (1.0 - ab) AS coef1, (1.0 - ab_prev) * sqrt(alpha) / (1.0 - ab) AS coef2,
        ln(CASE WHEN t = 0 THEN lead(pv, 1) OVER (ORDER BY t) ELSE beta END) AS mlv
 FROM e)"""


def _draws_sql(seed: int, k: int, tdraw: str | None = None) -> str:
    """Forward draws over encoded FX3: one row per (event, draw) with t, noise n_j, x_t xt_j."""
    t = tdraw or f"CAST(floor({U(seed, 'event_id', 'draw', chr(39) + 't' + chr(39))} * 500) AS BIGINT)"
    noise = [f"{g} AS n{j}" for j, g in enumerate(GAUSS_VEC(seed, 5, 'event_id', 'draw'))]
    xt = [f"s.sab * f{j} + s.s1mab * n{j} AS xt{j}" for j in range(5)]
    return f"""
WITH {_fx3_features_cte()},
sched AS {SCHEDULE},
ex AS (SELECT enc.*, CAST(dr AS BIGINT) AS draw FROM enc, range(1, {k + 1}) r(dr)),
tt AS (SELECT *, {t} AS t FROM ex),
nz AS (SELECT *, {', '.join(noise)} FROM tt),
dr AS (SELECT nz.*, s.ab, {', '.join(xt)} FROM nz JOIN sched s ON nz.t = s.t)"""


def _tdraw_sql(seed: int, weights: str) -> str:
    return f"""
WITH w AS ({weights}),
cum AS (SELECT t, sum(p) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM w),
ev AS (SELECT event_id, {U(seed, 'event_id', '1', chr(39) + 't' + chr(39))} AS u FROM events)
SELECT event_id, CAST(least(499, (SELECT count(*) FROM cum WHERE c <= ev.u)) AS BIGINT) AS t FROM ev"""


SNR_WEIGHTS = f"""SELECT t, sqrt(ab * (1.0 - ab)) / sum(sqrt(ab * (1.0 - ab))) OVER () AS p FROM {SCHEDULE}"""
ADA_WEIGHTS = f"""
WITH l AS (SELECT t, ln(ab / (1.0 - ab + {D(1e-8)}) + {D(1e-8)}) AS ls FROM {SCHEDULE}),
m AS (SELECT t, ls, avg(ls) OVER () AS mu, stddev_samp(ls) OVER () AS sd FROM l),
w AS (SELECT t, exp(-pow(ls - mu, 2) / (2.0 * pow(sd, 2))) AS w FROM m)
SELECT t, w / sum(w) OVER () AS p FROM w"""

_MSE = " + ".join(f"(xt{j} - n{j}) * (xt{j} - n{j})" for j in range(5))

ORACLES.update({
    "forward_noise": _draws_sql(3, 3) + f"""
SELECT event_id, draw, t, {', '.join(R6(f'xt{j}') + f' AS xt_{j}' for j in range(5))},
       {R6('1.0 - ab')} AS q_variance FROM dr""",
    "reverse_step": _draws_sql(3, 3) + f""",
rs AS (SELECT dr.event_id, dr.draw, dr.t, s.coef1, s.coef2, s.srab, s.srm1ab, s.mlv,
              {', '.join(f'xt{j}, n{j}, {g} AS z{j}' for j, g in enumerate(GAUSS_VEC(4, 5, "dr.event_id", "dr.draw")))}
       FROM dr JOIN sched s ON dr.t = s.t)
SELECT event_id, draw, t, {', '.join(R4(f"coef1 * (srab * xt{j} - srm1ab * n{j}) + coef2 * xt{j} + (CASE WHEN t <> 0 THEN exp(0.5 * mlv) ELSE 0.0 END) * z{j}") + f' AS xp_{j}' for j in range(5))}
FROM rs""",
    "timestep_draws_snr": _tdraw_sql(6, SNR_WEIGHTS),
    "timestep_draws_ada": _tdraw_sql(8, ADA_WEIGHTS),
    "importance_weights": _draws_sql(3, 3) + f""",
h AS (SELECT t, avg(({_MSE}) / 5) AS loss, count(*) AS cnt FROM dr GROUP BY t),
j AS (SELECT s.t, h.loss, coalesce(h.cnt, 0) AS cnt FROM sched s LEFT JOIN h ON s.t = h.t),
l AS (SELECT t, cnt, sqrt(coalesce(loss, 0.0) + {D(1e-10)}) + {D(1e-4)} AS lt FROM j),
l2 AS (SELECT t, CASE WHEN min(cnt) OVER () > 10 THEN
                   CASE WHEN t = 0 THEN max(CASE WHEN t = 1 THEN lt END) OVER () ELSE lt END ELSE 1.0 END AS w FROM l)
SELECT t, {R6('w / sum(w) OVER ()')} AS p FROM l2""",
    "poisson_sample": f"SELECT event_id FROM events WHERE {U(9, 'event_id', '5', chr(39) + 'poisson' + chr(39))} < {D(0.3)}",
    "minibatches": f"""
SELECT event_id, CAST((row_number() OVER (ORDER BY {U(9, 'event_id', '2', chr(39) + 'batch' + chr(39))}, event_id) - 1) // 128
       AS BIGINT) AS batch FROM events""",
    "exactly_n": f"""
WITH a AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rk FROM events WHERE {U(13, 'event_id')} < {D(0.7)})
SELECT event_id FROM a WHERE rk <= (SELECT count(*) // 2 FROM events)""",
    "knn_join": f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbor, list_distance(a.v, b.v) AS dist FROM e a, e b WHERE a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbor) AS rank FROM d)
SELECT vec_id, neighbor, CAST(rank AS BIGINT) AS rank, {R6('dist')} AS dist FROM k WHERE rank <= 5""",
    "knn_classify": f"""
WITH e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
           FROM embeddings),
d AS (SELECT a.vec_id, b.label, list_distance(a.v, b.v) AS dist, b.vec_id AS nb FROM e a, e b WHERE a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nb) AS rank FROM d),
t AS (SELECT *, min(dist) OVER (PARTITION BY vec_id) AS dmin FROM k WHERE rank <= 5),
w AS (SELECT vec_id, label, sum(CASE WHEN dmin = 0 THEN CAST(dist = 0 AS DOUBLE) ELSE 1.0 / dist END) AS w
      FROM t GROUP BY vec_id, label),
p AS (SELECT vec_id, label, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM w),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS rn FROM p)
SELECT vec_id, label AS pred, {R6('p')} AS p_pred FROM b WHERE rn = 1""",
})


ORACLES.update({
    "encoder_save_load": ENCODE_FX1,
    "streaming_encode": f"""
WITH {_fx3_features_cte()}
SELECT event_id, label, f0 AS num_0, f1 AS num_1, f2 AS cat_0, f3 AS cat_1, f4 AS cat_2 FROM enc""",
    "training_view": f"""
WITH e AS ({ENCODE_FX1}),
l AS ({' UNION ALL '.join(f"SELECT {i} AS pos, CAST(CAST({c} AS FLOAT) AS DOUBLE) AS x FROM e" for i, c in enumerate(['num_0', 'num_1', 'num_2', 'num_3', 'cat_0', 'cat_1', 'cat_2', 'cat_3', 'cat_4']))})
SELECT CAST(pos AS BIGINT) AS pos, {R6('avg(x)')} AS mean FROM l GROUP BY pos""",
})


ORACLES.update({
    "layout": f"""
WITH fx AS {FX2},
n AS (SELECT 'o_orderpriority' AS col, 1 AS pos, count(DISTINCT o_orderpriority) AS width FROM fx
      UNION ALL SELECT 'c_mktsegment', 2, count(DISTINCT c_mktsegment) FROM fx
      UNION ALL SELECT 'c_nation', 3, count(DISTINCT c_nation) FROM fx),
o AS (SELECT col, width, 2 + coalesce(sum(width) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS "offset" FROM n),
b AS (SELECT 'o_orderpriority' AS col, count(o_orderpriority) AS s FROM fx
      UNION ALL SELECT 'c_mktsegment', count(c_mktsegment) FROM fx
      UNION ALL SELECT 'c_nation', count(c_nation) FROM fx)
SELECT o.col, CAST(o."offset" AS BIGINT) AS "offset", CAST(o.width AS BIGINT) AS width, CAST(b.s AS DOUBLE) AS block_sum
FROM o JOIN b ON o.col = b.col""",
    "drop_nan_rows": "SELECT event_id, CAST(value > 50 AS INTEGER) AS label FROM events WHERE event_id % 23 <> 0",
    "profile_roundtrip": ORACLES["split_profile"],
    "metrics_roundtrip": f"""
WITH m AS (SELECT event_type, {R6('f1')} AS f1, {R6('accuracy')} AS accuracy, {R6('roc_auc')} AS roc_auc
           FROM ({_binary_report_sql('event_type')}))
SELECT event_type, 'f1' AS metric, f1 AS value FROM m UNION ALL SELECT event_type, 'accuracy', accuracy FROM m
UNION ALL SELECT event_type, 'roc_auc', roc_auc FROM m""",
})


def _quantile_uniform_sql(kind: str = "FLOAT") -> str:
    """Knots exactly as fitted (linear interpolation between order statistics,
    Spark's form), then numpy-interp semantics forward and backward."""
    knots = []
    for c in ("value", "user_id"):
        knots.append(f"""
(WITH v AS (SELECT CAST({c} AS DOUBLE) AS x, row_number() OVER (ORDER BY {c}) - 1 AS pos FROM events
            WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))),
 n AS (SELECT count(*) AS n FROM v),
 nq AS (SELECT least(greatest(least(n // 30, 1000), 10), n) AS nq, n FROM n),
 r AS (SELECT i AS idx, CASE WHEN i = nq - 1 THEN 1.0 ELSE i * (1.0 / (nq - 1)) + 0.0 END AS ref, n, nq
       FROM nq, range(0, nq) t(i)),
 h AS (SELECT idx, ref, nq, ref * (n - 1) AS h, CAST(floor(ref * (n - 1)) AS BIGINT) AS lo,
              CAST(ceil(ref * (n - 1)) AS BIGINT) AS hi FROM r)
 SELECT '{c}' AS col, idx, nq AS m, ref AS r,
        CASE WHEN h.hi = h.lo THEN a.x ELSE (h.hi - h.h) * a.x + (h.h - h.lo) * b.x END AS q
 FROM h JOIN v a ON a.pos = h.lo JOIN v b ON b.pos = h.hi)""")
    cols = []
    for i, c in enumerate(("value", "user_id")):
        x = f"CAST(e.{c} AS DOUBLE)"
        k = f"(SELECT * FROM kn WHERE col = '{c}')"
        cle = f"(SELECT count(*) FROM kn WHERE col = '{c}' AND q <= {x})"
        clt = f"(SELECT count(*) FROM kn WHERE col = '{c}' AND q < {x})"
        cols.append(f"""
  (SELECT CAST(CAST(
     CASE WHEN {x} - 1e-7 < k0.q THEN 0.0 WHEN {x} + 1e-7 > kl.q THEN 1.0 ELSE 0.5 * (
       (CASE WHEN f.j < 0 THEN 0.0 WHEN f.j >= kl.idx OR {x} = kl.q THEN 1.0 WHEN {x} = f.qj THEN f.rj
             ELSE ((f.rj1 - f.rj) / (f.qj1 - f.qj)) * ({x} - f.qj) + f.rj END)
       - (CASE WHEN g.b >= kl.idx + 1 THEN -1.0 WHEN g.b = 0 OR {x} = k0.q THEN -0.0 WHEN {x} = g.qb THEN -g.rb
               ELSE ((g.rb - g.ra) / (g.qb - g.qa)) * (g.qb - {x}) - g.rb END)) END
   AS {kind}) AS DOUBLE)
   FROM (SELECT * FROM {k} WHERE idx = 0) k0,
        (SELECT * FROM {k} WHERE idx = m - 1) kl,
        (SELECT {cle} - 1 AS j, max(CASE WHEN idx = {cle} - 1 THEN q END) AS qj,
                max(CASE WHEN idx = {cle} - 1 THEN r END) AS rj, max(CASE WHEN idx = {cle} THEN q END) AS qj1,
                max(CASE WHEN idx = {cle} THEN r END) AS rj1 FROM {k}) f,
        (SELECT {clt} AS b, max(CASE WHEN idx = {clt} THEN q END) AS qb, max(CASE WHEN idx = {clt} THEN r END) AS rb,
                max(CASE WHEN idx = {clt} - 1 THEN q END) AS qa, max(CASE WHEN idx = {clt} - 1 THEN r END) AS ra
         FROM {k}) g) AS num_{i}""")
    return f"""
WITH kn AS ({' UNION ALL '.join(knots)})
SELECT e.event_id, {', '.join(cols)}
FROM events e"""


ORACLES["quantile_encode_uniform"] = _quantile_uniform_sql()


def _normal_quantile_sql(p: str) -> str:
    """AS 241 with the same coefficients, clipped as the encoder clips."""
    from .functions import normal as nm

    def horner(coefs, x):
        out = D(coefs[-1])
        for c in reversed(coefs[:-1]):
            out = f"({out} * {x} + {D(c)})"
        return out
    q, r = f"({p} - 0.5)", f"({D(0.180625)} - ({p} - 0.5) * ({p} - 0.5))"
    t = f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1.0 - {p} END))"
    near, far = f"({t} - {D(1.6)})", f"({t} - {D(5)})"
    size = (f"(CASE WHEN {t} <= 5 THEN {horner(nm._C, near)} / {horner(nm._D, near)}"
            f" ELSE {horner(nm._E, far)} / {horner(nm._F, far)} END)")
    return (f"least(greatest(CASE WHEN {p} <= 0 THEN {D(nm.CLIP_MIN)} WHEN {p} >= 1 THEN {D(nm.CLIP_MAX)}"
            f" WHEN abs({q}) <= 0.425 THEN {q} * {horner(nm._A, r)} / {horner(nm._B, r)}"
            f" ELSE CASE WHEN {q} < 0 THEN -{size} ELSE {size} END END, {D(nm.CLIP_MIN)}), {D(nm.CLIP_MAX)})")


def _target_stats_sql() -> str:
    stats = []
    for c in ("lang", "source"):
        w = f"OVER (PARTITION BY {c} ORDER BY u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        stats.append(R6(f"(coalesce(sum(y) {w}, 0) + prior) / (count(*) {w} + 1.0)") + f" AS {c}_stat")
    return f"""
WITH d AS (SELECT d.doc_id, d.lang, d.source, CAST(l.quality = 1 AS BIGINT) AS y, {U(3, 'd.doc_id', "'order'")} AS u
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL),
e AS (SELECT *, avg(y) OVER () AS prior FROM d)
SELECT doc_id, {', '.join(stats)} FROM e"""


_REPORT_ROWS = f"""(WITH p AS {PRED_FX3},
 s AS (SELECT y, CASE event_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, least(score, 1.0) AS s FROM p)
 SELECT 'a|' || split AS ms, y, s AS score FROM s UNION ALL SELECT 'b|' || split, y, {D(1)} - s * s FROM s)"""

_SPARSE_ROWS = f"""(SELECT event_id, user_id, CASE WHEN user_id % 3 <> 0 THEN y ELSE 0 END AS y, score FROM {PRED_FX3})"""

_SAT_ROWS = """(SELECT event_id, CAST(user_id % 250 - 125 AS BIGINT) AS t,
  CASE WHEN event_id % 5 <> 0 THEN value > 50 END AS flag FROM events)"""

ORACLES.update({
    "quantile_encode_normal": f"""
SELECT event_id, {', '.join(R6(f'CAST(CAST({_normal_quantile_sql(f"num_{i}")} AS FLOAT) AS DOUBLE)') + f' AS num_{i}' for i in (0, 1))}
FROM ({_quantile_uniform_sql('DOUBLE')})""",
    "group_quantiles": f"""
SELECT user_id, count(value) AS n, {', '.join(R6(f'quantile_cont(value, {q})') + f' AS p{k}' for q, k in ((0.1, 10), (0.5, 50), (0.9, 90)))}
FROM events GROUP BY user_id""",
    "running_totals": """
WITH e AS (SELECT event_id, value, user_id, CASE event_id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN event_type END AS g FROM events)
SELECT event_id, g, row_number() OVER w AS rank,
       CAST(sum(user_id) OVER (PARTITION BY g ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS users
FROM e WINDOW w AS (PARTITION BY g ORDER BY value, event_id)""",
    "ordered_target_stats": _target_stats_sql(),
    "evaluation_report": f"""
WITH r AS ({_binary_report_sql('ms').replace(PRED_FX3, _REPORT_ROWS)})
SELECT split_part(ms, '|', 1) AS model, split_part(ms, '|', 2) AS split, metric, {R6('value')} AS value FROM (
  SELECT ms, 'f1' AS metric, f1 AS value FROM r UNION ALL SELECT ms, 'accuracy', accuracy FROM r
  UNION ALL SELECT ms, 'roc_auc', roc_auc FROM r)""",
    "knn_join_cells": ORACLES["knn_join"],
    "label_codes": """
WITH o AS (SELECT CAST(o_custkey % 37 * 3 AS INTEGER) AS y FROM orders),
c AS (SELECT y, count(*) AS n FROM o GROUP BY y)
SELECT y, row_number() OVER (ORDER BY y) - 1 AS least, row_number() OVER (ORDER BY y) - 1 AS most, n FROM c""",
    "decode_saturating": f"""
WITH e AS {_SAT_ROWS}, p AS (SELECT {D(2)} / (max(t) - min(t)) AS s, {D(-1)} - min(t) * ({D(2)} / (max(t) - min(t))) AS o FROM e),
x AS (SELECT event_id, flag, (CAST(CAST(CAST(t AS DOUBLE) * s + o AS FLOAT) AS DOUBLE) * {D(3)} - o) / s AS v FROM e, p)
SELECT event_id, CAST(least(greatest(round_even(v, 0), -128), 127) AS INTEGER) AS t, flag FROM x""",
    "split_keys_null": """
WITH e AS (SELECT CASE WHEN user_id % 7 <> 0 THEN user_id END AS k, value FROM events)
SELECT k, CASE WHEN bool_or(value > 95) THEN 'allowed' ELSE 'rejected' END AS part FROM e GROUP BY k""",
    "threshold_sparse": ORACLES["best_threshold"].replace(PRED_FX3, _SPARSE_ROWS).replace("event_type", "user_id")
    .replace("tp / pp AS rec", "CASE WHEN pp > 0 THEN tp / pp END AS rec")
    .replace(f"{R6('score')} AS threshold", R6("CASE WHEN f1 IS NOT NULL THEN score END") + " AS threshold"),
})
