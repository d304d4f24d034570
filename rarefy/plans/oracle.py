"""DuckDB twins of the registered queries (ANSI SQL over the driver's views).

Shared CTE fragments rebuild the fixtures of FIXTURES.md from ``events``;
each query appends its own final SELECT.  Column names and types match the
Spark results (counts BIGINT, flags INTEGER, measures DOUBLE rounded the
same way).
"""

from __future__ import annotations

from ..functions.hashing import hash_uniform_sql as U
from . import catalog as C


def _d(x) -> str:
    return f"{x!r}::DOUBLE"


H6 = 6 * 3600 * 1000 * 1000
H24 = 24 * 3600 * 1000 * 1000

CTE = {}
CTE["ev"] = f"""ev AS (
  SELECT event_id, user_id, value, event_type, ts,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         hour(ts) AS hr, epoch_us(ts) AS t_us,
         {U("'label:'", "event_id")} AS u
  FROM events)"""
CTE["transactions"] = f"""transactions AS (
  SELECT event_id AS idn,
    CASE WHEN k < 60 THEN 1 WHEN k < 90 THEN 2 ELSE 3 END AS resp_code,
    CASE WHEN event_type = 'signup' THEN 0
         WHEN u < ({_d(0.02)}
                   + CASE WHEN event_type = 'purchase' AND value >= 50 THEN {_d(0.35)} ELSE {_d(0.0)} END)
                   + CASE WHEN hr < 6 THEN {_d(0.08)} ELSE {_d(0.0)} END THEN 1
         ELSE -1 END AS label,
    value AS monto,
    CAST(event_type = 'purchase' AS INTEGER) AS is_purchase,
    CAST(event_type = 'click' AS INTEGER) AS is_click,
    CAST(event_type = 'view' AS INTEGER) AS is_view,
    CAST(dayofweek(ts) IN (0, 6) AS INTEGER) AS fds,
    CAST(hr < 6 AS INTEGER) AS madr,
    CAST(hr >= 6 AND hr < 12 AS INTEGER) AS morn,
    CAST(hr >= 12 AND hr < 18 AS INTEGER) AS tard,
    CAST(hr >= 18 AS INTEGER) AS noch,
    count(*) OVER (PARTITION BY user_id ORDER BY t_us
                   RANGE BETWEEN {H6} PRECEDING AND CURRENT ROW) AS cuenta_monto_user_6h,
    count(*) OVER (PARTITION BY user_id ORDER BY t_us
                   RANGE BETWEEN {H24} PRECEDING AND CURRENT ROW) AS cuenta_monto_user_24h,
    round(avg(value) OVER (PARTITION BY user_id ORDER BY t_us
                   RANGE BETWEEN {H24} PRECEDING AND CURRENT ROW), 6) AS pro_monto_user_24h
  FROM ev)"""
CTE["labelled"] = """labelled AS (
  SELECT * FROM transactions WHERE label <> 0 AND resp_code IN (1, 2))"""
CTE["train"] = f"""train AS (
  SELECT * FROM labelled WHERE {U("'split:'", f"'{C.SPLIT_SEED}'", "':'", "idn")} < {_d(C.TRAIN)})"""
CTE["votes"] = f"""votes AS (
  SELECT l.idn, l.label, v.tree,
         CAST(least(10, greatest(0, floor(11 * {U("'vote:'", "v.tree", "':'", "l.idn")}) + l.label))
              AS DOUBLE) / 10.0 AS p1
  FROM labelled l, range(0, {9}) v(tree))"""
CTE["logs"] = """logs AS (
  SELECT idn, label, count(*) AS n,
         CAST(count(*) FILTER (WHERE p1 > 0.5) AS INTEGER) AS n_votes,
         sum(ln(CASE WHEN p1 = 0 THEN 1e-13 ELSE p1 END)) AS l1,
         sum(ln(CASE WHEN 1.0 - p1 = 0 THEN 1e-13 ELSE 1.0 - p1 END)) AS l0,
         avg(p1) AS m1
  FROM votes GROUP BY idn, label)"""
CTE["scored"] = """scored AS (
  SELECT idn, label,
         1.0 / (1.0 + exp(l1 - l0)) AS p0,
         1.0 / (1.0 + exp(l0 - l1)) AS p1,
         CASE WHEN 1.0 / (1.0 + exp(l0 - l1)) > 1.0 / (1.0 + exp(l1 - l0))
                   OR n_votes > n - n_votes THEN 1 ELSE -1 END AS predicted_label
  FROM logs)"""
CTE["lrs"] = """lrs AS (
  SELECT idn, label, p0, p1, CAST(label = 1 AS INTEGER) AS flag,
         round(CASE WHEN p1 = 0 AND p0 = 0 THEN NULL
                    WHEN p1 = 0 THEN ln(1e-13 / p0)
                    WHEN p0 = 0 THEN ln(p1 / 1e-13)
                    ELSE ln(p1 / p0) END, 9) AS lr
  FROM scored)"""

ORDER = ["ev", "transactions", "labelled", "train", "votes", "logs", "scored", "lrs"]
NEEDS = {"ev": [], "transactions": ["ev"], "labelled": ["transactions"], "train": ["labelled"],
         "votes": ["labelled"], "logs": ["votes"], "scored": ["logs"], "lrs": ["scored"]}


def with_(*names: str, extra: str = "") -> str:
    need: set[str] = set()

    def add(n):
        if n not in need:
            need.add(n)
            for m in NEEDS[n]:
                add(m)
    for n in names:
        add(n)
    parts = [CTE[n] for n in ORDER if n in need]
    if extra:
        parts.append(extra)
    head = "WITH RECURSIVE " if "cdf_rec(" in extra else "WITH "
    return head + ",\n".join(parts) + "\n"


FEATURES = ["monto", "is_purchase", "is_click", "is_view", "fds", "madr", "morn", "tard", "noch",
            "cuenta_monto_user_6h", "cuenta_monto_user_24h", "pro_monto_user_24h"]
TX_COLS = ["idn", "resp_code", "label"] + FEATURES


def _arity_sql() -> str:
    unions = []
    for i, c in enumerate(FEATURES):
        unions.append(f"""SELECT {i} AS feature_index, '{c}' AS feature,
  CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value,
  count(*) FILTER (WHERE CAST({c} AS DOUBLE) <> (SELECT CAST(min({c}) AS DOUBLE) FROM labelled)
                     AND CAST({c} AS DOUBLE) <> (SELECT CAST(max({c}) AS DOUBLE) FROM labelled)) AS others
FROM labelled""")
    body = "\nUNION ALL\n".join(unions)
    return with_("labelled", extra=f"ar AS ({body})") + """
SELECT feature_index, feature, min_value, max_value,
  CAST(CASE WHEN min_value IS NULL THEN 0 WHEN others > 0 THEN NULL
            WHEN min_value = max_value THEN 1 ELSE 2 END AS INTEGER) AS arity,
  coalesce(CASE WHEN min_value IS NULL THEN 0 WHEN others > 0 THEN NULL
            WHEN min_value = max_value THEN 1 ELSE 2 END <= 2, false) AS categorical
FROM ar"""


def _plan_cte(src: str = "train") -> str:
    return f"""plan AS (
  SELECT n_minor, n_major, CAST(n_minor AS DOUBLE) / CAST(n_major AS DOUBLE) AS fraction,
         CAST(CASE WHEN n_minor > 0 THEN n_major // n_minor END AS BIGINT) AS ratio,
         CAST(CASE WHEN n_minor > 0 THEN n_major // n_minor END + 1
              - (CASE WHEN n_minor > 0 THEN n_major // n_minor END) % 2 AS BIGINT) AS n_trees
  FROM (SELECT count(*) FILTER (WHERE label = 1) AS n_minor,
               count(*) FILTER (WHERE label <> 1) AS n_major FROM {src}))"""


def _boot_ctes(src: str = "train", seed: str = C.BOOT_SEED) -> str:
    """Bootstrap: Poisson(T*f) total by inverse CDF, copies to uniform trees.

    One Poisson draw, as for means of at most 256 (here T*f is about 1).
    """
    return _plan_cte(src) + f""",
lam AS (SELECT n_trees * fraction AS lam, n_trees,
               CAST(ceil(n_trees * fraction + 12.0 * sqrt(n_trees * fraction) + 30.0) AS INTEGER) AS kmax
        FROM plan),
cdf_rec(k, pmf, cdf) AS (
  SELECT 0, exp(-lam), exp(-lam) FROM lam
  UNION ALL
  SELECT c.k + 1, c.pmf * l.lam / (c.k + 1), c.cdf + c.pmf * l.lam / (c.k + 1)
  FROM cdf_rec c, lam l WHERE c.k + 1 <= l.kmax),
maj AS (
  SELECT idn, label,
         (SELECT count(*) FROM cdf_rec WHERE cdf <= {U("'boot:'", f"'{seed}'", "':'", "s.idn")}) AS total
  FROM {src} s WHERE label <> 1),
copies AS (
  SELECT m.idn, m.label,
         CAST(floor((SELECT n_trees FROM lam) * {U("'tree:'", f"'{seed}'", "':'", "m.idn", "':'", "j.j")}) AS INTEGER) AS tree
  FROM maj m, LATERAL (SELECT * FROM range(1, m.total + 1) r(j)) j
  WHERE m.total > 0),
weights AS (
  SELECT tree, idn, label, CAST(count(*) AS INTEGER) AS w FROM copies GROUP BY tree, idn, label)"""


def _votes_sql(kind: str) -> str:
    if kind == "soft":
        p0 = "exp(l0) / (exp(l1) + exp(l0))"
        p1 = "exp(l1) / (exp(l1) + exp(l0))"
        lab = f"CASE WHEN ({p1}) > ({p0}) OR n_votes > n - n_votes THEN 1 ELSE -1 END"
    elif kind == "stable":
        p0 = "1.0 / (1.0 + exp(l1 - l0))"
        p1 = "1.0 / (1.0 + exp(l0 - l1))"
        lab = f"CASE WHEN ({p1}) > ({p0}) OR n_votes > n - n_votes THEN 1 ELSE -1 END"
    elif kind == "hard":
        p1 = "CAST(n_votes AS DOUBLE) / n"
        p0 = "CAST(n - n_votes AS DOUBLE) / n"
        lab = f"CASE WHEN ({p1}) > ({p0}) THEN 1 ELSE -1 END"
    else:
        p1 = "m1"
        p0 = "1.0 - m1"
        lab = f"CASE WHEN ({p1}) > ({p0}) THEN 1 ELSE -1 END"
    return with_("logs") + f"""SELECT idn, label, round({p0}, 9) AS p0, round({p1}, 9) AS p1,
  n_votes, {lab} AS predicted_label FROM logs"""


def _confusion_sql() -> str:
    return with_("scored") + """, c AS (
  SELECT count(*) FILTER (WHERE label = 1 AND predicted_label = 1) AS tp,
         count(*) FILTER (WHERE label = 1 AND predicted_label = -1) AS fn,
         count(*) FILTER (WHERE label = -1 AND predicted_label = -1) AS tn,
         count(*) FILTER (WHERE label = -1 AND predicted_label = 1) AS fp
  FROM scored),
r AS (SELECT tp, fn, tn, fp,
        CAST(tp AS DOUBLE) / (tp + fn) * 100.0 AS sens,
        CAST(tn AS DOUBLE) / (fp + tn) * 100.0 AS spc,
        CAST(tp AS DOUBLE) / (tp + fp) * 100.0 AS pre,
        CAST(tp + tn AS DOUBLE) / (tp + fn + fp + tn) * 100.0 AS acc,
        CAST(tp AS DOUBLE) AS dtp, CAST(fn AS DOUBLE) AS dfn,
        CAST(tn AS DOUBLE) AS dtn, CAST(fp AS DOUBLE) AS dfp FROM c)
SELECT tp, fn, tn, fp, round(sens, 9) AS tpr, round(spc, 9) AS spc, round(pre, 9) AS ppv,
  round(acc, 9) AS acc, round(2.0 * pre * sens / (pre + sens), 9) AS f1,
  round(sqrt(sens * spc), 9) AS mgeo,
  round((dtp * dtn - dfn * dfp) / ((dfn + dtp) * (dtn + dfp)), 9) AS pexc,
  round((dtp * dtn - dfp * dfn) / sqrt((dfn + dtp) * (dtn + dfp) * (dfp + dtp) * (dfn + dtn)), 9) AS mcc
FROM r"""


def _roc_groups(score: str) -> str:
    return f"""g AS (
  SELECT {score} AS score, count(*) FILTER (WHERE label = 1) AS tp,
         count(*) FILTER (WHERE label <> 1) AS fp
  FROM scored GROUP BY {score}),
cum AS (
  SELECT score, tp, fp,
         row_number() OVER (ORDER BY score DESC) AS pos,
         sum(tp) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctp,
         sum(fp) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cfp
  FROM g)"""


def _roc_sql(score: str) -> str:
    return with_("scored", extra=_roc_groups(score)) + """
SELECT CAST(pos AS BIGINT) AS pos,
       round(CAST(cfp AS DOUBLE) / (SELECT sum(fp) FROM g), 9) AS fpr,
       round(CAST(ctp AS DOUBLE) / (SELECT sum(tp) FROM g), 9) AS tpr FROM cum
UNION ALL SELECT CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE
UNION ALL SELECT CAST((SELECT count(*) FROM g) + 1 AS BIGINT), 1.0::DOUBLE, 1.0::DOUBLE"""


def _auc_sql(score: str) -> str:
    return with_("scored", extra=_roc_groups(score)) + """
SELECT round(CAST(sum(CAST(fp AS HUGEINT) * (2 * ctp - tp)) AS DOUBLE)
             / (2.0 * CAST(sum(tp) AS DOUBLE) * CAST(sum(fp) AS DOUBLE)), 9) AS auc FROM cum"""


def _kde_sql() -> str:
    lo, hi = C.AXIS
    return with_("lrs") + f""", bw AS (
  SELECT flag, count(lr) AS n, stddev_pop(lr) AS sd,
         stddev_pop(lr) * pow(4.0 / (3.0 * count(lr)), 0.2) AS h
  FROM lrs WHERE lr IS NOT NULL GROUP BY flag),
grp AS (SELECT flag, lr AS s, count(*) AS cnt FROM lrs WHERE lr IS NOT NULL GROUP BY flag, lr),
ax AS (SELECT i - {2 * lo} AS i, CAST(i AS DOUBLE) * 0.5 AS x FROM range({2 * lo}, {2 * hi + 1}) t(i)),
k AS (
  SELECT g.flag, a.i, a.x, sum(g.cnt * exp(-pow((a.x - g.s) / b.h, 2.0) / 2.0)) AS k,
         any_value(b.n) AS n, any_value(b.h) AS h
  FROM grp g JOIN bw b ON g.flag = b.flag, ax a
  GROUP BY g.flag, a.i, a.x)
SELECT round({lo}.0 + CAST(i AS DOUBLE) * 0.5, 1) AS x,
       round(CASE WHEN h > 0 THEN k / (n * h * sqrt(2.0 * pi())) END, 8) AS y,
       CASE WHEN flag = 1 THEN 'Fraude' ELSE 'Legal' END AS type
FROM k"""


def _eer_sql(mode: str) -> str:
    if mode == "standard":
        body = """cnt AS (SELECT count(*) FILTER (WHERE flag = 1) AS nf_all,
                    count(*) FILTER (WHERE flag = 0) AS nl_all FROM lrs WHERE lr IS NOT NULL),
g AS (SELECT lr, count(*) FILTER (WHERE flag = 1) AS nf, count(*) FILTER (WHERE flag = 0) AS nl
      FROM lrs WHERE lr IS NOT NULL GROUP BY lr),
cum AS (SELECT lr, row_number() OVER (ORDER BY lr) AS pos,
          sum(nf) OVER (ORDER BY lr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cf,
          sum(nl) OVER (ORDER BY lr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cl
        FROM g),
obj AS (SELECT c.lr, c.pos,
          abs(CAST(c.cf AS HUGEINT) * n.nl_all - CAST(n.nl_all - c.cl AS HUGEINT) * n.nf_all) AS gap,
          CAST(n.nl_all - c.cl AS DOUBLE) / n.nl_all AS pfa, n.nf_all, n.nl_all
        FROM cum c, cnt n)"""
    else:
        body = """cnt AS (SELECT count(*) FILTER (WHERE flag = 1) AS nf_all,
                    count(*) FILTER (WHERE flag = 0) AS nl_all FROM lrs WHERE lr IS NOT NULL),
cum AS (SELECT lr, row_number() OVER (ORDER BY lr, flag DESC, idn) AS pos,
          sum(flag) OVER (ORDER BY lr, flag DESC, idn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cf
        FROM lrs WHERE lr IS NOT NULL),
obj AS (SELECT c.lr, c.pos,
          abs(CAST(c.pos - 1 - c.cf AS HUGEINT) * n.nl_all - CAST(n.nl_all - c.cf AS HUGEINT) * n.nf_all) AS gap,
          CAST(n.nl_all - c.cf AS DOUBLE) / n.nl_all AS pfa, n.nf_all, n.nl_all
        FROM cum c, cnt n)"""
    return with_("lrs", extra=body) + """,
best AS (SELECT * FROM obj WHERE gap = (SELECT min(gap) FROM obj)),
ranked AS (SELECT *, row_number() OVER (ORDER BY pos) AS rk, count(*) OVER () AS c FROM best)
SELECT round(pfa * 100.0, 6) AS eer, lr,
       CASE WHEN CAST(gap AS DOUBLE) / (CAST(nf_all AS DOUBLE) * CAST(nl_all AS DOUBLE)) <= 1e-5
            THEN 1 ELSE 0 END AS state
FROM ranked WHERE rk = (c + 1) // 2"""


def _curves_sql() -> str:
    n = 150
    return with_("lrs") + f""", s AS (SELECT lr AS s, flag FROM lrs WHERE lr IS NOT NULL),
rng AS (SELECT min(s) AS lo, max(s) AS hi, (max(s) - min(s)) / {float(n - 1)} AS w FROM s),
hist AS (
  SELECT flag, CAST(CASE WHEN r.w = 0 THEN {n - 2}
                    ELSE least(floor((s.s - r.lo) / r.w), {n - 2}) END AS INTEGER) AS b,
         count(*) AS c
  FROM s, rng r GROUP BY ALL),
edges AS (SELECT CAST(i AS INTEGER) AS i, f.flag FROM range(0, {n}) t(i), (VALUES (1), (0)) f(flag)),
cum AS (
  SELECT e.i, e.flag,
         sum(coalesce(h.c, 0)) OVER (PARTITION BY e.flag ORDER BY e.i
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM edges e LEFT JOIN hist h ON h.flag = e.flag AND h.b + 1 = e.i)
SELECT c.i,
       round(CASE WHEN c.i = {n - 1} THEN r.hi ELSE r.lo + r.w * c.i END, 9) AS x,
       round(CAST(c.cum AS DOUBLE) / max(c.cum) OVER (PARTITION BY c.flag), 9) AS y,
       CASE WHEN c.flag = 1 THEN 'fraude' ELSE 'legal' END AS type
FROM cum c, rng r"""


def _runs_sql() -> str:
    pairs = ", ".join(f"({r}, {g})" for r in range(1, C.RUNS + 1) for g in range(C.GRID_POINTS))
    u = U("'split:'", "p.run", "':'", "p.grid_id", "':'", "l.idn")
    return with_("labelled") + f"""SELECT p.run, p.grid_id,
  CASE WHEN {u} < {_d(C.TRAIN)} THEN 'train' ELSE 'test' END AS split, l.label,
  count(*) AS n, CAST(sum(l.idn) AS BIGINT) AS id_sum
FROM labelled l, (VALUES {pairs}) p(run, grid_id)
GROUP BY ALL"""


BINARY = ["is_purchase", "is_click", "is_view", "fds", "madr", "morn", "tard", "noch"]


def _gain(kind: str) -> str:
    """Gain of a split with sides (nl, n1l) and (nr, n1r)."""
    def imp(n, n1):
        p1, p0 = f"({n1} / {n})", f"(({n} - {n1}) / {n})"
        if kind == "gini":
            return f"(1.0 - {p1} * {p1} - {p0} * {p0})"
        t = lambda p: f"(CASE WHEN {p} > 0 THEN -{p} * log2({p}) ELSE 0.0 END)"
        return f"({t(p1)} + {t(p0)})"
    n, n1 = "(nl + nr)", "(n1l + n1r)"
    return f"{imp(n, n1)} - nl / {n} * {imp('nl', 'n1l')} - nr / {n} * {imp('nr', 'n1r')}"


def _balanced_ctes(src: str = "train", seed: str = C.BOOT_SEED) -> str:
    return _boot_ctes(src, seed) + f""",
bal AS (
  SELECT CAST(t.tree AS INTEGER) AS tree, 1 AS w, CASE WHEN l.label = 1 THEN 1.0 ELSE 0.0 END AS y, l.*
  FROM {src} l, range(0, (SELECT n_trees FROM plan)) t(tree) WHERE l.label = 1
  UNION ALL
  SELECT wt.tree, wt.w, CASE WHEN l.label = 1 THEN 1.0 ELSE 0.0 END AS y, l.*
  FROM weights wt JOIN {src} l ON l.idn = wt.idn)"""


def _stump_ctes(kind: str, features: dict[str, str] | None = None) -> str:
    """``features``: name -> SQL expression (default: the binary features)."""
    features = features or {c: c for c in BINARY}
    cells = "\nUNION ALL\n".join(f"SELECT tree, w, y, {i} AS fi, CAST({e} AS INTEGER) AS x FROM bal"
                                 for i, e in enumerate(features.values()))
    gain = _gain(kind)
    names = ", ".join(f"'{c}'" for c in features)
    return _balanced_ctes() + f""",
cells AS ({cells}),
sides AS (
  SELECT tree, fi,
    CAST(sum(CASE WHEN x = 0 THEN w ELSE 0 END) AS DOUBLE) AS nl,
    CAST(sum(CASE WHEN x = 0 THEN w * y ELSE 0 END) AS DOUBLE) AS n1l,
    CAST(sum(CASE WHEN x <> 0 THEN w ELSE 0 END) AS DOUBLE) AS nr,
    CAST(sum(CASE WHEN x <> 0 THEN w * y ELSE 0 END) AS DOUBLE) AS n1r
  FROM cells GROUP BY tree, fi),
gains AS (SELECT *, round({gain}, 12) AS gain FROM sides WHERE nl > 0 AND nr > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY gain DESC, fi) AS rk FROM gains),
splits AS (
  SELECT tree, fi AS feature_index, [{names}][fi + 1] AS feature, round(gain, 9) AS gain,
         round(n1l / nl, 9) AS left_p1, round(n1r / nr, 9) AS right_p1
  FROM best WHERE rk = 1 AND gain > 0)"""


def _importances_sql() -> str:
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(BINARY))
    return with_("train", extra=_stump_ctes("gini")) + f""",
per AS (SELECT feature_index, count(*) AS c FROM splits GROUP BY feature_index),
names(feature_index, variable) AS (VALUES {names})
SELECT CAST(n.feature_index AS INTEGER) AS feature_index, n.variable,
       round(coalesce(CAST(p.c AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE) FROM splits), 0.0), 9)
         AS importance
FROM names n LEFT JOIN per p ON p.feature_index = n.feature_index"""


def _depth2_ctes(kind: str, src: str = "train", seed: str = C.BOOT_SEED) -> str:
    """Two levels of every tree, unrolled: ``nodes`` (heap numbering, root 1)."""
    gain = _gain(kind)

    def level(k: int, rows: str) -> str:
        cells = "\nUNION ALL\n".join(
            f"SELECT tree, node, w, y, {i} AS fi, CAST({c} AS INTEGER) AS x FROM {rows}"
            for i, c in enumerate(BINARY))
        return f"""cells{k} AS ({cells}),
sides{k} AS (
  SELECT tree, node, fi,
    CAST(sum(CASE WHEN x = 0 THEN w ELSE 0 END) AS DOUBLE) AS nl,
    CAST(sum(CASE WHEN x = 0 THEN w * y ELSE 0 END) AS DOUBLE) AS n1l,
    CAST(sum(CASE WHEN x <> 0 THEN w ELSE 0 END) AS DOUBLE) AS nr,
    CAST(sum(CASE WHEN x <> 0 THEN w * y ELSE 0 END) AS DOUBLE) AS n1r
  FROM cells{k} GROUP BY tree, node, fi),
best{k} AS (
  SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, fi) AS rk
  FROM (SELECT *, round({gain}, 12) AS gain FROM sides{k} WHERE nl > 0 AND nr > 0)),
split{k} AS (SELECT tree, node, fi, gain FROM best{k} WHERE rk = 1 AND gain > 0)"""

    value = "[" + ", ".join(f"CAST({c} AS INTEGER)" for c in BINARY) + "][s.fi + 1]"
    return _balanced_ctes(src, seed) + f""",
rows0 AS (SELECT *, 1 AS node FROM bal),
{level(0, "rows0")},
rows1 AS (SELECT b.* EXCLUDE (node), 2 * b.node + (CASE WHEN {value} > 0 THEN 1 ELSE 0 END) AS node
          FROM rows0 b JOIN split0 s USING (tree, node)),
{level(1, "rows1")},
rows2 AS (SELECT b.* EXCLUDE (node), 2 * b.node + (CASE WHEN {value} > 0 THEN 1 ELSE 0 END) AS node
          FROM rows1 b JOIN split1 s USING (tree, node)),
nodes AS (
  SELECT tree, node, CAST(floor(log2(node)) AS INTEGER) AS depth, n, n1, n1 / n AS prediction,
         fi IS NULL AS is_leaf, CAST(fi AS INTEGER) AS feature_index, gain
  FROM (SELECT tree, node, CAST(sum(w) AS DOUBLE) AS n, CAST(sum(w * y) AS DOUBLE) AS n1
        FROM (SELECT tree, node, w, y FROM rows0 UNION ALL SELECT tree, node, w, y FROM rows1
              UNION ALL SELECT tree, node, w, y FROM rows2) GROUP BY tree, node)
  LEFT JOIN (SELECT * FROM split0 UNION ALL SELECT * FROM split1) USING (tree, node))"""


def _cut_ctes() -> str:
    """``cuts`` (tree, fi, x below, t, sb): split points of every tree's own weighted rows."""
    cells = "\nUNION ALL\n".join(f"SELECT tree, idn, w, y, {i} AS fi, CAST({e} AS DOUBLE) AS x FROM bal"
                                 for i, e in enumerate(C.CUT_FEATURES.values()))
    m = C.CUT_BINS
    return _balanced_ctes() + f""",
cutcells AS ({cells}),
dist AS (SELECT tree, fi, x, CAST(sum(w) AS DOUBLE) AS w FROM cutcells GROUP BY tree, fi, x),
runs AS (
  SELECT *, sum(w) OVER (PARTITION BY tree, fi ORDER BY x) AS cum, sum(w) OVER (PARTITION BY tree, fi) AS total,
         count(*) OVER (PARTITION BY tree, fi) AS k, lead(x) OVER (PARTITION BY tree, fi ORDER BY x) AS above
  FROM dist),
cuts AS (
  SELECT tree, fi, x + (above - x) / 2 AS t, CAST(row_number() OVER (PARTITION BY tree, fi ORDER BY x) - 1 AS INTEGER) AS sb
  FROM runs WHERE above IS NOT NULL AND (k <= {m} OR floor(cum * {m} / total) > floor((cum - w) * {m} / total)))"""


def _binned_depth2_ctes(kind: str, codes: bool) -> str:
    """Two levels on ``CUT_FEATURES`` and, if asked, category sets of ``CODE_FEATURES``."""
    n_cut = len(C.CUT_FEATURES)
    coded = "".join(f"\nUNION ALL SELECT tree, idn, w, y, {n_cut + i} AS fi, CAST({e} AS INTEGER) AS b FROM bal"
                    for i, e in enumerate(C.CODE_FEATURES.values())) if codes else ""
    gain = _gain(kind)

    def level(k: int) -> str:
        by = "PARTITION BY tree, node, fi"
        return f"""hist{k} AS (
  SELECT a.tree, a.node, c.fi, c.b, CAST(sum(c.w) AS DOUBLE) AS c, CAST(sum(c.w * c.y) AS DOUBLE) AS c1
  FROM at{k} a JOIN cells c ON c.tree = a.tree AND c.idn = a.idn GROUP BY a.tree, a.node, c.fi, c.b),
ranked{k} AS (
  SELECT *, CAST(row_number() OVER ({by} ORDER BY CASE WHEN fi >= {n_cut} THEN c1 / c ELSE 0.0 END, b) - 1 AS INTEGER) AS pos
  FROM hist{k}),
sides{k} AS (
  SELECT tree, node, fi, b, pos, CASE WHEN fi >= {n_cut} THEN pos ELSE b END AS sb,
    sum(c) OVER ({by} ORDER BY pos) AS nl, sum(c1) OVER ({by} ORDER BY pos) AS n1l,
    sum(c) OVER ({by}) - sum(c) OVER ({by} ORDER BY pos) AS nr,
    sum(c1) OVER ({by}) - sum(c1) OVER ({by} ORDER BY pos) AS n1r FROM ranked{k}),
best{k} AS (
  SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, fi, sb) AS rk
  FROM (SELECT *, round({gain}, 12) AS gain FROM sides{k} WHERE nl > 0 AND nr > 0)),
split{k} AS (
  SELECT s.tree, s.node, s.fi, s.sb, s.gain, s.pos,
    CASE WHEN s.fi >= {n_cut} THEN (SELECT string_agg(CAST(r.b AS VARCHAR), ',' ORDER BY r.b) FROM ranked{k} r
      WHERE r.tree = s.tree AND r.node = s.node AND r.fi = s.fi AND r.pos <= s.pos) END AS left_codes
  FROM best{k} s WHERE rk = 1 AND gain > 0),
at{k + 1} AS (
  SELECT a.tree, a.idn, a.w, a.y, 2 * a.node + (CASE WHEN r.pos > s.pos THEN 1 ELSE 0 END) AS node
  FROM at{k} a JOIN split{k} s ON s.tree = a.tree AND s.node = a.node
  JOIN cells c ON c.tree = a.tree AND c.idn = a.idn AND c.fi = s.fi
  JOIN ranked{k} r ON r.tree = a.tree AND r.node = a.node AND r.fi = s.fi AND r.b = c.b)"""

    return _cut_ctes() + f""",
binned AS (
  SELECT d.tree, d.fi, d.x, CAST(count(c.t) AS INTEGER) AS b
  FROM dist d LEFT JOIN cuts c ON c.tree = d.tree AND c.fi = d.fi AND c.t < d.x GROUP BY d.tree, d.fi, d.x),
cells AS (
  SELECT v.tree, v.idn, v.w, v.y, v.fi, n.b FROM cutcells v
  JOIN binned n ON n.tree = v.tree AND n.fi = v.fi AND n.x = v.x{coded}),
at0 AS (SELECT tree, idn, w, y, 1 AS node FROM bal),
{level(0)},
{level(1)},
nodes AS (
  SELECT g.tree, CAST(g.node AS BIGINT) AS node, CAST(floor(log2(g.node)) AS INTEGER) AS depth, n, n1,
    round(n1 / n, 9) AS prediction, s.fi IS NULL AS is_leaf, CAST(s.fi AS INTEGER) AS feature_index,
    s.sb AS split_bin, round(c.t, 9) AS threshold, s.left_codes, round(s.gain, 9) AS gain
  FROM (SELECT tree, node, CAST(sum(w) AS DOUBLE) AS n, CAST(sum(w * y) AS DOUBLE) AS n1
        FROM (SELECT * FROM at0 UNION ALL BY NAME SELECT * FROM at1 UNION ALL BY NAME SELECT * FROM at2)
        GROUP BY tree, node) g
  LEFT JOIN (SELECT * FROM split0 UNION ALL SELECT * FROM split1) s ON s.tree = g.tree AND s.node = g.node
  LEFT JOIN cuts c ON c.tree = s.tree AND c.fi = s.fi AND c.sb = s.sb)
SELECT * FROM nodes"""


def _wide_arity_sql() -> str:
    names = ["monto", "madr", "cuenta_monto_user_6h"]
    exprs = {n: n for n in names} | C.CODE_FEATURES
    rows = "\nUNION ALL\n".join(
        f"SELECT {i} AS feature_index, '{n}' AS feature, CAST(min({e}) AS DOUBLE) AS min_value, "
        f"CAST(max({e}) AS DOUBLE) AS max_value, CAST(CASE WHEN count(DISTINCT {e}) <= {C.CUT_BINS} "
        f"THEN count(DISTINCT {e}) END AS INTEGER) AS arity, count(DISTINCT {e}) <= {C.CUT_BINS} AS categorical FROM labelled"
        for i, (n, e) in enumerate(exprs.items()))
    return with_("labelled") + rows


def _walk_ctes(side: str) -> str:
    """``votes`` (idn, label, tree, p1): the rows of ``side`` at their leaves."""
    def value(split: str) -> str:
        return "[" + ", ".join(f"CAST(r.{c} AS INTEGER)" for c in BINARY) + f"][{split}.feature_index + 1]"

    def step(name: str, before: str) -> str:
        return f"""{name} AS (
  SELECT r.*, n.tree AS at_tree, CASE WHEN n.is_leaf THEN n.node
         ELSE 2 * n.node + (CASE WHEN {value("n")} > 0 THEN 1 ELSE 0 END) END AS at_node
  FROM {before})"""
    return f"""side AS (SELECT * FROM {side}),
{step("walk1", "side r JOIN nodes n ON n.node = 1")},
{step("walk2", "(SELECT * FROM walk1) w JOIN nodes n ON n.tree = w.at_tree AND n.node = w.at_node JOIN side r ON r.idn = w.idn")},
votes AS (
  SELECT w.idn, w.label, w.at_tree AS tree, n.prediction AS p1
  FROM walk2 w JOIN nodes n ON n.tree = w.at_tree AND n.node = w.at_node)"""


TEST = f"""test AS (SELECT * FROM labelled
  WHERE NOT ({U("'split:'", f"'{C.SPLIT_SEED}'", "':'", "idn")} < {_d(C.TRAIN)}))"""
# Run 1, grid point 0 of an experiment: its seed drives the split and the bootstrap.
EXP_SEED = "1:0"


def _exp_side(side: str, seed: str) -> str:
    split = f"""{U("'split:'", f"'{seed}'", "':'", "idn")} < {_d(C.TRAIN)}"""
    return "SELECT * FROM labelled WHERE " + (split if side == "train" else f"NOT ({split})")


def _exp_ctes(seed: str = EXP_SEED, kind: str = "gini") -> str:
    return f"exp_train AS ({_exp_side('train', seed)}),\n" + _depth2_ctes(kind, "exp_train", seed)


def _on_experiment(sql: str, side: str, seed: str = EXP_SEED, kind: str = "gini") -> str:
    """A query over the votes fixture, over the experiment's votes instead."""
    votes = _exp_ctes(seed, kind) + ",\n" + _walk_ctes(f"({_exp_side(side, seed)})")
    assert CTE["votes"] in sql
    return sql.replace(CTE["votes"], votes).replace("WITH ev", "WITH RECURSIVE ev", 1)


def _grid_tail(kind: str) -> str:
    return f"'{kind}' AS impurity, 2 AS depth, 32 AS bins, 'balanced' AS balancing"


GRID_TAIL = _grid_tail("gini")


def _both_sides(select) -> str:
    """``select(sql of one side, its name)`` for test and train, in one result."""
    return "\nUNION ALL\n".join(f"SELECT * FROM ({select(side)})" for side in ("test", "train"))


def _report_confusion(k: int = 1, seed: str = EXP_SEED, kind: str = "gini") -> str:
    def one(side):
        hard = _on_experiment(_auc_sql("predicted_label"), side, seed, kind)
        by_lr = _on_experiment(_auc_sql("(SELECT x.lr FROM lrs x WHERE x.idn = scored.idn)"), side, seed, kind)
        by_lr = by_lr.replace(CTE["scored"], CTE["scored"] + ",\n" + CTE["lrs"], 1)
        return f"""SELECT '{side}' AS tipo, {k} AS k, tp, fn, tn, fp, tpr AS "TPR", spc AS "SPC", ppv AS "PPV",
  acc AS "ACC", f1 AS "F1", mgeo AS "MGEO", pexc AS "PEXC", mcc AS "MCC",
  (SELECT auc FROM ({hard})) AS "areaRoc", (SELECT auc FROM ({by_lr})) AS "areaRocScore", {_grid_tail(kind)}
FROM ({_on_experiment(_confusion_sql(), side, seed, kind)})"""
    return _both_sides(one)


def _experiment_grid() -> str:
    """Every run at every grid point, each with a split and a bootstrap of its own."""
    return "\nUNION ALL\n".join(_report_confusion(k, f"{k}:{g}", kind) for k in range(1, C.RUNS + 1)
                                for g, kind in enumerate(("gini", "entropy")))


def _report_importances() -> str:
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(BINARY))
    return with_("labelled", extra=_exp_ctes()) + _importance_rows(names) + f"""
SELECT variable, importance, 1 AS k, {GRID_TAIL} FROM named"""


def _importance_rows(names: str) -> str:
    return f""", per AS (SELECT tree, feature_index, sum(gain) AS g FROM nodes WHERE NOT is_leaf
                 GROUP BY tree, feature_index),
share AS (SELECT feature_index, sum(g / t) AS v
          FROM (SELECT *, sum(g) OVER (PARTITION BY tree) AS t FROM per) WHERE t <> 0 GROUP BY feature_index),
names(feature_index, variable) AS (VALUES {names}),
named AS (
  SELECT CAST(n.feature_index AS INTEGER) AS feature_index, n.variable,
         round(coalesce(v / (SELECT sum(v) FROM share), 0.0), 9) AS importance
  FROM names n LEFT JOIN share s ON s.feature_index = n.feature_index)"""


def _report_density(side: str) -> str:
    sql = _kde_sql().replace("* sqrt(2.0 * pi())) END, 8) AS y", "* sqrt(2.0 * pi())) END, 9) AS y")
    return f"""SELECT x AS "X", y AS "Y", 1 AS k, type, {GRID_TAIL} FROM ({_on_experiment(sql, side)})"""


def _report_nodes() -> str:
    return with_("labelled", extra=_exp_ctes()) + f"""SELECT 1 AS k, CAST(tree AS INTEGER) AS tree,
  CAST(node AS BIGINT) AS node, feature_index,
  CASE WHEN NOT is_leaf THEN 0.5::DOUBLE END AS threshold, CAST(NULL AS VARCHAR) AS left_categories,
  round(gain, 9) AS gain, round(prediction, 9) AS prediction,
  round(1.0 - (n1 / n) * (n1 / n) - ((n - n1) / n) * ((n - n1) / n), 9) AS node_impurity, is_leaf, {GRID_TAIL}
FROM nodes"""


def _hash_assigned_ctes() -> str:
    x = ", ".join(f"CAST({c} AS DOUBLE)" for c in BINARY)
    return f"""assigned AS (
  SELECT idn, CAST(floor({U("'cluster:'", "idn")} * {C.HASH_CLUSTERS}) AS INTEGER) AS cluster, [{x}] AS x
  FROM train WHERE label <> 1),
n_minor AS (SELECT count(*) AS n FROM train WHERE label = 1),
shares AS (
  SELECT cluster, m, ((SELECT n FROM n_minor) * m) // total AS whole, ((SELECT n FROM n_minor) * m) % total AS rest
  FROM (SELECT cluster, count(*) AS m, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM assigned GROUP BY cluster)),
quotas AS (
  SELECT cluster, m, CAST(whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, cluster)
         <= (SELECT n FROM n_minor) - sum(whole) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM shares)"""


def _nearest_pick_sql() -> str:
    means = ", ".join(f"avg(x[{i + 1}])" for i in range(len(BINARY)))
    d2 = " + ".join(f"(x[{i + 1}] - c[{i + 1}]) * (x[{i + 1}] - c[{i + 1}])" for i in range(len(BINARY)))
    return with_("train", extra=_hash_assigned_ctes()) + f""", means AS (
  SELECT cluster, [{means}] AS c FROM assigned GROUP BY cluster),
far AS (SELECT cluster, idn, round(0.0::DOUBLE + {d2}, 9) AS dist2 FROM assigned JOIN means USING (cluster)),
placed AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY dist2, idn) AS r FROM far)
SELECT cluster, idn, dist2 FROM placed JOIN quotas USING (cluster) WHERE r <= quota"""


def _stratified_pick_sql() -> str:
    u = U("'km:'", f"'{C.BOOT_SEED}'", "':'", "t.tree", "':'", "q.cluster", "':'", "j.j")
    return with_("train", extra=_hash_assigned_ctes()) + f""", placed AS (
  SELECT cluster, idn, row_number() OVER (PARTITION BY cluster ORDER BY idn) - 1 AS r FROM assigned),
draws AS (
  SELECT CAST(t.tree AS INTEGER) AS tree, q.cluster, CAST(floor(q.m * {u}) AS BIGINT) AS r
  FROM quotas q, range(0, {C.PICK_TREES}) t(tree), LATERAL (SELECT * FROM range(1, q.quota + 1) g(j)) j)
SELECT tree, idn, CAST(count(*) AS INTEGER) AS w FROM draws JOIN placed USING (cluster, r) GROUP BY tree, idn"""


def _repeated_pick_sql() -> str:
    return _stratified_pick_sql().replace("SELECT idn, CAST(floor", "SELECT idn // 10 AS idn, CAST(floor", 1).replace(
        "JOIN placed USING (cluster, r) GROUP BY tree, idn", "JOIN placed USING (cluster, r) GROUP BY tree, idn, cluster, r")


def _dealt_ctes(where: str) -> str:
    """``near``: neighbours by distance and id inside blocks dealt by a hash."""
    cols = C.NEAR_FEATURES
    d = " + ".join(f"(a.{c}::DOUBLE - b.{c}::DOUBLE) * (a.{c}::DOUBLE - b.{c}::DOUBLE)" for c in cols)
    return f"""own AS (SELECT idn, label, {', '.join(cols)} FROM labelled{where}),
blocks AS (SELECT greatest(1, ceil(count(*) / {C.NEAR_BLOCK}::DOUBLE)) AS b FROM own),
dealt AS (SELECT *, CAST(floor({U("'block:'", "idn")} * (SELECT b FROM blocks)) AS INTEGER) AS block FROM own),
ranked AS (
  SELECT a.idn, a.label, b.idn AS other, b.label AS other_label,
         row_number() OVER (PARTITION BY a.idn ORDER BY {d}, b.idn) AS r
  FROM dealt a JOIN dealt b ON a.block = b.block AND a.idn <> b.idn),
near AS (SELECT * FROM ranked WHERE r <= {C.NEAR_K})"""


def _smote_sql() -> str:
    u = U("'smote:'", f"'{C.BOOT_SEED}'", "':'", "idn", "':'", "j")
    gap = U("'gap:'", f"'{C.BOOT_SEED}'", "':'", "idn", "':'", "j")
    cols = ", ".join(
        (f"round(CASE WHEN d.gap < 0.5 THEN a.{c}::DOUBLE ELSE b.{c}::DOUBLE END, 6) AS {c}" if i in C.NEAR_NOMINAL else
         f"round(a.{c}::DOUBLE + d.gap * (b.{c}::DOUBLE - a.{c}::DOUBLE), 6) AS {c}")
        for i, c in enumerate(C.NEAR_FEATURES))
    return with_("labelled", extra=_dealt_ctes(" WHERE label = 1")) + f""", total AS (
  SELECT count(*) AS n, count(*) * {C.SMOTE_PERCENT} // 100 AS m FROM own),
placed AS (SELECT idn, row_number() OVER (ORDER BY idn) AS p FROM own),
shares AS (SELECT idn, (p * m) // n - ((p - 1) * m) // n AS share FROM placed, total),
sizes AS (SELECT idn, count(r) AS size FROM own LEFT JOIN near USING (idn) GROUP BY idn),
numbered AS (SELECT idn, size, j FROM shares JOIN sizes USING (idn),
             LATERAL (SELECT * FROM range(1, share + 1) g(j)) x),
draws AS (
  SELECT n.idn, n.j, coalesce(k.other, n.idn) AS neighbour, n.gap
  FROM (SELECT *, CAST(floor(size * {u}) AS BIGINT) + 1 AS pick, {gap} AS gap FROM numbered) n
  LEFT JOIN near k ON k.idn = n.idn AND k.r = n.pick)
SELECT d.idn, d.j, d.neighbour, round(d.gap, 9) AS gap, {cols}
FROM draws d JOIN own a ON a.idn = d.idn JOIN own b ON b.idn = d.neighbour"""


def _enn_sql() -> str:
    return with_("labelled", extra=_dealt_ctes("")) + """, votes AS (
  SELECT o.idn, o.label, CAST(count(r) AS INTEGER) AS n_near,
         CAST(count(r) FILTER (WHERE other_label <> o.label) AS INTEGER) AS n_other
  FROM own o LEFT JOIN near n ON n.idn = o.idn GROUP BY o.idn, o.label)
SELECT *, 2 * n_other <= n_near AS kept FROM votes"""


def _report_model() -> str:
    names = "[" + ", ".join(f"'{c}'" for c in BINARY) + "]"
    return with_("labelled", extra=_exp_ctes()) + f""", lines AS (
  SELECT n.tree, n.node, n.is_leaf, n.prediction, bin(n.node) AS place, {names}[p.feature_index + 1] AS name
  FROM nodes n LEFT JOIN nodes p ON p.tree = n.tree AND p.node = n.node // 2 AND NOT p.is_leaf)
SELECT 1 AS k, CAST(tree AS INTEGER) AS tree, place,
  repeat('  ', length(place) - 1)
  || CASE WHEN node = 1 THEN 'Tree' WHEN node % 2 = 0 THEN 'If (' || name || ' <= 0.500000)'
          ELSE 'Else (' || name || ' > 0.500000)' END
  || CASE WHEN is_leaf THEN ' Predict: ' || printf('%.6f', prediction) ELSE '' END AS line, {GRID_TAIL}
FROM lines"""


SQL: dict[str, str] = {
    "src_scan_filter": with_("transactions") + f"SELECT {', '.join(TX_COLS)} FROM transactions "
                       f"WHERE {C.SCAN_FILTER}",
    "src_numeric_drop": with_("transactions") + "SELECT "
                        + ", ".join(c for c in TX_COLS if c != "resp_code") + " FROM transactions",
    "labelled_filter": with_("labelled") + f"SELECT {', '.join(TX_COLS)} FROM labelled",
    "csv_export_rows": with_("labelled") + f"SELECT {', '.join(FEATURES)} FROM labelled WHERE "
                       + U("'sample:'", f"'{C.SAMPLE_SEED}'", "':'", "idn") + f" < {_d(C.SAMPLE_RATE)}",
    "feature_columns_binary": _arity_sql(),
    "class_counts": with_("labelled") + """SELECT count(*) FILTER (WHERE label = 1) AS n_fraud,
  count(*) FILTER (WHERE label = -1) AS n_legal FROM labelled""",
    "balance_plan": with_("train", extra=_plan_cte()) + "SELECT * FROM plan",
    "hash_split": with_("labelled") + "SELECT idn, label, CASE WHEN "
                  + U("'split:'", f"'{C.SPLIT_SEED}'", "':'", "idn")
                  + f" < {_d(C.TRAIN)} THEN 'train' ELSE 'test' END AS split FROM labelled",
    "hash_sample": with_("labelled") + "SELECT idn, label FROM labelled WHERE "
                   + U("'sample:'", f"'{C.SAMPLE_SEED}'", "':'", "idn") + f" < {_d(C.SAMPLE_RATE)}",
    "bootstrap_weights": with_("train", extra=_boot_ctes()) + "SELECT tree, idn, w FROM weights",
    "balanced_union": with_("train", extra=_boot_ctes()) + """SELECT CAST(t.tree AS INTEGER) AS tree, 1 AS w, l.idn, l.label
FROM train l, range(0, (SELECT n_trees FROM plan)) t(tree) WHERE l.label = 1
UNION ALL SELECT tree, w, idn, label FROM weights""",
    "runs_membership": _runs_sql(),
    "soft_vote": _votes_sql("soft"),
    "soft_vote_stable": _votes_sql("stable"),
    "hard_vote": _votes_sql("hard"),
    "mean_vote": _votes_sql("mean"),
    "confusion_metrics": _confusion_sql(),
    "roc_hard": _roc_sql("predicted_label"),
    "auc_hard": _auc_sql("predicted_label"),
    "roc_score": _roc_sql("round(p1, 9)"),
    "auc_score": _auc_sql("round(p1, 9)"),
    "llr": with_("lrs") + "SELECT idn, label, lr FROM lrs",
    "llr_inverse": with_("scored") + """SELECT idn, label,
  round(CASE WHEN p0 = 0 AND p1 = 0 THEN NULL
             WHEN p0 = 0 THEN ln(1e-13 / p1)
             WHEN p1 = 0 THEN ln(p0 / 1e-13)
             ELSE ln(p0 / p1) END, 9) AS lr
FROM scored""",
    "bandwidth": with_("lrs") + """SELECT CASE WHEN flag = 1 THEN 'Fraude' ELSE 'Legal' END AS type,
  count(lr) AS n, round(stddev_pop(lr), 9) AS sd,
  round(stddev_pop(lr) * pow(4.0 / (3.0 * count(lr)), 0.2), 9) AS h
FROM lrs WHERE lr IS NOT NULL GROUP BY flag""",
    "density_kde": _kde_sql(),
    "eer_standard": _eer_sql("standard"),
    "eer_reference": _eer_sql("reference"),
    "score_curves": _curves_sql(),
    "score_range": with_("lrs") + "SELECT min(lr) AS lo, max(lr) AS hi FROM lrs",
    "stump_gini": with_("train", extra=_stump_ctes("gini")) + "SELECT * FROM splits",
    "stump_entropy": with_("train", extra=_stump_ctes("entropy")) + "SELECT * FROM splits",
    "importances_named": _importances_sql(),
    "levelwise_stumps": with_("train", extra=_stump_ctes("gini")) + "SELECT * FROM splits",
    "src_scan_pushed": f"SELECT {', '.join(C.RAW_COLUMNS)} FROM events WHERE {C.RAW_FILTER}",
    "levelwise_rare_stumps": with_("train", extra=_stump_ctes("gini", C.RARE_FEATURES)) + "SELECT * FROM splits",
    "tree_thresholds": with_("train", extra=_cut_ctes()) + """SELECT tree, fi AS feature_index, sb AS split_bin,
  t AS threshold FROM cuts""",
    "levelwise_quantile_nodes": with_("train", extra=_binned_depth2_ctes("gini", False)),
    "levelwise_category_nodes": with_("train", extra=_binned_depth2_ctes("entropy", True)),
    "feature_arity_wide": _wide_arity_sql(),
    "levelwise_depth2_nodes": with_("train", extra=_depth2_ctes("gini")) + """SELECT tree, CAST(node AS BIGINT) AS node,
  depth, n, n1, round(prediction, 9) AS prediction, is_leaf, feature_index, round(gain, 9) AS gain FROM nodes""",
    "levelwise_depth2_entropy": with_("train", extra=_depth2_ctes("entropy")) + """SELECT tree,
  CAST(node AS BIGINT) AS node, is_leaf, feature_index, round(gain, 9) AS gain FROM nodes""",
    "levelwise_depth2_predictions": with_("train", extra=TEST + ",\n" + _depth2_ctes("gini") + ",\n"
                                          + _walk_ctes("test") + ",\n" + CTE["logs"] + ",\n" + CTE["scored"]) + """
SELECT s.idn, s.label, CAST(n AS INTEGER) AS n_trees, n_votes, round(p0, 9) AS p0, round(p1, 9) AS p1,
  predicted_label FROM scored s JOIN logs l USING (idn)""",
    "levelwise_depth2_importances": with_("train", extra=_depth2_ctes("gini"))
        + _importance_rows(", ".join(f"({i}, '{c}')" for i, c in enumerate(BINARY))) + "\nSELECT * FROM named",
    "kmeans_quotas": with_("train", extra=_hash_assigned_ctes()) + "SELECT cluster, m, quota FROM quotas",
    "kmeans_nearest_pick": _nearest_pick_sql(),
    "kmeans_stratified_pick": _stratified_pick_sql(),
    "kmeans_repeated_pick": _repeated_pick_sql(),
    "smote_synthetic": _smote_sql(),
    "enn_round": _enn_sql(),
    "report_model": _report_model(),
    "experiment_grid": _experiment_grid(),
    "report_confusion": _report_confusion(),
    "report_importances": _report_importances(),
    "report_roc": f"""SELECT fpr AS "X", tpr AS "Y", 1 AS k, pos, {GRID_TAIL}
FROM ({_on_experiment(_roc_sql("predicted_label"), "test")})""",
    "report_density_test": _report_density("test"),
    "report_density_train": _report_density("train"),
    "report_eer": _both_sides(lambda side: f"""SELECT 1 AS k, '{side}' AS type, eer AS "EER", lr AS "LR", state, {GRID_TAIL}
FROM ({_on_experiment(_eer_sql("reference"), side)})"""),
    "report_curves": _both_sides(lambda side: f"""SELECT x AS "X", y AS "Y", 1 AS k, '{side}-' || type AS type, {GRID_TAIL}
FROM ({_on_experiment(_curves_sql(), side)})"""),
    "report_nodes": _report_nodes(),
}
