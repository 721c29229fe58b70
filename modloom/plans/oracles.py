"""ANSI SQL that DuckDB runs over the same tables, for the queries that SQL can express."""

from __future__ import annotations


def _key(x: str, seed: int) -> str:
    return f"('0x' || substr(md5({x}::VARCHAR || ':{seed}'), 1, 8))::BIGINT"


def _six(x: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE"


G = """WITH arcs AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
e AS (SELECT src, dst, sum(w)::BIGINT AS w FROM (SELECT a AS src, b AS dst, w FROM arcs UNION ALL SELECT b, a, w FROM arcs) GROUP BY 1, 2),
d AS (SELECT src AS id, sum(w)::BIGINT AS d FROM e GROUP BY 1), t AS (SELECT sum(d)::DOUBLE AS tot, count(*) AS n FROM d)"""
LAB = f"lab AS (SELECT n_nationkey AS id, n_regionkey AS truth, ({_key('n_nationkey', 7)} % 5)::INT AS label FROM nation)"
L = f"WITH {LAB}"
GL = f"{G}, {LAB}"
COP = """WITH l AS (SELECT l_orderkey AS o, l_partkey AS p FROM lineitem),
e AS (SELECT a.p AS src, b.p AS dst, count(*) AS w FROM l a JOIN l b ON a.o = b.o AND a.p <> b.p GROUP BY 1, 2)"""
PTS = "WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label AS truth FROM embeddings)"
D2 = "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))"
KNN = f"""{PTS}, pair AS (SELECT a.id AS src, b.id AS dst, {D2} AS d2 FROM p a JOIN p b ON a.id <> b.id),
knn AS (SELECT src, dst, d2, row_number() OVER (PARTITION BY src ORDER BY round(d2, 9), dst)::INT AS rank FROM pair QUALIFY rank <= 10)"""
GAUSS = f"{KNN}, g AS (SELECT src, dst, exp(-4 * d2 / max(d2) OVER (PARTITION BY src)) AS w FROM knn)"
RBF = f"""{KNN}, u AS (SELECT src, dst, d2 FROM knn WHERE rank <= 9), h AS (SELECT src, dst, sum(d2) / 2 AS m FROM (SELECT src, dst, d2 FROM u UNION ALL SELECT dst, src, d2 FROM u) GROUP BY 1, 2),
r AS (SELECT src, dst, exp(-0.5 * m) AS w FROM h WHERE exp(-0.5 * m) < 1)"""
MARKS = f"{PTS}, k AS (SELECT id, v, row_number() OVER (ORDER BY {_key('id', 7)}, id)::INT AS rank FROM p)"


def _null(null: str) -> str:
    return "x.d * y.d / tot" if null == "ng" else "tot / (n * (n - 1))"


def _support(null: str) -> str:
    row = "d.d" if null == "ng" else "tot / (n - 1)"
    return f"""{G}, pr AS (SELECT src, dst, w, {_null(null)} AS p FROM e JOIN d x ON src = x.id JOIN d y ON dst = y.id CROSS JOIN t),
dp AS (SELECT src AS id, sum(greatest(w - p, 0)) AS dp FROM pr GROUP BY 1),
nd AS (SELECT d.id, d.d::DOUBLE AS d, dp, dp - d.d + {row} AS dn FROM d JOIN dp USING (id) CROSS JOIN t),
s AS (SELECT src, dst, w::DOUBLE AS w, 0.0::DOUBLE AS one FROM e UNION ALL SELECT id, id, 0, 1 FROM d),
m AS (SELECT src, dst, w, one, {_null(null)} AS p, x.d AS di, y.d AS dj, x.dp AS pi, y.dp AS pj, x.dn AS ni, y.dn AS nj FROM s JOIN nd x ON src = x.id JOIN nd y ON dst = y.id CROSS JOIN t)"""


BP, BN = "greatest(w - p, 0)", "greatest(p - w, 0)"
MATRICES = {
    "null_model": "p",
    "laplacian": "one * di - w",
    "laplacian_sym": "one - w / sqrt(nullif(di * dj, 0))",
    "laplacian_rw": "one - w / nullif(di, 0)",
    "signless": "one * di + p",
    "signless_sym": "one + p / sqrt(nullif(di * dj, 0))",
    "signless_rw": "one + p / nullif(di, 0)",
    "lmix_sym": "2 * one - (w - p) / sqrt(nullif(di * dj, 0))",
    "lmix_rw": "2 * one - (w - p) / nullif(di, 0)",
    "modularity_matrix": "w - p",
    "b_pos": BP,
    "b_neg": BN,
    "b_pos_lap_sym": f"one - {BP} / sqrt(nullif(pi * pj, 0))",
    "b_pos_lap_rw": f"one - {BP} / nullif(pi, 0)",
    "b_neg_signless_sym": f"one + {BN} / sqrt(nullif(ni * nj, 0))",
    "b_neg_signless_rw": f"one + {BN} / nullif(ni, 0)",
    "lb_sym": f"2 * one - {BP} / sqrt(nullif(pi * pj, 0)) + {BN} / sqrt(nullif(ni * nj, 0))",
    "lb_rw": f"2 * one - {BP} / nullif(pi, 0) + {BN} / nullif(ni, 0)",
}


def _modularity(pairs: str, inside: str = "w", gamma: float = 1.0) -> str:
    return f"""{GL}, f AS (SELECT src, dst, {inside} AS w FROM e), fd AS (SELECT src AS id, sum(w)::DOUBLE AS d FROM f GROUP BY 1),
c AS (SELECT label, sum(d) AS d, count(*)::DOUBLE AS size FROM lab JOIN fd USING (id) GROUP BY 1),
i AS (SELECT coalesce(sum(w), 0)::DOUBLE AS inside FROM f JOIN lab x ON src = x.id JOIN lab y ON dst = y.id WHERE x.label = y.label),
z AS (SELECT sum(d) AS tot, sum(size) AS n, sum(d * d) AS dd, sum(size * size) AS ss FROM c)
SELECT {_six(f'inside / tot - {gamma} * {pairs}')} AS modularity FROM z CROSS JOIN i"""


NG, ER, ER_FULL = "dd / (tot * tot)", "(ss - n) / (n * (n - 1))", "ss / (n * (n - 1))"
_C = "c AS (SELECT truth, label, count(*) AS n FROM lab GROUP BY 1, 2), r AS (SELECT truth, sum(n) AS n FROM c GROUP BY 1), q AS (SELECT label, sum(n) AS n FROM c GROUP BY 1), z AS (SELECT sum(n)::DOUBLE AS n FROM c)"
_P = "n::DOUBLE * (n - 1) / 2"
_PUR = "(SELECT sum(m)::DOUBLE / sum(n) FROM (SELECT max(n) AS m, sum(n) AS n FROM c GROUP BY {}))"
_ARI = f"""(SELECT (x - a * b / t) / ((a + b) / 2 - a * b / t) FROM (SELECT (SELECT sum({_P}) FROM c) AS x, (SELECT sum({_P}) FROM r) AS a, (SELECT sum({_P}) FROM q) AS b, (SELECT {_P} FROM z) AS t))"""
_NMI = """(SELECT mi / ((ha + hb) / 2) FROM (SELECT (SELECT sum(c.n / z.n * ln(c.n * z.n / (r.n * q.n)::DOUBLE)) FROM c JOIN r USING (truth) JOIN q USING (label) CROSS JOIN z) AS mi,
  (SELECT -sum(r.n / z.n * ln(r.n / z.n)) FROM r CROSS JOIN z) AS ha, (SELECT -sum(q.n / z.n * ln(q.n / z.n)) FROM q CROSS JOIN z) AS hb))"""


def _values() -> dict[str, str]:
    out = {}
    for name, f in MATRICES.items():
        for null in ("ng", "er"):
            sql = f"{_support(null)} SELECT src, dst, {_six(f)} AS v FROM m"
            if name.startswith("laplacian"):
                out[name] = sql if null == "ng" else out[name]
            else:
                out[f"{name}_{null}"] = sql
    return out


def _report() -> str:
    body = _modularity(NG).rsplit("SELECT", 1)[0].replace(", c AS", ", cm AS").replace("\nc AS", "\ncm AS").replace("FROM c)", "FROM cm)").replace("z AS (SELECT sum(d)", "zm AS (SELECT sum(d)")
    return f"""{body}, {_C}
SELECT {_six('inside / tot - ' + NG)} AS modularity, {_six('inside / tot - ' + ER.replace('ss', 'zm.ss').replace('n)', 'zm.n)').replace('(n ', '(zm.n '))} AS modularity_er, {_six(_PUR.format('label'))} AS purity, {_six(_PUR.format('truth'))} AS inverse_purity, {_six(_ARI)} AS ari, {_six(_NMI)} AS nmi FROM zm CROSS JOIN i"""


FORCE = f"""{GL}, u AS (SELECT id, k, d, CASE WHEN label = k THEN 1.0 ELSE -1.0 END::DOUBLE AS u FROM lab JOIN d USING (id) CROSS JOIN (SELECT unnest(range(5))::INT AS k)),
mean AS (SELECT k, sum(d * u) / sum(d) AS mean FROM u GROUP BY 1),
f AS (SELECT id, k, u + 2 * 0.5 * 0.001 * d * (u - mean) AS w FROM u JOIN mean USING (k))"""
_LAB8 = LAB.replace("':7'", "':8'").replace("lab AS", "lab8 AS")
SEED = f"s AS (SELECT id, truth AS label FROM lab QUALIFY row_number() OVER (PARTITION BY truth ORDER BY {_key('id', 7)}, id) = 1)"

ORACLES: dict[str, str] = _values() | {
    "report": _report(),
    "truth_recode": "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 WHEN c_mktsegment = 'MACHINERY' THEN 0 END::INT AS truth FROM customer",
    "sbm_graph": f"""WITH a AS (SELECT x.i AS src, y.i AS dst FROM range(120) x(i) JOIN range(120) y(i) ON x.i < y.i),
f AS (SELECT src, dst FROM a WHERE {_key('(src * 120 + dst)', 7)} / 4294967296.0::DOUBLE < CASE WHEN src // 30 = dst // 30 THEN 0.95 ELSE 0.01 END)
SELECT src, dst, 1::BIGINT AS w FROM f UNION ALL SELECT dst, src, 1 FROM f""",
    "scan_points": f"{PTS} SELECT id, len(v)::INT AS dims, {_six('list_sum(v)')} AS total, truth FROM p",
    "edges_symmetrized": f"{G} SELECT src, dst, w FROM e",
    "copurchase_edges": f"{COP} SELECT src, dst, w FROM e",
    "degree": f"{COP} SELECT src AS id, sum(w)::BIGINT AS d FROM e GROUP BY 1",
    "b_degrees_ng": f"{_support('ng')} SELECT id, {_six('dp')} AS b_pos_degree, {_six('dn')} AS b_neg_degree FROM nd",
    "b_degrees_er": f"{_support('er')} SELECT id, {_six('dp')} AS b_pos_degree, {_six('dn')} AS b_neg_degree FROM nd",
    "knn_edges": f"{KNN} SELECT src, dst, {_six('d2')} AS d2, rank FROM knn",
    "knn_gaussian_weights": f"{GAUSS} SELECT src, dst, {_six('w')} AS w FROM g",
    "knn_symmetrized": f"{GAUSS} SELECT src, dst, {_six('sum(w) / 2')} AS w FROM (SELECT src, dst, w FROM g UNION ALL SELECT dst, src, w FROM g) GROUP BY 1, 2",
    "zp_affinity": f"""{KNN}, tau AS (SELECT src AS id, max(d2) AS tau FROM knn GROUP BY 1), full_ AS (SELECT src, dst, d2 FROM pair UNION ALL SELECT id, id, 0 FROM p),
s AS (SELECT src, dst, d2 / sqrt(x.tau * y.tau) AS v FROM full_ JOIN tau x ON src = x.id JOIN tau y ON dst = y.id),
b AS (SELECT src, dst, exp(-v) AS w FROM s QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(v, 9), dst) <= 11)
SELECT src, dst, {_six('max(w)')} AS w FROM (SELECT src, dst, w FROM b UNION ALL SELECT dst, src, w FROM b) GROUP BY 1, 2""",
    "knn_rbf_affinity": f"{RBF} SELECT src, dst, {_six('w')} AS w FROM r",
    "affinity_mean_normalized": f"{RBF} SELECT src, dst, {_six('w / (SELECT avg(d) FROM (SELECT sum(w) AS d FROM r GROUP BY src))')} AS w FROM r",
    "landmark_sample": f"{MARKS} SELECT id, rank FROM k WHERE rank <= 20",
    "rbf_block": f"{MARKS} SELECT a.id, rank, {_six(f'exp(-0.5 * {D2})')} AS value FROM p a CROSS JOIN (SELECT * FROM k WHERE rank <= 10) b",
    "rbf_div_block": f"{MARKS} SELECT a.id, rank, round(exp(-{D2} / 2.0)::FLOAT::DOUBLE, 5) + 0.0::DOUBLE AS value FROM p a CROSS JOIN (SELECT * FROM k WHERE rank <= 10) b",
    "covariance_entries": f"""{PTS}, x AS (SELECT id, unnest(v) AS x, unnest(range(len(v)))::INT AS i FROM p)
SELECT a.i, b.i AS j, {_six('(sum(a.x * b.x) - count(*) * avg(a.x) * avg(b.x)) / (count(*) - 1)')} AS covariance FROM x a JOIN x b ON a.id = b.id AND a.i <= b.i GROUP BY 1, 2""",
    "gram_matrix": f"""{PTS}, x AS (SELECT id, unnest(v) AS x, unnest(range(len(v)))::INT AS i FROM p)
SELECT a.i, b.i AS j, {_six('sum(a.x * b.x)')} AS gram FROM x a JOIN x b ON a.id = b.id AND a.i <= b.i GROUP BY 1, 2""",
    "nystrom_degree_k1": f"{MARKS}, c AS (SELECT a.id, exp(-0.5 * {D2}) AS value FROM p a CROSS JOIN (SELECT * FROM k WHERE rank = 1) b) SELECT id, {_six('value * (SELECT sum(value) FROM c)')} AS degree FROM c",
    "onehot_pm1": f"{L} SELECT id, array_to_string(list_transform(range(5), lambda i: CASE WHEN i = label THEN 1 ELSE -1 END), ',') AS u FROM lab",
    "onehot_01": f"{L} SELECT id, array_to_string(list_transform(range(5), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), ',') AS u FROM lab",
    "argmax_label": f"{PTS} SELECT id, (list_position(v, list_max(v)) - 1)::INT AS label FROM p",
    "threshold": f"{PTS}, x AS (SELECT id, v[1] AS x FROM p) SELECT id, {_six('CASE WHEN x < 0 THEN 0 WHEN x > 0 THEN 1 ELSE x END')} AS at_zero, {_six('CASE WHEN x = -0.1::DOUBLE THEN x ELSE 1 END')} AS below_zero FROM x",
    "standard_labels": f"{L} SELECT id, (dense_rank() OVER (ORDER BY label) - 1)::INT AS label FROM lab",
    "binary_labels": f"{L} SELECT id, CASE dense_rank() OVER (ORDER BY label) WHEN 1 THEN -1 WHEN 2 THEN 1 ELSE 0 END::INT AS label FROM lab",
    "binary_labels_std": f"{L} SELECT id, CASE dense_rank() OVER (ORDER BY label) WHEN 1 THEN -1 WHEN 2 THEN 1 ELSE 0 END::INT AS label FROM lab WHERE label < 2",
    "communities": f"{L} SELECT label, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM lab GROUP BY 1",
    "communities_explode": f"{L} SELECT id, label FROM lab",
    "init_equal": f"{PTS}, r AS (SELECT id, row_number() OVER (ORDER BY {_key('id', 7)}, id) AS rank, count(*) OVER () AS n FROM p) SELECT id, CASE WHEN (rank - 1) // (n // 7) < 7 THEN (rank - 1) // (n // 7) END::INT AS label FROM r",
    "init_random": f"{PTS} SELECT id, ({_key('id', 7)} % 7)::INT AS label FROM p",
    "init_binary_random": f"{PTS} SELECT id, {_six(f'{_key("id", 7)} / 2147483648.0::DOUBLE - 1')} AS u FROM p",
    "init_binary_vector": f"{PTS} SELECT id, {_six('v[2]')} AS u FROM p",
    "init_binary_equal": f"{PTS}, r AS (SELECT id, row_number() OVER (ORDER BY {_key('id', 7)}, id) AS rank, count(*) OVER () AS n FROM p) SELECT id, CASE WHEN rank <= n // 2 THEN 1 ELSE -1 END::INT AS u FROM r",
    "init_semi_supervised": f"{L}, {SEED} SELECT lab.id, s.label FROM lab LEFT JOIN s USING (id)",
    "init_supervised_overlay": f"{L}, {SEED} SELECT lab.id, coalesce(s.label, lab.label)::INT AS label FROM lab LEFT JOIN s USING (id)",
    "modularity_ng": _modularity(NG),
    "modularity_ng_half": _modularity(NG, gamma=0.5),
    "modularity_er": _modularity(ER, "1"),
    "modularity_er_full": _modularity(ER_FULL),
    "modularity_ng_unweighted": _modularity(NG, "1"),
    "purity": f"{L}, {_C} SELECT {_six(_PUR.format('label'))} AS purity",
    "inverse_purity": f"{L}, {_C} SELECT {_six(_PUR.format('truth'))} AS purity",
    "ari": f"{L}, {_C} SELECT {_six(_ARI)} AS ari",
    "nmi": f"{L}, {_C} SELECT {_six(_NMI)} AS nmi",
    "contingency": f"{L} SELECT truth, label, count(*) AS n FROM lab GROUP BY 1, 2",
    "cluster_sizes": f"{L} SELECT label, count(*) AS n FROM lab GROUP BY 1",
    "num_clusters": f"{L} SELECT count(DISTINCT label) AS n FROM lab",
    "run_report": f"""WITH r AS (SELECT n_nationkey AS id, n_regionkey AS truth, s AS run, k::INT AS k, ('0x' || substr(md5(n_nationkey::VARCHAR || ':' || s::VARCHAR), 1, 8))::BIGINT % k AS label FROM nation CROSS JOIN range(10) x(s) CROSS JOIN (VALUES (4), (5)) y(k)),
c AS (SELECT k, run, label, truth, count(*) AS n FROM r GROUP BY ALL), m AS (SELECT k, run, label, max(n) AS m, sum(n) AS n FROM c GROUP BY ALL), q AS (SELECT k, run, sum(m)::DOUBLE / sum(n) AS purity, count(*) AS classes FROM m GROUP BY ALL)
SELECT k, {_six('avg(purity)')} AS purity, {_six('avg(classes)')} AS classes, count(*) AS runs FROM q GROUP BY k""",
    "dt_bounds": f"{G} SELECT {_six('max(d)::DOUBLE')} AS max_degree, {_six('sqrt(count(*) * 5)')} AS norm, round(0.15::DOUBLE / (1.5::DOUBLE * max(d)), 9) AS dt_low FROM d",
    "power_iteration_t": f"""{G}, x0 AS (SELECT id, CASE WHEN id = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM d),
x1 AS (SELECT d.id, any_value(y.x) + sum(w * x0.x) / any_value(d.d) AS x FROM d JOIN e ON src = d.id JOIN x0 ON dst = x0.id JOIN x0 y ON y.id = d.id GROUP BY 1),
x2 AS (SELECT d.id, any_value(y.x) + sum(w * x1.x) / any_value(d.d) AS x FROM d JOIN e ON src = d.id JOIN x1 ON dst = x1.id JOIN x1 y ON y.id = d.id GROUP BY 1)
SELECT d.id, {_six('any_value(y.x) + sum(w * x2.x) / any_value(d.d)')} AS x FROM d JOIN e ON src = d.id JOIN x2 ON dst = x2.id JOIN x2 y ON y.id = d.id GROUP BY 1""",
    "mbo_threshold": f"{FORCE} SELECT id, arg_max(k, w::DOUBLE - k * 1e-12::DOUBLE)::INT AS label FROM f GROUP BY 1",
    "mbo_stop_standard": f"{L}, {_LAB8} SELECT 4 * count(*) FILTER (lab.label <> lab8.label) AS stop FROM lab JOIN lab8 USING (id)",
    "mbo_stop_modularity": f"""{GL}, {_LAB8}, b AS (SELECT 0 AS g, id, label FROM lab UNION ALL SELECT 1, id, label FROM lab8), c AS (SELECT g, label, sum(d)::DOUBLE AS d FROM b JOIN d USING (id) GROUP BY 1, 2),
i AS (SELECT x.g, sum(w)::DOUBLE AS inside FROM e JOIN b x ON src = x.id JOIN b y ON dst = y.id AND x.g = y.g WHERE x.label = y.label GROUP BY 1),
q AS (SELECT g, any_value(inside) / any_value(tot) - sum(c.d * c.d) / any_value(tot * tot) AS q FROM c JOIN i USING (g) CROSS JOIN t GROUP BY 1)
SELECT {_six('abs((SELECT q FROM q WHERE g = 0) - (SELECT q FROM q WHERE g = 1))')} AS stop""",
    "hu_degree_weighted_mean": f"{FORCE} SELECT k, {_six('mean')} AS mean FROM mean",
    "hu_forcing_step": f"{FORCE} SELECT id, k, {_six('w')} AS w FROM f",
    "louvain_delta_q": f"""{GL}, l AS (SELECT id, label, d::DOUBLE AS d FROM lab JOIN d USING (id)), c AS (SELECT label, sum(d) AS dc FROM l GROUP BY 1),
near AS (SELECT src AS id, label AS cand, sum(w)::DOUBLE AS k FROM e JOIN lab ON dst = lab.id GROUP BY 1, 2),
stay AS (SELECT l.id, coalesce(k, 0) - l.d * (dc - l.d) / tot AS stay FROM l JOIN c USING (label) LEFT JOIN near ON near.id = l.id AND cand = label CROSS JOIN t)
SELECT l.id, l.label AS own, cand, {_six('k - l.d * dc / tot - stay')} AS gain FROM near JOIN l USING (id) JOIN c ON c.label = cand JOIN stay ON stay.id = l.id CROSS JOIN t WHERE cand <> l.label""",
    "graph_contract": f"{GL} SELECT x.label AS src, y.label AS dst, sum(w)::BIGINT AS w FROM e JOIN lab x ON src = x.id JOIN lab y ON dst = y.id GROUP BY 1, 2",
    "cnm_first_merge": f"{G} SELECT src AS a, dst AS b, round(2 * (w / tot - x.d::DOUBLE * y.d / (tot * tot)), 9) AS gain FROM e JOIN d x ON src = x.id JOIN d y ON dst = y.id CROSS JOIN t WHERE src < dst ORDER BY gain DESC, a, b LIMIT 1",
    "bfs_levels": f"""{G.replace('WITH', 'WITH RECURSIVE', 1)}, b AS (SELECT id AS source, id, 0 AS dist FROM d UNION SELECT source, dst, dist + 1 FROM b JOIN e ON src = id WHERE dist < 25)
SELECT source, id, min(dist)::INT AS dist FROM b GROUP BY 1, 2""",
    "connected_components": f"""{G.replace('WITH', 'WITH RECURSIVE', 1)}, s AS (SELECT src, dst FROM (SELECT *, max(w) OVER (PARTITION BY src) AS m FROM e) WHERE w = m), u AS (SELECT src, dst FROM s UNION SELECT dst, src FROM s),
r AS (SELECT src AS id, src AS far FROM u UNION SELECT id, dst FROM r JOIN u ON src = far) SELECT id, min(far) AS label FROM r GROUP BY 1""",
}

def _rounds_sql(scheme: str, rounds: int) -> str:
    """Rounds from fixed vectors, eigenvalues 0.1 to 0.4 and a keyed start of five classes."""
    pick, parts = (0.1, 6) if scheme == "finite_difference" else (0.2, 1)
    filt = {"projection": "exp(-0.5 * l * dt)", "boyd": "exp(-l * dt)"}.get(scheme, "1 / (1 + dt * l)")
    sql = f"""{PTS}, u AS (SELECT id, v, 1.0 + id % 5 AS d FROM p), l0 AS (SELECT id, ({_key('id', 7)} % 5)::INT AS label FROM p),
t AS (SELECT sqrt(0.15 / (1.5 * max(d)) * ln(sqrt(count(*) * 5)) / {pick}) / {parts} AS dt, sum(d) AS total FROM u),
j AS (SELECT range::INT + 1 AS j, (range + 1) / 10.0 AS l FROM range(4)), f AS (SELECT j, {filt} AS f FROM j, t),
k AS (SELECT range::INT AS k FROM range(5)), s AS (SELECT j, sum(d * v[j]) AS vd FROM u, j GROUP BY j), g AS (SELECT 2 * 0.5 * dt AS g FROM t),
gg AS (SELECT a.j AS a, b.j AS b, sum(d * v[a.j] * v[b.j]) AS g FROM u, j a, j b GROUP BY a.j, b.j)"""
    for r in range(1, rounds + 1):
        sql += f""", e{r} AS (SELECT id, d, j, v[j] AS x, k, CASE WHEN label = k THEN 1.0 ELSE -1.0 END AS y FROM u JOIN l{r - 1} USING (id), j, k),
c{r}_0 AS (SELECT j, k, sum(x * y) AS vw, sum(d * x * y) AS vdc FROM e{r} GROUP BY j, k)"""
        if scheme == "hu":
            sql += f", n{r}_0 AS (SELECT k, sum(d * y) / any_value(total) AS m FROM e{r}, t WHERE j = 1 GROUP BY k)"
            for i in (1, 2, 3):
                sql += f""", w{r}_{i} AS (SELECT j, k, vw + g.g * (vdc - vd * m) AS vw FROM c{r}_{i - 1} JOIN s USING (j) JOIN n{r}_{i - 1} USING (k), g),
h{r}_{i} AS (SELECT j, k, f * vw AS c FROM w{r}_{i} JOIN f USING (j)),
n{r}_{i} AS (SELECT k, sum(vd * c) / any_value(total) AS m FROM h{r}_{i} JOIN s USING (j), t GROUP BY k),
c{r}_{i} AS (SELECT j, k, vw, vdc FROM w{r}_{i} JOIN (SELECT a AS j, k, sum(g * c) AS vdc FROM gg JOIN h{r}_{i} h ON gg.b = h.j GROUP BY a, k) USING (j, k))"""
            sql += f", c{r} AS (SELECT j, k, c FROM h{r}_3)"
        else:
            sql += f", c{r} AS (SELECT j, k, f * vw AS c FROM c{r}_0 JOIN f USING (j))"
        sql += f""", l{r} AS (SELECT id, k AS label FROM (SELECT id, k, sum(v[j] * c) AS w FROM u, c{r} GROUP BY id, k) QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, k) = 1)"""
    return f"{sql} SELECT id, label FROM l{rounds}"


for _name in ("projection", "finite_difference", "hu", "boyd"):
    ORACLES[f"mbo_round_{_name}"] = _rounds_sql(_name, 1)
    ORACLES[f"mbo_rounds_{_name}"] = _rounds_sql(_name, 4)


def _moves_sql(rounds: int) -> str:
    """Rounds of local moves on the trade graph, from single nodes; even rounds move nodes of even keys."""
    sql = f"{G}, l0 AS (SELECT id, id AS label FROM d)"
    for r in range(1, rounds + 1):
        b = r - 1
        sql += f""", c{r} AS (SELECT label, sum(d)::DOUBLE AS dc FROM l{b} JOIN d USING (id) GROUP BY label),
k{r} AS (SELECT src AS id, label AS cand, sum(w)::DOUBLE AS k FROM e JOIN l{b} ON dst = id GROUP BY src, label),
s{r} AS (SELECT l.id, l.label, d.d::DOUBLE AS d, tot, coalesce(k, 0) - d.d * (dc - d.d) / tot AS stay FROM l{b} l JOIN d USING (id) JOIN c{r} USING (label) LEFT JOIN k{r} ON k{r}.id = l.id AND cand = l.label, t),
b{r} AS (SELECT s.id, cand FROM s{r} s JOIN k{r} USING (id) JOIN c{r} c ON c.label = cand WHERE cand <> s.label AND k - d * dc / tot - stay > 1e-9 AND {_key('s.id', 5)} % 2 = {b % 2}
  QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY round(k - d * dc / tot - stay, 9) DESC, cand) = 1),
l{r} AS (SELECT id, coalesce(cand, label) AS label FROM l{b} LEFT JOIN b{r} USING (id))"""
    return f"{sql} SELECT id, label FROM l{rounds}"


ORACLES["louvain_moves"] = _moves_sql(4)
ORACLES["projection_codes"] = f"""{PTS}, c AS (SELECT id, unnest(v) AS x, unnest(range(len(v))) AS i FROM p), m AS (SELECT i, avg(x) AS m FROM c GROUP BY i),
b AS (SELECT greatest(1, ceil(log2(count(*) / 16.0)))::INT AS bits FROM p),
h AS (SELECT t.range AS t, b.range AS b, i, {_key("(t.range || '-' || b.range || '-' || i)", 7)} / 4294967296.0::DOUBLE - 0.5 AS h FROM range(2) t, range(64) b, m WHERE b.range <= (SELECT bits FROM b)),
s AS (SELECT id, t, b, sum((x - m) * h) AS s FROM c JOIN m USING (i) JOIN h USING (i) GROUP BY id, t, b)
SELECT id, t::INT AS "table", sum(CASE WHEN s > 0 AND b < bits THEN 1 << b ELSE 0 END)::BIGINT AS code, {_six('max(CASE WHEN b = bits THEN s END)')} AS along FROM s, b GROUP BY id, t"""


def _betweenness_sql(levels: int) -> str:
    """Paths counted level by level and shares flowing back, for graphs of at most so many levels."""
    sql = f"{G}, h AS (SELECT src, dst FROM e WHERE w > (SELECT avg(w) FROM e)), l0 AS (SELECT DISTINCT src AS s, src AS id, 1.0::DOUBLE AS n FROM h)"
    for i in range(1, levels + 1):
        known = " UNION ALL ".join(f"SELECT s, id FROM l{j}" for j in range(i))
        sql += f", l{i} AS (SELECT s, dst AS id, sum(n) AS n FROM l{i - 1} JOIN h ON src = id WHERE (s, dst) NOT IN ({known}) GROUP BY s, dst)"
    sql += f", f{levels} AS (SELECT s, id, 1.0::DOUBLE AS f, n FROM l{levels})"
    for i in range(levels, 0, -1):
        sql += f""", b{i} AS (SELECT x.s, src, dst, y.n * x.f / x.n AS p FROM f{i} x JOIN h ON dst = x.id JOIN l{i - 1} y ON y.s = x.s AND y.id = src),
f{i - 1} AS (SELECT l.s, l.id, 1 + coalesce(sum(p), 0) AS f, any_value(l.n) AS n FROM l{i - 1} l LEFT JOIN b{i} b ON b.s = l.s AND b.src = l.id GROUP BY l.s, l.id)"""
    every = " UNION ALL ".join(f"SELECT src, dst, p FROM b{i}" for i in range(1, levels + 1))
    return f"{sql} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, {_six('sum(p) / 2')} AS paths FROM ({every}) GROUP BY 1, 2"


ORACLES["edge_betweenness"] = _betweenness_sql(6)


def _merges_sql(graph: str, merges: int) -> str:
    """Greedy merges one after the other, as many as a graph of merges + 1 nodes can take, from (src, dst, w)."""
    sql = f"""{G}, p0 AS (SELECT src, dst, w::DOUBLE AS w FROM ({graph})), z AS (SELECT sum(w) AS tot FROM p0),
s0 AS (SELECT src AS id, sum(w) AS d FROM p0 GROUP BY src), l0 AS (SELECT id, id AS label FROM s0)"""
    for r in range(1, merges + 1):
        b = r - 1
        to = lambda c, r=r: f"CASE WHEN {c} = (SELECT b FROM b{r}) THEN (SELECT a FROM b{r}) ELSE {c} END"
        sql += f""", b{r} AS MATERIALIZED (SELECT src AS a, dst AS b FROM p{b} JOIN s{b} x ON x.id = src JOIN s{b} y ON y.id = dst, z
  WHERE src < dst AND w * z.tot - x.d * y.d > 5e-13 * z.tot * z.tot ORDER BY w * z.tot - x.d * y.d DESC, src, dst LIMIT 1),
p{r} AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT {to('src')} AS src, {to('dst')} AS dst, w FROM p{b}) WHERE src <> dst GROUP BY 1, 2),
s{r} AS MATERIALIZED (SELECT {to('id')} AS id, sum(d) AS d FROM s{b} GROUP BY 1), l{r} AS MATERIALIZED (SELECT id, {to('label')} AS label FROM l{b})"""
    return f"{sql} SELECT id, min(id) OVER (PARTITION BY label) AS label FROM l{merges}"


_STRONG = "SELECT src, dst, w FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) <= 3"
ORACLES["cnm"] = _merges_sql("SELECT src, dst, w FROM e", 24)
ORACLES["cnm_batches"] = _merges_sql(f"SELECT src, dst, w FROM ({_STRONG}) UNION SELECT dst, src, w FROM ({_STRONG})", 24)


def _power_sql(steps: int, rounds: int, k: int) -> str:
    sql = f"{G}, x0 AS (SELECT id, d / tot AS x FROM d, t)"
    for i in range(1, steps + 1):
        sql += f""", y{i} AS (SELECT src AS id, sum(w * x) / any_value(d.d) AS y FROM e JOIN x{i - 1} x ON dst = x.id JOIN d ON d.id = src GROUP BY src),
x{i} AS (SELECT id, y / (SELECT sum(y) FROM y{i}) AS x FROM y{i})"""
    sql += f", c0 AS (SELECT range::INT AS i, lo + (range + 0.5::DOUBLE) / {k} * (hi - lo) AS c FROM range({k}), (SELECT min(x) AS lo, max(x) AS hi FROM x{steps}))"
    near = lambda r: f"SELECT id, x, i FROM x{steps}, c{r} QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(abs(x - c), 12), i) = 1"
    for r in range(1, rounds + 1):
        sql += f", c{r} AS (SELECT i, coalesce(m, c) AS c FROM c{r - 1} LEFT JOIN (SELECT i, avg(x) AS m FROM ({near(r - 1)}) GROUP BY i) USING (i))"
    return f"{sql} SELECT id, i AS label FROM ({near(rounds)})"


ORACLES["power_clusters"] = _power_sql(6, 5, 5)
