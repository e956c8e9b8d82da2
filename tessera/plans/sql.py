"""Pieces of SQL that the catalogue's statements are put together from."""

from __future__ import annotations

from tessera.functions.text import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in ("", *STOP_WORDS))


def words(table: str, doc: str) -> str:
    return f"""WITH w AS (SELECT doc, term FROM (
      SELECT {doc} AS doc, unnest(string_split(translate(lower(text), '([,.!?:;])' || chr(10) || chr(92), '            '), ' ')) AS term FROM {table})
    WHERE term NOT IN ({_STOP})) """


TFIDF = (
    words("documents", "source").rstrip()
    + """,
counts AS (SELECT doc, term, count(*) AS n FROM w GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM counts GROUP BY 1),
idf AS (SELECT term, log2(CAST((SELECT count(DISTINCT doc) FROM counts) AS DOUBLE) / df) AS idf FROM df),
tf AS (SELECT doc, term, CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY doc) AS tf FROM counts),
ti AS (SELECT doc, term, round(tf * idf, 6) AS tfidf FROM tf JOIN idf USING (term)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY tfidf DESC, term) AS r FROM ti)
"""
)

PROFILES = (
    TFIDF.rstrip().replace("{", "{{").replace("}", "}}")
    + """,
prof AS (SELECT doc, term FROM ranked WHERE r <= {k}),
own AS (SELECT DISTINCT doc_id % 50 AS "user", source AS doc FROM documents WHERE source IN (SELECT doc FROM prof)),
up AS (SELECT "user", term, CAST(count(*) AS DOUBLE) / any_value(nd) AS weight
       FROM own JOIN prof USING (doc) JOIN (SELECT "user", count(*) AS nd FROM own GROUP BY 1) USING ("user") GROUP BY 1, 2)
"""
)

ITEMSETS = """WITH b AS MATERIALIZED (SELECT DISTINCT l_orderkey AS key, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT ceil({share} * (SELECT count(DISTINCT key) FROM b)) AS s),
f1 AS (SELECT item AS items, CAST(1 AS INTEGER) AS size, count(*) AS support FROM b GROUP BY 1 HAVING count(*) >= (SELECT s FROM s)),
f2 AS (SELECT a.item || ',' || b.item AS items, CAST(2 AS INTEGER) AS size, count(*) AS support
       FROM b a JOIN b ON a.key = b.key AND a.item < b.item GROUP BY 1 HAVING count(*) >= (SELECT s FROM s)),
f3 AS (SELECT a.item || ',' || b.item || ',' || c.item AS items, CAST(3 AS INTEGER) AS size, count(*) AS support
       FROM b a JOIN b ON a.key = b.key AND a.item < b.item JOIN b c ON c.key = a.key AND b.item < c.item GROUP BY 1 HAVING count(*) >= (SELECT s FROM s)),
f4 AS (SELECT a.item || ',' || b.item || ',' || c.item || ',' || d.item AS items, CAST(4 AS INTEGER) AS size, count(*) AS support
       FROM b a JOIN b ON a.key = b.key AND a.item < b.item JOIN b c ON c.key = a.key AND b.item < c.item
       JOIN b d ON d.key = a.key AND c.item < d.item GROUP BY 1 HAVING count(*) >= (SELECT s FROM s))
"""


def pearson(item: str, id: str, other: str) -> str:
    """``model`` of ids by what they rated; ``rt`` holds the ratings (user, item, rating) with this item."""
    return f"""WITH rt AS (SELECT o_custkey AS "user", {item} AS item, CAST(l_quantity AS DOUBLE) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
one AS (SELECT {id} AS id, {other} AS other, avg(CAST(l_quantity AS DOUBLE)) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
sums AS (SELECT a.id AS id1, b.id AS id2, count(*) AS common, sum(a.r) AS sx, sum(b.r) AS sy, sum(a.r * b.r) AS sxy, sum(a.r * a.r) AS sxx, sum(b.r * b.r) AS syy
         FROM one a JOIN one b ON a.other = b.other AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= 3),
v AS (SELECT id1, id2, common, sxy - sx * sy / common AS cov, greatest(round(sxx - sx * sx / common, 9), 0) AS vx, greatest(round(syy - sy * sy / common, 9), 0) AS vy FROM sums),
model AS (SELECT id1, id2, common, round(CASE WHEN sqrt(vx * vy) = 0 THEN -1 ELSE cov / sqrt(vx * vy) END, 6) AS sim FROM v
          WHERE CASE WHEN sqrt(vx * vy) = 0 THEN -1 ELSE cov / sqrt(vx * vy) END >= 0.0000005),
both_ways AS (SELECT id1 AS x, id2 AS y, sim FROM model UNION ALL SELECT id2, id1, sim FROM model)
"""


def predict_items(k: int, normalized: bool) -> str:
    score = "sum(sim * rating) / sum(sim)" if normalized else "sum(sim * rating)"
    return (
        pearson("l_suppkey", "l_suppkey", "o_custkey").rstrip()
        + f""",
want AS (SELECT DISTINCT "user", item FROM rt),
near AS (SELECT w."user", w.item, r.rating, sim, row_number() OVER (PARTITION BY w."user", w.item ORDER BY sim DESC, r.item, r.rating) AS k
         FROM want w JOIN rt r ON r."user" = w."user" JOIN both_ways m ON m.x = w.item AND m.y = r.item),
scored AS (SELECT "user", item, {score} AS score FROM near WHERE k <= {k} GROUP BY 1, 2),
means AS (SELECT item, avg(rating) AS mean FROM rt GROUP BY 1)
SELECT "user", item, round(coalesce(score, mean, (SELECT avg(mean) FROM means)), {4 if normalized else 6}) AS prediction
FROM want LEFT JOIN scored USING ("user", item) LEFT JOIN means USING (item)"""
    )


def predict_users(k: int) -> str:
    return (
        pearson("l_partkey", "o_custkey", "l_partkey").rstrip()
        + f""",
want AS (SELECT DISTINCT "user", item FROM rt),
means AS (SELECT "user", avg(rating) AS mean FROM rt GROUP BY 1),
near AS (SELECT w."user", w.item, r.rating - m.mean AS rating, sim,
                row_number() OVER (PARTITION BY w."user", w.item ORDER BY sim DESC, r."user", r.rating) AS k
         FROM want w JOIN rt r ON r.item = w.item JOIN both_ways b ON b.x = w."user" AND b.y = r."user" JOIN means m ON m."user" = r."user"),
scored AS (SELECT "user", item, sum(sim * rating) / sum(sim) AS score FROM near WHERE k <= {k} GROUP BY 1, 2)
SELECT "user", item, round(coalesce(score, 0) + coalesce(mean, (SELECT avg(mean) FROM means)), 4) AS prediction
FROM want LEFT JOIN scored USING ("user", item) LEFT JOIN means USING ("user")"""
    )


EDGES = """WITH RECURSIVE u AS (SELECT DISTINCT o_custkey AS id, l_partkey AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
once AS MATERIALIZED (SELECT a.id AS src, b.id AS dst FROM u a JOIN u b ON a.item = b.item AND a.id < b.id GROUP BY 1, 2 HAVING count(*) >= {t}),
e AS MATERIALIZED (SELECT src, dst FROM once UNION ALL SELECT dst, src FROM once)
"""


def label_propagation(edges: str, rounds: int, end: str = "SELECT id, label FROM {last}") -> str:
    out = edges.rstrip() + ",\nl0 AS MATERIALIZED (SELECT DISTINCT src AS id, src AS label FROM e)"
    for i in range(rounds):
        out += f""",
l{i + 1} AS MATERIALIZED (SELECT id, label FROM (SELECT src AS id, label, row_number() OVER (PARTITION BY src ORDER BY n DESC, label) AS r
  FROM (SELECT e.src, l.label, count(*) AS n FROM e JOIN l{i} l ON l.id = e.dst GROUP BY 1, 2)) WHERE r = 1)"""
    return out + "\n" + end.format(last=f"l{rounds}")


#: Distances by walks of distinct (root, vertex, length), then counts of the paths along them.
BFS = """, walk AS (SELECT DISTINCT src AS root, src AS id, 0 AS level FROM e
  UNION SELECT w.root, e.dst, w.level + 1 FROM walk w JOIN e ON e.src = w.id WHERE w.level < 40),
dist AS MATERIALIZED (SELECT root, id, min(level) AS level FROM walk GROUP BY 1, 2),
path AS (SELECT DISTINCT src AS root, src AS id, 0 AS level FROM e
  UNION ALL SELECT p.root, e.dst, p.level + 1 FROM path p JOIN e ON e.src = p.id JOIN dist d ON d.root = p.root AND d.id = e.dst AND d.level = p.level + 1),
sigma AS MATERIALIZED (SELECT root, id, level, count(*) AS n_paths FROM path GROUP BY 1, 2, 3)
"""

BETWEENNESS = """SELECT least(e.src, e.dst) AS a, greatest(e.src, e.dst) AS b,
  round(sum(CAST(su.n_paths AS DOUBLE) * vt.n_paths / st.n_paths) / 2, 6) AS betweenness
FROM e JOIN sigma su ON su.id = e.src JOIN sigma vt ON vt.root = e.dst JOIN sigma st ON st.root = su.root AND st.id = vt.id AND st.level = su.level + 1 + vt.level
GROUP BY 1, 2"""

REACH = """, reach AS (SELECT DISTINCT src AS id, src AS other FROM e UNION SELECT r.id, e.dst FROM reach r JOIN e ON e.src = r.other),
comp AS MATERIALIZED (SELECT id, min(other) AS component FROM reach GROUP BY 1)
"""

MODULARITY = """, deg AS (SELECT src AS id, count(*) AS k FROM e GROUP BY 1), m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM e),
pairs AS (SELECT sum(CAST(x.k AS DOUBLE) * y.k) AS kk FROM deg x JOIN comp a ON a.id = x.id JOIN deg y ON x.id < y.id JOIN comp b ON b.id = y.id WHERE a.component = b.component),
inside AS (SELECT count(*) AS n FROM once JOIN comp a ON a.id = src JOIN comp b ON b.id = dst WHERE a.component = b.component)
SELECT round((n - kk / m) / m, 6) AS modularity FROM pairs, inside, m"""

POINTS = """WITH x AS MATERIALIZED (SELECT vec_id AS point_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
"""

Z = """, st AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY 1),
z AS (SELECT point_id, dim, CASE WHEN s > 0 THEN (x - m) / s ELSE 0.0 END AS z FROM x JOIN st USING (dim))
"""

NEAREST = """, c AS (SELECT CAST(label AS INTEGER) AS cluster_id, dim, avg(x) AS c FROM x GROUP BY 1, 2),
d AS (SELECT point_id, any_value(label) AS label, cluster_id, sqrt(sum((x - c) * (x - c))) AS distance FROM x JOIN c USING (dim) GROUP BY point_id, cluster_id),
near AS MATERIALIZED (SELECT point_id, label, cluster_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, cluster_id) AS r FROM d) WHERE r = 1)
"""

NMI = """, cells AS (SELECT label AS l1, cluster_id AS l2, CAST(count(*) AS DOUBLE) AS c FROM near GROUP BY 1, 2), t AS (SELECT sum(c) AS n FROM cells),
a AS (SELECT l1, sum(c) AS x FROM cells GROUP BY 1), b AS (SELECT l2, sum(c) AS y FROM cells GROUP BY 1),
h1 AS (SELECT -sum(x / n * ln(x / n)) AS h FROM a, t), h2 AS (SELECT -sum(y / n * ln(y / n)) AS h FROM b, t),
mi AS (SELECT sum(c / n * ln(c * n / (x * y))) AS v FROM cells JOIN a USING (l1) JOIN b USING (l2), t)
SELECT round(v / ((h1.h + h2.h) / 2), 6) AS nmi FROM mi, h1, h2"""
