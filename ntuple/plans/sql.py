"""SQL building blocks for checking the queries: the same computations in long form.

Everything is written as joins and aggregates over (row, bit) or (row, label, tuple)
relations, unlike the array expressions and constants of the Spark side.
"""

from __future__ import annotations


def chain(*ctes: str, final: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes if c) + "\n" + final


# -- inputs: xs(row_id, label, f, v) ------------------------------------------

VECTORS = """
xs AS (SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS label, CAST(f AS INTEGER) AS f,
              CAST(embedding[f + 1] AS DOUBLE) AS v
       FROM embeddings, range(64) AS t(f))"""


def documents(join: str = "JOIN") -> str:
    return f"""
docs AS (SELECT d.doc_id AS row_id, CAST(l.quality AS VARCHAR) AS label,
                CAST(n_chars AS DOUBLE) AS x0,
                length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / CAST(n_chars AS DOUBLE) AS x1,
                len(list_distinct(string_split(text, ' '))) / CAST(len(string_split(text, ' ')) AS DOUBLE) AS x2,
                CAST(len(string_split(text, ' ')) AS DOUBLE) AS x3
         FROM documents d {join} labels l ON d.doc_id = l.doc_id),
xs AS (SELECT row_id, label, 0 AS f, x0 AS v FROM docs UNION ALL SELECT row_id, label, 1, x1 FROM docs
       UNION ALL SELECT row_id, label, 2, x2 FROM docs UNION ALL SELECT row_id, label, 3, x3 FROM docs)"""


DOCUMENTS = documents()

LINES = """
li AS (SELECT row_number() OVER () AS row_id, l_returnflag || l_linestatus AS label,
              l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
xs AS (SELECT row_id, label, 0 AS f, l_quantity AS v FROM li
       UNION ALL SELECT row_id, label, 1, l_extendedprice FROM li
       UNION ALL SELECT row_id, label, 2, l_discount FROM li
       UNION ALL SELECT row_id, label, 3, l_tax FROM li)"""

ORDERS = """
od AS (SELECT o_orderkey AS row_id, o_totalprice AS y, CAST(o_custkey AS DOUBLE) AS x0,
              CAST(month(o_orderdate) AS DOUBLE) AS x1, CAST(day(o_orderdate) AS DOUBLE) AS x2,
              coalesce(TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE), 0) AS x3 FROM orders),
xs AS (SELECT row_id, y, 0 AS f, x0 AS v FROM od UNION ALL SELECT row_id, y, 1, x1 FROM od
       UNION ALL SELECT row_id, y, 2, x2 FROM od UNION ALL SELECT row_id, y, 3, x3 FROM od)"""

EVENT_POINTS = """
ev AS (SELECT event_id AS row_id, ts, user_id, event_type AS label, value,
              (hour(ts) * 60 + minute(ts)) / 60.0::DOUBLE AS hour FROM events)"""


# -- bits(row_id, ..., i, b) --------------------------------------------------


def bits_from(thresholds: str, columns: str = "row_id, label") -> str:
    """``thresholds`` is a relation (f, k, t); bits are numbered feature-major."""
    return f"""
thr AS ({thresholds}),
bits AS (SELECT {columns}, p.i, CASE WHEN x.v > p.t THEN 1 ELSE 0 END AS b
         FROM xs x JOIN (SELECT f, t, CAST(row_number() OVER (ORDER BY f, k) - 1 AS INTEGER) AS i FROM thr) p
         ON x.f = p.f)"""


VECTOR_THRESHOLDS = (
    "SELECT CAST(f AS INTEGER) AS f, k, CAST(-0.5 AS DOUBLE) + k * (CAST(1.0 AS DOUBLE) / 2) AS t "
    "FROM range(64) a(f), range(2) b(k)"
)
VECTOR_BITS = bits_from(VECTOR_THRESHOLDS)

LINE_THRESHOLDS = (
    "SELECT f, k, CAST(0 AS DOUBLE) + k * (hi / 8) AS t FROM "
    "(VALUES (0, CAST(50 AS DOUBLE)), (1, CAST(100000 AS DOUBLE)), (2, CAST(0.1 AS DOUBLE)), "
    "(3, CAST(0.08 AS DOUBLE))) r(f, hi), range(8) b(k)"
)


# -- mapping: map([label,] ram, pos, i) ---------------------------------------


def shared_mapping(n_bits: int, size: int, seed: int, complete: bool = True, name: str = "map") -> str:
    rest = n_bits % size
    out = f"""
{name} AS (SELECT CAST((rn - 1) // {size} AS INTEGER) AS ram, CAST((rn - 1) % {size} AS INTEGER) AS pos, i
        FROM (SELECT CAST(i AS INTEGER) AS i, row_number() OVER (ORDER BY md5('{seed}:' || i)) AS rn
              FROM range({n_bits}) t(i))"""
    if rest and complete:
        out += f"""
        UNION ALL SELECT {n_bits // size}, CAST({rest} + j AS INTEGER),
               CAST(('0x' || substr(md5('{seed}:pad:' || j), 1, 12))::BIGINT % {n_bits} AS INTEGER)
        FROM range({size - rest}) p(j)"""
    elif rest:
        out += f"\n        WHERE rn <= {n_bits - rest}"
    return out + ")"


def label_mapping(n_bits: int, size: int, seed: int, labels: str, complete: bool = True) -> str:
    """One mapping per label; ``labels`` is a relation with a label column."""
    rest = n_bits % size
    out = f"""
map AS (SELECT label, CAST((rn - 1) // {size} AS INTEGER) AS ram, CAST((rn - 1) % {size} AS INTEGER) AS pos, i
        FROM (SELECT l.label, CAST(i AS INTEGER) AS i,
                     row_number() OVER (PARTITION BY l.label ORDER BY md5('{seed}:' || l.label || ':' || i)) AS rn
              FROM ({labels}) l, range({n_bits}) t(i))"""
    if rest and complete:
        out += f"""
        UNION ALL SELECT l.label, {n_bits // size}, CAST({rest} + j AS INTEGER),
               CAST(('0x' || substr(md5('{seed}:' || l.label || ':pad:' || j), 1, 12))::BIGINT % {n_bits} AS INTEGER)
        FROM ({labels}) l, range({size - rest}) p(j)"""
    elif rest:
        out += f"\n        WHERE rn <= {n_bits - rest}"
    return out + ")"


# -- addresses, model, votes --------------------------------------------------

ADDRESSES = """
addr AS (SELECT row_id, label, ram, CAST(sum(b << pos) AS BIGINT) AS a
         FROM bits JOIN map USING (i) GROUP BY row_id, label, ram)"""

MODEL = """
model AS (SELECT label, ram, a, count(*) AS c FROM addr GROUP BY label, ram, a)"""

LABELS = """
labels_ AS (SELECT label, count(DISTINCT row_id) AS trained FROM addr WHERE label IS NOT NULL GROUP BY label)"""

VOTES = """
votes AS (SELECT q.row_id, q.label AS truth, l.label, q.ram, coalesce(m.c, 0) AS v
          FROM addr q CROSS JOIN labels_ l
          LEFT JOIN model m ON m.label = l.label AND m.ram = q.ram AND m.a = q.a)"""

CLASSIFIER = ADDRESSES + "," + MODEL + "," + LABELS + "," + VOTES

LABEL_CLASSIFIER = """
own AS (SELECT x.row_id, x.label AS truth, m.label, m.ram, CAST(sum(x.b << m.pos) AS BIGINT) AS a
        FROM bits x JOIN map m ON x.i = m.i GROUP BY x.row_id, x.label, m.label, m.ram),
model AS (SELECT label, ram, a, count(*) AS c FROM own WHERE truth = label GROUP BY label, ram, a),
votes AS (SELECT q.row_id, q.truth, q.label, q.ram, coalesce(m.c, 0) AS v
          FROM own q LEFT JOIN model m ON m.label = q.label AND m.ram = q.ram AND m.a = q.a)"""


# -- decision: scores(row_id, truth, label, s) --------------------------------

HITS = "CASE WHEN v > t THEN 1 ELSE 0 END"
EXCESS = "CASE WHEN v > t THEN v - t ELSE 0 END"


def bleaching(part: str = HITS, source: str = "votes", confidence: int = 1) -> str:
    """Smallest threshold of the row at which no later label comes close to the first best one."""
    return f"""
cand AS MATERIALIZED (SELECT DISTINCT row_id, v AS t FROM {source} WHERE v > 0 UNION SELECT DISTINCT row_id, 0 FROM {source}),
sc AS MATERIALIZED (SELECT row_id, truth, t, label, CAST(trunc(sum({part})) AS BIGINT) AS s
       FROM {source} JOIN cand USING (row_id) GROUP BY row_id, truth, t, label),
top AS MATERIALIZED (SELECT row_id, t, max(s) AS m FROM sc GROUP BY row_id, t),
lead_ AS MATERIALIZED (SELECT row_id, t, m, min(label) AS first FROM sc JOIN top USING (row_id, t) WHERE s = m GROUP BY row_id, t, m),
open_ AS MATERIALIZED (SELECT row_id, t, m > 1 AND bool_or(label > first AND m - s < {confidence}) AS open
          FROM sc JOIN lead_ USING (row_id, t) GROUP BY row_id, t, m),
pick AS MATERIALIZED (SELECT row_id, min(t) AS t FROM open_ WHERE NOT open GROUP BY row_id),
scores AS MATERIALIZED (SELECT row_id, truth, label, s FROM sc JOIN pick USING (row_id, t))"""


def winner(source: str = "scores", direction: str = "DESC") -> str:
    """Best score; the last (DESC) or first (ASC) label wins ties; all negative is ''."""
    return f"""
won AS (SELECT row_id, truth, CASE WHEN s < 0 THEN '' ELSE label END AS predicted
        FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, label {direction}) AS r FROM {source})
        WHERE r = 1)"""


PREDICTED = "SELECT row_id, truth AS label, predicted FROM won"
RANKED = "SELECT row_id, label AS candidate, s AS score FROM scores"
CONFUSION = "SELECT truth AS label, predicted, count(*) AS n FROM won GROUP BY truth, predicted"
