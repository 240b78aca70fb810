"""SQL twins of the catalogue, for an engine that shares nothing with Spark.

Written from the definitions, not from the plans: training is unrolled, box
extension is a filter over all unprobed clusters.
"""

from __future__ import annotations

from votegrid.plans import fixtures as fx
from votegrid.plans.config import CATEGORY_RISK, DIM, FLAG_LANES

_V = ", ".join(f"v[{k + 1}] AS v{k}" for k in range(DIM))
_L2 = fx.l2_sql
_FLAGS = fx.flags_sql

ISO_PARTS = """
SELECT event_id, CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(day(ts) AS BIGINT) AS day,
       CAST(hour(ts) AS BIGINT) AS hour, CAST(minute(ts) AS BIGINT) AS minute, CAST(epoch_us(ts) // 1000000 % 60 AS BIGINT) AS second,
       CAST(isodow(ts) - 1 AS BIGINT) AS weekday, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS epoch FROM events"""

VECTORIZE = f"""WITH {fx.REQUESTS_SQL}, X AS (SELECT request_id, [{fx.REQUEST_VECTORS_SQL}] AS v FROM T)
SELECT request_id, {_V} FROM X"""

REFS = f"WITH {fx.VECTORS_SQL} SELECT record_index, CAST(label AS BIGINT) AS label, {_V} FROM R"


def _ranked(source: str, order: str, k: int = 5) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM ({source})) WHERE rank <= {k}"


_PAIRS = f"SELECT query_id, record_index, label, {_L2('Q.v', 'R.v')} AS distance FROM Q, R"
_EXACT = f"X5 AS ({_ranked(_PAIRS, 'distance, record_index')})"
_FILTERED_PAIRS = f"{_PAIRS} WHERE {_FLAGS('Q.v', 'R.v')}"
_FILTERED = f"F5 AS ({_ranked(_FILTERED_PAIRS, 'distance, record_index')})"

EXACT_TOPK = f"WITH {fx.VECTORS_SQL}, {_EXACT} SELECT query_id, CAST(rank AS BIGINT) AS rank, record_index, distance FROM X5"
FRAUD_SCORE = f"""WITH {fx.VECTORS_SQL}, {_EXACT}
SELECT query_id, CAST(sum(label) AS BIGINT) AS votes, CAST(sum(label) AS DOUBLE) / count(*) AS fraud_score,
       CAST(sum(label) AS DOUBLE) / count(*) < 0.5 AS approved FROM X5 GROUP BY query_id"""
RESPONSE_BODY = f"""WITH {fx.VECTORS_SQL}, {_EXACT}, S AS (SELECT query_id, sum(label) AS n FROM X5 GROUP BY query_id)
SELECT query_id, CASE n WHEN 0 THEN '{{"approved":true,"fraud_score":0.0}}' WHEN 1 THEN '{{"approved":true,"fraud_score":0.2}}'
  WHEN 2 THEN '{{"approved":true,"fraud_score":0.4}}' WHEN 3 THEN '{{"approved":false,"fraud_score":0.6}}'
  WHEN 4 THEN '{{"approved":false,"fraud_score":0.8}}' WHEN 5 THEN '{{"approved":false,"fraud_score":1.0}}' END AS body FROM S"""
FILTERED_TOPK = f"WITH {fx.VECTORS_SQL}, {_FILTERED} SELECT query_id, CAST(rank AS BIGINT) AS rank, record_index, distance FROM F5"


def topk_among(filtered: bool) -> str:
    where = "(query_id + record_index) % 7 = 0" + (f" AND {_FLAGS('Q.v', 'R.v')}" if filtered else "")
    return f"""WITH {fx.VECTORS_SQL}, C AS ({_ranked(f'{_PAIRS} WHERE {where}', 'distance, record_index DESC')})
SELECT query_id, CAST(rank AS BIGINT) AS rank, record_index, distance FROM C"""


_RISKS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in CATEGORY_RISK.items())
CATEGORY = f"""WITH M AS (SELECT event_id, right(lpad(CAST(event_id AS VARCHAR), 4, '5'), 4) AS mcc FROM events
  UNION ALL SELECT event_id, '7995' FROM events)
SELECT event_id, mcc, CAST(CASE mcc {_RISKS} ELSE 0.5 END AS DOUBLE) AS risk, CAST(CASE mcc {_RISKS} ELSE 0.5 END AS DOUBLE) AS risk_by_number FROM M"""

STRIDED = f"""WITH {fx.VECTORS_SQL}, N AS (SELECT count(*) AS n FROM R),
P AS (SELECT CAST(i AS BIGINT) AS sample_no, CASE WHEN n <= 100 THEN i ELSE least(n - 1, CAST(floor(i * (CAST(n AS DOUBLE) / 100.0)) AS BIGINT)) END AS spot
      FROM N, (SELECT unnest(range(0, 100)) AS i) WHERE i < n)
SELECT sample_no, record_index, {_V} FROM P JOIN R ON record_index = spot"""

# --- training, unrolled ------------------------------------------------------------


def _assignment(name: str, centroids: str) -> str:
    return f"""{name} AS (SELECT record_index, cluster_id, d FROM (
  SELECT record_index, cluster_id, d, row_number() OVER (PARTITION BY record_index ORDER BY d, cluster_id) AS rn
  FROM (SELECT record_index, cluster_id, {_L2('R.v', 'c.v')} AS d FROM R, {centroids} c)) WHERE rn = 1)"""


def _means(name: str, before: str, assigned: str) -> str:
    cut = "[" + ", ".join(f"sum(R.v[{k + 1}]) // count(*)" for k in range(DIM)) + "]"
    return f"""{name} AS (SELECT c.cluster_id, CASE WHEN m.v IS NULL THEN c.v ELSE m.v END AS v FROM {before} c LEFT JOIN (
  SELECT cluster_id, [{', '.join(f'CAST(x[{k + 1}] AS BIGINT)' for k in range(DIM))}] AS v FROM (
    SELECT cluster_id, {cut} AS x FROM {assigned} JOIN R USING (record_index) GROUP BY cluster_id)) m ON m.cluster_id = c.cluster_id)"""


def _trained(clusters: int, rounds: int = 2) -> str:
    steps = [f"""N AS (SELECT count(*) AS n FROM R),
C0 AS (SELECT CAST(c AS BIGINT) AS cluster_id, v FROM N, (SELECT unnest(range(0, {clusters})) AS c), R WHERE record_index = c * n // {clusters})"""]
    for k in range(rounds):
        steps += [_assignment(f"A{k}", f"C{k}"), _means(f"C{k + 1}", f"C{k}", f"A{k}")]
    steps += [f"C AS (SELECT * FROM C{rounds})", _assignment("A", "C")]
    return ",\n".join(steps)


_INDEX = f"""Z AS (SELECT C.cluster_id, count(record_index) AS size FROM C LEFT JOIN A ON A.cluster_id = C.cluster_id GROUP BY C.cluster_id),
O AS (SELECT cluster_id, size, CAST(sum(size) OVER (ORDER BY cluster_id) - size AS BIGINT) AS first_position FROM Z),
M AS (SELECT A.record_index, A.cluster_id, R.label, R.v,
             first_position + row_number() OVER (PARTITION BY A.cluster_id ORDER BY A.record_index) - 1 AS ordered_pos
      FROM A JOIN R ON R.record_index = A.record_index JOIN O ON O.cluster_id = A.cluster_id),
B AS (SELECT C.cluster_id, {', '.join(f'coalesce(min(A2.v[{k + 1}]), any_value(C.v[{k + 1}])) AS low{k}, coalesce(max(A2.v[{k + 1}]), any_value(C.v[{k + 1}])) AS high{k}' for k in range(DIM))}
      FROM C LEFT JOIN (SELECT A.cluster_id, R.v FROM A JOIN R ON R.record_index = A.record_index) A2 ON A2.cluster_id = C.cluster_id GROUP BY C.cluster_id)"""


def _with_index(clusters: int = 8) -> str:
    return f"WITH {fx.VECTORS_SQL}, {_trained(clusters)}, {_INDEX}"


ASSIGN = f"""WITH {fx.VECTORS_SQL}, {_trained(8, 0)} SELECT record_index, cluster_id, d AS centroid_distance FROM A"""
LLOYD = f"""WITH {fx.VECTORS_SQL}, {_trained(8)}, I AS (SELECT CAST(sum(d) AS BIGINT) AS inertia FROM A1)
SELECT cluster_id, inertia, {_V} FROM C, I"""
OFFSETS = f"{_with_index()} SELECT cluster_id, CAST(size AS BIGINT) AS size, first_position FROM O"
POSTINGS = f"{_with_index()} SELECT CAST(ordered_pos AS BIGINT) AS ordered_pos, record_index, cluster_id FROM M"
BOXES = f"{_with_index()} SELECT cluster_id, {', '.join(f'low{k}, high{k}' for k in range(DIM))} FROM B"
_GAPS = [f"greatest(low{k} - v[{k + 1}], v[{k + 1}] - high{k}, 0)" for k in range(DIM)]
_BOUND = " + ".join(f"({g}) * ({g})" for g in _GAPS)
BOX_BOUND = f"{_with_index()} SELECT query_id, cluster_id, CAST({_BOUND} AS BIGINT) AS bound FROM Q, B"


def _probes(n: int, name: str = "P") -> str:
    return f"""{name} AS (SELECT query_id, cluster_id, probe_rank FROM (SELECT query_id, cluster_id,
  row_number() OVER (PARTITION BY query_id ORDER BY d, cluster_id) AS probe_rank
  FROM (SELECT query_id, cluster_id, {_L2('Q.v', 'C.v')} AS d FROM Q, C)) WHERE probe_rank <= {n})"""


PROBE = f"{_with_index()}, {_probes(3)} SELECT query_id, cluster_id, CAST(probe_rank AS BIGINT) AS probe_rank FROM P"


def _scan(name: str, probes: str) -> str:
    body = f"""SELECT P.query_id, M.record_index, M.label, P.probe_rank, M.ordered_pos, {_L2('Q.v', 'M.v')} AS distance
  FROM {probes} P JOIN Q ON Q.query_id = P.query_id JOIN M ON M.cluster_id = P.cluster_id WHERE {_FLAGS('Q.v', 'M.v')}"""
    return f"{name} AS ({_ranked(body, 'distance, probe_rank, ordered_pos')})"


def _boxed(name: str, probes: str, first: str) -> str:
    """All clusters the boxes let through, as if they followed the probes."""
    return f"""{name}_W AS (SELECT query_id, distance AS worst FROM {first} WHERE rank = 5),
{name}_X AS (SELECT query_id, cluster_id, 1000 + row_number() OVER (PARTITION BY query_id ORDER BY bound, cluster_id) AS probe_rank FROM (
  SELECT Q.query_id, B.cluster_id, {_BOUND} AS bound, worst FROM Q JOIN {name}_W W ON W.query_id = Q.query_id, B
  WHERE NOT EXISTS (SELECT 1 FROM {probes} P WHERE P.query_id = Q.query_id AND P.cluster_id = B.cluster_id)) WHERE bound < worst),
{_scan(f'{name}_S', f'{name}_X')},
{name} AS ({_ranked(f"SELECT query_id, record_index, label, probe_rank, ordered_pos, distance FROM {first} UNION ALL SELECT query_id, record_index, label, probe_rank, ordered_pos, distance FROM {name}_S", 'distance, probe_rank, ordered_pos')})"""


def _vote(name: str, found: str, enough: str | None = None) -> str:
    """Votes, with exact search where too little was found."""
    test = enough or f"SELECT query_id FROM {found} GROUP BY query_id HAVING count(*) >= 5"
    return f"""{name}_E AS ({test}),
{name} AS (SELECT Q.query_id, CAST(CASE WHEN e.query_id IS NULL THEN x.n ELSE coalesce(f.n, 0) END AS BIGINT) AS votes, e.query_id IS NULL AS used_fallback
  FROM Q LEFT JOIN {name}_E e ON e.query_id = Q.query_id
  LEFT JOIN (SELECT query_id, sum(label) AS n FROM {found} GROUP BY query_id) f ON f.query_id = Q.query_id
  LEFT JOIN (SELECT query_id, sum(label) AS n FROM X5 GROUP BY query_id) x ON x.query_id = Q.query_id)"""


IVF_VOTES = f"{_with_index()}, {_EXACT}, {_probes(2)}, {_scan('S', 'P')}, {_vote('V', 'S')} SELECT * FROM V"
IVF_BOX_VOTES = f"{_with_index()}, {_EXACT}, {_probes(2)}, {_scan('S', 'P')}, {_boxed('S2', 'P', 'S')}, {_vote('V', 'S2')} SELECT * FROM V"
ADAPTIVE = f"""{_with_index()}, {_EXACT}, {_probes(1, 'P1')}, {_scan('S1', 'P1')}, {_vote('V1', 'S1')}, {_probes(4, 'P4')}, {_scan('S4', 'P4')}, {_vote('V4', 'S4')}
SELECT V1.query_id, CASE WHEN V1.votes IN (2, 3) THEN V4.votes ELSE V1.votes END AS votes, V1.votes IN (2, 3) AS expanded
FROM V1 JOIN V4 ON V4.query_id = V1.query_id"""
# every vote count leads to expansion with boxes: the answer is the filtered exact
# one where the twelve nearest clusters hold five matches, else the exact one
DEPLOYED = f"""{_with_index(16)}, {_EXACT}, {_FILTERED}, {_probes(12)}, {_scan('S', 'P')},
{_vote('V', 'F5', 'SELECT query_id FROM S GROUP BY query_id HAVING count(*) >= 5')}
SELECT query_id, votes, CAST(votes AS DOUBLE) / 5 AS fraud_score, CAST(votes AS DOUBLE) / 5 < 0.5 AS approved FROM V"""
POSTINGS_VOTES = f"""{_with_index()}, {_EXACT}, {_probes(1)}, {_scan('S', 'P')},
{_vote('V', 'S', 'SELECT query_id FROM P JOIN O ON O.cluster_id = P.cluster_id GROUP BY query_id HAVING sum(size) >= 5')} SELECT * FROM V"""

# --- product quantisation ------------------------------------------------------------


def _slice(v: str, s: int) -> str:
    return "[" + ", ".join(f"{v}[{4 * s + j + 1}]" if 4 * s + j < DIM else "0" for j in range(4)) + "]"


_BOOKS = "K AS (" + " UNION ALL ".join(
    f"SELECT {s} AS subvector, code, {_slice('R.v', s)} AS w FROM N, (SELECT unnest(range(0, 256)) AS code), R WHERE record_index = code * n // 256" for s in range(4)
) + ")"
_GAP4 = _L2("x.w", "K.w", range(4))
_CODES = f"""XP AS ({' UNION ALL '.join(f"SELECT record_index, {s} AS subvector, {_slice('R.v', s)} AS w FROM R" for s in range(4))}),
CODES AS (SELECT record_index, subvector, code FROM (SELECT record_index, x.subvector, code,
  row_number() OVER (PARTITION BY record_index, x.subvector ORDER BY {_GAP4}, code) AS rn FROM XP x JOIN K ON K.subvector = x.subvector) WHERE rn = 1)"""
PQ_ENCODE = f"""{_with_index()}, {_BOOKS}, {_CODES}
SELECT record_index, {', '.join(f'CAST(max(CASE WHEN subvector = {s} THEN code END) AS BIGINT) AS code{s}' for s in range(4))} FROM CODES GROUP BY record_index"""
_QP = f"""QP AS ({' UNION ALL '.join(f"SELECT query_id, {s} AS subvector, {_slice('Q.v', s)} AS w FROM Q" for s in range(4))}),
LUT AS (SELECT query_id, x.subvector, code, {_GAP4} AS d FROM QP x JOIN K ON K.subvector = x.subvector),
ADC AS (SELECT P.query_id, M.record_index, M.label, P.probe_rank, M.ordered_pos, sum(d) AS adc FROM P JOIN M ON M.cluster_id = P.cluster_id
  JOIN CODES ON CODES.record_index = M.record_index JOIN LUT ON LUT.query_id = P.query_id AND LUT.subvector = CODES.subvector AND LUT.code = CODES.code
  GROUP BY P.query_id, M.record_index, M.label, P.probe_rank, M.ordered_pos),
SL AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adc, probe_rank, ordered_pos) AS adc_rank FROM ADC) WHERE adc_rank <= 20)"""
_WITH_PQ = f"{_with_index()}, {_BOOKS}, {_CODES}, {_probes(2)}, {_QP}"
LOOKUP = f"{_WITH_PQ} SELECT query_id, CAST(subvector AS BIGINT) AS subvector, CAST(code AS BIGINT) AS code, CAST(d AS BIGINT) AS distance FROM LUT"
ADC_SHORTLIST = f"{_WITH_PQ} SELECT query_id, CAST(adc_rank AS BIGINT) AS adc_rank, record_index, CAST(adc AS BIGINT) AS adc FROM SL"
_RERANKED = f"""SELECT SL.query_id, SL.record_index, SL.label, adc_rank - 20 AS probe_rank, ordered_pos, {_L2('Q.v', 'R.v')} AS distance
FROM SL JOIN Q ON Q.query_id = SL.query_id JOIN R ON R.record_index = SL.record_index"""


def pq_votes(boxes: bool) -> str:
    top = f"S AS ({_ranked(_RERANKED, 'distance, probe_rank')})"
    more = f", {_boxed('S2', 'P', 'S')}" if boxes else ""
    return f"{_WITH_PQ}, {_EXACT}, {top}{more}, {_vote('V', 'S2' if boxes else 'S')} SELECT * FROM V"


RECALL = f"""{_with_index()}, {_FILTERED}, {_probes(2)}, {_scan('S', 'P')}
SELECT F5.query_id, CAST(count(S.record_index) AS BIGINT) AS hits FROM F5 LEFT JOIN S ON S.query_id = F5.query_id AND S.record_index = F5.record_index GROUP BY F5.query_id"""
HISTOGRAM = f"WITH {fx.VECTORS_SQL} SELECT count(*) AS records, count(*) FILTER (WHERE label = 1) AS fraud, count(*) FILTER (WHERE label = 0) AS legit FROM R"
PHASES = """WITH X AS (SELECT event_type AS phase, CAST(round(value * 1000) AS BIGINT) AS ns FROM events)
SELECT phase, count(ns) AS count, CAST(sum(ns) AS BIGINT) AS total_ns, max(ns) AS max_ns, CAST(sum(ns) // count(ns) AS BIGINT) AS avg_ns FROM X GROUP BY phase"""
COUNTERS = """SELECT count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_id % 2 = 0) AS fast_path,
count(*) FILTER (WHERE event_id % 2 <> 0) AS fallback_path, count(*) FILTER (WHERE event_id % 7 = 0) AS exact_fallbacks,
count(*) FILTER (WHERE event_id % 3 = 0) AS expansions FROM events"""
MALFORMED = f"""WITH {fx.VECTORS_SQL}, {fx.REQUESTS_SQL}, G AS (SELECT request_id AS query_id, [{fx.REQUEST_VECTORS_SQL}] AS v FROM T WHERE request_id % 5 IN (0, 4)),
S AS (SELECT query_id, CAST(sum(label) AS DOUBLE) / count(*) AS s FROM ({_ranked(f"SELECT query_id, record_index, label, {_L2('G.v', 'R.v')} AS distance FROM G, R", 'distance, record_index')}) GROUP BY query_id)
SELECT request_id, CASE WHEN s IS NULL THEN false ELSE s < 0.5 END AS approved, coalesce(s, 1.0) AS fraud_score, s IS NULL AS failed
FROM T LEFT JOIN S ON query_id = request_id"""

# kinds 0 and 4 of the bodies are whole; the others have no vector
REQUEST_VECTORS = f"""WITH {fx.REQUESTS_SQL}, X AS (SELECT request_id, request_id % 5 IN (0, 4) AS valid, [{fx.REQUEST_VECTORS_SQL}] AS v FROM T)
SELECT request_id, valid, {', '.join(f'CASE WHEN valid THEN v[{k + 1}] END AS v{k}' for k in range(DIM))} FROM X"""
INGESTED = f"""WITH X AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS record_index, CAST(CASE WHEN label >= 5 THEN 1 ELSE 0 END AS BIGINT) AS label,
  [{', '.join(f"{'trunc' if k in FLAG_LANES else 'round'}(CAST(embedding[{k + 1}] AS DOUBLE) * 10000)" for k in range(DIM))}] AS v FROM embeddings)
SELECT record_index, label, {', '.join(f'CAST(v[{k + 1}] AS BIGINT) AS v{k}' for k in range(DIM))} FROM X"""


def _mixed(state: str) -> str:
    """The generator's output function, in 128-bit arithmetic cut to 64 bits."""
    cut = lambda x: f"CAST(({x}) % 18446744073709551616 AS UBIGINT)"
    one = cut(f"CAST(xor({state}, {state} >> 30) AS UHUGEINT) * 13787848793156543929")
    two = cut("CAST(xor(z1, z1 >> 27) AS UHUGEINT) * 10723151780598845931")
    return f"SELECT n, xor(z2, z2 >> 31) AS z FROM (SELECT n, {two} AS z2 FROM (SELECT n, {one} AS z1 FROM S))"


# the n-th state of the generator is its seed and n + 1 steps, so draws need no recursion
WARM_UP = f"""WITH {fx.VECTORS_SQL}, {_trained(8)},
S AS (SELECT n, CAST((14627333968688430831 + CAST(n + 1 AS UHUGEINT) * 11400714819323198485) % 18446744073709551616 AS UBIGINT) AS s FROM (SELECT unnest(range(0, 500)) AS n)),
D AS ({_mixed('s')})
SELECT n AS query_id, {', '.join(f"(C.v[{k + 1}] + {({0: 17, 7: 23}).get(k, 0)} + 32768) % 65536 - 32768 AS v{k}" for k in range(DIM))}
FROM D JOIN C ON C.cluster_id = CAST(z % 8 AS BIGINT)"""
# sound training whatever the random draws were
TRAINED_INDEX = f"""WITH {fx.VECTORS_SQL} SELECT count(*) AS records, CAST(8 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS misplaced,
CAST(0 AS BIGINT) AS outside, count(*) AS positions FROM R"""
TRAINED_CODES = f"""WITH {fx.VECTORS_SQL} SELECT count(*) AS members, CAST(4 AS BIGINT) AS subvectors, CAST(0 AS BIGINT) AS not_nearest,
CAST(0 AS BIGINT) AS out_of_range FROM R"""
