"""DuckDB SQL for the registered queries, built from shared relations."""

from __future__ import annotations

from ..functions.scalars import FEATURE_GROUPS, FEATURES, VERSION_WORDS

NOTES = """
notes AS (
  SELECT user_id AS piece_id, floor(epoch(ts) / 21600)::BIGINT AS tick, 36 + (props->>'k')::INT % 48 AS pitch, floor(value)::INT % 128 AS velocity
  FROM events)"""

SKY = NOTES + """,
top AS (SELECT piece_id, tick, max(struct_pack(p := pitch, v := velocity)) AS top FROM notes WHERE velocity > 0 GROUP BY ALL),
sky AS (
  SELECT piece_id, tick / 4.0 AS beat, top.p AS pitch, top.v AS velocity FROM top QUALIFY count(*) OVER (PARTITION BY piece_id) >= 32)"""

CURVE = SKY + """,
ends AS (SELECT *, min(beat) OVER p AS b0, max(beat) OVER p AS b1 FROM sky WINDOW p AS (PARTITION BY piece_id)),
phase AS (SELECT *, (beat - b0) / (b1 - b0) AS p0 FROM ends),
seg AS (
  SELECT *, lead(p0) OVER w AS p1, lead(pitch) OVER w AS q, lead(velocity) OVER w AS u FROM phase WINDOW w AS (PARTITION BY piece_id ORDER BY beat)),
curve AS (
  SELECT piece_id, k::INT AS k, k / 15.0 AS t, pitch + (k / 15.0 - p0) / (p1 - p0) * (q - pitch) AS pitch,
    velocity + (k / 15.0 - p0) / (p1 - p0) * (u - velocity) AS velocity
  FROM seg, range(16) g(k) WHERE p1 IS NOT NULL AND k / 15.0 >= p0 AND (k / 15.0 < p1 OR (p1 = 1 AND k = 15)))"""


def _corr(a: str, b: str) -> str:
    return f"coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) FILTER ({b} IS NOT NULL) * stddev_pop({b}) FILTER ({a} IS NOT NULL), 0), 0)"


def _share(cond: str) -> str:
    return f"avg(({cond})::INT)"


_EDGES = {"unison": "a < 1", "step": "a >= 1 AND a < 3", "third_fourth": "a >= 3 AND a < 5", "fifth_seventh": "a >= 5 AND a < 8", "octave": "a >= 8 AND a < 13", "large": "a >= 13"}
_ENTROPY = "-list_sum(list_transform(list_filter({}, lambda x: x > 0), lambda x: x * log2(x)))"
_WIDE = {
    "duration_beats": "greatest(max(beat) - min(beat), 1e-9)", "onset_count": "count(*)::DOUBLE", "onset_density": "count(*) / greatest(max(beat) - min(beat), 1e-9)",
    "pitch_mean": "avg(pitch)", "pitch_std": "stddev_pop(pitch)", "pitch_range": "max(pitch) - min(pitch)", "pitch_q10": "quantile_cont(pitch, 0.1)", "pitch_q90": "quantile_cont(pitch, 0.9)",
    "interval_abs_mean": "avg(a)", "interval_abs_std": "stddev_pop(a)", "interval_abs_max": "max(a)", "step_fraction": _share("a <= 2"), "leap_fraction": _share("a >= 5"), "repeat_fraction": _share("a = 0"),
    "ascending_fraction": _share("iv > 0"), "descending_fraction": _share("iv < 0"), "direction_change": _share("turn < 0"),
    "contour_slope": "regr_slope(pitch, phase)", "pitch_autocorrelation": "CASE WHEN stddev_pop(pitch) > 1e-9 THEN " + _corr("p0", "pitch") + " END",
    "interval_entropy": _ENTROPY.format("[" + ", ".join(_share(f"step = {k}") for k in range(-12, 13)) + "]"),
    **{f"interval_{n}_fraction": _share(c) for n, c in _EDGES.items()},
    "velocity_mean": "avg(velocity)", "velocity_std": "stddev_pop(velocity)", "velocity_range": "max(velocity) - min(velocity)", "velocity_change_abs_mean": "avg(abs(vd))", "velocity_change_std": "stddev_pop(vd)",
    "pitch_velocity_correlation": "CASE WHEN stddev_pop(pitch) > 1e-9 AND stddev_pop(velocity) > 1e-9 THEN " + _corr("pitch", "velocity") + " END",
    "ioi_mean": "avg(ioi)", "ioi_std": "stddev_pop(ioi)", "ioi_cv": "stddev_pop(ioi) / greatest(avg(ioi), 1e-9)", "ioi_q25": "quantile_cont(ioi, 0.25)", "ioi_q75": "quantile_cont(ioi, 0.75)",
    "offbeat_fraction": _share("least(f, 1 - f) > 0.10"), "rhythm_regularity": "1 / (1 + stddev_pop(ioi) / greatest(avg(ioi), 1e-9))",
    "ioi_entropy": _ENTROPY.format("[" + ", ".join(_share(f"bin = {k}") for k in range(8)) + "]"),
    **{f"pc_{k}": _share(f"pc = {k}") for k in range(12)},
    "pitch_class_entropy": _ENTROPY.format("[" + ", ".join(_share(f"pc = {k}") for k in range(12)) + "]"),
    "pitch_class_peak": "list_max([" + ", ".join(_share(f"pc = {k}") for k in range(12)) + "])",
    "pitch_class_top3": "list_sum(list_slice(list_reverse_sort([" + ", ".join(_share(f"pc = {k}") for k in range(12)) + "]), 1, 3))",
}
FEATURE_BASE = SKY + """,
d AS (
  SELECT piece_id, beat, pitch::DOUBLE AS pitch, velocity::DOUBLE AS velocity, (lag(pitch) OVER w)::DOUBLE AS p0, (pitch - lag(pitch) OVER w)::DOUBLE AS iv,
    beat - lag(beat) OVER w AS ioi, (velocity - lag(velocity) OVER w)::DOUBLE AS vd, min(beat) OVER p AS b0, max(beat) OVER p AS b1
  FROM sky WINDOW w AS (PARTITION BY piece_id ORDER BY beat), p AS (PARTITION BY piece_id)),
d2 AS (
  SELECT *, abs(iv) AS a, sign(iv) * sign(lag(iv) OVER w) AS turn, (beat - b0) / greatest(b1 - b0, 1e-9) AS phase, ln(1 + ioi) AS lg FROM d
  WINDOW w AS (PARTITION BY piece_id ORDER BY beat)),
d3 AS (
  SELECT *, CASE WHEN lg IS NOT NULL THEN least(floor((lg - min(lg) OVER p) / ((max(lg) OVER p + 1e-9 - min(lg) OVER p) / 8)), 7) END AS bin, ((round_even(pitch, 0)::INT % 12) + 12) % 12 AS pc,
    beat - floor(beat) AS f, CASE WHEN iv IS NOT NULL THEN least(greatest(round_even(iv, 0), -12), 12) END AS step FROM d2 WINDOW p AS (PARTITION BY piece_id)),
wide AS (SELECT piece_id, """ + ", ".join(f"{_WIDE[c]} AS {c}" for c in FEATURES) + " FROM d3 GROUP BY piece_id)"

_ANY = "|".join(VERSION_WORDS)
FILES = """
files AS (
  SELECT genre || '/' || lpad(doc_id::VARCHAR, 10, '0') || '.txt' AS path, genre, n_chars,
    nullif(regexp_replace(lower(regexp_extract(text, '^([^\\n]*)', 1)), '[^a-z0-9]+', '', 'g'), '') AS title, sha256(text) AS sha,
    sha256(nullif(regexp_replace(lower(text), '[^a-z]+', '', 'g'), '')) AS print
  FROM (SELECT *, ['Classical', 'Jazz', 'Rock', 'Blues', 'Electronic'][1 + coalesce(nullif(regexp_extract(source, '([0-9]+)$', 1), '')::INT, 0) % 5] AS genre FROM documents))"""
LABELS = "WITH RECURSIVE" + FILES + """,
star AS (
  SELECT path AS a, min(path) OVER (PARTITION BY title) AS b FROM files WHERE title IS NOT NULL
  UNION SELECT path, min(path) OVER (PARTITION BY sha) FROM files WHERE sha IS NOT NULL
  UNION SELECT path, min(path) OVER (PARTITION BY print) FROM files WHERE print IS NOT NULL),
edge AS (SELECT a, b FROM star WHERE a <> b UNION SELECT b, a FROM star WHERE a <> b),
reach AS (SELECT path, path AS r FROM files UNION SELECT reach.path, edge.b FROM reach JOIN edge ON edge.a = reach.r),
lab AS (SELECT files.*, l.label FROM files JOIN (SELECT path, min(r) AS label FROM reach GROUP BY path) l USING (path)),
grp AS (
  SELECT label, 'grp_' || left(sha256(array_to_string(list_sort(list(path)), chr(10))), 16) AS "group", array_to_string(list_sort(list(DISTINCT genre)), '/') AS genres,
    (count(DISTINCT genre) > 1)::INT AS cross_genre, count(*) AS versions, count(DISTINCT title) AS n_titles, min(title) AS title, min(path) AS file
  FROM lab GROUP BY label)"""
SAMPLE = LABELS + """,
cand AS (SELECT lab.* FROM lab JOIN grp USING (label) WHERE cross_genre = 0 AND n_chars >= 200),
one AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY genre, label ORDER BY md5('2026|version|' || path), path) = 1),
pos AS (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY md5('2026|group|' || genre || '|' || label), label)::INT AS position FROM one),
quota AS (SELECT min(n) AS q FROM (SELECT genre, least(max(position), 40) AS n FROM pos GROUP BY genre)),
sample AS (SELECT genre, path, label, position FROM pos, quota WHERE position <= q)"""

E = """
e AS (SELECT vec_id AS id, label::VARCHAR AS label, embedding::DOUBLE[] AS v FROM embeddings),
pairs AS (SELECT a.id AS i, b.id AS j, round(list_distance(a.v, b.v) / 8, 9) AS dist, a.label AS la, b.label AS lb, (a.label = b.label)::INT AS same FROM e a JOIN e b ON a.id < b.id)"""
KNN = E + """,
two_way AS (SELECT i, j, dist FROM pairs UNION ALL SELECT j, i, dist FROM pairs),
folds AS (
  SELECT seed, id, label, ((row_number() OVER (PARTITION BY seed, label ORDER BY md5(seed || '|' || id), id) - 1) % 5)::INT AS fold
  FROM e, (SELECT unnest({seeds})::INT AS seed) s),
near AS (
  SELECT f.seed, f.fold, d.i AS test, row_number() OVER (PARTITION BY f.seed, d.i ORDER BY dist, d.j) AS rank, g.label
  FROM two_way d JOIN folds f ON f.id = d.i JOIN folds g ON g.id = d.j AND g.seed = f.seed AND g.fold <> f.fold QUALIFY rank <= 9),
votes AS (
  SELECT seed, fold, test, k, label, count(*) AS n, sum(k - rank) AS closeness, sum(1 + 1e-9 * (k - rank + 1)) AS w
  FROM near, (SELECT unnest([1, 3, 5, 7, 9])::INT AS k) ks WHERE rank <= k GROUP BY ALL),
pred AS (
  SELECT seed, fold, test AS id, k, label AS pred, w / sum(w) OVER (PARTITION BY seed, test, k) AS prob, row_number() OVER (PARTITION BY seed, test, k ORDER BY n DESC, closeness DESC, label) AS r
  FROM votes QUALIFY r = 1),
res AS (SELECT pred.seed, pred.fold, pred.k, pred.id, e.label, pred.pred, pred.prob FROM pred JOIN e USING (id))"""
KNN42 = KNN.replace("{seeds}", "[42]")
KNN_ALL = KNN.replace("{seeds}", "[11, 23, 42, 67, 101]")


def metrics(source: str, keys: str) -> str:
    """A chain of relations that ends in ``met`` (keys, accuracy, balanced_accuracy, macro_f1)."""
    return f""",
cell AS (SELECT {keys}, label, pred, count(*) AS n FROM {source} GROUP BY ALL),
cls AS (
  SELECT {keys}, c, sum(truth) AS truth, sum(said) AS said, sum(hit) AS hit FROM (
    SELECT {keys}, label AS c, n AS truth, 0 AS said, CASE WHEN label = pred THEN n ELSE 0 END AS hit FROM cell
    UNION ALL SELECT {keys}, pred, 0, n, 0 FROM cell) GROUP BY ALL),
met AS (
  SELECT {keys}, sum(hit) / sum(truth) AS accuracy, avg(hit / truth) FILTER (truth > 0) AS balanced_accuracy, avg(2 * hit / (truth + said)) AS macro_f1
  FROM cls GROUP BY ALL)"""


RUNS = "WITH" + KNN_ALL + metrics("res", "seed, k") + ", runs AS (SELECT 'knn_' || k AS method, 2026 AS sample_seed, seed AS outer_seed, accuracy, balanced_accuracy, macro_f1 FROM met)"
_STAT = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std, round(min({m}), 6) AS {m}_min, round(max({m}), 6) AS {m}_max" for m in ("accuracy", "balanced_accuracy", "macro_f1"))


def _grid_curve(points: int, weight: float) -> str:
    """Relations from ``sky`` to ``rel`` (piece_id, k, t, pitch, velocity): curves of ``points`` points, pitch about its median, velocity weighted, and to ``loc``, each coordinate in its own range."""
    n = points - 1
    return SKY + f""",
ends AS (SELECT *, min(beat) OVER p AS b0, max(beat) OVER p AS b1 FROM sky WINDOW p AS (PARTITION BY piece_id)),
phase AS (SELECT *, (beat - b0) / (b1 - b0) AS p0 FROM ends),
seg AS (SELECT *, lead(p0) OVER w AS p1, lead(pitch) OVER w AS q, lead(velocity) OVER w AS u FROM phase WINDOW w AS (PARTITION BY piece_id ORDER BY beat)),
curve AS (
  SELECT piece_id, k::INT AS k, k / {n}.0 AS t, pitch + (k / {n}.0 - p0) / (p1 - p0) * (q - pitch) AS pitch, velocity + (k / {n}.0 - p0) / (p1 - p0) * (u - velocity) AS velocity
  FROM seg, range({points}) g(k) WHERE p1 IS NOT NULL AND k / {n}.0 >= p0 AND (k / {n}.0 < p1 OR (p1 = 1 AND k = {n}))),
rel AS (SELECT piece_id, k, t, (pitch - quantile_cont(pitch, 0.5) OVER p) / 12 AS pitch, {weight} * (velocity - 64) / 32 AS velocity FROM curve WINDOW p AS (PARTITION BY piece_id)),
loc AS (SELECT piece_id, k, """ + ", ".join(f"CASE WHEN max({c}) OVER p > min({c}) OVER p THEN ({c} - min({c}) OVER p) / (max({c}) OVER p - min({c}) OVER p) ELSE 0.5 END AS {c}" for c in ("t", "pitch", "velocity")) + """ FROM curve WINDOW p AS (PARTITION BY piece_id))"""


def _family(name: str, source: str, square: str) -> str:
    """Relation ``name`` (i, j, hd, q95, mhd) of the curves of ``source``, with the squared distance of points a and b given."""
    one = "max(d) AS hd, quantile_cont(d, 0.95) AS q95, avg(d) AS mhd"
    return f""",
{name}_d AS NOT MATERIALIZED (SELECT a.piece_id AS i, b.piece_id AS j, a.k AS ka, b.k AS kb, sqrt({square}) AS d FROM {source} a JOIN {source} b ON a.piece_id < b.piece_id),
{name} AS (
  SELECT i, j, greatest(x.hd, y.hd) AS hd, greatest(x.q95, y.q95) AS q95, greatest(x.mhd, y.mhd) AS mhd
  FROM (SELECT i, j, {one} FROM (SELECT i, j, ka, min(d) AS d FROM {name}_d GROUP BY ALL) GROUP BY ALL) x
  JOIN (SELECT i, j, {one} FROM (SELECT i, j, kb, min(d) AS d FROM {name}_d GROUP BY ALL) GROUP BY ALL) y USING (i, j))"""


_TP, _TPV = "(a.t - b.t) ^ 2 + (a.pitch - b.pitch) ^ 2", "(a.t - b.t) ^ 2 + (a.pitch - b.pitch) ^ 2 + (a.velocity - b.velocity) ^ 2"
BASE_DISTANCES = (
    "WITH" + _grid_curve(96, 0.25) + _family("l", "loc", _TPV) + _family("p", "rel", _TP) + _family("v", "rel", _TPV) + """,
r AS (SELECT i, j, sqrt(sum(s) / 96) AS rmse FROM (
  SELECT a.piece_id AS i, b.piece_id AS j, (a.pitch - b.pitch) ^ 2 + (a.velocity - b.velocity) ^ 2 AS s FROM rel a JOIN rel b ON a.piece_id < b.piece_id AND a.k = b.k) GROUP BY ALL)
SELECT i, j, round(l.hd, 6) AS hd_local, round(p.hd, 6) AS hd_tp, round(v.hd, 6) AS hd_tpv, round(v.q95, 6) AS q95_tpv, round(v.mhd, 6) AS mhd_tpv, round(rmse, 6) AS phase_rmse
FROM l JOIN p USING (i, j) JOIN v USING (i, j) JOIN r USING (i, j)"""
)
MHD_GRID = " UNION ALL ".join(
    "SELECT * FROM (WITH" + _grid_curve(n, w) + _family("v", "rel", _TPV) + f" SELECT {n} AS points, {w}::DOUBLE AS weight, i, j, round(mhd, 6) AS mhd FROM v)" for n in (48, 72, 96) for w in (0.0, 0.1, 0.25, 0.5)
)
def _dtw(points: int, weight: float, band: int) -> str:
    """Relation ``pair`` (i, j, dtw), by anti-diagonals: d holds the costs of a diagonal by row (the first entry is row 0), c those of the one before."""
    n, inf = points, "'inf'::DOUBLE"
    return "WITH RECURSIVE" + _grid_curve(n, weight) + f""",
list AS (SELECT piece_id AS id, list(pitch ORDER BY k) AS p, list(velocity ORDER BY k) AS v FROM rel GROUP BY piece_id),
step AS (
  SELECT a.id AS i, b.id AS j, a.p AS ap, a.v AS av, b.p AS bp, b.v AS bv, 1 AS s,
    list_transform(range(0, {n} + 1), lambda r: {inf}) AS d, list_transform(range(0, {n} + 1), lambda r: CASE WHEN r = 0 THEN 0 ELSE {inf} END) AS c
  FROM list a JOIN list b ON a.id < b.id
  UNION ALL
  SELECT i, j, ap, av, bp, bv, s + 1, list_transform(range(0, {n} + 1), lambda r: CASE WHEN r >= 1 AND s + 1 - r BETWEEN 1 AND {n} AND abs(2 * r - s - 1) <= {band}
    THEN sqrt((ap[r] - bp[s + 1 - r]) ^ 2 + (av[r] - bv[s + 1 - r]) ^ 2) + least(d[r], d[r + 1], c[r]) ELSE {inf} END), d
  FROM step WHERE s < 2 * {n}),
pair AS (SELECT i, j, d[{n} + 1] / (2 * {n}) AS dtw FROM step WHERE s = 2 * {n})"""


DTW_NEIGHBOURS = _dtw(36, 0.25, 4) + """,
two AS (SELECT i AS id, j AS neighbour, round(dtw, 9) AS dist FROM pair UNION ALL SELECT j, i, round(dtw, 9) FROM pair)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY dist, neighbour)::INT AS rank, neighbour, round(dist, 6) AS dist FROM two QUALIFY rank <= 9"""
DTW_GRID = " UNION ALL ".join(
    "SELECT * FROM (" + _dtw(n, w, band) + f" SELECT {n} AS points, {w}::DOUBLE AS weight, {share}::DOUBLE AS \"window\", i, j, round(dtw, 6) AS dtw FROM pair)"
    for n, bands in ((36, ((0.1, 4), (0.2, 7))), (48, ((0.1, 5), (0.2, 10)))) for w in (0.0, 0.25, 0.5) for share, band in bands
)
VECTOR_FAMILY = (
    "WITH pt AS (SELECT vec_id AS piece_id, k::INT AS k, k / (len(embedding) - 1.0) AS t, embedding[k + 1]::DOUBLE AS pitch FROM embeddings, range(64) g(k))" + _family("p", "pt", _TP)
    + " SELECT i, j, round(hd, 6) AS hd, round(q95, 6) AS q95, round(mhd, 6) AS mhd FROM p"
)
HEX8 = "right(lpad(to_hex(({})::BIGINT), 16, '0'), 8)"

# The sequential deal, one step a group: labels by number, counts of all labels as lists, the state as one list of folds by labels.
ORDER_FOLDS = """WITH RECURSIVE
c AS (SELECT o_custkey AS g, o_orderpriority AS l, count(*) AS n FROM orders GROUP BY ALL),
lab AS (SELECT l, sum(n)::DOUBLE AS t, row_number() OVER (ORDER BY l) AS p FROM c GROUP BY l),
w AS (SELECT list(1.0 / (t * t) ORDER BY p) AS w, count(*)::INT AS nl FROM lab),
grid AS (SELECT g, p, coalesce(n, 0) AS n FROM (SELECT DISTINCT g FROM c) CROSS JOIN lab LEFT JOIN c USING (g, l)),
v AS (SELECT g, list(n ORDER BY p) AS v, string_agg(p || ':' || n, ',' ORDER BY p) FILTER (n > 0) AS kind, sum(n)::BIGINT AS size FROM grid GROUP BY g),
placed AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('42|' || g), g) - 1 AS place, count(*) OVER (PARTITION BY kind) AS m FROM v),
chunks AS (SELECT greatest(1, ceil(count(DISTINCT kind) / 4096.0))::BIGINT AS n FROM placed WHERE m % 5 > 0),
rest AS (SELECT g, v, size, (('0x' || substr(md5('42|' || kind), 1, 8))::BIGINT % n)::INT AS chunk, kind, place FROM placed, chunks WHERE place >= m - m % 5),
ord AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY size DESC, kind, place) AS o FROM rest),
deal(chunk, o, g, f, s) AS (
  SELECT DISTINCT chunk, 0::BIGINT, NULL::BIGINT, NULL::INT, list_transform(range(5 * nl), lambda i: 0::BIGINT) FROM ord, w
  UNION ALL
  SELECT chunk, o, g, f, list_transform(range(5 * nl), lambda i: s[i + 1] + CASE WHEN i // nl = f THEN v[i % nl + 1] ELSE 0 END)
  FROM (
    SELECT d.chunk, r.o, r.g, r.v, d.s, nl, list_sort(list_transform(range(5), lambda f: struct_pack(
        cost := round(list_sum(list_transform(range(nl), lambda i: d.s[f * nl + i + 1] * r.v[i + 1] * w[i + 1])), 12),
        held := list_sum(list_transform(range(nl), lambda i: d.s[f * nl + i + 1])), f := f)))[1].f::INT AS f
    FROM deal d JOIN ord r ON r.chunk = d.chunk AND r.o = d.o + 1, w)),
fold AS (
  SELECT g, ((f + chunk) % 5)::INT AS fold FROM deal WHERE o > 0
  UNION ALL SELECT g, (place % 5)::INT FROM placed WHERE place < m - m % 5)
SELECT o_orderkey AS id, o_custkey AS grp, o_orderpriority AS label, fold FROM orders JOIN fold ON g = o_custkey"""

ORACLES = {
    "skyline": "WITH" + SKY + " SELECT piece_id, beat, pitch, velocity FROM sky",
    "resample_in_time": "WITH" + CURVE + " SELECT piece_id, k, round(t, 6) AS t, round(pitch, 6) AS pitch, round(velocity, 6) AS velocity FROM curve",
    "curve_minmax": "WITH" + CURVE + " SELECT piece_id, k, " + ", ".join(f"round(CASE WHEN max({c}) OVER p > min({c}) OVER p THEN ({c} - min({c}) OVER p) / (max({c}) OVER p - min({c}) OVER p) ELSE 0.5 END, 6) AS {c}" for c in ("t", "pitch", "velocity")) + " FROM curve WINDOW p AS (PARTITION BY piece_id)",
    "curve_relative": "WITH" + CURVE + " SELECT piece_id, k, round(t, 6) AS t, round((pitch - quantile_cont(pitch, 0.5) OVER p) / 12, 6) + 0.0 AS pitch, round(0.25 * (velocity - 64) / 32, 6) AS velocity FROM curve WINDOW p AS (PARTITION BY piece_id)",
    "melody_fingerprint": "WITH" + SKY + """, r AS (
  SELECT piece_id, beat, round_even((beat - min(beat) OVER p) / greatest(max(beat) OVER p - min(beat) OVER p, 1e-12) * 10000, 0) AS a,
    round_even(pitch - quantile_cont(pitch, 0.5) OVER p, 0) AS b FROM sky WINDOW p AS (PARTITION BY piece_id))
SELECT piece_id, sha256(unhex(""" + HEX8.format("count(*)") + " || string_agg(" + HEX8.format("a") + " || " + HEX8.format("b") + ", '' ORDER BY beat))) AS melody_fingerprint FROM r GROUP BY piece_id",
    **{f"features_{g}": "WITH" + FEATURE_BASE + " SELECT piece_id, " + ", ".join(f"round(coalesce({c}, 0)::DOUBLE, 6) AS {c}" for c in cols) + " FROM wide" for g, cols in FEATURE_GROUPS.items()},
    "canonical_titles": f"""WITH f AS (
  SELECT p_partkey, p_name || CASE p_size % 7 WHEN 0 THEN ' (Live)' WHEN 1 THEN '_1' WHEN 2 THEN ' - Take 2' WHEN 3 THEN ' Remastered 2009' WHEN 4 THEN ' [LP Version]' ELSE '' END || '.mid' AS file FROM part),
t AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(file, '\\.[^.]*$', '')), '[(\\[][^)\\]]*\\b({_ANY})\\b[^)\\]]*[)\\]]', ' ', 'g'), '\\b({_ANY})\\b[^\\n]*$', ' '), '[_-]\\s*(take\\s*)?[0-9]+$', ' ') AS x FROM f)
SELECT p_partkey, file, coalesce(nullif(regexp_replace(x, '[^a-z0-9]', '', 'g'), ''), 'untitled-' || lower(file)) AS title FROM t""",
    "prediction_keys": "SELECT p_partkey, replace(replace(replace(replace(lower(p_name || '-' || p_type || ' (x)'), '-', '_'), ' ', '_'), '(', ''), ')', '') AS key FROM part",
    "combined_digest": """WITH slices AS (
  SELECT source, left(h, 3) AS slice, count(*) AS n, sha256(string_agg(h || chr(10), '' ORDER BY h)) AS digest FROM (SELECT source, sha256(text) AS h FROM documents WHERE text IS NOT NULL) GROUP BY ALL)
SELECT source, sha256(string_agg(digest || chr(10), '' ORDER BY slice)) AS digest, sum(n)::BIGINT AS n_texts FROM slices GROUP BY source""",
    "midi_note_ons": "WITH" + NOTES + " SELECT piece_id::VARCHAR AS path, 4 AS division, tick, pitch, velocity, NULL::VARCHAR AS error FROM notes WHERE velocity > 0",
    "identifier_audit": "WITH" + FILES + " " + " UNION ALL ".join(f"SELECT '{n}' AS identifier, (SELECT count(*) FROM (SELECT {c} FROM files WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)) AS duplicate_sets" for n, c in (("canonical_title", "title"), ("sha256", "sha"), ("melody_fingerprint", "print"))),
    "document_duplicate_groups": LABELS + ' SELECT "group", label, genres, cross_genre, versions, n_titles FROM grp',
    "cross_label_conflicts": LABELS + ' SELECT genres, count(*) AS group_count, sum(versions)::BIGINT AS versions, arg_min(title, "group") AS title, arg_min(file, "group") AS file FROM grp WHERE cross_genre = 1 GROUP BY genres',
    "balanced_sample": SAMPLE + " SELECT genre, path, label, position FROM sample",
    "sample_by_rounds": SAMPLE.replace("n_chars >= 200", "n_chars >= 200 AND sha >= '4'") + " SELECT genre, path, label, position FROM sample",
    "dedup_audit": SAMPLE + """,
own AS (
  SELECT lab.genre, count(*) AS raw, count(DISTINCT CASE WHEN cross_genre = 1 THEN label END) AS cross_genre_groups, count(DISTINCT CASE WHEN cross_genre = 0 THEN label END) AS candidate_groups,
    least(count(DISTINCT CASE WHEN cross_genre = 0 AND n_chars >= 200 THEN label END), 40) AS usable_groups
  FROM lab JOIN grp USING (label) GROUP BY lab.genre),
by_genre AS (SELECT own.*, (SELECT count(*) FROM sample s WHERE s.genre = own.genre) AS selected FROM own)
SELECT genre, raw, cross_genre_groups, candidate_groups, usable_groups, selected FROM by_genre
UNION ALL SELECT 'TOTAL', (SELECT count(*) FROM files), (SELECT count(*) FROM grp WHERE cross_genre = 1), (SELECT count(*) FROM grp WHERE cross_genre = 0), sum(usable_groups)::BIGINT, sum(selected)::BIGINT FROM by_genre""",
    "grouped_folds": "WITH" + KNN42 + " SELECT id, label, fold FROM folds",
    "stratified_group_folds": ORDER_FOLDS,
    "fold_leak_check": "WITH" + KNN42 + """,
g AS (SELECT DISTINCT label, id % 50 AS grp FROM e),
dealt AS (SELECT grp, ((row_number() OVER (PARTITION BY label ORDER BY md5('42|' || grp), grp) - 1) % 5)::INT AS fold FROM g),
by_group AS (SELECT e.id % 50 AS grp, d.fold FROM e JOIN (SELECT grp, min(fold) AS fold FROM dealt GROUP BY grp) d ON d.grp = e.id % 50)
SELECT 'by_group' AS split, grp, count(DISTINCT fold) AS folds FROM by_group GROUP BY grp HAVING count(DISTINCT fold) > 1
UNION ALL SELECT 'by_piece', id % 50, count(DISTINCT fold) FROM folds GROUP BY id % 50 HAVING count(DISTINCT fold) > 1""",
    "aligned_probabilities": "WITH" + KNN42 + """,
p AS (SELECT test, k, label, w / sum(w) OVER (PARTITION BY test, k) AS prob FROM votes)
SELECT a.test, a.k, c.label, round(coalesce(p.prob, 0), 6) AS prob
FROM (SELECT DISTINCT test, k FROM votes) a CROSS JOIN (SELECT DISTINCT label FROM e) c LEFT JOIN p ON p.test = a.test AND p.k = a.k AND p.label = c.label""",
    "distance_checks": "WITH" + E + """,
m AS (SELECT i, j, dist FROM pairs UNION ALL SELECT j, i, dist FROM pairs UNION ALL SELECT id, id, 0.0 FROM e),
b AS (SELECT m.*, r.dist AS r FROM m LEFT JOIN m r ON r.i = m.j AND r.j = m.i)
SELECT count(*) AS cells, count(DISTINCT i) AS items, coalesce(max(abs(dist)) FILTER (i = j), 0)::DOUBLE AS diagonal, count(*) FILTER (r IS NULL OR abs(dist - r) > 1e-12) AS skew,
  count(*) FILTER (dist IS NULL OR isnan(dist) OR isinf(dist) OR dist < 0) AS bad, round(avg((dist > 1e-12)::INT) FILTER (i <> j), 6) AS "distinct" FROM b""",
    "curve_phase_rmse": "WITH" + E + " SELECT i, j, dist FROM pairs",
    "base_distances": BASE_DISTANCES,
    "curve_hausdorff_family": VECTOR_FAMILY,
    "mhd_grid": MHD_GRID,
    "synthetic_robustness": """WITH b AS (SELECT k, k / 95.0 AS t, sin(2 * pi() * k / 95.0) AS p FROM range(96) r(k)),
m AS (SELECT s, round(s * 0.2, 1) AS shift, k AS kj, t AS u, p + CASE WHEN k = 48 THEN round(s * 0.2, 1) ELSE 0 END AS q FROM b, range(11) x(s)),
d AS (SELECT s, shift, k AS ki, kj, sqrt((t - u) ^ 2 + (p - q) ^ 2) AS d FROM m, b),
i AS (SELECT s, shift, max(d) AS hd, quantile_cont(d, 0.95) AS q95, avg(d) AS mhd FROM (SELECT s, shift, ki, min(d) AS d FROM d GROUP BY ALL) GROUP BY ALL),
j AS (SELECT s, max(d) AS hd, quantile_cont(d, 0.95) AS q95, avg(d) AS mhd FROM (SELECT s, kj, min(d) AS d FROM d GROUP BY ALL) GROUP BY ALL)
SELECT round(shift::DOUBLE, 6) AS shift, round(greatest(i.hd, j.hd), 6) AS hd, round(greatest(i.q95, j.q95), 6) AS q95, round(greatest(i.mhd, j.mhd), 6) AS mhd FROM i JOIN j USING (s)""",
    "knn_probabilities": "WITH" + KNN42 + " SELECT test, k, label, round(w / sum(w) OVER (PARTITION BY test, k), 6) AS prob FROM votes",
    "dtw_neighbours": DTW_NEIGHBOURS,
    "dtw_grid": DTW_GRID,
    "knn_pivots": "WITH" + KNN42 + " SELECT test, k, label, round(w / sum(w) OVER (PARTITION BY test, k), 6) AS prob FROM votes",
    "knn_predictions": "WITH" + KNN42 + " SELECT id, fold, k, label, pred FROM res",
    "choose_k": "WITH" + KNN42 + """,
tr AS (SELECT o.outer_, s.seed AS sd, f.id, f.label FROM folds f, (SELECT unnest(range(5))::INT AS outer_) o, (SELECT unnest([2026, 2027, 2028])::INT AS seed) s WHERE f.fold <> o.outer_),
inn AS (SELECT *, ((row_number() OVER (PARTITION BY outer_, sd, label ORDER BY md5(sd || '|' || id), id) - 1) % 3)::INT AS inner_ FROM tr),
nn AS (
  SELECT a.outer_, a.sd, a.inner_, d.i AS test, a.label AS truth, row_number() OVER (PARTITION BY a.outer_, a.sd, a.inner_, d.i ORDER BY dist, d.j) AS rank, b.label
  FROM two_way d JOIN inn a ON a.id = d.i JOIN inn b ON b.id = d.j AND b.outer_ = a.outer_ AND b.sd = a.sd AND b.inner_ <> a.inner_ QUALIFY rank <= 9),
nv AS (
  SELECT outer_, sd, inner_, test, truth, k, label AS pred, count(*) AS n, sum(k - rank) AS c FROM nn, (SELECT unnest([1, 3, 5, 7, 9])::INT AS k) ks WHERE rank <= k GROUP BY ALL),
np AS (SELECT * FROM nv QUALIFY row_number() OVER (PARTITION BY outer_, sd, inner_, test, k ORDER BY n DESC, c DESC, pred) = 1),
rc AS (SELECT outer_, sd, inner_, k, truth, avg((truth = pred)::INT) AS r FROM np GROUP BY ALL),
ba AS (SELECT outer_, sd, inner_, k, avg(r) AS ba FROM rc GROUP BY ALL),
sc AS (SELECT outer_, k, round(avg(ba), 12) AS score FROM ba GROUP BY ALL)
SELECT outer_ AS "outer", k, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY outer_ ORDER BY sc.score DESC, k) = 1""",
    "confusion": "WITH" + KNN42 + " SELECT label, pred, count(*) AS n FROM res WHERE k = 5 GROUP BY ALL",
    "class_recall": "WITH" + KNN42 + " SELECT label, count(*) AS n, round(avg((label = pred)::INT), 6) AS recall FROM res WHERE k = 5 GROUP BY ALL",
    "metric_values": "WITH" + KNN42 + metrics("res", "k") + " SELECT k, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(macro_f1, 6) AS macro_f1 FROM met",
    "fold_metrics": "WITH" + KNN42 + ", r5 AS (SELECT * FROM res WHERE k = 5)" + metrics("r5", "fold") + " SELECT fold, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(macro_f1, 6) AS macro_f1, (SELECT count(*) FROM r5 WHERE r5.fold = met.fold) AS n_test FROM met",
    "disagreements": "WITH" + KNN42 + """,
w AS (SELECT id, label, """ + ", ".join(f"max(CASE WHEN k = {k} THEN pred END) AS knn_{k}, max(CASE WHEN k = {k} THEN prob END) AS p{k}" for k in (1, 5, 9)) + """ FROM res GROUP BY ALL)
SELECT id, label, knn_1, round(p1, 6) AS knn_1_prob, knn_5, round(p5, 6) AS knn_5_prob, knn_9, round(p9, 6) AS knn_9_prob, (NOT (knn_1 = knn_5 AND knn_5 = knn_9))::INT AS disagree,
  (knn_1 <> label OR knn_5 <> label OR knn_9 <> label)::INT AS any_error
FROM w WHERE NOT (knn_1 = knn_5 AND knn_5 = knn_9) OR knn_1 <> label OR knn_5 <> label OR knn_9 <> label""",
    "top_disagreements": "WITH" + KNN42 + """,
w AS (SELECT id, label, """ + ", ".join(f"max(CASE WHEN k = {k} THEN pred END) AS k{k}" for k in (1, 5, 9)) + """ FROM res GROUP BY ALL),
d AS (SELECT id, label, (NOT (k1 = k5 AND k5 = k9))::INT AS disagree, (k1 <> label OR k5 <> label OR k9 <> label)::INT AS any_error FROM w)
SELECT (row_number() OVER (ORDER BY disagree DESC, label, id::VARCHAR, id))::INT AS rank, id, label, disagree, any_error FROM d WHERE disagree = 1 OR any_error = 1 QUALIFY rank <= 30""",
    "complementarity": "WITH" + KNN42 + """,
w AS (SELECT id, """ + ", ".join(f"max(CASE WHEN k = {k} THEN (label = pred)::INT END) AS k{k}" for k in (1, 5, 9)) + """ FROM res GROUP BY id)
SELECT k1 AS a_right, k9 AS b_right, count(*) AS n, sum(k5)::BIGINT AS fused_right FROM w GROUP BY ALL""",
    "mcnemar_holm": "WITH" + KNN42 + """,
w AS (SELECT id, """ + ", ".join(f"max(CASE WHEN k = {k} THEN (label = pred)::INT END) AS k{k}" for k in (1, 5, 9)) + """ FROM res GROUP BY id),
c AS (""" + " UNION ALL ".join(f"SELECT 'knn_{a} vs knn_{b}' AS comparison, count(*) FILTER (k{a} = 1 AND k{b} = 0) AS a_only, count(*) FILTER (k{a} = 0 AND k{b} = 1) AS b_only FROM w" for a, b in ((1, 5), (1, 9), (5, 9))) + """),
p AS (
  SELECT *, CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1),
    lambda i: exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2))))) END AS p FROM c),
h AS (SELECT *, least(1.0, (3 - row_number() OVER (ORDER BY p, comparison) + 1) * p) AS s FROM p),
x AS (SELECT *, max(s) OVER (ORDER BY p, comparison ROWS UNBOUNDED PRECEDING) AS ph FROM h)
SELECT comparison, a_only, b_only, round(p, 6) AS p, round(ph, 6) AS p_holm, (ph < 0.05)::INT AS significant FROM x""",
    "label_mean_distance": "WITH" + E + ", b AS (SELECT la, lb, dist FROM pairs UNION ALL SELECT lb, la, dist FROM pairs) SELECT la AS label_a, lb AS label_b, round(avg(dist), 6) AS mean_dist FROM b GROUP BY ALL",
    "distance_statistics": "WITH" + E + """ SELECT round(avg(dist) FILTER (same = 1), 6) AS within_mean, round(avg(dist) FILTER (same = 0), 6) AS between_mean,
  round(quantile_cont(dist, 0.5) FILTER (same = 1), 6) AS within_median, round(quantile_cont(dist, 0.5) FILTER (same = 0), 6) AS between_median,
  round(avg(dist) FILTER (same = 0) - avg(dist) FILTER (same = 1), 6) AS gap FROM pairs""",
    "pair_auc": "WITH" + E + """,
r AS (SELECT same, rank() OVER (ORDER BY dist DESC) + (count(*) OVER (PARTITION BY dist) - 1) / 2.0 AS r FROM pairs)
SELECT round((sum(r) FILTER (same = 1) - count(*) FILTER (same = 1) * (count(*) FILTER (same = 1) + 1) / 2.0) / (count(*) FILTER (same = 1)::DOUBLE * count(*) FILTER (same = 0)), 6) AS auc FROM r""",
    "distance_histogram": "WITH" + E + """,
t AS (SELECT quantile_cont(dist, 0.995) FILTER (same = 0) AS top FROM pairs),
i AS (SELECT least(floor(dist / (top / 54)), 53)::INT AS bin, same, top FROM pairs, t WHERE dist <= top),
n AS (SELECT sum(same) AS w, sum(1 - same) AS b, max(top) AS top FROM i)
SELECT bin, round(sum(same) / n.w / (n.top / 54), 4) AS within, round(sum(1 - same) / n.b / (n.top / 54), 4) AS between FROM i, n GROUP BY bin, n.w, n.b, n.top""",
    "run_summary": RUNS + f" SELECT method, count(*) AS runs, count(DISTINCT sample_seed) AS sample_seeds, count(DISTINCT outer_seed) AS outer_seeds, {_STAT} FROM runs GROUP BY method",
    "paired_differences": RUNS + " SELECT a.sample_seed, a.outer_seed, round(a.accuracy - b.accuracy, 6) AS difference FROM runs a JOIN runs b USING (sample_seed, outer_seed) WHERE a.method = 'knn_1' AND b.method = 'knn_9'",
    "ablation_summary": RUNS + """,
c AS (SELECT a.method AS removed, round(a.balanced_accuracy - b.balanced_accuracy, 9) AS change FROM runs a JOIN runs b USING (outer_seed) WHERE a.method <> 'knn_9' AND b.method = 'knn_9')
SELECT removed, round(avg(change), 6) AS change_mean, round(stddev_samp(change), 6) AS change_std, round(min(change), 6) AS change_min, round(max(change), 6) AS change_max, round(avg((change < 0)::INT), 6) AS share_negative FROM c GROUP BY removed""",
    "covariance_ellipses": """WITH e AS (SELECT label::VARCHAR AS label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
c AS (SELECT label, avg(x) AS x, avg(y) AS y, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS d FROM e GROUP BY label),
h AS (SELECT *, (a + d) / 2 AS mid, sqrt(((a - d) / 2) ^ 2 + b * b) AS half FROM c)
SELECT label, round(x, 6) AS x, round(y, 6) AS y, round(3.1 * sqrt(greatest(mid + half, 0)), 6) AS width, round(3.1 * sqrt(greatest(mid - half, 0)), 6) AS height, round(degrees(atan2(2 * b, a - d) / 2), 6) AS angle FROM h""",
}
