"""Queries on embeddings, detections, labels and edit history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import make_box
from ..functions.vectors import cosine_distance
from ..operators import agreement, calibration, clusters, detections, neighbors, style
from ..operators.ordered import ordered_rows
from .checks import FRAMES_SQL, num
from .frames import FACES_SQL, faces, table
from .registry import ORACLES, query

_DIST = "1 - list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


@query("consecutive_distance", f"""SELECT label, vec_id, round({_DIST.format(a='e', b='p')}, 6) AS distance FROM
 (SELECT label, vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p
 FROM embeddings) WHERE p IS NOT NULL""")
def consecutive_distance(spark, sf_dir):
    rows = ordered_rows(_embeddings(spark, sf_dir), ("label",), ("vec_id",)).lag("prev", "embedding")
    return rows.result().where("prev IS NOT NULL").select(
        "label", "vec_id", F.round(cosine_distance("prev.embedding", "embedding"), 6).alias("distance"))


def _knn_sql(a: str, b: str, k: int, extra: str = "TRUE") -> str:
    dist = _DIST.format(a=a, b=b)
    return f"""(SELECT vec_id, neighbor, distance, rank FROM (SELECT x.vec_id, y.vec_id AS neighbor, {dist} AS distance,
 row_number() OVER (PARTITION BY x.vec_id ORDER BY {dist}, y.vec_id) AS rank FROM embeddings x JOIN embeddings y
 ON x.vec_id <> y.vec_id AND {extra}) WHERE rank <= {k})"""


@query("knn_topk", f"SELECT vec_id, neighbor, round(distance, 6) AS distance, rank FROM "
       f"{_knn_sql('x.embedding', 'y.embedding', 5)}")
def knn_topk(spark, sf_dir):
    near = neighbors.knn(_embeddings(spark, sf_dir), "vec_id", "embedding", 5)
    return near.select("vec_id", "neighbor", F.round("distance", 6).alias("distance"),
                       F.col("rank").cast("long").alias("rank"))


# a second embedding of the same rows: every dimension weighed anew
_SCALED = "list_transform({v}.embedding, lambda e, i: e * (1 + i % 4))"


@query("neighbor_jaccard", f"""WITH a AS {_knn_sql('x.embedding', 'y.embedding', 5)}, b AS
 {_knn_sql(_SCALED.format(v='x'), _SCALED.format(v='y'), 5)}, c AS (SELECT a.vec_id, COUNT(*) AS n FROM a JOIN b
 USING (vec_id, neighbor) GROUP BY a.vec_id) SELECT COUNT(*) AS n, round(AVG(COALESCE(c.n, 0) /
 CAST(10 - COALESCE(c.n, 0) AS DOUBLE)), 6) AS jaccard FROM embeddings e LEFT JOIN c USING (vec_id)""")
def neighbor_jaccard(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).withColumn("scaled", F.transform("embedding", lambda e, i: e * (1 + (i + 1) % 4)))
    found = neighbors.neighbor_jaccard(rows, "vec_id", "embedding", "scaled", 5)
    return found.select("n", F.round("jaccard", 6).alias("jaccard"))


COMPONENT_DIST = 0.62


@query("cluster_components", f"""WITH RECURSIVE edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN
 embeddings y ON x.vec_id <> y.vec_id AND {_DIST.format(a='x.embedding', b='y.embedding')} <= {COMPONENT_DIST}),
 reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
 SELECT a AS vec_id, MIN(b) AS component FROM reach GROUP BY a""")
def cluster_components(spark, sf_dir):
    return clusters.cluster_components(_embeddings(spark, sf_dir), "vec_id", "embedding", COMPONENT_DIST)


@query("cluster_greedy", f"""WITH RECURSIVE pairs AS (SELECT x.vec_id AS a, y.vec_id AS b,
 {_DIST.format(a='x.embedding', b='y.embedding')} AS d FROM embeddings x JOIN embeddings y
 ON y.vec_id < x.vec_id AND x.label = y.label), near AS (SELECT * FROM (SELECT *, row_number() OVER
 (PARTITION BY a ORDER BY d, b DESC) AS rn FROM pairs WHERE d <= {COMPONENT_DIST}) WHERE rn = 1),
 tree AS (SELECT vec_id, vec_id AS root FROM embeddings WHERE vec_id NOT IN (SELECT a FROM near)
 UNION ALL SELECT n.a, t.root FROM near n JOIN tree t ON t.vec_id = n.b)
 SELECT e.label, e.vec_id, t.root AS cluster FROM embeddings e JOIN tree t USING (vec_id)""")
def cluster_greedy(spark, sf_dir):
    return clusters.cluster_greedy(_embeddings(spark, sf_dir), ["label"], ["vec_id"], "vec_id", "embedding",
                                   COMPONENT_DIST)


def _greedy_sql(rows: str) -> str:
    """CTEs ending in `tree` (vec_id, root): greedy clusters per label of `rows`."""
    return f"""pairs AS (SELECT x.vec_id AS a, y.vec_id AS b, {_DIST.format(a='x.embedding', b='y.embedding')} AS d
 FROM {rows} x JOIN {rows} y ON y.vec_id < x.vec_id AND x.label = y.label), near AS (SELECT * FROM (SELECT *,
 row_number() OVER (PARTITION BY a ORDER BY d, b DESC) AS rn FROM pairs WHERE d <= {COMPONENT_DIST}) WHERE rn = 1),
 tree AS (SELECT vec_id, vec_id AS root FROM {rows} WHERE vec_id NOT IN (SELECT a FROM near)
 UNION ALL SELECT n.a, t.root FROM near n JOIN tree t ON t.vec_id = n.b)"""


# three in ten poses are too unsure to be grouped, one in seven is unknown
@query("group_poses", f"""WITH RECURSIVE sure AS (SELECT * FROM embeddings WHERE vec_id % 10 >= 3 AND vec_id % 7 <> 2),
 {_greedy_sql('sure')} SELECT s.label, s.vec_id, t.root AS cluster FROM sure s JOIN tree t USING (vec_id)""")
def group_poses(spark, sf_dir):
    poses = _embeddings(spark, sf_dir).withColumns({
        "pose": F.expr("CASE WHEN vec_id % 7 <> 2 THEN embedding END"), "pose_confidence": F.expr("CASE WHEN vec_id % 10 >= 3 THEN 0.5D ELSE 0.49D END")})
    return clusters.group_poses(poses, ["label"], ["vec_id"], "vec_id", limit=COMPONENT_DIST)


# every three faces in a row are on one photo
@query("group_persons", f"""WITH RECURSIVE {_greedy_sql('embeddings')} SELECT DISTINCT e.label, t.root AS person, e.vec_id // 3 AS photo_id
 FROM embeddings e JOIN tree t USING (vec_id)""")
def group_persons(spark, sf_dir):
    shown = _embeddings(spark, sf_dir).withColumn("photo_id", F.expr("vec_id div 3")).withColumnRenamed("embedding", "faceprint")
    return clusters.group_persons(shown, ["label"], ["vec_id"], "photo_id", "vec_id", limit=COMPONENT_DIST)


# --- detections -------------------------------------------------------------------

_MOVED = "x + CAST((photo_id + idx) % 4 AS DOUBLE) / 50"
_BOTH_SQL = f"""{FRAMES_SQL}, {FACES_SQL}, a AS (SELECT photo_id, idx, x, y, w, h FROM faces WHERE (photo_id + idx) % 5 <> 0),
 b AS (SELECT photo_id, idx, {_MOVED} AS x, y, w, h FROM faces WHERE (photo_id + idx) % 7 <> 0)"""
_IOU_SQL = """greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))
 * greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"""


def _detectors(spark, sf_dir):
    rows = faces(spark, sf_dir).select("photo_id", "idx", "bbox")
    box = F.col("bbox")
    shift = ((F.col("photo_id") + F.col("idx")) % 4).cast("double") / 50
    moved = rows.withColumn("bbox", make_box(box["x"] + shift, box["y"], box["w"], box["h"]))
    return (rows.where("(photo_id + idx) % 5 <> 0"), moved.where("(photo_id + idx) % 7 <> 0"))


@query("iou_pairs", f"""WITH {_BOTH_SQL} SELECT photo_id, key_a, key_b, round(i / (s - i), 6) AS iou FROM (SELECT a.photo_id,
 a.idx AS key_a, b.idx AS key_b, {_IOU_SQL} AS i, a.w * a.h + b.w * b.h AS s FROM a JOIN b USING (photo_id))
 WHERE s - i > 0 AND i / (s - i) >= 0.3""")
def iou_pairs(spark, sf_dir):
    a, b = _detectors(spark, sf_dir)
    return detections.iou_pairs(a, b, ["photo_id"], "idx").withColumn("iou", F.round("iou", 6))


@query("match_detections", f"""WITH RECURSIVE {_BOTH_SQL}, pairs AS (SELECT photo_id, key_a, list(key_b ORDER BY key_b) AS cand
 FROM (SELECT a.photo_id, a.idx AS key_a, b.idx AS key_b, {_IOU_SQL} AS i, a.w * a.h + b.w * b.h AS s FROM a JOIN b
 USING (photo_id)) WHERE s - i > 0 AND i / (s - i) >= 0.3 GROUP BY photo_id, key_a),
 asked AS (SELECT a.photo_id, a.idx AS key_a, COALESCE(cand, []) AS cand, row_number() OVER (PARTITION BY a.photo_id
 ORDER BY a.idx) AS k FROM a LEFT JOIN pairs p ON p.photo_id = a.photo_id AND p.key_a = a.idx),
 walk AS (SELECT photo_id, key_a, k, cand[1] AS key_b, cand[1:1] AS used FROM asked WHERE k = 1 UNION ALL
 SELECT photo_id, key_a, k, free[1], list_concat(used, free[1:1]) FROM (SELECT n.photo_id, n.key_a, n.k, w.used,
 list_filter(n.cand, lambda c: NOT list_contains(w.used, c)) AS free FROM walk w JOIN asked n ON n.photo_id = w.photo_id
 AND n.k = w.k + 1))
 SELECT photo_id, key_a, key_b FROM walk UNION ALL SELECT b.photo_id, NULL, b.idx FROM b LEFT JOIN walk w
 ON w.photo_id = b.photo_id AND w.key_b = b.idx WHERE w.photo_id IS NULL""")
def match_detections(spark, sf_dir):
    a, b = _detectors(spark, sf_dir)
    return detections.match_detections(a, b, ["photo_id"], "idx")


@query("detection_union", f"""WITH {_BOTH_SQL}, m AS ({ORACLES['match_detections']})
 SELECT photo_id, idx AS key, 'a' AS source, round(x, 6) AS x FROM a UNION ALL SELECT b.photo_id, b.idx, 'b', round(b.x, 6)
 FROM b JOIN m ON m.photo_id = b.photo_id AND m.key_b = b.idx AND m.key_a IS NULL""")
def detection_union(spark, sf_dir):
    a, b = _detectors(spark, sf_dir)
    found = detections.union_detections(a, b, ["photo_id"], "idx")
    return found.select("photo_id", F.col("idx").alias("key"), "source", F.round("bbox.x", 6).alias("x"))


# boxes of an image best first; each step looks at one box of every image
_OVERLAP = """greatest(0.0, least(q.x + q.w, b.x + b.w) - greatest(q.x, b.x))
 * greatest(0.0, least(q.y + q.h, b.y + b.h) - greatest(q.y, b.y))"""


@query("nms", f"""WITH RECURSIVE {FRAMES_SQL}, {FACES_SQL}, boxes AS (SELECT photo_id // 4 AS image, photo_id * 10 + idx AS box_id,
 capture_quality, x, y, w, h FROM faces), ranked AS (SELECT *, row_number() OVER (PARTITION BY
 image ORDER BY capture_quality DESC NULLS LAST, box_id) AS k FROM boxes), walk AS (SELECT image, k, box_id, capture_quality, TRUE AS keep,
 [{{'x': x, 'y': y, 'w': w, 'h': h}}] AS kept FROM ranked WHERE k = 1 UNION ALL SELECT image, k, box_id, capture_quality, keep,
 CASE WHEN keep THEN list_append(kept, me) ELSE kept END FROM (SELECT b.image, b.k, b.box_id, b.capture_quality, a.kept,
 {{'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}} AS me, len(list_filter(a.kept, lambda q: {_OVERLAP} >= 0.4 * (q.w * q.h + b.w * b.h -
 {_OVERLAP}))) = 0 AS keep FROM walk a JOIN ranked b ON b.image = a.image AND b.k = a.k + 1))
 SELECT image, box_id, capture_quality FROM walk WHERE keep""")
def nms(spark, sf_dir):
    rows = faces(spark, sf_dir).withColumn(
        "image", F.expr("photo_id div 4")).withColumn("box_id", F.col("photo_id") * 10 + F.col("idx"))
    return detections.nms(rows, ["image"], "box_id", score="capture_quality")


# --- agreement and calibration ------------------------------------------------------

@query("spearman", """WITH r AS (SELECT row_number() OVER (ORDER BY value, event_id) AS a, row_number() OVER
 (ORDER BY event_id * 7919 % 10007, event_id) AS b FROM events)
 SELECT COUNT(*) AS n, round(corr(a, b), 6) AS spearman FROM r""")
def spearman(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", "value", (F.col("event_id") * 7919 % 10007).alias("other"))
    return agreement.spearman(rows, "value", "other", "event_id").withColumn("spearman", F.round("spearman", 6))


@query("rank_disagreement", """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS rank_a,
 row_number() OVER (ORDER BY event_id * 7919 % 10007 DESC, event_id) - 1 AS rank_b FROM events)
 SELECT event_id, rank_a, rank_b, abs(rank_a - rank_b) AS rank_gap FROM r ORDER BY rank_gap DESC, event_id LIMIT 5""")
def rank_disagreement(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", "value", (F.col("event_id") * 7919 % 10007).alias("other"))
    return agreement.rank_disagreement(rows, "value", "other", "event_id")


@query("weighted_median", """WITH l AS (SELECT photo, idx, a, w FROM (SELECT l_orderkey AS photo, l_partkey * 100 + l_linenumber
 * 10 + l_suppkey % 10 AS idx, CAST(l_partkey % 61 - 30 AS DOUBLE) AS a, l_quantity AS w FROM lineitem)),
 u AS (SELECT *, SUM(w) OVER (PARTITION BY photo ORDER BY a, idx ROWS UNBOUNDED PRECEDING) AS upto,
 SUM(w) OVER (PARTITION BY photo) AS tot FROM l WHERE abs(a) <= 25),
 m AS (SELECT photo, MAX(tot) AS tot, MIN(CASE WHEN upto >= tot / 2 THEN a END) AS med FROM u GROUP BY photo)
 SELECT p.photo, tot AS total_weight, CASE WHEN tot >= 40 THEN med END AS weighted_median
 FROM (SELECT DISTINCT photo FROM l) p LEFT JOIN m USING (photo)""")
def weighted_median(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS photo", "l_partkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS idx",
        "CAST(l_partkey % 61 - 30 AS DOUBLE) AS a", "l_quantity AS w")
    return agreement.weighted_median(lines, ["photo"], "a", "w", "idx", min_total=40.0)


_SCORED_SQL = """scored AS (SELECT least(1.0, n_chars / CAST(3000 AS DOUBLE)) AS score, quality = 1 AS is_open, lang
 FROM documents JOIN labels USING (doc_id))"""
_RATES = """AVG(CASE WHEN is_open THEN CASE WHEN score < t THEN 1.0 ELSE 0.0 END END) AS fr,
 AVG(CASE WHEN NOT is_open THEN CASE WHEN score >= t THEN 1.0 ELSE 0.0 END END) AS fa"""


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.least(F.lit(1.0), F.col("n_chars") / 3000.0).alias("score"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("is_open", F.col("quality") == 1)


@query("evaluate_threshold", f"""WITH {_SCORED_SQL} SELECT round(fr, 6) AS false_reject, round(fa, 6) AS false_accept,
 round((2 - fr - fa) / 2, 6) AS balanced_accuracy FROM (SELECT {_RATES.replace('< t', '< 0.4').replace('>= t', '>= 0.4')} FROM scored)""")
def evaluate_threshold(spark, sf_dir):
    rates = calibration.evaluate(_scored(spark, sf_dir), "score", F.col("is_open"), 0.4)
    return rates.select(*[F.round(c, 6).alias(c) for c in rates.columns])


_SWEEP_SQL = f"""{_SCORED_SQL}, grid AS (SELECT i / CAST(100 AS DOUBLE) AS t FROM range(101) r(i)),
 swept AS (SELECT t, {_RATES} FROM scored, grid GROUP BY t),
 rated AS (SELECT t AS threshold, fr AS false_reject, fa AS false_accept, (2 - fr - fa) / 2 AS balanced_accuracy FROM swept)"""


@query("threshold_sweep", f"""WITH {_SWEEP_SQL} SELECT threshold, round(false_reject, 6) AS false_reject,
 round(false_accept, 6) AS false_accept, round(balanced_accuracy, 6) AS balanced_accuracy FROM rated""")
def threshold_sweep(spark, sf_dir):
    swept = calibration.sweep(_scored(spark, sf_dir), "score", F.col("is_open"))
    return swept.select("threshold", *[F.round(c, 6).alias(c) for c in swept.columns[1:]])


@query("best_threshold", f"""WITH {_SWEEP_SQL} SELECT threshold, round(false_reject, 6) AS false_reject,
 round(false_accept, 6) AS false_accept, round(balanced_accuracy, 6) AS balanced_accuracy FROM rated
 ORDER BY round(balanced_accuracy, 9) DESC, threshold LIMIT 1""")
def best_threshold(spark, sf_dir):
    best = calibration.best_threshold(_scored(spark, sf_dir), "score", F.col("is_open"))
    return best.select("threshold", *[F.round(c, 6).alias(c) for c in best.columns[1:]])


@query("label_report", """WITH r AS (SELECT lang, CASE WHEN d.doc_id % 6 <> 0 THEN n_chars / CAST(3000 AS DOUBLE) END
 AS score, CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 'unclear' WHEN quality = 1 THEN 'open' ELSE 'closed'
 END AS label FROM documents d LEFT JOIN labels l USING (doc_id)), u AS (SELECT * FROM r WHERE label IN ('open', 'closed'))
 SELECT lang, COUNT(*) AS labelled, COUNT(score) AS measured, COUNT(CASE WHEN label = 'open' THEN score END) AS n_positive,
 COUNT(CASE WHEN label = 'closed' THEN score END) AS n_negative, round(AVG(CASE WHEN label = 'open' THEN score END), 6)
 AS mean_positive, round(AVG(CASE WHEN label = 'closed' THEN score END), 6) AS mean_negative FROM u GROUP BY lang""")
def label_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "lang", "CASE WHEN doc_id % 6 <> 0 THEN n_chars / 3000D END AS score")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("label", F.expr(
        "CASE WHEN toxic = 1 THEN 'unclear' WHEN quality = 1 THEN 'open' WHEN quality = 0 THEN 'closed' END"))
    report = calibration.label_report(rows, "score", "label", "lang")
    return report.withColumns({c: F.round(c, 6) for c in ("mean_positive", "mean_negative")})


@query("label_precision", """WITH r AS (SELECT source, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN
 'unclear' WHEN quality = 1 THEN 'real' ELSE 'not_face' END AS label FROM documents d LEFT JOIN labels l USING (doc_id)),
 c AS (SELECT source, COUNT(*) AS total, COUNT(CASE WHEN label = 'real' THEN 1 END) AS real,
 COUNT(CASE WHEN label = 'not_face' THEN 1 END) AS not_face, COUNT(CASE WHEN label = 'unclear' THEN 1 END) AS unclear,
 COUNT(CASE WHEN label = 'unlabelled' THEN 1 END) AS unlabelled FROM r GROUP BY source)
 SELECT *, round(real / CAST(NULLIF(real + not_face, 0) AS DOUBLE), 6) AS precision FROM c""")
def label_precision(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").selectExpr(
        "doc_id", "CASE WHEN toxic = 1 THEN 'unclear' WHEN quality = 1 THEN 'real' ELSE 'not_face' END AS label")
    found = calibration.label_precision(table(spark, sf_dir, "documents"), labels, "doc_id", "source")
    return found.withColumn("precision", F.round("precision", 6))


_DECIDED = """CASE WHEN l_discount > 0.05 THEN 'pick' ELSE 'reject' END AS engine, CASE WHEN l_tax > 0.04 THEN 'pick'
 ELSE 'reject' END AS user_state"""


@query("override_agreement", f"""SELECT l_returnflag, COUNT(*) AS n, round(AVG(CASE WHEN engine = user_state THEN 1.0
 ELSE 0.0 END), 6) AS agreement, round(AVG(CASE WHEN user_state = 'pick' THEN CASE WHEN engine = 'reject' THEN 1.0
 ELSE 0.0 END END), 6) AS false_reject FROM (SELECT l_returnflag, {_DECIDED} FROM lineitem) GROUP BY l_returnflag""")
def override_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag", "CASE WHEN l_discount > 0.05 THEN 'pick' ELSE 'reject' END AS engine",
        "CASE WHEN l_tax > 0.04 THEN 'pick' ELSE 'reject' END AS user_state")
    found = calibration.override_agreement(rows, "engine", "user_state", ["l_returnflag"])
    return found.withColumns({c: F.round(c, 6) for c in ("agreement", "false_reject")})


@query("weight_refit")
def weight_refit(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("toxic_score", F.col("toxic").cast("double"))
    fitted = calibration.refit_weights(rows, ("score", "toxic_score"), "quality",
                                       {"score": 0.5, "toxic_score": 0.1})
    return spark.createDataFrame(list(fitted.items()), "metric string, weight double")


# --- style --------------------------------------------------------------------------

@query("delta_targets", """SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, round(ln(l_extendedprice / (1000 + l_quantity)), 6)
 AS delta_temperature, round(l_tax - l_discount, 6) AS delta_tint FROM lineitem""")
def delta_targets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice AS final_temperature",
        "1000 + l_quantity AS base_temperature", "l_tax AS final_tint", "l_discount AS base_tint")
    found = style.delta_targets(rows, ("temperature", "tint"))
    return found.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey",
                        *[F.round(c, 6).alias(c) for c in ("delta_temperature", "delta_tint")])


@query("look_families")
def look_families(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).selectExpr("vec_id", *[
        f"CAST(embedding[{i}] AS DOUBLE) AS d{i}" for i in range(64)])
    found = style.look_families(rows, [f"d{i}" for i in range(64)], 4)
    return found.groupBy("family").agg(F.count(F.lit(1)).alias("n"))


_BLEND_SQL = f"""near AS {_knn_sql('x.embedding', 'y.embedding', 8, 'x.label = y.label')},
 blended AS (SELECT e.label, n.vec_id, COUNT(*) AS n_neighbors, AVG(1 - distance) AS confidence,
 SUM(exp((1 - distance) / {num(.1)}) * CAST(e.embedding[1] AS DOUBLE)) / SUM(exp((1 - distance) / {num(.1)})) AS pred
 FROM near n JOIN embeddings e ON e.vec_id = n.neighbor GROUP BY e.label, n.vec_id)"""


def _blend(spark, sf_dir):
    rows = _embeddings(spark, sf_dir).withColumn("delta", F.col("embedding")[0].cast("double"))
    return rows, style.knn_blend(rows, "vec_id", "embedding", "label", ["delta"])


@query("knn_blend", f"""WITH {_BLEND_SQL} SELECT e.label, e.vec_id, COALESCE(n_neighbors, 0) AS n_neighbors,
 round(confidence, 6) AS confidence, round(pred, 6) AS pred_delta FROM embeddings e LEFT JOIN blended USING (vec_id)""")
def knn_blend(spark, sf_dir):
    found = _blend(spark, sf_dir)[1]
    return found.withColumns({c: F.round(c, 6) for c in ("confidence", "pred_delta")})


@query("clamp_to_group", """WITH b AS (SELECT l_suppkey, MIN(l_discount) AS lo, MAX(l_discount) AS hi FROM lineitem
 WHERE l_suppkey % 5 <> 0 GROUP BY l_suppkey) SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey,
 CASE WHEN l_quantity > 5 AND lo IS NOT NULL THEN least(hi, greatest(lo, l_tax * 1.5)) END AS pred_delta
 FROM lineitem LEFT JOIN b USING (l_suppkey)""")
def clamp_to_group(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    history = items.where("l_suppkey % 5 <> 0").select("l_suppkey", F.col("l_discount").alias("delta"))
    rows = items.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity",
                        (F.col("l_tax") * 1.5).alias("pred_delta"))
    return style.clamp_to_family(rows, history, "l_suppkey", ["delta"], F.col("l_quantity") > 5).drop("l_quantity")


@query("eval_vs_median", f"""WITH {_BLEND_SQL}, j AS (SELECT e.label, CAST(e.embedding[1] AS DOUBLE) AS a,
 CASE WHEN confidence > 0.2 THEN pred END AS p FROM embeddings e JOIN blended USING (vec_id)),
 m AS (SELECT label, median(a) AS med FROM j GROUP BY label)
 SELECT j.label, COUNT(*) AS n, round(AVG(CASE WHEN p IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage,
 round(AVG(abs(p - a)), 6) AS mae, round(AVG(CASE WHEN p IS NOT NULL THEN CASE WHEN sign(p) = sign(a) THEN 1.0 ELSE 0.0
 END END), 6) AS sign_agreement, round(AVG(CASE WHEN p IS NOT NULL THEN abs(med - a) END), 6) AS median_mae
 FROM j JOIN m USING (label) GROUP BY j.label""")
def eval_vs_median(spark, sf_dir):
    rows, blended = _blend(spark, sf_dir)
    joined = rows.select("label", "vec_id", "delta").join(
        blended.select("vec_id", F.when(F.col("confidence") > 0.2, F.col("pred_delta")).alias("pred")), "vec_id")
    found = style.eval_vs_median(joined, "label", "vec_id", "delta", "pred")
    return found.withColumns({c: F.round(c, 6) for c in ("coverage", "mae", "sign_agreement", "median_mae")})
