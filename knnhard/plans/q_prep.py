"""Registered queries B1-B12 (vector preparation, validation, sampling)."""

from pyspark.sql import functions as F

from knnhard.functions import vec
from knnhard.operators import vectors as vops
from knnhard.plans import fixtures as fx
from knnhard.plans import sqlgen as S
from knnhard.plans.registry import register

SEED = 1234


def _digest(col="v"):
    return [F.size(col).cast("long").alias("dim"), vec.rnd(vec.vsum(vec.dvec(col))).alias("vsum"),
            vec.rnd(vec.norm2(col)).alias("norm2")]


def _sdigest(col="v"):
    return f"len({col})::BIGINT AS dim, {S.r6(S.vsum(col))} AS vsum, {S.r6(S.norm2(col))} AS norm2"


@register("nan_repair", fx.with_fixtures(["vectors_dirty"], f"""
SELECT id, len(list_filter(v, lambda x: isnan(x)))::BIGINT AS n_nan, {_sdigest('w')}
FROM (SELECT id, v, list_transform(v, lambda x: CASE WHEN isnan(x) THEN 0.0::FLOAT ELSE x END) AS w FROM vectors_dirty)"""))
def q_nan_repair(spark, sf):
    d = vops.nan_repair(fx.vectors_dirty(spark, sf))
    return d.select("id", F.col("n_nan").cast("long").alias("n_nan"), *_digest())


@register("finite_check", fx.with_fixtures(["vectors_dirty"], """
SELECT sum(CASE WHEN len(list_filter(v, lambda x: isnan(x) OR isinf(x))) > 0 THEN 1 ELSE 0 END)::BIGINT AS n_not_finite
FROM vectors_dirty"""))
def q_finite_check(spark, sf):
    return vops.finite_violations(fx.vectors_dirty(spark, sf)).select(F.col("n_not_finite").cast("long"))


_REPAIRED = """(SELECT id, list_transform(v, lambda x: CASE WHEN isnan(x) THEN 0.0::FLOAT ELSE x END) AS v FROM vectors_dirty)"""


@register("drop_zero", fx.with_fixtures(["vectors_dirty"], f"""
SELECT id FROM {_REPAIRED} WHERE len(list_filter(v, lambda x: x <> 0)) > 0"""))
def q_drop_zero(spark, sf):
    d = vops.nan_repair(fx.vectors_dirty(spark, sf)).drop("n_nan")
    return vops.drop_zero(d).select("id")


@register("l2_normalise", fx.with_fixtures(["vectors_dirty"], f"""
SELECT id, {_sdigest('w')} FROM (
  SELECT id, list_transform(v, lambda x: x::DOUBLE / sqrt({S.norm2('v')})) AS w
  FROM {_REPAIRED} WHERE len(list_filter(v, lambda x: x <> 0)) > 0)"""))
def q_l2_normalise(spark, sf):
    d = vops.nan_repair(fx.vectors_dirty(spark, sf)).drop("n_nan")
    d = vops.l2_normalise(vops.drop_zero(d))
    return d.select("id", *_digest())


@register("pad8", fx.with_fixtures(["vectors_ip"], f"""
SELECT id, {_sdigest('w')} FROM (
  SELECT id, list_concat(v, list_transform(range(((8 - len(v) % 8) % 8)::BIGINT), lambda i: 0.0)) AS w FROM vectors_ip)"""))
def q_pad8(spark, sf):
    return vops.pad8(fx.vectors_ip(spark, sf)).select("id", *_digest())


@register("ip_lift", fx.with_fixtures(["vectors_dirty"], f"""
, s AS (SELECT greatest(1.0, max(sqrt({S.norm2('v')}))) AS m FROM {_REPAIRED})
SELECT id, {_sdigest('w')}, {S.r6('w[-1]')} AS last FROM (
  SELECT id, list_concat(y, [sqrt(greatest(0.0, 1.0 - {S.norm2('y')}))]) AS w
  FROM (SELECT id, list_transform(v, lambda x: x::DOUBLE / s.m) AS y FROM {_REPAIRED}, s))""".replace("\n, s AS", ", s AS", 1)))
def q_ip_lift(spark, sf):
    d = vops.nan_repair(fx.vectors_dirty(spark, sf)).drop("n_nan")
    d = vops.ip_lift(d)
    return d.select("id", *_digest(), vec.rnd(F.element_at("v", -1)).alias("last"))


@register("validate_vectors", fx.with_fixtures(["vectors_dirty"], f"""
SELECT count(*)::BIGINT AS n_rows, min(len(v))::BIGINT AS n_dims_min, max(len(v))::BIGINT AS n_dims_max,
  sum(CASE WHEN len(list_filter(v, lambda x: isnan(x) OR isinf(x))) > 0 THEN 1 ELSE 0 END)::BIGINT AS n_not_finite,
  sum(CASE WHEN abs(sqrt({S.norm2('v')}) - 1) > 1e-5 THEN 1 ELSE 0 END)::BIGINT AS n_not_unit
FROM vectors_dirty"""))
def q_validate_vectors(spark, sf):
    v = vops.validate(fx.vectors_dirty(spark, sf), "angular")
    return v.select(*[F.col(c).cast("long").alias(c) for c in v.columns])


@register("sample_without", fx.with_fixtures(["vectors"], f"""
SELECT id FROM vectors ORDER BY md5(concat_ws(':', '{SEED}', id::VARCHAR)), id LIMIT 25"""))
def q_sample_without(spark, sf):
    return vops.sample_without(fx.vectors(spark, sf), 25, SEED).select("id")


_DRAWS = f"""(SELECT range AS draw, floor({S.uniform(SEED, 'pick', '0', 'range')} * (SELECT max(id) + 1 FROM vectors))::BIGINT AS id
  FROM range(100))"""


@register("sample_with", fx.with_fixtures(["vectors"], f"SELECT d.draw::BIGINT AS draw, d.id FROM {_DRAWS} d JOIN vectors USING (id)"))
def q_sample_with(spark, sf):
    return vops.sample_with(fx.vectors(spark, sf), 100, SEED).select(F.col("draw").cast("long"), "id")


@register("holdout", fx.with_fixtures(["vectors"], f"SELECT id FROM vectors WHERE id NOT IN (SELECT id FROM {_DRAWS})"))
def q_holdout(spark, sf):
    v = fx.vectors(spark, sf)
    return vops.holdout(v, vops.sample_with(v, 100, SEED)).select("id")


@register("reset_last", fx.with_fixtures(["vectors_ip"], f"""
SELECT id, {_sdigest('w')}, {S.r6('w[-1]')} AS last FROM (SELECT id, list_concat(v[1:len(v)-1], [0.0]) AS w FROM vectors_ip)"""))
def q_reset_last(spark, sf):
    d = vops.reset_last(fx.vectors_ip(spark, sf), "v")
    return d.select("id", *_digest(), vec.rnd(F.element_at("v", -1)).alias("last"))


@register("znorm", fx.with_fixtures(["vectors"], f"""
SELECT id, {_sdigest('w')} FROM (
  SELECT id, list_transform(v, lambda x: (x::DOUBLE - mu) / sd) AS w FROM (
    SELECT id, v, mu, sqrt(list_sum(list_transform(v, lambda x: (x::DOUBLE - mu) * (x::DOUBLE - mu))) / len(v)) AS sd
    FROM (SELECT id, v, {S.vsum('v')} / len(v) AS mu FROM vectors)))"""))
def q_znorm(spark, sf):
    return vops.znorm(fx.vectors(spark, sf)).select("id", *_digest())
