"""Feature preparation, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions.convert import range_midpoint
from tabwright.operators import features as X
from tabwright.operators import metrics as M
from tabwright.plans.base import CUSTOMER_DIRTY, EVENTS_DIRTY, MODELS, SCORED, query, table, view


@query(
    "column_roles",
    """select 'c_custkey' as "column", 'numeric' as role union all
       select 'acctbal_txt', case when (select count(distinct acctbal_txt) from dirty) <= 50 then 'low_card' else 'high_card' end union all
       select 'name_txt', case when (select count(distinct name_txt) from dirty) <= 50 then 'low_card' else 'high_card' end union all
       select 'segment', case when (select count(distinct segment) from dirty) <= 50 then 'low_card' else 'high_card' end""",
    dirty=CUSTOMER_DIRTY,
)
def _(spark, sf):
    return X.roles_table(view(spark, sf, CUSTOMER_DIRTY))


@query(
    "fit_medians",
    """select 'value' as "column", cast(median(value) as double) as median from dirty
       union all select 'user_id', cast(median(user_id) as double) from dirty""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    prep = X.fit_features(view(spark, sf, EVENTS_DIRTY), ["value", "user_id"])
    return spark.createDataFrame(sorted(prep.medians.items()), "column string, median double")


@query(
    "fit_modes",
    """select 'event_type' as "column", (select event_type from dirty where event_type is not null
         group by event_type order by count(*) desc, event_type limit 1) as mode""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    prep = X.fit_features(view(spark, sf, EVENTS_DIRTY), ["event_type"])
    return spark.createDataFrame(sorted(prep.modes.items()), "column string, mode string")


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_MODE = "(select segment from dirty where segment is not null group by segment order by count(*) desc, segment limit 1)"


@query(
    "onehot_drop_first",
    "select c_custkey, "
    + ", ".join(f"cast(coalesce(segment, {_MODE}) = '{s}' as double) as \"segment_{s}\"" for s in _SEGMENTS[1:])
    + " from dirty",
    dirty=CUSTOMER_DIRTY,
)
def _(spark, sf):
    df = view(spark, sf, CUSTOMER_DIRTY).select("c_custkey", "segment")
    return X.fit_features(df, ["segment"]).transform(df)


@query(
    "encode_unseen",
    """with d as (select name_txt, row_number() over (order by name_txt) - 1 as pos from
           (select distinct name_txt from dirty where c_custkey % 3 <> 0))
       select c_custkey, cast(coalesce(pos, -1) as double) as name_txt from dirty left join d using (name_txt)""",
    dirty=CUSTOMER_DIRTY,
)
def _(spark, sf):
    df = view(spark, sf, CUSTOMER_DIRTY).select("c_custkey", "name_txt")
    return X.fit_features(df.filter("c_custkey % 3 <> 0"), ["name_txt"]).transform(df)


@query(
    "align_features",
    """select event_id, cast(0 as double) as absent, coalesce(value, 0) as value, cast(user_id as double) as user_id from dirty""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    return X.align_features(view(spark, sf, EVENTS_DIRTY), ["absent", "value", "user_id"], ["event_id"])


@query(
    "target_index",
    """select o_orderkey, cast((select count(*) from (select distinct o_orderstatus as s from orders) where s < o.o_orderstatus)
         as double) as label, o_orderstatus as decoded from orders o""",
)
def _(spark, sf):
    df = table(spark, sf, "orders")
    labels = X.target_labels(df, "o_orderstatus")
    out = labels.encode(df, "o_orderstatus", "label")
    return out.select("o_orderkey", "label", labels.decode(F.col("label")).alias("decoded"))


@query(
    "problem_type",
    """select case when count(distinct l_linenumber) <= 20 and count(distinct l_linenumber) < count(*) * 0.05
                   then 'classification' else 'regression' end as l_linenumber,
              case when count(distinct l_extendedprice) <= 20 and count(distinct l_extendedprice) < count(*) * 0.05
                   then 'classification' else 'regression' end as l_extendedprice,
              'classification' as l_returnflag from lineitem""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    names = ["l_linenumber", "l_extendedprice", "l_returnflag"]
    return spark.createDataFrame([tuple(X.problem_type(df, n) for n in names)], ", ".join(f"{n} string" for n in names))


@query(
    "sample_n",
    "select o_orderkey, o_totalprice from orders order by md5('42|' || cast(o_orderkey as varchar)), o_orderkey limit 1000",
)
def _(spark, sf):
    return X.sample_exact(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 1000)


@query(
    "train_test_split",
    """select o_orderkey, case when cast('0x' || substr(md5('42|' || cast(o_orderkey as varchar)), 1, 8) as bigint) % 100 < 20
              then 'test' else 'train' end as part from orders""",
)
def _(spark, sf):
    train, test = X.train_test(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "stratified_folds",
    """select event_id, event_type, cast((row_number() over (partition by event_type
          order by md5('42|' || cast(event_id as varchar)), event_id) - 1) % 5 as integer) as fold from events""",
)
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type")
    return X.stratified_folds(df, "event_type", ["event_id"])


@query(
    "model_metadata",
    """select 'event_type' as "column", 'low_card' as role, cast(null as double) as median,
              (select event_type from dirty where event_type is not null group by event_type
               order by count(*) desc, event_type limit 1) as mode,
              (select list(event_type order by event_type) from (select distinct event_type from dirty where event_type is not null)) as categories
       union all select 'value', 'numeric', (select cast(median(value) as double) from dirty), null, null""",
    dirty=EVENTS_DIRTY,
)
def _(spark, sf):
    prep = X.fit_features(view(spark, sf, EVENTS_DIRTY), ["event_type", "value"])
    rows = [
        (c, "numeric" if c in prep.medians else "low_card" if c in prep.categories else "high_card",
         prep.medians.get(c), prep.modes.get(c), prep.categories.get(c))
        for c in prep.inputs
    ]
    schema = "column string, role string, median double, mode string, categories array<string>"
    return spark.createDataFrame(rows, schema)


@query(
    "gnb_stats",
    """select event_type, count(*) as n, round(avg(value), 6) as mean, round(var_pop(value), 4) as variance
       from events group by event_type""",
)
def _(spark, sf):
    from tabwright.operators.models import class_statistics

    out = class_statistics(table(spark, sf, "events"), "event_type", ["value"])
    return out.select(
        "event_type", "n", F.round("value_mean", 6).alias("mean"), F.round("value_variance", 4).alias("variance")
    )


@query(
    "range_bins",
    """select "column", case when high - low <= 15 and low = floor(low) and high = floor(high)
                then [cast(cast(v as bigint) as varchar) for v in range(cast(low as bigint), cast(high as bigint) + 1)]
                else [format('{:.1f}', round(low + i * (high - low) / 8, 1)) || '-' || format('{:.1f}', round(low + (i + 1) * (high - low) / 8, 1)) for i in range(8)]
              end as options
       from (select 'l_linenumber' as "column", cast(min(l_linenumber) as double) as low, cast(max(l_linenumber) as double) as high from lineitem
             union all select 'l_quantity', min(l_quantity), max(l_quantity) from lineitem)""",
)
def _(spark, sf):
    from tabwright.operators.scoring import input_options

    return input_options(table(spark, sf, "lineitem"), ["l_linenumber", "l_quantity"])


@query(
    "range_midpoint",
    """select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then (l_quantity + (l_quantity + 10)) / 2
              when 1 then l_quantity else l_quantity end as value from lineitem""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    q = F.col("l_quantity").cast("string")
    kind = F.col("l_linenumber") % 3
    text = (
        F.when(kind == 0, F.concat(q, F.lit("-"), (F.col("l_quantity") + 10).cast("string")))
        .when(kind == 1, F.concat(q, F.lit("+")))
        .otherwise(q)
    )
    return df.select("l_orderkey", "l_linenumber", range_midpoint(text).alias("value"))


# --- metrics ---------------------------------------------------------------------------------


@query("accuracy", "select round(avg(case when y = p then 1.0 else 0.0 end), 6) as accuracy from scored", scored=SCORED)
def _(spark, sf):
    return M.accuracy(view(spark, sf, SCORED), "y", "p").select(F.round("accuracy", 6).alias("accuracy"))


@query(
    "weighted_prf",
    """with per as (select c, sum(case when y = c then 1 else 0 end) as support, sum(case when p = c then 1 else 0 end) as claimed,
                       sum(case when y = c and p = c then 1 else 0 end) as tp
                    from scored, (select distinct y as c from scored) group by c),
            pr as (select support, coalesce(tp / nullif(claimed, 0), 0) as p, tp / support as r from per)
       select round(sum(p * support) / sum(support), 6) as "precision", round(sum(r * support) / sum(support), 6) as recall,
              round(sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * support) / sum(support), 6) as f1 from pr""",
    scored=SCORED,
)
def _(spark, sf):
    out = M.weighted_scores(view(spark, sf, SCORED), "y", "p")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "roc_auc",
    """with r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from scored)
       select round((sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) as auc from r""",
    scored=SCORED,
)
def _(spark, sf):
    return M.roc_auc(view(spark, sf, SCORED), "y", "score").select(F.round("auc", 6).alias("auc"))


@query(
    "regression_metrics",
    """select round(sqrt(avg((y - p) ** 2)), 6) as rmse, round(avg(abs(y - p)), 6) as mae,
              round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) as r2
       from (select l_extendedprice as y, l_quantity * 1500 as p from lineitem)""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    out = M.regression_scores(df, "y", "p")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "confusion_matrix",
    """select y as actual, count(*) filter (p = 0) as predicted_0, count(*) filter (p = 1) as predicted_1
       from scored group by y""",
    scored=SCORED,
)
def _(spark, sf):
    return M.confusion_matrix(view(spark, sf, SCORED), "y", "p", [0, 1])


@query(
    "rank_importance",
    """select l_orderkey, l_linenumber, importance, position from (select l_orderkey, l_linenumber, abs(l_tax - 0.04) as importance,
         row_number() over (partition by l_orderkey order by abs(l_tax - 0.04) desc, l_linenumber) as position from lineitem)
       where position <= 3""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_tax") - 0.04).alias("coefficient"))
    return M.rank_importance(df, ["l_orderkey"], "l_linenumber", "coefficient", 3).drop("coefficient")


@query(
    "leaderboard",
    """select job_id, model_no, accuracy, f1, row_number() over (partition by job_id
              order by coalesce(f1, 0) desc, model_no, created_at, training_time, accuracy) as position from models""",
    models=MODELS,
)
def _(spark, sf):
    out = M.leaderboard(view(spark, sf, MODELS), ["job_id"], "f1", ["model_no", "created_at", "training_time", "accuracy"])
    return out.select("job_id", "model_no", "accuracy", "f1", "position")


@query(
    "leaderboard_all_jobs",
    """select job_id, model_no, row_number() over (order by coalesce(accuracy, 0) desc, job_id, model_no, training_time, created_at)
       as position from models""",
    models=MODELS,
)
def _(spark, sf):
    out = M.leaderboard(view(spark, sf, MODELS), [], "accuracy", ["job_id", "model_no", "training_time", "created_at"])
    return out.select("job_id", "model_no", "position")


@query(
    "compare_models",
    """with m as (select c_custkey as id, case when c_custkey % 2 = 0 then null else c_acctbal end as accuracy,
                         cast(c_nationkey as double) as f1_score from customer where c_custkey in (2, 3, 5, 7, 8)),
            u as (select 'accuracy' as metric, id, accuracy as value from m union all select 'f1_score', id, f1_score from m)
       select metric, id as best_id, value as best_value from (select *, row_number() over (partition by metric order by value desc, id) as r
         from u where value is not null) where r = 1""",
)
def _(spark, sf):
    df = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 2 != 0, F.col("c_acctbal")).alias("accuracy"),
        F.col("c_nationkey").cast("double").alias("f1_score"),
    )
    return M.compare_models(df, [2, 3, 5, 7, 8], "id", ["accuracy", "f1_score"])


def _shown(df):
    odd = F.col("l_linenumber") % 2 == 1
    none = F.lit(None).cast("double")
    return df.select(
        "l_orderkey", "l_linenumber",
        F.when(odd, none).otherwise(F.col("l_discount")).alias("accuracy"),
        F.when(odd, none).otherwise(F.col("l_tax")).alias("precision"),
        none.alias("recall"),
        none.alias("f1_score"),
        F.when(odd, F.col("l_discount") - 0.02).alias("r2"),
        F.when(odd, F.col("l_quantity")).alias("rmse"),
        F.when(odd, F.col("l_tax")).alias("mae"),
    )


@query(
    "display_scores",
    """with s as (select l_orderkey, l_linenumber, l_linenumber % 2 = 1 as reg, l_discount as d, l_discount - 0.02 as r2,
                         l_tax as t, l_quantity as q from lineitem)
       select l_orderkey, l_linenumber, reg as is_regression,
              round(case when reg then case when r2 = 0 then 0 else greatest(0, r2 * 100) end else d * 100 end, 6) as accuracy,
              round(case when reg then case when q = 0 then 0 else greatest(0, 100 - q * 10) end
                   else coalesce(nullif(t, 0), d) * 100 end, 6) as "precision",
              round(case when reg then case when t = 0 then 0 else greatest(0, 100 - t * 10) end else d * 100 end, 6) as recall,
              round(case when reg then case when r2 = 0 then 0 else greatest(0, r2 * 100) end else d * 100 end, 6) as f1
       from s""",
)
def _(spark, sf):
    out = M.display_scores(_shown(table(spark, sf, "lineitem")))
    scores = ("accuracy", "precision", "recall", "f1")
    return out.select(*[F.round(c, 6).alias(c) if c in scores else F.col(c) for c in out.columns])


@query(
    "best_model",
    """select job_id, model_no, f1 from (select *, row_number() over (partition by job_id
         order by coalesce(f1, 0) desc, model_no, created_at) as r from models) where r = 1""",
    models=MODELS,
)
def _(spark, sf):
    out = M.best_model(view(spark, sf, MODELS), ["job_id"], "f1", ["model_no", "created_at"])
    return out.select("job_id", "model_no", "f1")


@query(
    "latest_results",
    """select job_id, model_no, accuracy, created_at from models order by created_at desc,
         coalesce(nullif(accuracy, 0), nullif(f1, 0), 0) desc, job_id, model_no limit 50""",
    models=MODELS,
)
def _(spark, sf):
    out = M.latest_results(view(spark, sf, MODELS), "created_at", ["accuracy", "f1"], ["job_id", "model_no"], 50)
    return out.select("job_id", "model_no", "accuracy", "created_at")


@query(
    "hyperparams_explode",
    "select event_id, k as name, json_extract_string(props, k) as value from (select event_id, props, unnest(json_keys(props)) as k from events)",
)
def _(spark, sf):
    return M.hyperparameters(table(spark, sf, "events"), "props", ["event_id"])


# --- nearest neighbours ------------------------------------------------------------------------

_NEIGHBOURS = """
select c_custkey as query_id, s_suppkey as train_id, s_nationkey % 3 as payload, s_acctbal as amount,
       sqrt((c_acctbal / 1000 - s_acctbal / 1000) ** 2 + (c_nationkey / 10 - s_nationkey / 10) ** 2) as distance
from customer, supplier qualify row_number() over (partition by c_custkey order by distance, s_suppkey) <= 5
"""


def _knn(spark, sf, payload):
    from tabwright.operators.neighbors import nearest

    queries = table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_nationkey") / 10).alias("y")
    )
    train = table(spark, sf, "supplier").select(
        "s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_nationkey") / 10).alias("y"), payload.alias("label")
    )
    return nearest(queries, train, ["x", "y"], 5, "c_custkey", "s_suppkey", "label")


@query(
    "knn_classify",
    """select query_id, payload as prediction from (select query_id, payload, count(*) as n from nn group by all)
       qualify row_number() over (partition by query_id order by n desc, payload) = 1""",
    nn=_NEIGHBOURS,
)
def _(spark, sf):
    from tabwright.operators.neighbors import knn_classify

    return knn_classify(_knn(spark, sf, F.col("s_nationkey") % 3))


@query(
    "knn_hashed",
    """select query_id, train_id, label from (
         select q.vec_id as query_id, t.vec_id as train_id, t.label, row_number() over (partition by q.vec_id order by list_distance(q.e, t.e), t.vec_id) as r
         from v q join v t on q.vec_id % 20 = 0 and t.vec_id % 20 <> 0) where r <= 5""",
    v="select vec_id, label, embedding::double[] as e from embeddings",
)
def _(spark, sf):
    """Neighbours over all 64 columns; tables this small fit one bucket, so they are the exact ones."""
    from tabwright.operators.neighbors import nearest_hashed

    vectors = table(spark, sf, "embeddings")
    names = [f"e{i}" for i in range(64)]
    wide = vectors.select("vec_id", "label", *[F.col("embedding")[i].alias(n) for i, n in enumerate(names)])
    asked, stock = wide.where("vec_id % 20 = 0"), wide.where("vec_id % 20 <> 0")
    found = nearest_hashed(asked, stock, names, 5, "vec_id", "vec_id", "label")
    return found.select("query_id", "train_id", F.col("payload").alias("label"))


@query(
    "knn_regress",
    """select query_id, round(case when min(distance) = 0 then avg(amount) filter (distance = 0)
              else sum(amount / nullif(distance, 0)) / sum(1 / nullif(distance, 0)) end, 4) as prediction from nn group by query_id""",
    nn=_NEIGHBOURS,
)
def _(spark, sf):
    from tabwright.operators.neighbors import knn_regress

    out = knn_regress(_knn(spark, sf, F.col("s_acctbal")), "distance")
    return out.select("query_id", F.round("prediction", 4).alias("prediction"))
