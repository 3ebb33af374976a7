"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the key ``-ln(u) / weight`` with a uniform ``u`` from its id and a weight from its quality
label; ascending keys are a weighted sample without replacement. A source first gives all its documents as many
whole times as its token budget holds, then documents in key order until the rest of the budget is filled. The
document at the edge gives only the words that are missing.

Prefix sums need no sort of a source: keys fall into buckets by their distribution, bucket totals are summed
up, and only the one bucket of each source that holds the edge is put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import WORD, fresh, table
from tabwright.session import cut_lineage

#: Fixed values of the mix: weights repeat along the ordered sources.
WEIGHTS = (5, 2, 1)
#: Words of the mix by words of the input, and of a source's share by its words at most.
SHARE, MOST = 1.5, 2
#: Sampling weights of documents labelled good, labelled bad and not labelled.
GOOD, BAD, PLAIN = 2.0, 0.5, 1.0
#: Documents in one key bucket, about.
BUCKET_ROWS = 50_000


def _drawn(docs: DataFrame, labels: DataFrame | None, rows: int) -> DataFrame:
    """(doc_id, text_hash, source, size, key, bucket): what sampling needs, without the texts."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", "source").alias("text_hash"), "source", size.alias("size"))
    weight = F.lit(PLAIN)
    if labels is not None:
        rated = labels.where("quality is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("__quality"))
        out = out.join(rated, out.doc_id == rated["__id"], "left")
        weight = F.when(F.col("__quality") == 1, GOOD).when(F.col("__quality") == 0, BAD).otherwise(PLAIN)
    # 52 bits of the id's digest, never 0; rows without an id draw by their text, so that no bucket holds them all
    digits = F.substring(F.md5(F.coalesce("doc_id", "text_hash").cast("string")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    out = out.withColumn("key", -F.log(u) / weight)
    buckets = -(-rows // BUCKET_ROWS) or 1
    bucket = F.floor((1 - F.exp(-F.col("key"))) * buckets)
    return out.select("doc_id", "text_hash", "source", "size", "key", bucket.alias("bucket"))


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their place in code point order, null last, counted by sorted ranges."""
    ranged = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    before = ranged.groupBy("part").agg(F.count("*").alias("n"))
    # one row for each partition
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    order = Window.partitionBy("part").orderBy(F.col("source").isNull(), F.col("source"))
    return ranged.join(before, "part").select("source", "source_size", (F.col("before") + F.row_number().over(order)).alias("place"))


def _targets(sources: DataFrame) -> DataFrame:
    """Adds ``target``: shares by weight, stopped at ``MOST`` times the source, the excess shared again.

    The fixed point is ``least(MOST * size, rate * weight)`` with one rate for all; each round needs two sums.
    """
    cases = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    sources = cut_lineage(_ranked(sources).withColumn("weight", cases))
    top = F.col("source_size") * MOST
    budget = SHARE * (sources.agg(F.sum("source_size")).first()[0] or 0)
    rate, before = -1.0, None
    while True:
        full = top <= F.lit(rate) * F.col("weight")
        row = sources.agg(F.sum(F.when(full, top).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if tuple(row) == before or not row[1]:
            break
        before, rate = tuple(row), (budget - row[0]) / row[1]
    target = F.least(top.cast("double"), F.lit(rate) * F.col("weight")) if before else F.lit(0.0)
    return sources.withColumn("target", target)


def plan(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, text_hash.

    ``size`` counts words, null texts have none. ``taken`` counts the words the mix takes of the document,
    repeats included. Rows without doc_id draw by their text. Rows repeated in full may be taken differently.
    """
    drawn = cut_lineage(_drawn(docs, labels, docs.count()))
    sums = cut_lineage(drawn.groupBy("source", "bucket").agg(F.sum("size").alias("n")))
    sources = _targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")))
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    sources = sources.withColumn("epochs", epochs)
    sources = sources.withColumn("rest", F.floor("target") - F.col("epochs") * F.col("source_size"))
    sources = sources.select(F.col("source").alias("__source"), "source_size", "target", "epochs", "rest")
    by_key = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("before", F.sum("n").over(by_key) - F.col("n"))
    state = sums.join(sources, sums.source.eqNullSafe(sources["__source"])).drop("source")
    state = state.withColumnRenamed("bucket", "__bucket").withColumn("left", F.col("rest") - F.col("before"))
    state = cut_lineage(state.select("__source", "__bucket", "source_size", "target", "epochs", "left", "n"))
    rows = drawn.join(state, drawn.source.eqNullSafe(state["__source"]) & (drawn.bucket == state["__bucket"]))
    edge = (F.col("left") > 0) & (F.col("left") < F.col("n"))
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "text_hash")
    inner = rows.where(edge).withColumn("done", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    some = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("done")))
    whole = rows.where(~edge).withColumn("some", F.when(F.col("left") > 0, F.col("size")).otherwise(0))
    both = whole.unionByName(inner.withColumn("some", some).drop("done"))
    taken = (F.col("epochs") * F.col("size") + F.col("some")).cast("long")
    return both.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken"), "text_hash")


def mix(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The mixed documents with all their columns, repeated as the plan says.

    The document at the edge of a budget comes whole if half of it or more is taken, else not.
    """
    name, code, times, n = fresh(docs, "mix_id", "mix_hash", "mix_times", "mix_n")
    chosen = plan(docs, labels).where("taken > 0").groupBy(F.col("doc_id").alias(name), F.col("text_hash").alias(code))
    chosen = chosen.agg(F.max(F.round(F.col("taken") / F.col("size"))).cast("int").alias(times)).where(F.col(times) > 0)
    same = docs.doc_id.cast("long").eqNullSafe(chosen[name]) & (F.xxhash64(docs.text, docs.source) == chosen[code])
    return docs.join(chosen, same).withColumn(n, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def op4_source_mix(spark, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


OP4_SQL = r"""
with recursive d as materialized (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         -ln((('0x' || md5(cast(doc_id as varchar))[1:13])::bigint + 0.5) / 4503599627370496.0)
           / case q.quality when 1 then 2.0::double when 0 then 0.5::double else 1.0::double end as k
  from documents left join (select doc_id, max(quality) as quality from labels where quality is not null group by doc_id) q using (doc_id)),
s as materialized (
  select source, sum(size)::bigint as n, [5, 2, 1][cast((row_number() over (order by source is null, source) - 1) % 3 + 1 as bigint)] as w from d group by source),
r(i, rate) as (
  select 0, (select 1.5 * sum(n)::double / sum(w) from s)
  union all
  select i + 1, (select (1.5 * sum(n)::double - sum(case when 2 * n <= rate * w then 2 * n else 0 end)::double)
                        / sum(case when 2 * n <= rate * w then 0 else w end)::double from s) from r where i < 40),
t as materialized (select source, n, least(2.0::double * n, (select max(rate) from r) * w) as target from s),
e as (select *, floor(target / n)::bigint as epochs, floor(target)::bigint - floor(target / n)::bigint * n as rest from t),
p as (select d.doc_id, d.source, d.size, e.n, e.target, e.epochs, e.rest,
             sum(d.size) over (partition by d.source order by d.k, d.doc_id rows unbounded preceding) - d.size as done
      from d join e on d.source is not distinct from e.source)
select doc_id, source, size, n as source_size, target,
       cast(epochs * size + greatest(0, least(size, rest - done)) as bigint) as taken from p
"""
