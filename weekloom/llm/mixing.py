"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies, target / source_size, so the prefix sum of
expected copies is that number times the document's rank within its source, and a document is taken once for
each integer between the prefix sums on its two sides, all moved by one offset of the source. Documents are
ranked by size first, so each stretch of similar sizes gives its share and the words taken come near the target.

The rank of a hot source does not need its rows in one task: rows are counted in small cells (source, leading
digits of the size, residue of the id), the cells are summed up in order, and rows are numbered inside cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.shared import WORD, materialize

#: Cells for each size class of a source, by a residue of the id.
CELLS = 64
#: Weights of the sources by code point, repeating, null last.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def hashed_residue(doc_id: F.Column) -> F.Column:
    """A residue that spreads ids, in arithmetic that SQL engines share."""
    return F.pmod(F.pmod(F.coalesce(doc_id, F.lit(0)), F.lit(2147483647)) * F.lit(48271), F.lit(2147483647)) % CELLS


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` with one row a source.

    Targets are min(MOST * size, level * weight) for the one level at which they add up to SHARE of all sizes, which is
    what resharing the excess by weight until none is above arrives at. Sources fill up in order of MOST * size / weight, so
    the level follows from running sums in that order. These two windows see one row a source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = totals.withColumn("weight", weight).withColumn("fills", MOST * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("fills", F.asc_nulls_last("source"))
    whole = Window.partitionBy()
    before = weighed.withColumn("full", F.coalesce(F.sum(MOST * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    before = before.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))).withColumn("total", F.sum("source_size").over(whole))
    level = (SHARE * F.col("total") - F.col("full")) / F.col("open")
    # the first source that does not fill up at the level left for it and those after it
    at = before.withColumn("level", F.when(level < F.col("fills"), level)).withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(MOST * F.col("source_size"), F.coalesce("level", F.lit(float("inf"))) * F.col("weight"))
    return at.select("source", "source_size", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """Per row: ``doc_id, size, source_size, target, taken, copies``; taken = copies * size, copies at most 2.

    size is the number of words (null text: 0). The null source is a source of its own, the last. A source without words, or a
    document without words, takes nothing (its copies may still be 1 or 2 where its source has words). The offset of a source is a
    hash of the seed and its name, and ties of one cell are ordered by id, so reruns agree; rows that repeat an id and a size are
    interchangeable. Null ids are kept. Other columns are ignored; an empty table gives an empty result."""
    text_size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), text_size.alias("size"))
    digits = F.col("size").cast("string")
    sizes = sizes.withColumn("class", F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")).withColumn("cell", hashed_residue(F.col("doc_id")).cast("int"))
    sizes = materialize(sizes, "mix-sizes")

    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    cells = sizes.groupBy("source", "class", "cell").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("source").orderBy("class", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    targets = source_targets(sizes)
    plan = cells.join(targets, cells["source"].eqNullSafe(targets["source"])).select(F.coalesce(F.concat(F.lit("s"), cells["source"]), F.lit("null")).alias("name"), "class", "cell", "before", "source_size", "target")
    plan = plan.withColumn("offset", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("name"))), 1, 8), 16, 10).cast("double") / float(1 << 32))
    inside = Window.partitionBy("name", "class", "cell").orderBy("size", F.asc_nulls_last("doc_id"))
    ranked = sizes.withColumn("name", name).withColumn("place", F.row_number().over(inside)).join(plan, ["name", "class", "cell"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("before") + F.col("place")
    copies = (F.floor(rate * rank + F.col("offset")) - F.floor(rate * (rank - 1) + F.col("offset"))).cast("long")
    return ranked.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


#: The same in DuckDB; ``docs`` is the name of the documents.
MIX_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from {docs}
), c as (
  select *, length(size::varchar) * 100 + substr(size::varchar, 1, 2)::int as class,
    ((coalesce(doc_id, 0) % 2147483647 + 2147483647) % 2147483647 * 48271) % 2147483647 % 64 as cell,
    coalesce('s' || source, 'null') as name
  from d
), s as (
  select name, source, sum(size)::bigint as source_size from c group by all
), w as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s
), f as (
  select *, 2.0::double * source_size / weight as fills from w
), b as (
  select *, coalesce(sum(2.0::double * source_size) over (order by fills, source nulls last rows between unbounded preceding and 1 preceding), 0) as "full",
    sum(weight) over (order by fills, source nulls last rows between current row and unbounded following) as "open", sum(source_size) over ()::double as total
  from f
), l as (
  select *, case when (1.5::double * total - "full") / "open" < fills then (1.5::double * total - "full") / "open" end as own from b
), t as (
  select *, case when source_size > 0 then least(2.0::double * source_size, coalesce(first_value(own ignore nulls) over (order by fills, source nulls last rows between unbounded preceding and unbounded following), 'infinity'::double) * weight) else 0 end as target from l
), r as (
  select c.*, t.source_size, t.target, ('0x' || substr(md5('mix:' || c.name), 1, 8))::bigint::double / 4294967296.0::double as u,
    row_number() over (partition by c.name order by class, cell, size, doc_id nulls last) as rank
  from c join t on t.name = c.name
), e as (
  select *, case when source_size > 0 then target / source_size else 0 end as rate from r
)
select doc_id, size, source_size, target,
  (floor(rate * rank + u)::bigint - floor(rate * (rank - 1) + u)::bigint) * size as taken,
  floor(rate * rank + u)::bigint - floor(rate * (rank - 1) + u)::bigint as copies
from e
"""
