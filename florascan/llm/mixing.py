"""Mixing sources to target weights by Poisson replication.

A source with target weight w and size s gets the mean repetition rate w * budget / s. A document's count is the inverse
of the Poisson distribution with that mean at a uniform number hashed from seed and document id: the smallest k whose
cumulative probability exceeds it. Each document is repeated count times, and the copies are dealt to tasks and sorted
within them by a hash, which is a shuffle of the whole corpus.

Sources without a weight of their own form one group, ``rest``. There are at most ``len(weights) + 1`` groups, whose rates
the driver reads. Sizes are counted over all documents, in code points plus one each.

Poisson counts add up: a document of a group with a rate above ``MAX_RATE`` gets the sum of as many draws of equal smaller
rates as it takes, each from a hash of its own. So no list of probabilities grows with a rate, which bounds the table that
is broadcast, and the draws of a document are dealt to tasks before they are repeated.

Defined results: a null source belongs to ``rest``, a null text has size one, a null id hashes as the word null, equal
ids get equal counts, an empty table gives an empty one. Weights are divided by the sum of those whose groups have
documents. Copies of a document are numbered from 0, those of further draws from multiples of 256 on. Input columns named
copy or shuffle_key are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from florascan.llm.common import hidden, table, text_or_empty


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


def repetition_rates(docs: DataFrame, weights: Mapping[str, float], rest_weight: float, budget: float | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """(mix_group, group_size, rate): one row for each group that has documents."""
    sized = docs.select(_group(weights, source).alias("mix_group"), (F.length(text_or_empty(text)) + 1).alias("size"))
    groups = sized.groupBy("mix_group").agg(F.sum("size").alias("group_size"))
    weight = F.lit(float(rest_weight))
    for name, w in weights.items():
        weight = F.when(F.col("mix_group") == name, F.lit(float(w))).otherwise(weight)
    everything = W.partitionBy(F.lit(0))  # at most len(weights) + 1 rows
    total = F.sum("group_size").over(everything) if budget is None else F.lit(float(budget))
    share = F.col("weight") / F.sum("weight").over(everything)
    return groups.withColumn("weight", weight).select("mix_group", "group_size", (share * total / F.col("group_size")).alias("rate"))


def _group(weights: Mapping[str, float], source: str) -> Column:
    return F.when(F.col(source).isin(list(weights)), F.col(source)).otherwise(F.lit("rest"))


#: Largest rate of one draw, and more copies than such a draw gives (twelve deviations above the mean and 20).
MAX_RATE, DRAW_COPIES = 64, 256


def poisson_steps(rates: DataFrame) -> DataFrame:
    """rates with ``steps``: the cumulative probabilities of 0, 1, 2 ... up to twelve deviations above the mean of a draw."""
    draws = F.greatest(F.lit(1.0), F.ceil(F.col("rate") / MAX_RATE)).cast("bigint")
    each = rates.select("mix_group", draws.alias("draws"), (F.col("rate") / draws).alias("rate"))
    top = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    terms = each.withColumn("k", F.explode(F.sequence(F.lit(0), top)))
    ordered = W.partitionBy("mix_group").orderBy("k")
    log_factorial = F.sum(F.ln(F.greatest(F.col("k"), F.lit(1)).cast("double"))).over(ordered)
    mass = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.ln("rate") - F.col("rate") - F.col("log_factorial"))).otherwise((F.col("k") == 0).cast("double"))
    terms = terms.withColumn("log_factorial", log_factorial).withColumn("step", F.sum(mass).over(ordered))
    pairs = terms.groupBy("mix_group", "draws", "rate").agg(F.sort_array(F.collect_list(F.struct("k", "step"))).alias("pairs"))
    return pairs.select("mix_group", "draws", F.col("pairs.step").alias("steps"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float],
    rest_weight: float,
    budget: float | None = None,
    seed: int = 20,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """docs, each row as often as drawn, with copy (from 0) and shuffle_key, in a random order over all tasks."""
    base = hidden(docs, "copy", "shuffle_key", "mix_group", "rate", "draws", "steps")
    if source not in base.columns:
        base = base.withColumn(source, F.lit(None).cast("string"))
    known = repetition_rates(base, weights, rest_weight, budget, source, text).collect()  # at most len(weights) + 1 rows
    rates = docs.sparkSession.createDataFrame([(r.mix_group, float(r.rate)) for r in known], "mix_group string, rate double")
    often = [r.mix_group for r in known if r.rate > MAX_RATE]
    grouped = base.withColumn("mix_group", _group(weights, source))
    steps = F.broadcast(poisson_steps(rates))
    drawn = grouped.filter(~F.col("mix_group").isin(often)).join(steps, "mix_group").withColumn("__draw", F.lit(0).cast("bigint")) if often else grouped.join(steps, "mix_group").withColumn("__draw", F.lit(0).cast("bigint"))
    if often:
        many = grouped.filter(F.col("mix_group").isin(often)).join(steps, "mix_group")
        block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(draws - 1) div 1024")))  # two steps: no long list
        many = many.withColumn("__block", block).withColumn("__draw", F.explode(F.sequence(F.col("__block") * 1024, F.least(F.col("draws") - 1, F.col("__block") * 1024 + 1023)))).drop("__block")
        drawn = drawn.unionByName(many.repartition(F.xxhash64(F.col(doc_id), F.col("__draw"))))
    id_text = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    draw_text = F.when(F.col("__draw") > 0, F.concat(F.lit("|"), F.col("__draw").cast("string"))).otherwise(F.lit(""))
    uniform = _hex(F.concat(F.lit(f"{seed}|"), id_text, draw_text), 13) / F.lit(float(16**13))
    drawn = drawn.withColumn("__u", uniform).withColumn("__n", F.size(F.filter("steps", lambda step: step <= F.col("__u"))))
    drawn = drawn.filter("__n > 0").drop("steps", "draws", "mix_group", "__u")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).withColumn("copy", F.col("__draw") * DRAW_COPIES + F.col("copy")).drop("__n", "__draw")
    copies = copies.withColumn("shuffle_key", _hex(F.concat_ws("|", F.lit(f"{seed}|copy"), id_text, F.col("copy").cast("string")), 15))
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key", doc_id, "copy")


#: Targets of the query: one over-large source cut down, four small ones repeated, the others as they are or nearly.
QUERY_WEIGHTS = {"src0": 0.10, "src1": 0.08, "src2": 0.08, "src3": 0.06, "src4": 0.06}
QUERY_REST = 0.62


def op1_mixing(spark, sf_dir):
    mixed = mix_sources(table(spark, sf_dir, "documents"), QUERY_WEIGHTS, QUERY_REST)
    return mixed.select("doc_id", "source", "copy", "shuffle_key", "text")


_DOCS = "documents"


def mixing_sql(docs: str, columns: str) -> str:
    """DuckDB SQL for mix_sources with the query's parameters over the relation docs."""
    named = ", ".join(f"'{s}'" for s in QUERY_WEIGHTS)
    weight = " ".join(f"when '{s}' then {w}::double" for s, w in QUERY_WEIGHTS.items())
    return f"""
with docs0 as (select *, case when source in ({named}) then source else 'rest' end as mix_group from {docs}),
groups as (select mix_group, sum(length(coalesce(text, '')) + 1)::double as size, case mix_group {weight} else {QUERY_REST}::double end as weight from docs0 group by 1),
rates0 as (select mix_group, weight / sum(weight) over () * sum(size) over () / size as rate0 from groups),
rates as (select mix_group, greatest(1, ceil(rate0 / {MAX_RATE}))::bigint as draws, rate0 / greatest(1, ceil(rate0 / {MAX_RATE}))::bigint as rate from rates0),
terms as (select mix_group, draws, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 20)::int)) as k from rates),
logs as (select *, sum(ln(greatest(k, 1)::double)) over (partition by mix_group order by k) as lf from terms),
steps as (select *, sum(exp(k * ln(rate) - rate - lf)) over (partition by mix_group order by k) as step from logs),
lists as (select mix_group, draws, list(step order by k) as steps from steps group by 1, 2),
dealt as (select d.*, l.steps, unnest(generate_series(0, l.draws - 1)) as draw from docs0 d join lists l using (mix_group)),
drawn as (select *, len(list_filter(steps, lambda s: s <= ('0x' || substr(md5('20|' || coalesce(doc_id::varchar, 'null') || case when draw > 0 then '|' || draw else '' end), 1, 13))::bigint / 4503599627370496.0::double)) as n
  from dealt),
copies as (select *, draw * {DRAW_COPIES} + unnest(generate_series(0, n - 1)) as copy0 from drawn where n > 0)
select {columns} from (select *, copy0::bigint as copy, ('0x' || substr(md5('20|copy|' || coalesce(doc_id::varchar, 'null') || '|' || copy0), 1, 15))::bigint as shuffle_key from copies)
"""


OP1_SQL = mixing_sql(_DOCS, "doc_id, source, copy, shuffle_key, text")
