"""Mixing sources to target weights by hierarchical budgeting; DataFrame functions only.

The weights form a tree of domain, language and source. A budget of tokens flows down: each node passes its budget to
its children in proportion to their weights, no child gets more than its leaves can give in ``epochs`` passes, and what
a child cannot take goes to its siblings. As a node's own budget never exceeds what its leaves can give, a shortage
reaches another branch only when all siblings are full. Each leaf then takes the prefix of its documents, in an order
drawn by seed and epoch, that reaches its budget.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelens.llm.tables import WORD, written

#: A leaf's documents are dealt into so many slices of the random order. Slices below the cut are taken whole; only the
#: documents of the one slice that holds the cut are ordered, so no leaf, however large, is sorted in one task.
SLICES = 4096
LEAF = ["domain", "lang", "source"]
LEAVES_BROADCAST = 50_000
_HEX = 8  # digits of the md5 that order documents: 32 bits


@dataclass(frozen=True)
class Mixture:
    """Target weights. A child of a node is named by its value at that level; values without an entry get ``other``.

    ``share``: the budget as a part of the corpus's tokens. ``epochs``: passes over a leaf at most.
    """

    domains: dict[str, float] = field(default_factory=dict)
    languages: dict[str, float] = field(default_factory=dict)
    sources: dict[str, float] = field(default_factory=dict)
    other: float = 1.0
    share: float = 0.7
    epochs: int = 1
    seed: int = 7


#: Domains are groups of ten sources. English gets half of each domain, the other languages a fixed part each; the
#: sources of a domain count alike.
PRODUCTION = Mixture(
    domains={"d0": 2.0, "d1": 1.0}, languages={"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}, share=0.7, epochs=2)


def tokens(text: Column) -> Column:
    """Words of the text and one end mark, so that every document counts."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("bigint") + 1


def domain(source: Column) -> Column:
    """``src<k>`` belongs to ``d<k div 10>``, anything else to ``other``."""
    number = F.regexp_extract(source, "^src([0-9]+)$", 1)
    return F.when(number == "", "other").otherwise(
        F.concat(F.lit("d"), F.floor(number.cast("bigint") / 10).cast("string")))


def _weight(column: str, table: dict[str, float], other: float) -> Column:
    found = F.lit(float(other))
    for name, weight in sorted(table.items()):
        found = F.when(F.col(column) == name, F.lit(float(weight))).otherwise(found)
    return found


def fill(nodes: DataFrame, parents: list[str], child: str) -> DataFrame:
    """``budget`` of every child: its part of ``parent_budget`` by ``weight``, none above ``capacity``.

    Children fill at one common rate per unit of weight; in order of capacity / weight, those that the rate exceeds are
    full. ``nodes`` is the weight tree, not the corpus: one row per node.
    """
    order = Window.partitionBy(*parents).orderBy(F.col("capacity") / F.col("weight"), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    taken = F.coalesce(F.sum("capacity").over(before), F.lit(0))
    rate = (F.col("parent_budget") - taken) / F.sum("weight").over(onward)
    nodes = nodes.where("weight > 0").withColumn("_rate", rate)
    rate = F.max("_rate").over(Window.partitionBy(*parents))
    share = F.least(F.col("capacity"), F.round(rate * F.col("weight")).cast("bigint"))
    return nodes.withColumn("budget", F.greatest(share, F.lit(0).cast("bigint"))).drop("_rate")


def leaf_budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``budget``."""
    e = mixture.epochs
    leaves = leaves.withColumn("capacity", F.col("tokens") * e)
    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(mixture.share)).cast("bigint").alias("parent_budget"))
    level = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    level = level.withColumn("weight", _weight("domain", mixture.domains, mixture.other)).withColumn("_all", F.lit(0))
    top = fill(level.join(F.broadcast(total)), ["_all"], "domain")  # one row, the corpus total, beside each domain
    top = top.select("domain", F.col("budget").alias("parent_budget"))
    level = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    level = level.withColumn("weight", _weight("lang", mixture.languages, mixture.other)).join(top, "domain")
    mid = fill(level, ["domain"], "lang").select("domain", "lang", F.col("budget").alias("parent_budget"))
    level = leaves.withColumn("weight", _weight("source", mixture.sources, mixture.other)).join(mid, ["domain", "lang"])
    return fill(level, ["domain", "lang"], "source").drop("weight", "parent_budget", "capacity")


def _draw(seed: int, epoch: Column) -> Column:
    """The document's place in the order of an epoch: 32 bits of an md5."""
    mark = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(mark.cast("binary")), 1, _HEX), 16, 10).cast("bigint")


def _leaf_rows(docs: DataFrame, *more: Column) -> DataFrame:
    unknown = F.lit("unknown")
    rows = docs.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), unknown).alias("lang"),
        F.coalesce(F.col("source").cast("string"), unknown).alias("source"), tokens(F.col("text")).alias("tokens"), *more)
    return rows.withColumn("domain", domain(F.col("source")))


def selection(docs: DataFrame, mixture: Mixture = PRODUCTION) -> DataFrame:
    """One row per document and epoch in which it is taken: doc_id, epoch, domain, lang, source, tokens.

    Epoch 0 takes documents until the leaf's budget is reached; a budget above the leaf's tokens runs on into epoch 1,
    in another order, and so on. A document is taken when the tokens before it in its epoch are below what is left of
    the budget. Rows of one leaf that share a doc_id are taken or left together. Null lang or source counts as
    ``unknown``, a null text as empty. An empty table gives no rows; other columns are not read.
    """
    rows = written(_leaf_rows(docs), "mix-rows")
    return _taken(rows, rows, mixture).select("doc_id", "epoch", *LEAF, "tokens")


def mix(docs: DataFrame, mixture: Mixture = PRODUCTION) -> DataFrame:
    """``docs`` as ``selection`` takes them, all columns kept; a document taken in two epochs appears twice."""
    counted = written(_leaf_rows(docs), "mix-rows")
    return _taken(counted, _leaf_rows(docs, F.struct("*").alias("_row")), mixture).select("_row.*")


def _taken(counted: DataFrame, rows: DataFrame, mixture: Mixture) -> DataFrame:
    leaves = counted.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"))
    budgets = written(leaf_budgets(leaves, mixture), "mix-budgets")
    # One row per leaf and epoch that takes part: what the budget leaves for the epoch.
    epochs = budgets.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(mixture.epochs - 1))))
    epochs = epochs.withColumn("_left", F.col("budget") - F.col("epoch") * F.col("tokens")).where("_left > 0")
    epochs = epochs.withColumn("_whole", F.col("_left") >= F.col("tokens")).drop("tokens", "budget")
    dealt = _sliced(_meet(counted, epochs.where("NOT _whole"), LEAF), mixture.seed)
    slices = dealt.groupBy(*LEAF, "epoch", "_slice", "_left").agg(F.sum("tokens").alias("_n"))
    earlier = Window.partitionBy(*LEAF, "epoch").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    cut = slices.where("_before < _left AND _before + _n >= _left").select(
        *LEAF, "epoch", F.col("_slice").alias("_cut"), "_before")
    plan = written(epochs.join(cut, [*LEAF, "epoch"], "left"), "mix-plan")
    met = _sliced(_meet(rows, plan, LEAF), mixture.seed)
    sure = met.where("_whole OR _slice < _cut")
    order = Window.partitionBy(*LEAF, "epoch").orderBy("_draw", "doc_id")
    same = Window.partitionBy(*LEAF, "epoch", "_draw", "doc_id")
    start = F.col("_before") + F.sum("tokens").over(order) - F.sum("tokens").over(same)
    edge = met.where("NOT _whole AND _slice = _cut").withColumn("_start", start).where("_start < _left").drop("_start")
    return sure.unionByName(edge)


def _sliced(rows: DataFrame, seed: int) -> DataFrame:
    rows = rows.withColumn("_draw", _draw(seed, F.col("epoch")))
    return rows.withColumn("_slice", F.floor(F.col("_draw") / F.lit(2 ** 32 // SLICES)).cast("bigint"))


def _meet(rows: DataFrame, leaves: DataFrame, keys: list[str], salts: int = 64) -> DataFrame:
    """Rows beside the entries of their leaf. The leaves are counted: up to LEAVES_BROADCAST are broadcast, so that no
    row moves; beyond it rows meet them on (leaf, salt), which spreads a source with a third of all rows."""
    if leaves.count() <= LEAVES_BROADCAST:
        return rows.join(F.broadcast(leaves), keys)
    copies = leaves.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    return rows.withColumn("_salt", salt).join(copies, [*keys, "_salt"]).drop("_salt")


ORACLE = """
WITH RECURSIVE r AS (
  SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS tokens,
         CASE WHEN regexp_matches(coalesce(source, ''), '^src[0-9]+$')
              THEN 'd' || (CAST(substr(source, 4) AS BIGINT) // 10) ELSE 'other' END AS domain
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM r GROUP BY ALL),
a AS (
  SELECT domain, CAST(sum(tokens) * 2 AS BIGINT) AS cap,
         CASE domain WHEN 'd0' THEN 2.0::DOUBLE WHEN 'd1' THEN 1.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         (SELECT CAST(floor(sum(tokens) * 0.7::DOUBLE) AS BIGINT) FROM leaves) AS pb
  FROM leaves GROUP BY domain),
a1 AS (SELECT *, (pb - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM a),
a2 AS (SELECT domain, greatest(0, least(cap, CAST(round(max(rate) OVER () * w) AS BIGINT))) AS pb FROM a1),
b AS (
  SELECT domain, lang, CAST(sum(tokens) * 2 AS BIGINT) AS cap,
         CASE lang WHEN 'en' THEN 5.0::DOUBLE WHEN 'de' THEN 2.0::DOUBLE WHEN 'fr' THEN 2.0::DOUBLE
                   WHEN 'es' THEN 1.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM leaves GROUP BY domain, lang),
b1 AS (SELECT b.*, pb, (pb - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
       FROM b JOIN a2 USING (domain)),
b2 AS (SELECT domain, lang, greatest(0, least(cap, CAST(round(max(rate) OVER (PARTITION BY domain) * w) AS BIGINT))) AS pb
       FROM b1),
c AS (SELECT domain, lang, source, tokens, tokens * 2 AS cap, 1.0::DOUBLE AS w FROM leaves),
c1 AS (SELECT c.*, pb, (pb - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
       FROM c JOIN b2 USING (domain, lang)),
c2 AS (SELECT domain, lang, source, tokens AS leaf_tokens,
         greatest(0, least(cap, CAST(round(max(rate) OVER (PARTITION BY domain, lang) * w) AS BIGINT))) AS budget FROM c1),
e AS (SELECT c2.*, CAST(epoch AS INTEGER) AS epoch, budget - epoch * leaf_tokens AS remains
      FROM c2, (SELECT unnest([0, 1]) AS epoch) WHERE budget - epoch * leaf_tokens > 0),
d AS (SELECT r.*, epoch, remains,
        CAST('0x' || substr(md5('7:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS draw
      FROM r JOIN e USING (domain, lang, source)),
f AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY draw, doc_id)
              - sum(tokens) OVER (PARTITION BY domain, lang, source, epoch, draw, doc_id) AS start FROM d)
SELECT doc_id, epoch, domain, lang, source, tokens FROM f WHERE start < remains
"""
