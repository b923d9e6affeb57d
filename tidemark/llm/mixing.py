"""Mixing sources to target weights: hierarchical budgets, and seeded epochs cut at a token.

Documents hang on a tree: domain, language, source. A token budget goes down the tree. At each node it is dealt to the
children by their weights; a child whose documents can't give its share (its tokens times ``max_epochs``) gives what it has,
and the rest is dealt again to its siblings by weight. As a node is never given more than its whole subtree can supply, a
shortage is met among siblings first, and by the ancestors' siblings only when all of them are used up. All amounts are
integers; rounding goes to the running total, so shares always add up.

A leaf with ``take`` tokens to give and ``have`` tokens of text repeats its documents ``take div have`` times, and gives a
prefix of one epoch more: documents in the order of a hash of seed, epoch and id, until the remaining tokens are reached
(the document that reaches them is the last; a leaf exceeds its share by less than one document).

Plan: the tree has one row for each leaf, so all of its windows are small. The prefix is found without sorting a leaf: the
hash's first ten bits make 1024 buckets whose token sums (partial aggregates, at most leaves x 1024 rows) tell the bucket in
which the cut lies; ten bits more cut that bucket again; only the rows of the last sub-bucket, about a millionth of a leaf,
are put in order. The cut becomes (hash, id) on the leaf's row, and picking documents is a comparison on the map side: the
texts are never shuffled. So a source with a third of all rows costs no more than the same rows dealt evenly.

Cases: null domain, language or source is the name '(none)'; null and empty texts have no tokens, take part in the order
and come along while tokens are still missing; a leaf without tokens gives nothing; weights are positive integers; rows
that share an id stand at the same place; a very long text counts with all its tokens and is taken whole; other columns pass
through; an empty table gives an empty table. Products of tokens and weights have 37 digits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, table, words

LEVELS = ("__domain", "__lang", "__source")
BUCKET_BITS = 10
#: Leaves up to this number are broadcast as one small table (under 20 MB); beyond, they are joined.
BROADCAST_LEAVES = 100_000


@dataclass(frozen=True)
class Mix:
    """Columns that name a document's place in the tree, and weights as SQL over these names (``domain``, ``lang``, ``source``)."""

    domain: str = "concat('d', pmod(crc32(cast(source as binary)), 4))"
    lang: str = "lang"
    source: str = "source"
    domain_weight: str = "case domain when 'd0' then 4 when 'd1' then 3 when 'd2' then 2 else 1 end"
    lang_weight: str = "case lang when 'en' then 6 else 2 end"
    source_weight: str = "1 + pmod(crc32(cast(source as binary)), 3)"
    budget: int | None = None  # tokens; None: budget_share of what the documents hold
    budget_share: tuple[int, int] = (1, 2)
    max_epochs: int = 4
    seed: int = 20


def _name(sql: str) -> Column:
    return F.coalesce(F.expr(sql).cast("string"), F.lit("(none)"))


def _deal(children: DataFrame, parent: list[str], child: str, room: str, weight: str, given: Column) -> DataFrame:
    """children with ``share``: the parent's ``given`` tokens dealt by weight, no child above its room.

    In the order of room per weight, the children that can't take their part of what is left come first.
    """
    order = W.partitionBy(*parent).orderBy(F.col(room) / F.col(weight), child)
    so_far = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*parent)
    out = children.withColumns(
        {
            "__given": given,
            "__room_before": F.coalesce(F.sum(room).over(so_far), F.lit(0)),
            "__weight_left": F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(so_far), F.lit(0)),
        }
    )
    tokens, weights = (lambda c: c.cast("decimal(19,0)")), (lambda c: c.cast("decimal(18,0)"))  # their products pass a bigint
    out = out.withColumn("__full", tokens(F.col(room)) * weights(F.col("__weight_left")) <= weights(F.col(weight)) * tokens(F.col("__given") - F.col("__room_before")))
    out = out.withColumns(
        {
            "__left": F.col("__given") - F.sum(F.when(F.col("__full"), F.col(room)).otherwise(0)).over(whole),
            "__open": F.sum(F.when(F.col("__full"), 0).otherwise(F.col(weight))).over(whole),
            "__upto": F.sum(F.when(F.col("__full"), 0).otherwise(F.col(weight))).over(order.rowsBetween(W.unboundedPreceding, 0)),
        }
    )
    upto = lambda x: f"cast(__left AS decimal(19,0)) * cast({x} AS decimal(18,0)) div cast(__open AS decimal(18,0))"
    part = F.expr(f"{upto('__upto')} - {upto(f'__upto - {weight}')}")
    out = out.withColumn("share", F.when(F.col("__full"), F.col(room)).otherwise(part))
    return out.drop("__given", "__room_before", "__weight_left", "__full", "__left", "__open", "__upto")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """For each leaf (domain, lang, source, have): take, the tokens that it is to give."""
    d, l, s = LEVELS  # noqa: E741
    sql = {"domain": d, "lang": l, "source": s}

    def weight(text: str) -> Column:
        return F.expr(f"cast(({text}) as bigint)")

    named = leaves.withColumns({k: F.col(v) for k, v in sql.items()})
    named = named.withColumns({"__wd": weight(mix.domain_weight), "__wl": weight(mix.lang_weight), "__ws": weight(mix.source_weight), "__room": F.col("have") * mix.max_epochs}).drop(*sql)
    langs = named.groupBy(d, l).agg(F.max("__wd").alias("__wd"), F.max("__wl").alias("__wl"), F.sum("__room").alias("__room"), F.sum("have").alias("have"))
    domains = langs.groupBy(d).agg(F.max("__wd").alias("__wd"), F.sum("__room").alias("__room"), F.sum("have").alias("have"))
    root = domains.withColumn("__top", F.lit(0))
    top = W.partitionBy("__top")
    wanted = F.lit(mix.budget).cast("bigint") if mix.budget is not None else F.expr(f"(sum(have) over (partition by __top)) * {mix.budget_share[0]}L div {mix.budget_share[1]}L")
    to_domains = _deal(root, ["__top"], d, "__room", "__wd", F.least(wanted, F.sum("__room").over(top))).select(d, F.col("share").alias("__given_d"))
    to_langs = _deal(langs.join(to_domains, d), [d], l, "__room", "__wl", F.col("__given_d")).select(d, l, F.col("share").alias("__given_l"))
    to_leaves = _deal(named.join(to_langs, [d, l]), [d, l], s, "__room", "__ws", F.col("__given_l"))
    return to_leaves.select(*LEVELS, "have", F.col("share").alias("take"))


def _crossing(sums: DataFrame, bucket: str, rest: str) -> DataFrame:
    """For each leaf the bucket in which the running sum of tokens reaches ``rest``, and what is missing there."""
    w = W.partitionBy(*LEVELS).orderBy(bucket)
    run = sums.withColumn("__run", F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    there = run.where((F.col("__run") >= F.col(rest)) & (F.col("__run") - F.col("tokens") < F.col(rest)))
    return there.select(*LEVELS, F.col(bucket), (F.col(rest) - F.col("__run") + F.col("tokens")).alias("__missing"))


def _leaf_side(df: DataFrame, leaves: DataFrame) -> DataFrame:
    side = F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves
    return df.join(side, [*LEVELS])


def place(docs: DataFrame, mix: Mix, id_col: str, text_col: str) -> DataFrame:
    """docs with its leaf, its tokens (words) and, for ordering, its id without null."""
    at = {LEVELS[0]: _name(mix.domain), LEVELS[1]: _name(mix.lang), LEVELS[2]: _name(mix.source)}
    return docs.withColumns(at | {"__tokens": F.size(words(text_col)).cast("bigint"), "__id": F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))})


def _order(epoch: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), epoch, F.col("__id"))


def plan(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each leaf: have, take, epochs (whole ones), cut_hash and cut_id (the last document of the next epoch's prefix; null: none)."""
    rows = cut(place(docs, mix, id_col, text_col).select(*LEVELS, "__id", F.col("__tokens").alias("tokens")))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("have"))
    dealt = cut(budgets(leaves, mix).withColumns({"epochs": F.expr("if(have = 0, 0, take div have)"), "rest": F.expr("if(have = 0, 0, take % have)")}))
    first = F.shiftright("__h", 64 - BUCKET_BITS)
    second = F.shiftright("__h", 64 - 2 * BUCKET_BITS).bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))
    part = _leaf_side(rows, dealt.where("rest > 0").select(*LEVELS, "epochs", "rest")).withColumn("__h", _order(F.col("epochs"), mix.seed)).withColumns({"__b1": first, "__b2": second})
    sums = part.groupBy(*LEVELS, "__b1").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    cut1 = cut(_crossing(sums, "__b1", "rest").withColumnRenamed("__missing", "__m1").withColumnRenamed("__b1", "__c1"))
    part = _leaf_side(part, cut1).where("__b1 = __c1")
    sums = part.groupBy(*LEVELS, "__b2").agg(F.sum("tokens").alias("tokens"), F.first("__m1").alias("__m1"))
    cut2 = cut(_crossing(sums, "__b2", "__m1").withColumnRenamed("__missing", "__m2").withColumnRenamed("__b2", "__c2"))
    part = _leaf_side(part, cut2).where("__b2 = __c2")
    w = W.partitionBy(*LEVELS).orderBy("__h", "__id")
    run = F.sum("tokens").over(w)  # rows that share an id count together
    last = part.withColumn("__run", run).where("__run >= __m2").groupBy(*LEVELS).agg(F.min(F.struct("__h", "__id")).alias("__cut"))
    return dealt.join(last, [*LEVELS], "left").select(*LEVELS, "have", "take", "epochs", F.col("__cut.__h").alias("cut_hash"), F.col("__cut.__id").alias("cut_id"))


def _counted(docs: DataFrame, mix: Mix, id_col: str, text_col: str) -> DataFrame:
    """docs with its place in the tree, __tokens and __copies."""
    leaves = plan(docs, mix, id_col, text_col).select(*LEVELS, F.col("epochs").alias("__epochs"), F.col("cut_hash").alias("__cut_hash"), F.col("cut_id").alias("__cut_id"))
    placed = _leaf_side(place(docs, mix, id_col, text_col), cut(leaves))
    h = _order(F.col("__epochs"), mix.seed)
    inside = F.coalesce((h < F.col("__cut_hash")) | ((h == F.col("__cut_hash")) & (F.col("__id") <= F.col("__cut_id"))), F.lit(False))
    return placed.withColumn("__copies", F.col("__epochs") + inside.cast("bigint")).drop("__epochs", "__cut_hash", "__cut_id", "__id")


def mix_documents(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with __domain, __lang, __source, __tokens and ``copies`` (replaced if docs has it): how many times each document stands in
    the mixture."""
    return _counted(docs, mix or Mix(), id_col, text_col).withColumn("copies", F.col("__copies")).drop("__copies")


def mixture(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixture itself: the columns of docs, each row as often as it is picked."""
    picked = _counted(docs, mix or Mix(), id_col, text_col).where("__copies > 0")
    return picked.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix_documents(docs).select("doc_id", F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.col("__tokens").alias("n_tokens"), "copies")


QUERIES = {"op5_source_mixing": op5_source_mixing}
#: XXH64, which orders the epochs, is no DuckDB function; tests/llm compares with a brute-force version.
ORACLES: dict[str, str] = {}
