"""Mixing of sources to target weights, by hierarchical budgets.

Documents are leaves of a tree domain / language / source.  A token budget goes down the
tree in proportion to the weights of siblings.  No node gets more than its documents give
in ``max_epochs`` passes; what it cannot take goes to its siblings first, by water
filling, and only what a whole family cannot take goes to the family's own siblings.
Each leaf then takes a prefix of its tokens in seeded order: whole epochs, then a partial
one whose last document is cut.

All of it is DataFrame expressions.  The order within a leaf is two-level: sums over
hash ranges find the one range in which the budget ends, and only that range is ranked
row by row, so a leaf with a third of all rows is no hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm import _io

WORD = "[^\\x20\\x09-\\x0D]+"
LEVELS = ("domain", "lang", "source")
RANGE_HEX = 3


def count_words(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _filled(nodes: DataFrame, parents: list[str], node: str, weight: str) -> DataFrame:
    """Allot ``budget`` of each family to its nodes: adds ``quota``.

    A node is full if its cap is at most its share of what the nodes before it (by cap
    for weight) leave.  Shares are whole tokens; the tokens that rounding leaves go one
    each to the first nodes by name.
    """
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = family.orderBy(F.col("cap").cast("double") / F.col(weight), node)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    full = F.col("cap") * behind <= F.col(weight) * (F.col("budget") - before)
    rows = nodes.filter(F.col(weight) > 0).withColumn("full", full)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col(weight))).over(family)
    rows = rows.withColumn("rest", rest).withColumn("open", open_weight)
    rows = rows.withColumn("share", F.when(~F.col("full"), F.expr(f"({weight} * rest) div open")))
    left = F.col("rest") - F.sum(F.when(~F.col("full"), F.col("share"))).over(family)
    turn = F.row_number().over(family.orderBy("full", node))
    quota = F.when(F.col("full"), F.col("cap")).otherwise(F.col("share") + F.when(turn <= left, 1).otherwise(0))
    return rows.withColumn("quota", quota.cast("long")).drop("full", "rest", "open", "share")


def leaf_quotas(leaves: DataFrame, budget_share: tuple[int, int], max_epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens and a weight for each level) with quota.

    The budget is budget_share (numerator, denominator) of all tokens.
    """
    num, den = budget_share
    caps = leaves.filter("w_domain > 0 and w_lang > 0 and w_source > 0").withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.agg(F.sum("tokens").alias("all_tokens")).select(F.expr(f"all_tokens * {num} div {den}").alias("budget"), F.lit(0).alias("one"))
    top = caps.groupBy("domain").agg(F.sum("cap").alias("cap"), F.max("w_domain").alias("w_domain")).withColumn("one", F.lit(0))
    top = top.join(F.broadcast(total), "one").drop("one")  # one row
    top = _filled(top, [], "domain", "w_domain").select("domain", F.col("quota").alias("budget"))
    mid = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.max("w_lang").alias("w_lang")).join(top, "domain")
    mid = _filled(mid, ["domain"], "lang", "w_lang").select("domain", "lang", F.col("quota").alias("budget"))
    return _filled(caps.join(mid, ["domain", "lang"]), ["domain", "lang"], "source", "w_source").select(*LEVELS, "tokens", "quota")


def _borders(rows: DataFrame) -> DataFrame:
    """For each leaf the span (first digits of the key) in which its part of the tokens ends, and the tokens before it.

    By the first digit, then by the spans of the one digit in which the part ends: at most 16
    and 256 sums a leaf.
    """
    up_to = Window.partitionBy(*LEVELS).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)

    def ends(sums: DataFrame, start) -> DataFrame:
        upto = sums.withColumn("before", start + F.sum("own").over(up_to) - F.col("own"))
        return upto.filter("before < part and part <= before + own")

    digit = F.substring("span", 1, 1)
    first = ends(rows.groupBy(*LEVELS, digit.alias("at")).agg(F.sum("n_tokens").alias("own"), F.max("part").alias("part")), F.lit(0))
    first = first.select(*LEVELS, F.col("at").alias("digit"), F.col("before").alias("start"))
    near = rows.withColumn("digit", digit).join(first, [*LEVELS, "digit"])
    sums = near.groupBy(*LEVELS, F.col("span").alias("at")).agg(F.sum("n_tokens").alias("own"), F.max("part").alias("part"), F.max("start").alias("start"))
    return _io.stored(ends(sums, F.col("start")).select(*LEVELS, F.col("at").alias("border"), "before"), "borders")  # one row a leaf


def mix_sources(docs: DataFrame, weights: DataFrame, domain, budget_share: tuple[int, int] = (3, 4), max_epochs: int = 2, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """Chosen documents, a row for each epoch: doc_id, domain, lang, source, epoch, n_tokens, take_tokens.

    domain: an expression over the documents' columns.  weights: (domain, lang, source,
    w_domain, w_lang, w_source) whole numbers; a leaf without a row there or with a weight
    of 0 gets nothing.  Tokens are words ``[^\\x20\\x09-\\x0D]+``.  take_tokens is less than
    n_tokens only for the document in which a leaf's budget ends.  A null language or
    source is the empty string; null and wordless texts have no tokens and are not chosen;
    rows that repeat an identifier are different documents; an empty table gives an empty
    result.  Order within a leaf and epoch: md5 of seed:epoch:doc_id, then doc_id.
    row_col: a column of stored keys, one for each row; it goes along as a last column, so
    that rows without identifier, or with the same one, can be told apart.
    """
    row = [row_col] if row_col else []
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(domain, F.lit("")).alias("domain"),
        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        count_words(F.col(text_col)).alias("n_tokens"),
        *row,
    ).filter("n_tokens > 0")
    rows = _io.stored(rows, "token-counts")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).join(weights, list(LEVELS))
    quota = leaf_quotas(leaves, budget_share, max_epochs).select(*LEVELS, F.expr("quota div tokens").alias("whole"), F.expr("quota % tokens").alias("part"))
    quota = _io.stored(quota, "quotas")  # one row a leaf; the plan behind it is made once
    near = rows.join(quota, list(LEVELS))
    whole = near.filter("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    whole = whole.select("doc_id", *LEVELS, "epoch", "n_tokens", F.col("n_tokens").alias("take_tokens"), *row)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    last = near.filter("part > 0").withColumn("key", key).withColumn("span", F.substring("key", 1, RANGE_HEX))
    border = _borders(last)
    placed = last.join(border, list(LEVELS))
    inside = placed.filter("span < border").select("doc_id", *LEVELS, F.col("whole").alias("epoch"), "n_tokens", F.col("n_tokens").alias("take_tokens"), *row)
    rank = Window.partitionBy(*LEVELS, "span").orderBy("key", "doc_id", "n_tokens", *row).rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.filter("span = border").withColumn("ahead", F.col("before") + F.sum("n_tokens").over(rank) - F.col("n_tokens")).filter("ahead < part")
    edge = edge.select("doc_id", *LEVELS, F.col("whole").alias("epoch"), "n_tokens", F.least("n_tokens", F.expr("part - ahead")).alias("take_tokens"), *row)
    return whole.unionByName(inside).unionByName(edge)


def mixed_documents(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text", epochs: bool = False, row_col: str | None = None) -> DataFrame:
    """The documents of a mix, with all their columns, cut where the mix cuts them.

    A cut text is its first words joined by one space.  Without ``epochs`` a document
    chosen in several epochs is there once, with its longest cut; with it, once for each.
    Rows are found by row_col, as given to ``mix_sources``, which is not returned; without
    it by identifier, so rows without one are left out and rows that share one are cut alike.
    """
    key = row_col or "doc_id"
    own, take, whole = _io.fresh(docs, "_own", "_take", "_whole")
    pick = chosen.filter(F.col(key).isNotNull()).select(F.col(key).alias(own), "epoch", F.col("take_tokens").alias(take), F.col("n_tokens").alias(whole))
    if not epochs:
        pick = pick.groupBy(own).agg(F.max(take).alias(take), F.max(whole).alias(whole))
    both = docs.withColumn(own, F.col(row_col or id_col).cast("long")).join(pick.select(own, take, whole), own)
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.col(take).cast("int")), " ")
    return both.select(*[F.when(F.col(take) < F.col(whole), cut).otherwise(F.col(text_col)).alias(c) if c == text_col else c for c in docs.columns if c != row_col])
