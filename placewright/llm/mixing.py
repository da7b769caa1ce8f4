"""Mixing sources to target shares of tokens (problem 9).

Documents get hash-random keys; within each source they are ranged over equal slices of the key space (the keys are uniform,
so the slices need no sampling), prefix sums of tokens run over the slices, and only the one slice in which a source's budget
ends is sorted row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewright.llm.tokenizer import TOKENIZERS, count_tokens
from placewright.session import cut

#: Slices of the key space of each source. Their table has at most (listed sources x slices) rows.
SLICES = 4096


def sized_documents(documents: DataFrame, targets: DataFrame, seed: int = 17, slices: int = SLICES, directory: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, source, tokens, key, slice) of the documents of listed sources that have tokens, written once (tokenizing is the dear step)."""
    listed = targets.where("source IS NOT NULL").select("source").distinct()
    mine = documents.select("doc_id", "source", "text").where("doc_id IS NOT NULL").join(listed, "source", "left_semi")
    counted = count_tokens(mine, directory=directory, name=name).where("tokens > 0")
    key = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1)
    return cut(counted.select("doc_id", "source", "tokens", key.alias("key"), F.shiftrightunsigned(key, 63 - (slices.bit_length() - 1)).cast("int").alias("slice")))


def budgets(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available, documents, budget): one row per listed source.

    A source can give at most its tokens times ``max_repeats``. Without ``total`` the mixture is the largest in which
    every source that has documents has its share (relative to each other) exactly. With ``total``, sources that cannot
    fill their share give all they can and the rest is shared among the others in proportion, as long as any can give.
    A listed source without documents has budget 0; repeated rows of a source in ``targets`` count as one (largest
    share); null or negative shares count as 0, a null max_repeats as 1.
    """
    t = targets.where("source IS NOT NULL").groupBy("source").agg(
        F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"),
        F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"),
    )
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    rows = t.join(have, "source", "left").na.fill(0, ["available", "documents"]).collect()  # one row for each listed source
    cap = {r.source: r.available * r.max_repeats for r in rows}
    open_ = {r.source: r.target_share for r in rows if cap[r.source] > 0 and r.target_share > 0}
    share = dict(open_)
    whole = sum(share.values())
    given = {r.source: 0.0 for r in rows}
    if total is None:
        scale = min((cap[s] / w for s, w in open_.items()), default=0.0)
        given |= {s: min(cap[s], w * scale) for s, w in open_.items()}
    elif whole:
        left = float(total)
        while open_ and left > 0.5:
            scale = left / sum(open_.values())
            full = [s for s, w in open_.items() if given[s] + w * scale >= cap[s]]
            for s in full or list(open_):
                add = cap[s] - given[s] if full else open_[s] * scale
                given[s] += add
                left -= add
            if not full:
                break
            open_ = {s: w for s, w in open_.items() if s not in full}
    schema = "source string, target_share double, max_repeats int, available bigint, documents bigint, budget bigint"
    return sized.sparkSession.createDataFrame([(r.source, r.target_share, int(r.max_repeats), int(r.available), int(r.documents), int(round(given[r.source]))) for r in rows], schema)


def mix(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each document is used.

    Every document of a source is used ``budget // available`` times; the rest of the budget is cut from the hash order
    at the document where the prefix sum comes nearest (a document is whole or not at all; one whose middle lies on the
    cut is in). Equal keys are ordered by doc_id. Documents used 0 times have no row.
    """
    b = F.broadcast(plan.select("source", F.expr("budget DIV available").alias("epochs"), F.expr("budget % available").alias("rest")).where("available > 0"))  # a row for each listed source
    per_slice = sized.groupBy("source", "slice").agg(F.sum("tokens").alias("in_slice"))
    w = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = per_slice.withColumn("end", F.sum("in_slice").over(w)).join(b, "source").withColumn("start", F.col("end") - F.col("in_slice"))
    docs = sized.join(placed.select("source", "slice", "start", "end", "epochs", "rest"), ["source", "slice"])
    whole = docs.where("end <= rest OR start >= rest").withColumn("extra", F.when(F.col("end") <= F.col("rest"), 1).otherwise(0))
    order = Window.partitionBy("source", "slice").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = docs.where("end > rest AND start < rest").withColumn("upto", F.col("start") + F.sum("tokens").over(order))
    split = split.withColumn("extra", F.when(2 * F.col("upto") - F.col("tokens") <= 2 * F.col("rest"), 1).otherwise(0)).drop("upto")
    return (
        whole.unionByName(split)
        .select("doc_id", "source", "tokens", (F.col("epochs") + F.col("extra")).cast("int").alias("copies"))
        .where("copies > 0")
    )


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """The report: what each listed source should give, could give and gives."""
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    all_ = Window.partitionBy(F.lit(1))  # over the listed sources
    return (
        plan.join(used, "source", "left").na.fill(0, ["mixed_tokens", "most_copies"])
        .withColumn("actual_share", F.when(F.sum("mixed_tokens").over(all_) > 0, F.col("mixed_tokens") / F.sum("mixed_tokens").over(all_)).otherwise(0.0))
        .withColumn("gap", F.col("actual_share") - F.col("target_share"))
    )
