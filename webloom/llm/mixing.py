"""Problem 8: mixing sources to target weights.

Method: weighted fair queueing.  The documents of a source are shuffled by a hash; each gets its virtual finish
time, the source's tokens so far divided by its weight; documents of all sources are range-sorted by it and the
sequence ends at the total budget, when every source has delivered its share.  A source that runs out starts again, shuffled
anew, up to its cap.

The running sums are made in two levels: sums of order-preserving hash buckets, which are few, and windows within
one bucket.  A source that holds most documents is spread over many buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.bpe import DEFAULT_VOCABULARY, token_counts
from webloom.operators.sized import checkpointed

DOCS_PER_BUCKET = 20_000


def sized_documents(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of the documents that have a source and at least one token."""
    rows = documents.where(F.col("source").isNotNull() & F.col("doc_id").isNotNull() & (F.col("text") != ""))
    return token_counts(rows, ["doc_id", "source"], vocabulary=vocabulary).where("n_tokens > 0")


def _virtual_end(budget: float, sources: list[tuple[float, float]]) -> float:
    """The virtual time at which sources of ``(weight, most tokens)`` have given ``budget`` tokens together; that of the last end if they never do."""
    now, given, active = 0.0, 0.0, sorted((most / weight, weight) for weight, most in sources)
    while active:
        rate = sum(weight for _, weight in active)
        if given + (active[0][0] - now) * rate >= budget:
            return now + (budget - given) / rate
        given, now = given + (active[0][0] - now) * rate, active[0][0]
        active = active[1:]
    return now


class Mixture:
    """A mixture of ``sized`` ``(doc_id, source, n_tokens)`` to ``targets`` ``(source, target_share, max_repeats)``.

    Without a ``budget`` the total is the largest at which every source present reaches its share within its cap.  With one,
    sources that run out give less, the others more by their weights, and the reported shares say so; the mixture falls short of the budget only where all have run out.  Sources with a target but no document, and documents
    whose source is NULL or has no positive target, take no part; the remaining targets are scaled to 1.  Of targets that name a
    source twice the larger share and cap hold.  A document repeated under one id is one document of each row.
    """

    def __init__(self, sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0):
        self.sized, self.seed = checkpointed(sized.select("doc_id", "source", "n_tokens")), seed
        targets = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.coalesce(F.greatest(F.max("max_repeats"), F.lit(1)), F.lit(1)).alias("cap"))
        self.targets = targets
        have = self.sized.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count(F.lit(1)).alias("docs"))
        # One row a source of the targets, a table of fixed size.
        plan = targets.join(have, "source").collect()
        total = sum(r.target_share for r in plan)
        self.weights = {r.source: r.target_share / total for r in plan}
        reach = [r.cap * r.available / self.weights[r.source] for r in plan]
        self.budget = (min(reach) if reach else 0.0) if budget is None else float(budget)
        #: Virtual time at which the budget is served: sources that have run out leave their part to the others.
        self.end = _virtual_end(self.budget, [(self.weights[r.source], float(r.cap * r.available)) for r in plan])
        rows = [(r.source, self.weights[r.source], min(r.cap, -int(-self.end * self.weights[r.source] // r.available) + 1)) for r in plan]
        spark = sized.sparkSession
        self.plan = spark.createDataFrame(rows, "source string, weight double, rounds int")
        copies = sum(r.docs for r in plan)
        self.bits = max(1, (copies // DOCS_PER_BUCKET).bit_length())

    def sequence(self) -> DataFrame:
        """``(doc_id, source, copy, n_tokens, finish)`` in the order of the mixture; ``copy`` counts from 1."""
        queued = self.sized.join(F.broadcast(self.plan), "source").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rounds"))))
        queued = queued.withColumn("key", F.xxhash64(F.lit(self.seed), "copy", "doc_id")).withColumn("bucket", F.shiftright("key", 64 - self.bits))
        sums = queued.groupBy("source", "copy", "bucket").agg(F.sum("n_tokens").alias("tokens"))
        before = F.sum("tokens").over(Window.partitionBy("source").orderBy("copy", "bucket").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.select("source", "copy", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
        within = F.sum("n_tokens").over(Window.partitionBy("source", "copy", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
        served = queued.withColumn("within", within).join(sums, ["source", "copy", "bucket"])
        finish = (F.col("before") + F.col("within")) / F.col("weight")
        served = served.withColumn("finish", finish).where(F.col("finish") <= self.end * (1 + 1e-12))
        return served.select("doc_id", "source", "copy", "n_tokens", "finish").orderBy("finish", "source", "copy", "doc_id")

    def shares(self) -> DataFrame:
        """``(source, target_share, max_repeats, docs, tokens, share, repeats)`` of every source on either side.

        ``share`` is of the mixture's tokens, ``repeats`` the source's tokens in the mixture divided by those it has.
        """
        out = self.sequence().groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
        have = self.sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
        every = have.join(self.targets, "source", "full").join(out, "source", "left")
        total = out.agg(F.sum("tokens").alias("total"))
        every = every.crossJoin(F.broadcast(total))  # one row
        tokens = F.coalesce("tokens", F.lit(0))
        return every.select(
            "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("cap", F.lit(0)).cast("int").alias("max_repeats"), F.coalesce("docs", F.lit(0)).cast("bigint").alias("docs"),
            tokens.cast("bigint").alias("tokens"), F.coalesce(tokens / F.col("total"), F.lit(0.0)).alias("share"), F.coalesce(tokens / F.col("available"), F.lit(0.0)).alias("repeats"),
        )
