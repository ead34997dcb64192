"""Similar pairs and components that grow batch by batch, from stored hashes only.

``TokenIndex`` files the token hashes of every item it has seen.  A batch of
new items is compared with the old ones and with itself; what is stored is
enough for that, so no old text is read again.  The pairs of all batches are
those of ``pairs.similar_pairs`` over all items at once.

Under ``path`` lie, for each batch: ``sets`` (items with all their tokens, by
bucket of the item), ``ids``, ``prefix`` (the tokens through which an item can
meet another, by bucket of the token), ``pairs`` (found when the batch came)
and ``done``.  A batch reads only the buckets it has tokens or candidates in.
``order`` holds the frequencies that the first batch had: tokens stand in this
order for ever, common ones last.  Any fixed order gives the same pairs; a
better one only means fewer candidates, so an index whose data have changed
much is worth building anew.

An index whose batches are ``large`` has no ``prefix`` and no ``order``: a batch
that has tokens in every bucket reads all of them anyway.  It reads the stored
tokens once for short codes (``pairs.able_items``), which tell the items that can
have a new partner at all, and only the tokens of those are moved and ordered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.operators import clustering, pairs
from curata.session import stage, stage_once, table_exists

BUCKETS = 64


def _present(df: DataFrame) -> list[int]:
    """The buckets of a table: as many numbers at most."""
    return sorted(row.bucket for row in df.select("bucket").distinct().collect())


@dataclass(frozen=True)
class TokenIndex:
    """Pairs at a threshold among all items ever added; ``over`` as in ``pairs.similar_pairs``.

    ``buckets`` (``BUCKETS`` where it is None) and ``large`` must stay the same for a path;
    ``large`` batches need tokens that are hashes of 64 bits.
    """

    path: str
    at_least: float
    over: int = pairs.UNION
    buckets: int | None = None
    large: bool = False

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets or BUCKETS)).cast("int")

    def batches(self, spark: SparkSession) -> int:
        """How many batches are finished."""
        n = 0
        while table_exists(spark, f"{self.path}/done/batch={n}"):
            n += 1
        return n

    def _old(self, like: DataFrame, name: str, n: int, buckets: list[int]) -> DataFrame:
        """The rows of earlier batches in these buckets, with the columns of ``like``; no other folder is read."""
        paths = [f"{self.path}/{name}/batch={k}" for k in range(n)]
        reader = like.sparkSession.read.schema(like.schema).option("basePath", f"{self.path}/{name}")
        return reader.parquet(*paths).filter(F.col("bucket").isin(buckets)).select(like.columns)

    def _write(self, rows: DataFrame, name: str, n: int) -> DataFrame:
        """A batch of a table in buckets, written unless it is there."""
        path = f"{self.path}/{name}/batch={n}"
        if not table_exists(rows.sparkSession, path):
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def _placed(self, sets: DataFrame, order: DataFrame) -> DataFrame:
        """``occurrences`` in the order of the index, with the ``bucket`` of the token."""
        rows = sets.select("_id", "_n", F.explode("_tokens").alias("_token")).join(order, "_token", "left")
        sorted_tokens = F.sort_array(F.collect_list(F.struct(F.coalesce("_rank", F.lit(0)).alias("r"), F.col("_token").alias("t"))))
        ordered = rows.groupBy("_id", "_n").agg(sorted_tokens.alias("_sorted"))
        placed = ordered.select("_id", "_n", F.posexplode("_sorted").alias("_place", "_p"))
        left = F.col("_n") - F.col("_place")
        least = F.lit(1) if self.over == pairs.SMALLER else F.ceil(F.lit(self.at_least) * F.col("_n") - 1e-9)
        kept = placed.select("_id", "_n", F.col("_p.t").alias("_token"), left.alias("_left")).filter(left >= least)
        return kept.withColumn("bucket", self._bucket("_token"))

    def add(self, items: DataFrame, item: str, tokens: str, batch: int | None = None) -> DataFrame:
        """File a batch and return its new pairs ``a < b, score``; ids must be new, contents distinct.

        A batch that was stopped goes on at the table it was writing; give it
        the same items.  With its number, a finished one only returns its pairs.
        """
        spark = items.sparkSession
        n = self.batches(spark) if batch is None else batch
        if table_exists(spark, f"{self.path}/done/batch={n}"):
            return spark.read.parquet(f"{self.path}/pairs/batch={n}")
        sets = items.select(F.col(item).alias("_id"), F.col(tokens).alias("_tokens"), F.size(tokens).alias("_n"))
        if self.large:
            new_sets = stage_once(spark, f"{self.path}/sets/batch={n}", lambda: sets)
            stage_once(spark, f"{self.path}/ids/batch={n}", lambda: new_sets.select("_id"))
            found = stage_once(spark, f"{self.path}/pairs/batch={n}", lambda: self._large_pairs(spark, n, new_sets))
            stage_once(spark, f"{self.path}/done/batch={n}", lambda: spark.range(1))
            return found
        new_sets = self._write(sets.withColumn("bucket", self._bucket("_id")), "sets", n)
        stage_once(spark, f"{self.path}/ids/batch={n}", lambda: new_sets.select("_id"))

        def frequencies():
            counts = new_sets.select(F.explode("_tokens").alias("_token")).groupBy("_token").agg(F.count(F.lit(1)).alias("_rank"))
            return counts.filter("_rank > 1")

        order = stage_once(spark, f"{self.path}/order", frequencies)
        new = self._write(self._placed(new_sets, order), "prefix", n)
        found = stage_once(spark, f"{self.path}/pairs/batch={n}", lambda: self._pairs(spark, n, new, new_sets))
        stage_once(spark, f"{self.path}/done/batch={n}", lambda: spark.range(1))
        return found

    def _pairs(self, spark: SparkSession, n: int, new: DataFrame, new_sets: DataFrame) -> DataFrame:
        columns = ["_token", "_id", "_n", "_left"]
        rows = new.select(*columns, F.lit(True).alias("_new"))
        if n:
            old = self._old(new, "prefix", n, _present(new))
            met = old.join(new.select("_token").distinct(), "_token", "left_semi")
            rows = rows.unionByName(met.select(*columns, F.lit(False).alias("_new")))
        held = rows.groupBy("_token").agg(F.count(F.lit(1)).alias("_df")).filter("_df > 1")
        rows = stage(rows.join(held, "_token"), "index-met")
        fresh, stored = rows.filter("_new"), rows.filter("NOT _new")
        met = pairs.candidate_pairs(fresh, fresh, [], self.at_least, self.over)
        for large, small in ((fresh, stored), (stored, fresh)) if n else ():
            met = met.unionByName(pairs.candidate_pairs(large, small, [], self.at_least, self.over))
        found = stage(met.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct(), "index-candidates")
        sets = new_sets
        if n:
            named = found.select(F.explode(F.array("a", "b")).alias("_id")).distinct().withColumn("bucket", self._bucket("_id"))
            old = self._old(new_sets, "sets", n, _present(named)).join(named, ["_id", "bucket"], "left_semi")
            sets = new_sets.select("_id", "_n", "_tokens").unionByName(old.select("_id", "_n", "_tokens"))
        return pairs.scored_pairs(found, sets, [], self.at_least, self.over).select("a", "b", "score")

    def _large_pairs(self, spark: SparkSession, n: int, new: DataFrame) -> DataFrame:
        sets = new.select("_id", "_n", "_tokens", F.lit(True).alias("_new"))
        if n:
            old = spark.read.schema(new.schema).parquet(*[f"{self.path}/sets/batch={k}" for k in range(n)])
            sets = sets.unionByName(old.select("_id", "_n", "_tokens", F.lit(False).alias("_new")))
        able = pairs.able_items(sets, "_id", "_tokens", self.at_least, self.over, self.buckets or BUCKETS)
        shared = pairs.shared_sets(sets.join(able, "_id", "left_semi"), [])
        shared = stage(pairs.enough(shared, self.at_least, self.over), "index-shared")
        rows = stage(pairs.prefixes(shared, [], self.at_least, self.over), "index-met")
        fresh, stored = rows.filter("_new"), rows.filter("NOT _new")
        met = pairs.candidate_pairs(fresh, fresh, [], self.at_least, self.over)
        for large, small in ((fresh, stored), (stored, fresh)) if n else ():
            met = met.unionByName(pairs.candidate_pairs(large, small, [], self.at_least, self.over))
        found = met.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct()
        return pairs.scored_pairs(found, shared, [], self.at_least, self.over).select("a", "b", "score")

    def _all(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(*[f"{self.path}/{name}/batch={k}" for k in range(self.batches(spark))])

    def known(self, spark: SparkSession) -> DataFrame:
        """``_id`` of every item of finished batches."""
        return self._all(spark, "ids")

    def found(self, spark: SparkSession) -> DataFrame:
        """All pairs of finished batches."""
        return self._all(spark, "pairs")


def merged_components(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Components ``member, rep`` after new ``edges a, b``; ``labels`` are those before, or None.

    Only the representatives that new edges touch are looked at; what they
    join moves to the smallest of them.
    """
    if labels is None:
        return clustering.connected_components(edges)
    rep = lambda side: labels.select(F.col("member").alias(side), F.col("rep").alias(f"_{side}"))
    lifted = edges.join(rep("a"), "a", "left").join(rep("b"), "b", "left")
    lifted = lifted.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    moved = stage(clustering.connected_components(lifted), "merged-reps")
    kept = labels.join(moved.select(F.col("member").alias("rep"), F.col("rep").alias("_to")), "rep", "left")
    kept = kept.select("member", F.coalesce("_to", "rep").alias("rep"))
    return kept.unionByName(moved.join(labels.select("member"), "member", "left_anti"))
