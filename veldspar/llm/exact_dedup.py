"""Exact dedup with a log-structured merge index, in DataFrame operations only.

Memtables flush: the digests of each share of the input splits, one row a digest, become a
run, bucketed by digest and sorted within each bucket. Compaction merges two runs of a level
into one of the next by a sort-merge join that needs neither a shuffle nor a sort, as both
sides lie bucketed and in order; it keeps the wanted identifier and adds the counts. The last
run's filter, a bitmap over its repeated digests, is probed by every row: only rows that it
lets through (the hits) move with their texts, which are compared byte for byte with the
text of the row that stays. Rows that only share the digest are regrouped by the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Bucketed, materialise, shuffle_partitions

#: Memtables, and so runs of the lowest level; a power of two.
MEMTABLES = 4
#: Digests of a run's bucket on average, where the cluster's shuffle partitions are too few.
BUCKET_ROWS = 1 << 20
#: Groups of more rows than HOT meet their kept text in SALTS parts.
HOT, SALTS = 500, 32
#: Bits of the filter for each hit digest, and at most: two bitmaps of 16 MiB are broadcast.
FILTER_RATE, MAX_FILTER_BITS = 16, 1 << 27


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Lets plans made inside rely on the order within a bucket's file."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def flush(rows: DataFrame, best: Callable[[str], Column], buckets: int) -> Bucketed:
    """A memtable's run from its rows (id, digest): copies are combined before they move."""
    combined = rows.groupBy("digest").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    dealt = combined if buckets == shuffle_partitions(rows.sparkSession) else combined.repartition(buckets, "digest")
    return Bucketed(dealt, buckets, "digest", ordered=True)


def merged_rows(a: Bucketed, b: Bucketed, keep: str) -> DataFrame:
    """The rows of two runs merged in the order of their digests."""
    left, right = a.table(), b.table().select(F.col("digest").alias("d"), F.col("keep_id").alias("k"), F.col("n").alias("m"))
    best = F.greatest if keep == "max" else F.least  # both pass over nulls
    zero = F.lit(0).cast("long")
    both = left.join(right.hint("merge"), F.col("digest") == F.col("d"), "full_outer")
    return both.select(F.coalesce("digest", "d").alias("digest"), best("keep_id", "k").alias("keep_id"), (F.coalesce("n", zero) + F.coalesce("m", zero)).alias("n"))


def compact(runs: list[Bucketed], keep: str) -> Bucketed:
    """Level by level, two runs of a level become one of the next."""
    while len(runs) > 1:
        above = []
        for a, b in zip(runs[::2], runs[1::2], strict=True):
            with _sorted_buckets(a.spark):
                above.append(Bucketed(merged_rows(a, b, keep), a.buckets, "digest", ordered=True))
            a.drop()
            b.drop()
        runs = above
    return runs[0]


def index(docs: DataFrame, key: str, text: str, keep: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(digest, keep_id, n) of every digest, by memtables, runs and compaction."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    share = F.pmod(F.spark_partition_id(), F.lit(MEMTABLES))
    rows = materialise(docs.select(F.col(key).cast("long").alias("id"), digest(content).alias("digest"), share.alias("memtable")), "digests", "memtable")
    spark, n = docs.sparkSession, rows.count()
    buckets = min(100_000, max(shuffle_partitions(spark), -(-n // BUCKET_ROWS)))
    best = F.max if keep == "max" else F.min
    return compact([flush(rows.filter(F.col("memtable") == k).select("id", "digest"), best, buckets) for k in range(MEMTABLES)], keep).close()


class Filter:
    """Bitmaps over the digests that occur more than once, and over those of hot groups; their
    size follows the number of such digests up to a bound, from where on they let more through."""

    def __init__(self, hits: DataFrame):
        n = hits.count()
        self.bits = min(MAX_FILTER_BITS, max(1 << 15, 1 << (FILTER_RATE * n).bit_length()))
        slots = hits.select(self._slot().alias("s"), "n")
        self.bitmap = slots.groupBy(F.expr("bitmap_bucket_number(s)").alias("__bucket")).agg(
            F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("__hit"), F.expr(f"bitmap_construct_agg(bitmap_bit_position(s)) FILTER (WHERE n > {HOT})").alias("__hot")
        )

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.bits))

    def probe(self, rows: DataFrame) -> DataFrame:
        """rows (with a digest) and two booleans: may, whether the digest can be a hit; hot."""
        s = self._slot()
        probed = rows.withColumn("__bucket", F.call_function("bitmap_bucket_number", s)).withColumn("__bit", F.call_function("bitmap_bit_position", s))

        def told(bits: str) -> Column:
            byte = f"cast(conv(hex(substring({bits}, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int)"
            return F.coalesce(F.expr(f"bit_get({byte}, cast(__bit % 8 as int)) = 1"), F.lit(False))

        return probed.join(F.broadcast(self.bitmap), "__bucket", "left").withColumn("may", told("__hit")).withColumn("hot", told("__hot")).drop("__bucket", "__bit", "__hit", "__hot")


def _salted(rows: DataFrame) -> DataFrame:
    """rows (with `hot`) dealt to the salts of their group by their place in the input."""
    return rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))


def _spread(rows: DataFrame) -> DataFrame:
    """rows (with `hot`) once for each salt of their group."""
    return rows.withColumn("s", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "max", digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest.

    keep: "max" or "min", which identifier of equal texts stays. A null text equals the
    empty text. A null identifier is never preferred; a group of nulls only keeps null, and
    its rows count as kept. Rows repeated with the same identifier all count in group_size,
    and each is kept if its identifier is the one that stays. Very long texts are digested
    and compared whole, each within one row's memory. An empty table gives an empty result;
    other columns, whatever their names, are ignored.
    """
    best = F.max if keep == "max" else F.min
    merged = index(docs, key, text, keep, digest)
    alone = merged.filter("n = 1").select(F.col("keep_id").alias("id"), "keep_id", F.col("n").alias("group_size"), F.lit(True).alias("kept"), "digest")
    hit = merged.filter("n > 1")
    told = Filter(hit)
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("id"), content.alias("content")).withColumn("digest", digest(F.col("content")))
    rows = _salted(told.probe(rows).filter("may").drop("may"))
    stays = _spread(told.probe(hit).drop("may")).select(F.col("digest").alias("d"), "s", "keep_id", "n")
    # The texts of hits, written once.
    hits = materialise(rows.join(stays.hint("shuffle_hash"), (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s"))).drop("d", "s"), "hits")
    held = hits.filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "hot").agg(best("content").alias("held"))
    held = _spread(held).select(F.col("digest").alias("d"), "s", "held")
    checked = hits.join(held.hint("shuffle_hash"), (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s"))).withColumn("same", F.col("content") == F.col("held"))
    sure = checked.filter("same").select("id", "keep_id", "n", "digest")
    # Rows that only share the digest: none for SHA-256, so what follows moves next to nothing.
    other = checked.filter("not same").select("id", "content", "digest")
    apart = other.groupBy("digest", "content").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    lost = apart.groupBy(F.col("digest").alias("d")).agg(F.sum("n").alias("lost"))
    sure = sure.join(F.broadcast(lost) if digest is sha256_hex else lost, F.col("digest") == F.col("d"), "left").select(
        "id", "keep_id", (F.col("n") - F.coalesce("lost", F.lit(0))).alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )
    other = other.join(apart, ["digest", "content"]).select("id", "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
    return alone.unionByName(sure).unionByName(other)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; of equal texts (null as empty) the largest doc_id stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP10_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """The rows of docs that stay, with their columns, whatever their names: one per text.

    A null text equals the empty one. Of rows repeated with the same identifier and text one
    stays, of those without any identifier one for each text. An empty table stays empty.
    Rows whose text occurs once are told by the filter and move nowhere; only the others
    meet the list of what stays.
    """
    found = materialise(exact_dedup(docs, key, text, keep), "decided")
    repeated = found.filter("group_size > 1")
    per_id = repeated.filter("kept").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("rows"), F.max("group_size").alias("n"))
    told = Filter(per_id.select("digest", "n"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = told.probe(docs.select(row, F.col(f"`{key}`").cast("long").alias("own"), sha256_hex(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("digest")))
    flagged = _salted(own.filter("may"))
    # A flagged row of a text that occurs once is not in the list of repeated digests.
    stays = per_id.select(F.col("digest").alias("d"), "id", "rows")
    met = flagged.join(stays.hint("shuffle_hash"), (F.col("digest") == F.col("d")) & F.col("own").eqNullSafe(F.col("id")), "left")
    known = _spread(told.probe(per_id.select("digest")).drop("may")).select(F.col("digest").alias("d2"), "s")
    alone = met.filter("rows is null").join(known.hint("shuffle_hash"), (F.col("digest") == F.col("d2")) & (F.col("salt") == F.col("s")), "left_anti")
    # Rows that share identifier and text are alike but for other columns: any one is chosen, and
    # by a partial aggregate, so that a hot group of them does not gather.
    sortable = [F.col(f"row.`{c}`") for c in docs.columns if _sortable(docs, c)]
    one = met.filter("rows > 1").groupBy("digest", "id").agg(F.min_by("row", F.struct(*sortable)).alias("row"))
    return own.filter("not may").select("row.*").unionByName(alone.select("row.*")).unionByName(met.filter("rows = 1").select("row.*")).unionByName(one.select("row.*"))


def _sortable(docs: DataFrame, name: str) -> bool:
    return not any(x in docs.schema[name].dataType.simpleString() for x in ("map<", "variant"))
