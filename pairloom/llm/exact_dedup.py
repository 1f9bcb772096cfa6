"""Exact dedup against a persistent digest index; DataFrame operations only.

The index is a table of SHA-256 digests, bucketed and sorted by digest. A batch is reduced to one row per digest, freed
of digests that earlier batches hold by a sort-merge anti-join that reads the index in place (its buckets are not
shuffled), and the rest is appended. compact() makes one sorted file of each bucket again after appends.

Defined results: a null text counts as empty, and empty texts equal each other; a null id sorts below every other id;
rows that repeat both id and text count in group_size, and one of them at most is kept (keep_one: the least of them in
the order of their columns); texts of any length are read whole; an empty batch gives no rows and appends nothing; other
columns of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import join_groups, materialise, one_row_each, scratch_path, scratch_table, table

#: Batches into which op1 deals its table: each meets an index that holds what the earlier ones appended.
BATCHES = 3


class DigestIndex:
    """(digest binary, keep_id long, batch string) in ``buckets`` buckets under ``path``, a shared folder.

    Another session opens an index again by giving the same path, name and bucket count. Generations of the table are
    numbered; the newest in the catalog counts.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int):
        self.spark, self.path, self.base, self.buckets, self.generation = spark, path, name, buckets, 0
        while spark.catalog.tableExists(self._named(self.generation + 1)):
            self.generation += 1
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/{self.generation}'"
        )

    def _named(self, generation: int) -> str:
        return f"{self.base}_g{generation}"

    @property
    def name(self) -> str:
        return self._named(self.generation)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _writer(self, rows: DataFrame):
        """One file for each bucket: the rows are dealt out by the hash that buckets use.

        The substring is the whole digest; by its plain name, a read of the index itself would not be dealt out again.
        """
        rows = rows.select("digest", "keep_id", "batch").repartition(self.buckets, F.substring("digest", 1, 32))
        return rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")

    def append(self, rows: DataFrame) -> None:
        self._writer(rows).mode("append").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def compact(self) -> None:
        """Rewrite the index with one sorted file for each bucket, so that joins need no sort; the old one goes last."""
        old, new = self.name, self._named(self.generation + 1)
        self._writer(self.rows()).option("path", f"{self.path}/{self.generation + 1}").saveAsTable(new)
        self.generation += 1
        self.spark.sql(f"DROP TABLE {old}")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per (digest, id) with the number of rows that repeat it."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest"))
    return rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))


def _group(members: DataFrame) -> DataFrame:
    return members.groupBy("digest").agg(F.max("doc_id").alias("top_id"), F.sum("copies").alias("group_size"))


def admit(groups: DataFrame, index: DigestIndex, batch: str) -> None:
    """Append what the index lacks of a batch's groups (digest, top_id). A batch that runs again appends nothing twice."""
    fresh = groups.join(index.rows().hint("merge"), "digest", "left_anti")
    index.append(fresh.select("digest", F.col("top_id").alias("keep_id"), F.lit(batch).alias("batch")))


def resolve(members: DataFrame, groups: DataFrame, index: DigestIndex, batches: list[str]) -> DataFrame:
    """A row per input row of ``members``: doc_id, keep_id, group_size, kept (new in ``batches``), text_sha256.

    Only the digests of ``groups`` are looked up; the index is read in place.
    """
    held = groups.select("digest", "group_size").join(index.rows().hint("merge"), "digest")
    held = held.select("digest", "keep_id", F.col("batch").isin(*batches).alias("is_new"), "group_size")
    resolved = materialise(held, "resolved")
    total = members.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    rows = join_groups(members, resolved, "digest", "group_size", total)
    return rows.select(
        "doc_id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"), "is_new", "digest"
    ).select(
        "doc_id", "keep_id", "group_size",
        (F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate a batch within itself and against the index, append what is new, and return a row per input row.

    Columns: doc_id, keep_id, group_size (rows of this batch with that text), kept, text_sha256. A batch that is run
    again under its name gets the same answer and appends nothing twice.
    """
    members = materialise(digests(docs, id_col, text_col), "digests")
    groups = materialise(_group(members), "digest-groups")
    admit(groups, index, batch)
    return resolve(members, groups, index, [batch])


def new_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index in the shared folder, with as many buckets as the session has shuffle partitions."""
    path = scratch_path(spark, "digest-index")
    index = DigestIndex(spark, path, "digest_index_" + path[-12:], buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    for generation in range(2):
        scratch_table(spark, f"{index.base}_g{generation}")
    return index


def deduplicate_all(docs: DataFrame, index: DigestIndex, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal a whole table into the index, the batches of the largest ids first, and return every row's final state.

    Batches are ranges of ids, so the row that the index keeps of a text is that of the largest id. Later batches are
    deduplicated by the anti-join against what the earlier ones appended. group_size counts rows of the whole table.
    """
    members = materialise(digests(docs, id_col, text_col), "digests")
    bounds = members.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)]).alias("b")).first()[0] or []
    bounds = sorted(set(bounds), reverse=True)
    number = reduce(lambda rest, i: F.when(F.col("doc_id") >= bounds[i], i).otherwise(rest), reversed(range(len(bounds))), F.lit(len(bounds)))
    names = [f"batch-{i}" for i in range(len(bounds) + 1)]
    for i, name in enumerate(names):
        admit(materialise(_group(members.where(number == i)), "digest-groups"), index, name)
    index.compact()
    return resolve(members, materialise(_group(members), "digest-groups"), index, names)


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents whose row stays, with all their columns: the largest doc_id of each text, one row of it."""
    members = materialise(digests(docs), "digests")
    groups = materialise(_group(members), "digest-groups")
    index = new_index(docs.sparkSession)
    admit(groups, index, "corpus")
    kept = materialise(resolve(members, groups, index, ["corpus"]).where("kept").select(F.col("doc_id").alias("k_id"), F.unhex("text_sha256").alias("k_digest")), "kept")
    # A struct holds the input's columns, so their names can't clash with those used here.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), digest(docs["text"]).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("digest") == F.col("k_digest"))
    rows = rows.join(kept, same, "left_semi")
    twice = materialise(members.where("copies > 1").select(F.col("doc_id").alias("k_id"), F.col("digest").alias("k_digest")), "repeated-rows")
    return one_row_each(rows, twice, same, ["id", "digest"], docs.schema).select("row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_all(table(spark, sf_dir, "documents"), new_index(spark))


QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLE = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
        g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
        SELECT d.doc_id, g.keep_id, g.n AS group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
    """
}
