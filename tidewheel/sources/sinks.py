"""Sinks: upserts, immutable versions, published digests.

Tables are folders of immutable versions with a pointer written last, through
Spark's own readers and writers, so any store that Spark knows will do. A reader
sees the old version until the pointer names the new one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.sources.commits import Change, State, Tables


class VersionedTable:
    """A table whose current version is named by its newest pointer row."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self) -> bool:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointer/_SUCCESS")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def version(self) -> tuple[int, str] | None:
        """Number and folder of the current version."""
        if not self._exists():
            return None
        row = self.spark.read.schema("n long, folder string").json(f"{self.path}/pointer").orderBy(F.desc("n")).first()
        return (row.n, row.folder) if row else None

    def read(self) -> DataFrame | None:
        """The current version, or None; a version is one folder, or several that were appended one by one."""
        now = self.version()
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in now[1].split(",")]) if now else None

    def append(self, df: DataFrame) -> None:
        """Add rows as a folder of their own: what is there stays as it is, and only the pointer's list grows."""
        self._put(df, keep=True)

    def write(self, df: DataFrame, partition: list[str] | None = None) -> None:
        """Make ``df`` the current version; a crash before the last step leaves the old one current."""
        self._put(df, partition)

    def _put(self, df: DataFrame, partition: list[str] | None = None, keep: bool = False) -> None:
        now = self.version()
        folder = f"v-{uuid.uuid4().hex}"
        out = df.write.partitionBy(*partition) if partition else df.write
        out.parquet(f"{self.path}/{folder}")
        named = f"{now[1]},{folder}" if keep and now else folder
        self.spark.createDataFrame([((now[0] if now else 0) + 1, named)], "n long, folder string").coalesce(1).write.mode("append").json(f"{self.path}/pointer")


def _words(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))


def upsert_items(current: DataFrame, incoming: DataFrame, order: str = "ord") -> DataFrame:
    """Items after an ingest, with ``inserted`` and ``changed``.

    Per (source, external_id) the first incoming row counts. Known rows are only
    enriched: a title if empty, over 5 characters longer, or at least 80% as long
    with more words; an abstract if over 80 characters longer; authors, date and
    URL if missing. Rows of deadline sections are overwritten. Changed content
    clears the summary.
    """
    key = ["source", "external_id"]
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1")
    old, new = current.alias("o"), first.alias("n")
    joined = old.join(new, (F.col("o.source") == F.col("n.source")) & (F.col("o.external_id") == F.col("n.external_id")), "full")
    o, n = lambda c: F.col(f"o.{c}"), lambda c: F.col(f"n.{c}")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    fresh, gone = o("source").isNull(), n("source").isNull()
    dead = n("section").isin("opportunities", "events")
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    better_title = ~blank(n("title")) & (blank(o("title")) | (size(n("title")) > size(o("title")) + 5) | ((size(n("title")) >= F.lit(0.8) * size(o("title"))) & (_words(n("title")) > _words(o("title")))))
    better_body = size(n("abstract")) > size(o("abstract")) + 80
    take = lambda c, better: F.when(gone, o(c)).when(fresh | dead | better, n(c)).otherwise(o(c))
    title, body = take("title", better_title), take("abstract", better_body)
    changed = ~fresh & ~gone & (~title.eqNullSafe(o("title")) | ~body.eqNullSafe(o("abstract")))
    fill = lambda c: F.when(fresh | (dead & n(c).isNotNull()), n(c)).otherwise(F.coalesce(o(c), n(c)))
    return joined.select(F.coalesce(o("source"), n("source")).alias("source"), F.coalesce(o("external_id"), n("external_id")).alias("external_id"), F.coalesce(o("section"), n("section")).alias("section"), title.alias("title"), body.alias("abstract"), *[fill(c).alias(c) for c in ("authors", "url", "published_at")], F.when(~changed & ~fresh, o("summary")).alias("summary"), fresh.alias("inserted"), changed.alias("changed"))


def details_hash(details: Column) -> Column:
    """Hash of a map of details, keys sorted, without the time of verification."""
    kept = F.map_filter(details, lambda k, _: k != "verified_at")
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept)))), 256)


def new_snapshots(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Versions (item_id, details, observed_at, details_hash) that are not there yet, one each."""
    hashed = incoming.withColumn("details_hash", details_hash(F.col("details")))
    first = hashed.withColumn("_n", F.row_number().over(Window.partitionBy("item_id", "details_hash").orderBy("observed_at"))).where("_n = 1").drop("_n")
    return first.join(existing.select("item_id", "details_hash"), ["item_id", "details_hash"], "left_anti")


def label_slate(slate: DataFrame) -> DataFrame:
    """First row of each item and of each label, in order ``ord``; a row dropped for its item leaves its label free."""
    once = slate.withColumn("_n", F.row_number().over(Window.partitionBy("digest_id", "item_id").orderBy("ord"))).where("_n = 1")
    return once.withColumn("_n", F.row_number().over(Window.partitionBy("digest_id", "label").orderBy("ord"))).where("_n = 1").drop("_n")


def replace_digest(table: DataFrame | None, rows: DataFrame, digest_id: str) -> DataFrame:
    """A table with one digest's rows replaced."""
    return rows if table is None else table.where(F.col("digest_id") != digest_id).unionByName(rows)


def publish(tables: Tables, digest_id: str, slate: DataFrame, features: DataFrame, impressions: DataFrame, audits: DataFrame | None = None, base: State | None = None, batch: tuple[str, int] | None = None) -> State:
    """Publish a digest in one commit: slate and features replace older ones of the digest, impressions are appended, audits replace their kind.

    Only the digest's own rows are written. Two writers of one digest conflict: the
    later is refused and keeps nothing. ``base`` is the state the slate was made
    from; with ``batch``, a replayed batch of a stream publishes nothing again.
    """
    clean = label_slate(slate)
    kept = features.join(clean.select("item_id"), "item_id", "left_semi").select(features.columns)
    own = [{"digest_id": digest_id}]
    changes = [Change("features", kept, own), Change("impressions", impressions), Change("slate", clean, own)]
    if audits is not None:
        kinds = [{"digest_id": r.digest_id, "audit_type": r.audit_type} for r in audits.select("digest_id", "audit_type").distinct().collect()]  # a row a kind of audit
        changes.append(Change("audits", audits, kinds))
    return tables.commit(changes, base, batch)


def mark_viewed(impressions: DataFrame, digest_id: str, visible: DataFrame | None = None) -> DataFrame:
    """Impressions with the selected (and visible) rows of a digest's latest run marked as viewed."""
    from tidewheel.operators.latest import latest_run

    mine = latest_run(impressions.where(F.col("digest_id") == digest_id)).where("selected")
    if visible is not None:
        mine = mine.join(visible.select("item_id"), "item_id", "left_semi")
    seen = mine.select("impression_id", F.lit(True).alias("_seen"))
    return impressions.join(seen, "impression_id", "left").withColumn("viewed", F.col("viewed") | F.coalesce("_seen", F.lit(False))).select(impressions.columns)


def toggle(members: DataFrame, item_ids: DataFrame, on: bool) -> DataFrame:
    """A set of items after adding or removing some; adding twice changes nothing."""
    if on:
        return members.unionByName(item_ids.join(members.select("item_id"), "item_id", "left_anti").dropDuplicates(["item_id"]))
    return members.join(item_ids.select("item_id"), "item_id", "left_anti")


def fill_column(table: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """A table with a column updated where there is an update."""
    new = updates.select(key, F.col(column).alias("_new"))
    return table.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).select(table.columns)


def embed_missing(items: DataFrame, cache: DataFrame, signature: str, embed: Column) -> DataFrame:
    """(item_id, signature, text_hash, vec): cached vectors of unchanged texts, new ones for the rest; other signatures go."""
    hashed = items.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    mine = cache.where(F.col("signature") == signature).select("item_id", "text_hash", F.col("vec").alias("_vec"))
    both = hashed.join(mine, ["item_id", "text_hash"], "left")
    new = both.where("_vec is null").withColumn("vec", embed)
    cols = ["item_id", F.lit(signature).alias("signature"), "text_hash", "vec"]
    return both.where("_vec is not null").withColumn("vec", F.col("_vec")).select(*cols).unionByName(new.select(*cols))
