"""Exactly-one selection over at-least-once deliveries, with state across batches.

State is two tables, each kept as parts that a manifest names in order:

* ``dictionary``: every identifier ever seen, exactly, with a shard and an ordinal that is
  dense within its shard; a batch appends the identifiers it adds, in folders by shard;
* ``bitmaps``: for each shard and run of 32,768 ordinals, the bits of the identifiers
  already delivered, as one binary that the file format compresses; a batch writes the
  runs it touches, and the latest part that holds a run counts.

So what a batch writes follows the batch, not the state; what it reads of the dictionary
are the shards it touches. After COMPACT parts the table is written as one, and parts no
manifest names any more are removed. A batch is reduced to its first arrival per
identifier before anything is shuffled in full, so an identifier that holds a third of all
rows costs one row per map task. Parts are written first and then named in the manifest,
whose replacement is a single rename: a job that dies leaves the former state in force,
and its leftovers are overwritten by the next try.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.scratch import Scratch


#: Parts of a table after which they are written as one.
COMPACT = 32


def _bit_is_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.coalesce(F.getbit(byte.cast("int"), (position % 8).cast("int")) == 1, F.lit(False))


@dataclass
class Batch:
    """What ``SeenStore.accept`` gives for one batch."""

    kept: DataFrame
    dropped: DataFrame


class SeenStore:
    """Identifiers delivered so far, in a folder shared by all executors.

    ``shards`` is fixed when the store is made; choose it so that the identifiers of one
    shard (all identifiers / shards) sort comfortably within one task.
    """

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], shards: int = 64) -> None:
        self.spark, self.root, self.keys, self.shards = spark, root.rstrip("/"), dict(keys), shards
        self.scratch = Scratch(spark)

    # -- the manifest ---------------------------------------------------------------

    def _pointer(self) -> str:
        return f"{self.root}/CURRENT"

    def _manifest(self) -> dict:
        fs, where = self.scratch._fs(self._pointer())
        if not fs.exists(where):
            return {"version": 0, "dictionary": [], "bitmaps": [], "tops": []}
        stream = fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self) -> int:
        """Number of batches committed."""
        return self._manifest()["version"]

    def _commit(self, manifest: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        fs, target = self.scratch._fs(self._pointer())
        fresh = jvm.org.apache.hadoop.fs.Path(f"{self._pointer()}.{manifest['version']}")
        stream = fs.create(fresh, True)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        # FileContext.rename with OVERWRITE replaces the pointer in one step.
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, target, options)

    def _schema(self, name: str) -> str:
        keys = ", ".join(f"`{k}` {t}" for k, t in self.keys.items())
        return {"dictionary": f"{keys}, ordinal long, shard int", "bitmaps": "bucket long, bits binary, shard int", "tops": "shard int, top long"}[name]

    def _part(self, name: str, number: int) -> str:
        return f"{self.root}/{name}-{number}"

    def _read(self, manifest: dict, name: str) -> DataFrame:
        """All parts of a table, those of a shard in folders of their own; with the number of the part."""
        out = None
        for number in manifest[name]:
            one = self.spark.read.schema(self._schema(name)).parquet(self._part(name, number)).withColumn("part", F.lit(number))
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], self._schema(name) + ", part int") if out is None else out

    def _bitmaps(self, manifest: dict) -> DataFrame:
        """The bits of every run as the latest part has them."""
        latest = self._read(manifest, "bitmaps").groupBy("shard", "bucket").agg(F.max_by("bits", "part").alias("bits"))
        return latest.select("shard", "bucket", "bits")

    def _write(self, df: DataFrame, name: str, number: int, by_shard: bool) -> None:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy("shard") if by_shard else writer).parquet(self._part(name, number))

    def _sweep(self, manifest: dict) -> None:
        """Remove parts the manifest does not name."""
        fs, where = self.scratch._fs(self.root)
        named = {f"{name}-{n}" for name in ("dictionary", "bitmaps", "tops") for n in manifest[name]} | {"CURRENT"}
        for found in fs.listStatus(where):
            if found.getPath().getName() not in named:
                fs.delete(found.getPath(), True)

    # -- one batch ----------------------------------------------------------------

    def accept(self, arrivals: DataFrame, arrival_id: str, order: Sequence[str], keep: Callable[[DataFrame], None] | None = None) -> Batch:
        """Keep one arrival of each identifier not delivered before and remember it.

        Of several arrivals with one identifier the one with the smallest ``order``
        columns stays, then the smallest ``arrival_id``; nulls sort last. Rows with a null
        in a key have no identifier: they are neither kept as first nor dropped, and are
        in neither result. ``arrival_id`` names a stored row; where rows repeat it with
        the same key and order, one of them counts as the arrival, the rest are dropped.
        Empty batches give empty results. Other columns pass through untouched, whatever
        their names. ``keep`` gets the kept rows before the batch is committed, so what it
        writes is there whenever the store counts them as seen.
        """
        names = list(self.keys)
        clash = [n for n in ("__first", "__shard", "__copy") if n in arrivals.columns]
        if clash:
            raise ValueError(f"reserved column names: {clash}")
        keyed = arrivals.where(" AND ".join(f"`{k}` IS NOT NULL" for k in names))
        rank = F.struct(*[x for c in [*order, arrival_id] for x in (F.col(c).isNull(), F.col(c))])
        firsts = keyed.groupBy(*names).agg(F.min(rank).alias("__first"))

        # Exact dictionary: known identifiers keep their code, new ones extend their shard.
        manifest = self._manifest()
        number = manifest["version"] + 1
        shard = F.pmod(F.xxhash64(*names), F.lit(self.shards)).cast("int")
        firsts = self.scratch.save(firsts.withColumn("shard", shard), "firsts")
        # At most ``shards`` numbers: only their folders of the dictionary are read.
        touched = [r.shard for r in firsts.select("shard").distinct().collect()]
        known = self._read(manifest, "dictionary").where(F.col("shard").isin(touched)).select("shard", *names, "ordinal")
        tops = self._read(manifest, "tops").select("shard", "top")
        coded = firsts.join(known, ["shard", *names], "left").withColumn("is_new", F.col("ordinal").isNull())
        within = Window.partitionBy("shard", "is_new").orderBy(*names)
        coded = (
            coded.withColumn("__n", F.row_number().over(within))
            .join(tops, "shard", "left")
            .withColumn("ordinal", F.coalesce("ordinal", F.coalesce("top", F.lit(0)) + F.col("__n")))
            .select(*names, "__first", "is_new", "shard", "ordinal")
            .withColumn("bucket", F.expr("bitmap_bucket_number(ordinal)"))
        )
        coded = self.scratch.save(coded, "coded")

        # One arrival per bit that is still unset, against the runs the batch touches.
        runs = coded.select("shard", "bucket").distinct()
        bitmaps = self._bitmaps(manifest).join(runs, ["shard", "bucket"], "left_semi")
        position = F.expr("bitmap_bit_position(ordinal)")
        unseen = (
            coded.join(bitmaps, ["shard", "bucket"], "left")
            .where(~_bit_is_set(F.col("bits"), position))
            .drop("bits")
        )
        unseen = self.scratch.save(unseen, "unseen")

        # The union of old and new bits, and the new identifiers, become the next parts.
        fresh = unseen.groupBy("shard", "bucket").agg(
            F.expr("bitmap_construct_agg(bitmap_bit_position(ordinal))").alias("bits")
        )
        changed = bitmaps.join(fresh.select("shard", "bucket"), ["shard", "bucket"], "left_semi")
        union = changed.unionByName(fresh).groupBy("shard", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
        added = coded.where("is_new").select(*names, "ordinal", "shard")
        ended = tops.unionByName(added.groupBy("shard").agg(F.max("ordinal").alias("top"))).groupBy("shard").agg(F.max("top").alias("top"))
        self._write(union, "bitmaps", number, by_shard=False)
        self._write(added.repartition("shard"), "dictionary", number, by_shard=True)
        self._write(ended.coalesce(1), "tops", number, by_shard=False)
        after = {
            "version": number, "dictionary": [*manifest["dictionary"], number], "bitmaps": [*manifest["bitmaps"], number], "tops": [number],
        }
        self.scratch.drop(firsts, coded)

        # Arrival ids are spread evenly, so a frequent identifier does not skew this join.
        keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(names)]
        winners = unseen.select(*keys, F.col(f"__first.{arrival_id}").alias("__id"))
        same = keyed[arrival_id].eqNullSafe(F.col("__id"))
        for i, k in enumerate(names):
            same = same & (F.col(k) == F.col(f"__k{i}"))
        marked = keyed.join(winners, same, "left")
        marked = marked.withColumn("__first", F.col("__k0").isNotNull()).drop(
            "__id", *[f"__k{i}" for i in range(len(names))]
        )
        copies = Window.partitionBy(arrival_id, *names).orderBy(*order)
        marked = marked.withColumn("__copy", F.row_number().over(copies))
        stays = F.col("__first") & (F.col("__copy") == 1)
        batch = Batch(
            kept=marked.where(stays).drop("__first", "__copy"),
            dropped=marked.where(~stays).drop("__first", "__copy"),
        )
        if keep:
            keep(batch.kept)
        self._commit(after)
        if len(after["bitmaps"]) > COMPACT:
            self.compact()
        else:
            self._sweep(after)
        return batch

    def compact(self) -> None:
        """Write each table as one part and name these; what is seen stays the same."""
        manifest = self._manifest()
        if not manifest["version"]:
            return
        # A number of its own: the parts it replaces stay until the new ones are named.
        number = -manifest["version"]
        self._write(self._bitmaps(manifest), "bitmaps", number, by_shard=False)
        self._write(self._read(manifest, "dictionary").drop("part").repartition("shard"), "dictionary", number, by_shard=True)
        after = manifest | {"dictionary": [number], "bitmaps": [number]}
        self._commit(after)
        self._sweep(after)

    def count(self) -> int:
        """Identifiers delivered so far, counted from the bitmaps."""
        found = self._bitmaps(self._manifest()).select(F.sum(F.expr("bitmap_count(bits)")).alias("n")).first()
        return int(found.n or 0)
