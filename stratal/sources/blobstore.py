"""Contents by digest and revisions of items, with erasing by tombstones.

Erasing adds tombstones, which every reader subtracts from then on; purging rewrites a table without the erased rows as a
folder that takes the old one's place only in a version of its own. So a crash at any step loses nothing else, and a
purge that is repeated starts over. An erased digest is not stored again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratal.sources.versions import Versions

TABLES = {
    "blobs": "digest string, content string",
    "revisions": "source string, item_id string, revision string, digest string",
    "tombstones": "digest string",
    "erased_items": "source string, item_id string",
}


class BlobStore:
    def __init__(self, spark: SparkSession, root: str):
        self.log = Versions(spark, root, TABLES)

    def put(self, contents: DataFrame, content: str = "content") -> int:
        """Stores each content once, under its digest. Only digests of what is stored are read, no contents."""
        new = contents.where(F.col(content).isNotNull()).groupBy(F.sha2(content, 256).alias("digest")).agg(F.min(content).alias("content"))
        make = lambda read: {"blobs": new.join(read("blobs").select("digest").unionByName(read("tombstones")), "digest", "left_anti")}
        return self.log.commit(make, [("blobs", "digest", "blobs"), ("blobs", "digest", "tombstones")])

    def put_revisions(self, rows: DataFrame) -> int:
        """Revisions (source, item_id, revision, content) and their contents as one version; the first write of a revision stays,
        within a call that of the smallest content. Erased items take none."""
        key = ["source", "item_id", "revision"]
        first = rows.groupBy(*key).agg(F.min("content").alias("content")).withColumn("digest", F.sha2("content", 256))

        def make(read):
            new = first.join(read("revisions").select(*key), key, "left_anti").join(read("erased_items"), ["source", "item_id"], "left_anti")
            new = new.join(read("tombstones"), "digest", "left_anti")
            held = new.where("content IS NOT NULL").groupBy("digest").agg(F.min("content").alias("content"))
            return {"revisions": new.select(*key, "digest"), "blobs": held.join(read("blobs").select("digest"), "digest", "left_anti")}

        return self.log.commit(make, [("revisions", "item_id", "revisions"), ("revisions", "item_id", "erased_items"), ("blobs", "digest", "blobs"), ("blobs", "digest", "tombstones")])

    def erase(self, digests: DataFrame) -> int:
        """Tombstones for the digests (digest)."""
        return self.log.commit(lambda read: {"tombstones": digests.select("digest").distinct().join(read("tombstones"), "digest", "left_anti")}, [])

    def erase_items(self, items: DataFrame) -> int:
        """All revisions of the items (source, item_id), and the contents that no other item has, as one version."""
        gone = items.select("source", "item_id").distinct()

        def make(read):
            own = read("revisions").join(gone, ["source", "item_id"], "left_semi").select("digest").distinct()
            others = read("revisions").join(gone, ["source", "item_id"], "left_anti").join(read("erased_items"), ["source", "item_id"], "left_anti")
            alone = own.join(others.select("digest"), "digest", "left_anti")
            return {"erased_items": gone.join(read("erased_items"), ["source", "item_id"], "left_anti"), "tombstones": alone.join(read("tombstones"), "digest", "left_anti")}

        return self.log.commit(make, [("erased_items", "item_id", "revisions"), ("tombstones", "digest", "revisions")])

    def blobs(self, version: int | None = None) -> DataFrame:
        """digest, content of what is stored and not erased."""
        at = self.log.latest() if version is None else version
        return self.log.read("blobs", at).join(self.log.read("tombstones", at), "digest", "left_anti")

    def damaged(self) -> DataFrame:
        """digest of blobs whose content is another one: reads all contents, so it is no part of storing or reading."""
        return self.blobs().where(F.sha2("content", 256) != F.col("digest")).select("digest")

    def revisions(self, version: int | None = None) -> DataFrame:
        at = self.log.latest() if version is None else version
        return self.log.read("revisions", at).join(self.log.read("erased_items", at), ["source", "item_id"], "left_anti")

    def purge(self) -> int:
        """Rewrites both tables without what is erased; old folders go with Versions.forget."""
        self.log.compact("blobs", lambda rows: rows.join(self.log.read("tombstones"), "digest", "left_anti"))
        return self.log.compact("revisions", lambda rows: rows.join(self.log.read("erased_items"), ["source", "item_id"], "left_anti"))
