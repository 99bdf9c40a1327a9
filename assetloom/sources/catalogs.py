"""Catalog manifests: nested JSON to normalized tables, snapshots with a revision, and fallback to the one before."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.sources.commits import create_once

VARIANT = "struct<id:string,label:string,profile:string,path:string,sha256:string,size_bytes:bigint,mtime_ns:bigint,created_at:string,source_variant_id:string,width:int,height:int,duration_sec:double,bitrate_kbps:int,video_codec:string,audio_codec:string,has_audio:boolean,probe_error:string>"
FINGERPRINT = "struct<duration_ms:bigint,aspect_ppm:bigint,frames:array<string>,luma:array<int>,has_audio:boolean,audio_hash:string,audio_luma:int>"
FAMILY = f"struct<id:string,name:string,category:string,source_variant_id:string,active_variant_id:string,known_hashes:array<string>,source_hashes:array<string>,content_fingerprint:{FINGERPRINT},variants:array<{VARIANT}>>"
ASSET = "struct<family_id:string,variant_id:string,part:string,occurrences:array<struct<slide_path:string,shape_id:string>>>"
OUTPUT = "struct<id:string,kind:string,path:string,sha256:string,size_bytes:bigint,mtime_ns:bigint,created_at:string>"
DECK = f"struct<id:string,name:string,source_path:string,source_sha256:string,source_aliases:array<string>,source_size_bytes:bigint,source_mtime_ns:bigint,assets:array<{ASSET}>,detached_outputs:array<{OUTPUT}>,restored_outputs:array<{OUTPUT}>,optimized_outputs:array<{OUTPUT}>>"
MANIFEST = f"schema_version int, project_id string, revision bigint, name string, families array<{FAMILY}>, decks array<{DECK}>, _corrupt string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11, SRC-14, D1: one row a manifest. Missing fields are null; what isn't an object is kept in `_corrupt`."""
    return spark.read.schema(MANIFEST).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def opened(spark: SparkSession, path: str, backup: str) -> tuple[DataFrame, bool]:
    """SRC-11: the manifest, or its backup where it is missing, corrupt or of another version; and whether it was recovered."""
    for source, recovered in ((path, False), (backup, True)):
        try:
            rows = read_manifest(spark, source)
            head = rows.select("schema_version", F.col("_corrupt").isNotNull().alias("bad")).head(2)
        except AnalysisException:
            continue
        if len(head) == 1 and head[0]["schema_version"] == 1 and not head[0]["bad"]:
            return rows, recovered
    raise ValueError(f"neither {path} nor {backup} is a readable catalog")


def families(manifest: DataFrame) -> DataFrame:
    """D2: one row a family, with its place in the catalog."""
    return manifest.select(F.posexplode("families").alias("ord", "f")).select("ord", "f.*")


def variants(family: DataFrame) -> DataFrame:
    """D3: one row a variant, with its family and place."""
    return family.select(F.col("id").alias("family_id"), F.posexplode("variants").alias("ord", "v")).select("family_id", "ord", "v.*")


def family_hashes(family: DataFrame) -> DataFrame:
    """D2, SET-01: (family_id, sha256, role) of known, source and variant hashes."""
    part = lambda column, role: family.select(F.col("id").alias("family_id"), F.explode(column).alias("sha256"), F.lit(role).alias("role"))
    return part(F.col("known_hashes"), "known").unionByName(part(F.col("source_hashes"), "source")).unionByName(part(F.col("variants.sha256"), "variant")).distinct()


def decks(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.posexplode("decks").alias("ord", "d")).select("ord", "d.*")


def occurrences(deck: DataFrame) -> DataFrame:
    """D5: one row an anchor of a deck's media."""
    assets = deck.select(F.col("id").alias("deck_id"), F.posexplode("assets").alias("asset", "a"))
    return assets.select("deck_id", "asset", "a.family_id", "a.variant_id", "a.part", F.posexplode_outer("a.occurrences").alias("ord", "o")).select("deck_id", "asset", "family_id", "variant_id", "part", "ord", "o.slide_path", "o.shape_id")


def outputs(deck: DataFrame) -> DataFrame:
    """SET-06, D6: all outputs of a deck, kinds in their order."""
    parts = [deck.select(F.col("id").alias("deck_id"), F.lit(k).alias("kind_ord"), F.posexplode(c).alias("ord", "o")).select("deck_id", "kind_ord", "ord", "o.*") for k, c in enumerate(("optimized_outputs", "detached_outputs", "restored_outputs"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def deck_paths(deck: DataFrame) -> DataFrame:
    """JON-16: every path under which a deck is known."""
    return deck.select(F.col("id").alias("deck_id"), F.explode(F.array_distinct(F.concat(F.array("source_path"), F.coalesce("source_aliases", F.array().cast("array<string>"))))).alias("path")).where("path IS NOT NULL")


def source_variant(family: DataFrame) -> DataFrame:
    """SUP-01: the variant that the pointer names, else the first original, else the first."""
    pick = lambda test: F.get(F.filter("variants", test), F.lit(0))
    chosen = F.coalesce(pick(lambda v: v["id"] == F.col("source_variant_id")), pick(lambda v: v["profile"] == "original"), F.get("variants", F.lit(0)))
    return family.select(F.col("id").alias("family_id"), chosen.alias("v")).select("family_id", "v.*")


def committed(rows: DataFrame, root: str, expected: int) -> str:
    """SNK-01: a new snapshot `rev=N+1`, written aside and then renamed; refused where that revision is there already.

    A revision belongs to who creates the file `_rev=N+1`, which names the folder that becomes it; of two writers one does,
    and the other is refused. Where a writer died between the two steps, the next one finishes the first one's revision.
    """
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final, staged, claim = (jvm.org.apache.hadoop.fs.Path(root, name) for name in (f"rev={expected + 1}", f"_staged-{uuid.uuid4().hex}", f"_rev={expected + 1}"))
    files = final.getFileSystem(conf)
    if not files.exists(final):
        rows.write.json(staged.toString())
        if spark.read.schema(rows.schema).json(staged.toString()).count() != rows.count():
            files.delete(staged, True)
            raise ValueError("the snapshot can't be read as it was written")
        if create_once(spark, claim.toString(), staged.toString()):
            if not files.exists(final):
                files.rename(staged, final)
            return final.toString()
        files.delete(staged, True)
        stream = files.open(claim)
        left = jvm.org.apache.hadoop.fs.Path(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        if files.exists(left) and not files.exists(final):
            files.rename(left, final)
    raise FileExistsError(f"PATH_ALREADY_EXISTS: {final.toString()}")


def latest(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """SRC-11: the newest snapshot that `committed` wrote and that can be read, with its revision."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(root)
    names = [f.getPath().getName() for f in folder.getFileSystem(conf).listStatus(folder)]
    for revision in sorted((int(n[4:]) for n in names if n.startswith("rev=") and n[4:].isdigit()), reverse=True):
        rows = read_manifest(spark, f"{root}/rev={revision}")
        if not rows.where("_corrupt IS NULL AND schema_version = 1").isEmpty():
            return rows, revision
    raise ValueError(f"{root} holds no readable snapshot")


def stored_by_hash(blobs: DataFrame, path: str) -> None:
    """SNK-02: content-addressed rows (sha256, content), in folders by the first two digits; a hash that is there isn't written again."""
    once = blobs.dropDuplicates(["sha256"]).withColumn("prefix", F.substring("sha256", 1, 2))
    try:
        there = blobs.sparkSession.read.schema("sha256 string, prefix string").parquet(path).select("sha256")
        once = once.join(there, "sha256", "left_anti")
    except AnalysisException:  # nothing stored yet
        pass
    once.write.mode("append").partitionBy("prefix").parquet(path)
