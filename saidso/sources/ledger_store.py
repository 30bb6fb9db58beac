"""The ledger as buckets of Parquet under numbered manifests.

A claim lies in the bucket its id hashes to. A batch reads and writes only the buckets it has claims for: they are merged into
new folders, and a manifest, which names the folder of every bucket, is put in place under the next number. Putting it fails if
that number is taken, so of two writers one is first; the other looks at what was written meanwhile, and merges again only
if it touches one of its own buckets. Readers take the highest manifest and never see half a batch; folders that no recent manifest
names are swept.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saidso.operators.ledger import upsert, with_ids
from saidso.schemas import CLAIMS
from saidso.session import materialize

#: Buckets of a new ledger; a ledger keeps the number it began with.
BUCKETS = 64
ATTEMPTS = 20


@dataclass
class Manifest:
    """number, how many buckets there are, the folder of each bucket that has claims, and the buckets the last write put there."""

    number: int = 0
    buckets: int = BUCKETS
    folders: dict[str, str] = field(default_factory=dict)
    touched: list[str] = field(default_factory=list)


class _Files:
    """The few calls on the file system of a ledger that Spark's readers and writers do not offer."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str) -> JavaObject:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def age(self, name: str) -> float:
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def put(self, name: str, text: str) -> bool:
        """Write a file at once under a name that must be free; false if it is taken."""
        draft = self.path(f"drafts/{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(self.path(name).getParent())
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(self.path(name)), none)
        except Py4JJavaError as err:
            self.fs.delete(draft, False)
            if "FileAlreadyExistsException" in err.java_exception.getClass().getName():
                return False
            raise
        return True


def _numbers(files: _Files) -> list[int]:
    return sorted(int(n[:-5]) for n in files.names("manifests") if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, root: str, number: int) -> Manifest:
    text = spark.read.text(f"{root.rstrip('/')}/manifests/{number:012d}.json", wholetext=True).first()[0]
    return Manifest(**json.loads(text))


def current(spark: SparkSession, root: str) -> Manifest:
    """The highest manifest; of an absent ledger, one without folders."""
    numbers = _numbers(_Files(spark, root))
    return _manifest(spark, root, numbers[-1]) if numbers else Manifest()


def bucket_of(claim_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(claim_id), F.lit(buckets)).cast("string")


def _rows(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], CLAIMS)
    return spark.read.schema(CLAIMS).parquet(*(f"{root.rstrip('/')}/{f}" for f in sorted(folders)))


def read_store(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The claims of the newest manifest, or of one that is still kept."""
    manifest = current(spark, root) if number is None else _manifest(spark, root, number)
    return _rows(spark, root, list(manifest.folders.values()))


def _written(rows: DataFrame, root: str, touched: list[str]) -> dict[str, str]:
    """The new folders of the buckets `touched`: `rows` with their bucket, in ledger order."""
    folder = f"data/{uuid.uuid4().hex}"
    dealt = rows.repartition(max(len(touched), 1), "bucket").sortWithinPartitions("bucket", "person_slug", "said_date", "id")
    dealt.write.partitionBy("bucket").parquet(f"{root.rstrip('/')}/{folder}")
    files = _Files(rows.sparkSession, root)
    return {n.removeprefix("bucket="): f"{folder}/{n}" for n in files.names(folder) if n.startswith("bucket=")}


def _commit(spark: SparkSession, root: str, base: Manifest, touched: list[str], folders: dict[str, str]) -> Manifest | None:
    """The manifest after `base` with the buckets `touched` replaced; none if another writer touched one of them meanwhile."""
    files = _Files(spark, root)
    while True:
        kept = {b: f for b, f in base.folders.items() if b not in touched}
        new = Manifest(base.number + 1, base.buckets, kept | folders, touched)
        if files.put(f"manifests/{new.number:012d}.json", json.dumps(vars(new))):
            return new
        other = _manifest(spark, root, new.number)
        if other.buckets != base.buckets or set(other.touched) & set(touched):
            return None
        base = other


def upsert_store(incoming: DataFrame, root: str, ordinal: str = "ordinal", buckets: int = BUCKETS) -> Manifest:
    """Merge a batch of claims into the ledger under `root`; only the buckets of its claims are read and written."""
    spark = incoming.sparkSession
    incoming = materialize(with_ids(incoming))
    for _ in range(ATTEMPTS):
        base = current(spark, root)
        base.buckets = base.buckets if base.number else buckets
        touched = sorted(r[0] for r in incoming.select(bucket_of(F.col("id"), base.buckets)).distinct().collect())  # at most one row a bucket
        if not touched:
            return base
        held = _rows(spark, root, [base.folders[b] for b in touched if b in base.folders])
        merged = upsert(held, incoming, ordinal).drop("change").select(*CLAIMS.names)
        folders = _written(merged.withColumn("bucket", bucket_of(F.col("id"), base.buckets)), root, touched)
        new = _commit(spark, root, base, touched, folders)
        if new is not None:
            return new
    raise RuntimeError(f"other writers came first {ATTEMPTS} times")


def replace_store(claims: DataFrame, root: str, buckets: int = BUCKETS) -> Manifest:
    """Put a whole ledger in place of what is there."""
    spark = claims.sparkSession
    for _ in range(ATTEMPTS):
        base = current(spark, root)
        base.buckets = base.buckets if base.number else buckets
        every = [str(b) for b in range(base.buckets)]
        folders = _written(claims.select(*CLAIMS.names).withColumn("bucket", bucket_of(F.col("id"), base.buckets)), root, every)
        new = _commit(spark, root, base, every, folders)
        if new is not None:
            return new
    raise RuntimeError(f"other writers came first {ATTEMPTS} times")


def sweep_store(spark: SparkSession, root: str, keep: int = 3, older_than: float = 86_400.0) -> list[str]:
    """Delete all but the last `keep` manifests and the folders none of them names; younger ones may belong to a writer at work."""
    files = _Files(spark, root)
    numbers = _numbers(files)
    live = {f for n in numbers[-keep:] for f in _manifest(spark, root, n).folders.values()}
    written = [f"data/{n}" for n in files.names("data") if files.age(f"data/{n}") >= older_than]
    held = {f: [f"{f}/{n}" for n in files.names(f) if n.startswith("bucket=")] for f in written}
    # A write goes as a whole when none of its buckets is named any more.
    gone = [x for f, buckets in held.items() for x in ([f] if not live & {*buckets} else [b for b in buckets if b not in live])]
    gone += [f"manifests/{n:012d}.json" for n in numbers[:-keep]]
    gone += [f"drafts/{n}" for n in files.names("drafts") if files.age(f"drafts/{n}") >= older_than]
    for name in gone:
        files.delete(name)
    return gone
