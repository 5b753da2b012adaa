"""WARC records and a Merkle fixity audit of replicas.

Pages become resource records, laid out in archives by ordered offset.  A
record's place in its archive's tree, its slot, comes from its own id, so a
record that is lost or added shifts no other.  A leaf hashes the records of one
slot; a node hashes its children's hashes with their offset ranges, counted
from the node's own start, so a change of length shows on one path only.  An
audit compares the roots of two replicas and descends only into branches that
differ, down to the records that are corrupt, missing or added.  Offsets are
compared last, in the archives that differ: a whole record at another place is
moved, not corrupt.

An archive holds the pages of ARCHIVE_IDS consecutive ids.  A record whose id
is null or not its own (it occurs twice in either replica) is known by its
content alone: copies are one record with a count, and such records are spread
over LOOSE_ARCHIVES archives by hash.  So no window or group is larger than an
archive, whatever ids repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.lineage import Scratch

FANOUT = 16
ARCHIVE_IDS = 2048
#: Levels above the leaves: FANOUT ** DEPTH slots at least.
DEPTH = 3
LOOSE_ARCHIVES = 1 << 20
#: Archives of records known by content are numbered downwards from here, below those of any id.
LOOSE_FROM = -(1 << 60)
DATE = "2024-01-01T00:00:00Z"


def _record_id(page_id: Column, url: Column) -> Column:
    h = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit("|"), url))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def record_text(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """One WARC/1.0 resource record; a null url or page counts as empty."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:uuid:"), _record_id(page_id, url),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame) -> DataFrame:
    """(page_id, record) of pages (page_id, url, html; more columns are ignored)."""
    page_id = F.col("page_id").cast("long")
    return pages.select(page_id.alias("page_id"), record_text(page_id, F.col("url").cast("string"), F.col("html").cast("string")).alias("record"))


def hashed(found: DataFrame) -> DataFrame:
    """(page_id, length, sha256, copies): distinct records by hash; copies fall before any shuffle."""
    return found.select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256")).groupBy("page_id", "length", "sha256").agg(F.count("*").alias("copies"))


def shared_ids(*replicas: DataFrame) -> DataFrame:
    """(page_id) of ids that more than one record of a replica has."""
    each = [r.where("page_id is not null").groupBy("page_id").agg(F.sum("copies").alias("n")).where("n > 1").select("page_id") for r in replicas]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.distinct()


def leaves(found: DataFrame, shared: DataFrame) -> DataFrame:
    """(page_id, archive, leaf, key, offset, length, sha256, copies): each record's slot and place.

    found: as from ``hashed``; shared: as from ``shared_ids``.  key is empty
    for records known by their id, else their hash; length is of one copy.
    """
    flagged = found.join(shared.withColumn("shared", F.lit(True)), "page_id", "left")
    loose = F.col("page_id").isNull() | F.coalesce("shared", F.lit(False))
    own_hash = F.xxhash64("page_id", "sha256")
    placed = flagged.select(
        "page_id", F.when(loose, LOOSE_FROM + F.pmod(own_hash, F.lit(LOOSE_ARCHIVES))).otherwise(F.floor(F.col("page_id") / ARCHIVE_IDS).cast("long")).alias("archive"),
        F.when(loose, F.pmod(F.shiftrightunsigned(own_hash, 24), F.lit(ARCHIVE_IDS))).otherwise(F.pmod("page_id", F.lit(ARCHIVE_IDS))).cast("long").alias("leaf"),
        F.when(loose, F.concat_ws(":", F.col("page_id").cast("string"), F.col("sha256"))).otherwise("").alias("key"), "length", "sha256", "copies",
    )
    before = Window.partitionBy("archive").orderBy("leaf", "key").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("length") * F.col("copies")
    return placed.withColumn("offset", F.sum(size).over(before) - size).select("page_id", "archive", "leaf", "key", "offset", "length", "sha256", "copies")


def _text_of(children: Column) -> Column:
    """Children in order as lines: number, range from the parent's start, hash."""
    line = lambda s, x: F.struct(
        F.concat(s["text"], x["node"].cast("string"), F.lit(":"), s["at"].cast("string"), F.lit("-"), (s["at"] + x["size"]).cast("string"), F.lit(":"), x["hash"], F.lit("\n")).alias("text"),
        (s["at"] + x["size"]).alias("at"),
    )
    return F.aggregate(children, F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")), line, lambda s: s["text"])


def tree(own: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """Levels of the trees of all archives, leaves first, each (archive, node, size, hash); the last holds the roots."""
    record = F.struct(F.col("key").alias("node"), (F.col("length") * F.col("copies")).alias("size"), F.concat_ws("x", F.col("sha256"), F.col("copies").cast("string")).alias("hash"))
    grouped = own.groupBy("archive", F.col("leaf").alias("node")).agg(F.array_sort(F.collect_list(record)).alias("c"), F.sum(F.col("length") * F.col("copies")).alias("size"))
    levels = [scratch.save(grouped.select("archive", "node", "size", F.sha2(_text_of(F.col("c")), 256).alias("hash")), f"{name}-0")]
    for k in range(1, DEPTH + 1):
        child = F.struct("node", "size", "hash")
        up = levels[-1].groupBy("archive", F.floor(F.col("node") / FANOUT).cast("long").alias("up")).agg(F.array_sort(F.collect_list(child)).alias("c"), F.sum("size").alias("size"))
        levels.append(scratch.save(up.select("archive", F.col("up").alias("node"), "size", F.sha2(_text_of(F.col("c")), 256).alias("hash")), f"{name}-{k}"))
    return levels


def audit(primary: DataFrame, replica: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(archive) of the trees that differ, and (archive, leaf) of the slots that differ in them.

    primary, replica: as from ``leaves``.  Each level is read only below nodes
    that differ.
    """
    a, b = tree(primary, scratch, "primary"), tree(replica, scratch, "replica")
    wrong: DataFrame | None = None
    roots: DataFrame | None = None
    for k in range(DEPTH, -1, -1):
        x, y = (side[k] for side in (a, b))
        if wrong is not None:
            up = F.floor(F.col("node") / FANOUT).cast("long")
            x, y = (d.withColumn("up", up).join(wrong, ["archive", "up"], "left_semi").drop("up") for d in (x, y))
        pair = x.alias("x").join(y.alias("y"), ["archive", "node"], "full").where(~F.col("x.hash").eqNullSafe(F.col("y.hash")))
        wrong = scratch.save(pair.select("archive", F.col("node").alias("up")), f"differ-{k}")
        roots = wrong if roots is None else roots
    scratch.drop(*(f"{side}-{k}" for side in ("primary", "replica") for k in range(DEPTH + 1)))
    return roots.select("archive").distinct(), wrong.select("archive", F.col("up").alias("leaf"))


def check_replica(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """(page_id, archive, leaf, offset, length, sha256, copies, status, intact) for each record of either replica.

    status: "intact"; "moved", whole but at another offset of its archive;
    "corrupt", its content differs; "missing" from the replica; "added", only
    there (place and hash are the replica's).  intact: status is intact or moved.
    A record without an id of its own is known by its content, so damage to it
    shows as one missing and one added; of copies that are too few or too many
    it shows as missing or added.  A null url or page is an empty one.  An empty
    primary gives the replica's records as added.
    """
    scratch = Scratch(pages.sparkSession, "fixity")
    ours, theirs = scratch.save(hashed(records(pages)), "ours"), scratch.save(hashed(records(replica)), "theirs")
    shared = scratch.save(shared_ids(ours, theirs), "shared")
    own, other = scratch.save(leaves(ours, shared), "own"), scratch.save(leaves(theirs, shared), "other")
    scratch.drop("ours", "theirs")
    archives, slots = audit(own, other, scratch)
    differing = other.join(archives, "archive", "left_semi")
    there = differing.select("archive", "leaf", "key", F.col("offset").alias("r_offset"), F.col("sha256").alias("r_sha256"), F.col("copies").alias("r_copies"))
    flagged = own.join(archives.withColumn("open", F.lit(True)), "archive", "left").join(slots.withColumn("located", F.lit(True)), ["archive", "leaf"], "left")
    paired = flagged.join(there, ["archive", "leaf", "key"], "left")
    changed = F.when(F.col("r_sha256").isNull() | (F.col("copies") > F.col("r_copies")), "missing").when(F.col("copies") < F.col("r_copies"), "added").when(F.col("sha256") != F.col("r_sha256"), "corrupt")
    status = F.coalesce(F.when(F.col("located"), changed), F.when(F.col("open") & (F.col("offset") != F.col("r_offset")), "moved"), F.lit("intact"))
    found = paired.select("page_id", "archive", "leaf", "offset", "length", "sha256", "copies", status.alias("status"))
    added = differing.join(slots, ["archive", "leaf"], "left_semi").join(own, ["archive", "leaf", "key"], "left_anti").select("page_id", "archive", "leaf", "offset", "length", "sha256", "copies", F.lit("added").alias("status"))
    return found.unionByName(added).withColumn("intact", F.col("status").isin("intact", "moved"))
