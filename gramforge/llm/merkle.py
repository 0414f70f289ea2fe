"""Fixity audit of WARC replicas by Merkle trees.

Every replica hashes its records, and its records in ranges of offsets, these ranges in ranges, up to a root, and publishes
the digests by level. An audit compares the roots and then, level by level, only the children of nodes that differ, down to
records that are altered, missing or extra. Records lie in files by id, each of which covers FILE_BITS of ids, so ranges of
offsets are ranges of ids; a manifest says which offset a record has, so that a lost record changes the digests above it
and no others. Records that share an id are one leaf of that tree; below it each has its own digest, by which
audit_records() finds it.

Where records lie is another tree's matter: a Layout numbers the records of each file by their offsets and hashes offset,
length and digest of each into leaves and ranges of FANOUT places, so that records in another order or place are found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramforge.llm.common import written

BITS = 4  # FANOUT = 16
FILE_BITS = 12
NO_ID = -(1 << 63)
#: A WARC record has a date; pages have none.
DATE = "1970-01-01T00:00:00Z"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", own: Column | None = None) -> DataFrame:
    """WARC records: _id (or another column), _n (bytes) and _d (SHA-256). Null bodies and URLs are empty; rows without an
    id share one."""
    body, url = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (body_col, url_col))
    name = F.coalesce(F.col(id_col if own is None else id_col + ".id").cast("string"), F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), name, F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    record = F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")
    return pages.select((F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) if own is None else own).alias("_id"), record.alias("_b")).select("_id", F.octet_length("_b").cast("long").alias("_n"), F.sha2("_b", 256).alias("_d"))


def leaves(own: DataFrame) -> DataFrame:
    """One row for each id: node, n_records, n_bytes, digest. Repeated ids are summed up digit by digit, whatever their
    order and however many there are; an id with one record has the record's SHA-256 as its digest."""
    part = lambda i: F.sum(F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"_{i}")
    own = own.groupBy("_id").agg(F.count("*").alias("n_records"), F.sum("_n").alias("n_bytes"), F.max("_d").alias("_one"), *(part(i) for i in range(8)))
    many = F.sha2(F.concat_ws(":", *(F.col(f"_{i}").cast("string") for i in range(8))), 256)
    return own.select(F.col("_id").alias("node"), "n_records", "n_bytes", F.when(F.col("n_records") == 1, F.col("_one")).otherwise(many).alias("digest"))


class Replica:
    """A replica's published digests: levels[0] has the records, in the order of their offsets, each further level the
    ranges of offsets that FANOUT nodes below cover, the last one the root (two where ids have both signs). A range's digest
    is one of its nodes' offsets and digests. Offsets are those of the archive's manifest: the replica's own ones, or those
    of another replica, which may have records that this one lost; records that the manifest doesn't know have none."""

    def __init__(self, pages: DataFrame, manifest: Replica | None = None, **columns: str):
        self.records = written(records(pages, **columns), "merkle-records")
        leaf = written(leaves(self.records), "merkle-leaves")
        place = offsets(leaf).select("node", "warc_offset") if manifest is None else manifest.levels[0].select("node", "warc_offset")
        leaf = written(leaf.join(place, "node", "left"), "merkle-0")
        low, high = leaf.agg(F.min("node"), F.max("node")).first()
        self.levels = [leaf]
        height = 0
        while low is not None and height * BITS < 64 and (low >> height * BITS) != (high >> height * BITS):
            height += 1
        for k in range(1, height + 1):
            child = F.array_sort(F.collect_list(F.struct("node", F.coalesce(F.col("warc_offset").cast("string"), F.lit("-")).alias("at"), "digest")))  # FANOUT of them at most
            body = F.array_join(F.transform(child, lambda c: F.concat_ws(":", c["node"].cast("string"), c["at"], c["digest"])), "\n")
            above = self.levels[-1].groupBy(F.shiftright("node", BITS).alias("node")).agg(F.min("warc_offset").alias("warc_offset"), F.sha2(body, 256).alias("digest"))
            self.levels.append(written(above, f"merkle-{k}"))


def descent(a: Replica, b: Replica) -> DataFrame:
    """node, _a and _b: ids whose records differ, with both digests. Trees of different height are compared from the lower
    top down; only children of nodes that differ are looked at. Empty replicas have no nodes and agree with each other."""
    height = min(len(a.levels), len(b.levels)) - 1
    differing = None
    for k in range(height, -1, -1):
        own, other = (r.levels[k].select("node", F.col("digest").alias(f"_{n}")) for r, n in ((a, "a"), (b, "b")))
        if differing is not None:
            up = differing.select(F.col("node").alias("_up"))
            own, other = (x.join(up, F.shiftright("node", BITS) == F.col("_up"), "left_semi") for x in (own, other))
        differing = written(own.join(other, "node", "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))), "differing")
        if differing.isEmpty():
            break
    return differing


def places_of(a: Replica, differing: DataFrame) -> DataFrame:
    return a.levels[0].join(differing.select("node"), "node", "left_semi").select("node", "n_bytes", "warc_offset")


def reported(found: DataFrame) -> DataFrame:
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("altered")
    return found.select(F.when(F.col("node") != NO_ID, F.col("node")).alias("record_id"), status.alias("status"), F.shiftright("node", FILE_BITS).alias("warc_file"), F.when(F.col("_a").isNotNull(), F.col("warc_offset")).alias("warc_offset"), "n_bytes", F.col("_a").alias("digest"), F.col("_b").alias("replica_digest"))


def audit(a: Replica, b: Replica) -> DataFrame:
    """Ids whose records differ: id, status (altered, missing or extra in b), file, offset and size in a (null for extra
    ones), and both digests. Records that share an id are one row."""
    differing = descent(a, b)
    return reported(differing.join(places_of(a, differing), "node", "left"))


def before(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows (one for each _id and _d) with the sum of a value over the same id's rows of smaller digests. Digests are dealt
    to 4,096 parts by their first digits, so that no task holds all records of one id."""
    part = F.substring("_d", 1, 3)
    sums = rows.groupBy("_id", part.alias("_part")).agg(F.sum(value).alias("_sum"))
    up = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_id", "_part", F.coalesce(F.sum("_sum").over(up("_id").orderBy("_part")), F.lit(0)).alias("_base"))
    own = rows.withColumn("_part", part).withColumn("_within", F.coalesce(F.sum(value).over(up("_id", "_part").orderBy("_d")), F.lit(0)))
    return own.join(sums, ["_id", "_part"]).withColumn(name, F.col("_base") + F.col("_within")).drop("_part", "_within", "_base")


def audit_records(a: Replica, b: Replica) -> DataFrame:
    """audit() with one row for each record: of records that share an id, those with a digest that both replicas have as
    often agree; what is left is paired by digest order (altered), and the rest is missing or extra. Records of one id lie
    one behind the other in the order of their digests."""
    differing = descent(a, b)
    ids = differing.select(F.col("node").alias("_id"))
    count = lambda r, n: r.records.join(ids, "_id", "left_semi").groupBy("_id", "_d").agg(F.count("*").alias(n), F.max("_n").alias(f"{n}_n"))
    own = written(before(count(a, "_ca").withColumn("_bytes", F.col("_ca") * F.col("_ca_n")), "_bytes", "_place"), "records-a")
    both = own.join(count(b, "_cb"), ["_id", "_d"], "full").withColumns({"_ca": F.coalesce("_ca", F.lit(0)), "_cb": F.coalesce("_cb", F.lit(0))}).filter("_ca != _cb")
    both = written(both, "records-differing")
    lost = before(both.filter("_ca > _cb").withColumn("_k", F.col("_ca") - F.col("_cb")), "_k", "_first")
    more = before(both.filter("_cb > _ca").withColumn("_k", F.col("_cb") - F.col("_ca")), "_k", "_first")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)).alias("_i")
    lost = lost.select("*", copies).select(F.col("_id").alias("node"), (F.col("_first") + F.col("_i")).alias("_m"), F.col("_d").alias("_a"), F.col("_ca_n").alias("n_bytes"), (F.col("_place") + F.col("_ca_n") * (F.col("_cb") + F.col("_i"))).alias("_place"))
    more = more.select("*", copies).select(F.col("_id").alias("node"), (F.col("_first") + F.col("_i")).alias("_m"), F.col("_d").alias("_b"))
    found = lost.join(more, ["node", "_m"], "full").join(places_of(a, differing).select("node", F.col("warc_offset").alias("_start")), "node", "left")
    return reported(found.withColumn("warc_offset", F.col("_start") + F.col("_place")))


class Layout:
    """The published digests of where records lie: levels[0] has file, node (the record's number in its file, by offset),
    digest (of offset, length and the record's digest) and the record; each further level has FANOUT times fewer nodes a
    file, the last one a root for each file. Null files and offsets count as '' and -1."""

    def __init__(self, pages: DataFrame, file_col: str, offset_col: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html"):
        places = pages.select(F.struct(F.coalesce(F.col(file_col).cast("string"), F.lit("")).alias("file"), F.coalesce(F.col(offset_col).cast("long"), F.lit(-1)).alias("at"), F.col(id_col).cast("long").alias("id")).alias("_p"), F.col(url_col).alias("_url"), F.col(body_col).alias("_body"))
        own = records(places, "_p", "_url", "_body", own=F.col("_p")).select("_id.*", "_n", "_d")
        order = Window.partitionBy("file").orderBy("at", "id", "_d")
        leaf = own.select("file", (F.row_number().over(order) - 1).cast("long").alias("node"), F.sha2(F.concat_ws(":", F.col("at").cast("string"), F.col("_n").cast("string"), "_d"), 256).alias("digest"), F.col("id").alias("record_id"), F.col("at").alias("warc_offset"), F.col("_n").alias("n_bytes"), F.col("_d").alias("record_digest"))
        self.levels = [written(leaf, "layout-0")]
        top = self.levels[0].agg(F.max("node")).first()[0] or 0
        while top:
            top >>= BITS
            child = F.array_sort(F.collect_list(F.struct("node", "digest")))  # FANOUT of them at most
            above = self.levels[-1].groupBy("file", F.shiftright("node", BITS).alias("node")).agg(F.sha2(F.array_join(F.transform(child, lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["digest"])), "\n"), 256).alias("digest"))
            self.levels.append(written(above, f"layout-{len(self.levels)}"))


def audit_layout(a: Layout, b: Layout) -> DataFrame:
    """Places that differ: file, place, status (moved: the same record at another offset; altered: another record; missing
    or extra: no record in b or a), and the id, offset, size and digest of both. Only ranges that differ are looked at. A
    record that is lost or put in moves all behind it in its file: audit_records() tells which one it was."""
    height = min(len(a.levels), len(b.levels)) - 1
    differing = None
    for k in range(height, -1, -1):
        own, other = (r.levels[k].select("file", "node", F.col("digest").alias(f"_{n}")) for r, n in ((a, "a"), (b, "b")))
        if differing is not None:
            up = differing.select("file", F.col("node").alias("_up"))
            own, other = (x.withColumn("_up", F.shiftright("node", BITS)).join(up, ["file", "_up"], "left_semi").drop("_up") for x in (own, other))
        differing = written(own.join(other, ["file", "node"], "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))), "differing-places")
        if differing.isEmpty():
            break
    columns = ("record_id", "warc_offset", "n_bytes", "record_digest")
    own = a.levels[0].select("file", "node", *columns)
    other = b.levels[0].select("file", "node", *(F.col(c).alias(f"replica_{c}") for c in columns))
    found = differing.join(own, ["file", "node"], "left").join(other, ["file", "node"], "left")
    same = F.col("record_digest") == F.col("replica_record_digest")
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(same, "moved").otherwise("altered")
    return found.select("file", F.col("node").alias("place"), status.alias("status"), *columns, *(f"replica_{c}" for c in columns))


def offsets(leaf: DataFrame) -> DataFrame:
    """Where each id's records start in their file; a file covers 2 ** FILE_BITS ids."""
    order = Window.partitionBy(F.shiftright("node", FILE_BITS)).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return leaf.select("node", "n_bytes", F.coalesce(F.sum("n_bytes").over(order), F.lit(0)).alias("warc_offset"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with faults in known places, for the query and the tests: by the first two hex digits of the id's MD5,
    00 alters a record, 01 loses one and 02 adds another under the negative id less one."""
    key = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    same = pages.select("page_id", "url", F.when(key == "00", F.concat(F.coalesce("html", F.lit("")), F.lit(" "))).otherwise(F.col("html")).alias("html")).filter(F.coalesce(key != "01", F.lit(True)))
    return same.unionByName(pages.filter(key == "02").select((-F.col("page_id") - 1).alias("page_id"), "url", "html"))
