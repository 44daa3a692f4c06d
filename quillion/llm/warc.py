"""WARC records and a Merkle fixity audit of replicas, with DataFrame functions only.

Pages become WARC/1.1 resource records; a record's place in the archive is the sum of the lengths before it in key order.
The leaf of a record is the SHA-256 of its bytes. A range is the records that begin in one stretch of ``RANGE_BYTES`` of
offsets; its digest is that of its stretches', of which each holds a bounded number of leaves in order: a manifest's range
has one, a replica's has more where keys that the reference lacks fill more than ``RANGE_BYTES``. Above the ranges stand
levels of nodes, each over ``FANOUT`` children in order, up to one root. A manifest is the table of all nodes and leaves.

An audit compares the roots and then, level by level, only the children of nodes that differ, down to ranges and their
records. A replica is read against the manifest's key order, so a record that is lost or added damages its own range
alone.

Prefix sums are made in two steps (within range partitions, then over one row a partition), so no task sees all
records.

Defined results: null url or html is as empty; a null key sorts first; records of one key are told apart by their
digest, in the digest's order; an empty table has no nodes and equals another empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillion.llm import store

RANGE_BYTES = 1 << 20
FANOUT = 16
CRLF = "\r\n"


def record(key: Column, url: Column, html: Column) -> Column:
    """Bytes of a page's WARC record; its id is derived from key and content, its date is fixed, so that it is reproducible."""
    body = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    digest = F.sha2(body, 256)
    uuid = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: resource" + CRLF + "WARC-Record-ID: <urn:uuid:"),
        uuid,
        F.lit(">" + CRLF + "WARC-Date: 1970-01-01T00:00:00Z" + CRLF + "WARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit(CRLF + "WARC-Page-Key: "),
        F.coalesce(key.cast("string"), F.lit("")),
        F.lit(CRLF + "WARC-Payload-Digest: sha256:"),
        digest,
        F.lit(CRLF + "Content-Type: text/html" + CRLF + "Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(CRLF + CRLF),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit(CRLF + CRLF), "UTF-8"))


def leaves(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(key, length, leaf) of every page's record."""
    raw = record(F.col(id_col), F.col(url_col), F.col(html_col))
    return pages.select(F.col(id_col).cast("long").alias("key"), F.octet_length(raw).cast("long").alias("length"), F.sha2(raw, 256).alias("leaf"))


def _placed(rows: DataFrame, amount: str, name: str, order: list[str]) -> DataFrame:
    """rows with ``name``: the sum of ``amount`` over all rows before in ``order``."""
    parts = store.materialise(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "parts")
    sums = parts.groupBy("_part").agg(F.sum(amount).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_before", F.coalesce(F.sum(amount).over(within), F.lit(0))).join(F.broadcast(sums), "_part").withColumn(name, F.col("_base") + F.col("_before")).drop("_part", "_before", "_base")


def _digest(rows: DataFrame, group: list[str], order: str, leaf: str) -> DataFrame:
    """group columns and the digest of the leaves of each group in order; groups are small by construction."""
    ordered = F.array_sort(F.collect_list(F.struct(order, leaf)))
    return rows.groupBy(*group).agg(F.sha2(F.concat_ws("", F.transform(ordered, lambda x: x[leaf])), 256).alias("digest"), F.count("*").alias("children"))


def manifest(rows: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """(records, nodes) of leaves (key, length, leaf).

    records: key, length, leaf, offset, position, range_no. nodes: level (0: ranges), number, digest, children.
    """
    placed = _placed(rows.withColumn("one", F.lit(1).cast("long")), "length", "offset", ["key", "leaf"])
    placed = placed.withColumn("range_no", F.floor(F.col("offset") / range_bytes).cast("long"))
    placed = store.materialise(placed.drop("one"), "records")
    return placed, tree(placed, fanout)


def tree(placed: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(level, number, digest, children) over records with range_no, key and leaf, and stretch where a range has several."""
    # records that begin within range_bytes, each longer than its header: some thousands at most
    keyed = placed.withColumn("place", F.struct(F.col("key"), F.col("leaf")))
    if "stretch" not in placed.columns:
        keyed = keyed.withColumn("stretch", F.lit(0).cast("long"))
    stretches = _digest(keyed, ["range_no", "stretch"], "place", "leaf")
    level = _digest(stretches, ["range_no"], "stretch", "digest").select(F.lit(0).alias("level"), F.col("range_no").alias("number"), "digest", "children")
    level = store.materialise(level, "ranges")
    nodes, number = level, 0
    while level.agg(F.max("number")).first()[0]:  # until only node 0 is left
        number += 1
        up = level.withColumn("parent", F.floor(F.col("number") / fanout).cast("long"))
        level = _digest(up, ["parent"], "number", "digest").select(F.lit(number).alias("level"), F.col("parent").alias("number"), "digest", "children")
        level = store.materialise(level, "level")
        nodes = nodes.unionByName(level)
    return store.materialise(nodes, "nodes")


def replica_records(reference: DataFrame, replica: DataFrame) -> DataFrame:
    """The replica's leaves with the ranges of the reference's records: by key, or for keys that the reference lacks, the range of the last key before.

    Of the latter, stretches of ``RANGE_BYTES`` have numbers of their own, so that any number of them is digested in parts.
    """
    ranges = reference.groupBy("key").agg(F.min("range_no").alias("range_no"))
    known = replica.join(ranges, replica["key"].eqNullSafe(ranges["key"]), "left").select(replica["key"], "length", "leaf", "range_no", F.lit(0).cast("long").alias("stretch"))
    known = store.materialise(known, "known")
    if not store.has_rows(known.where("range_no is null")):
        return known
    spans = reference.groupBy("range_no").agg(F.min("key").alias("low")).select(F.col("range_no").alias("r"), "low")
    lost = _placed(known.where("range_no is null").drop("range_no", "stretch"), "length", "before", ["key", "leaf"])
    lost = lost.withColumn("stretch", F.floor(F.col("before") / RANGE_BYTES).cast("long") + 1)
    # ranges are one row each 1 MiB, so an as-of join by a running maximum over the union of both
    none = {c: F.lit(None).cast(kind).alias(c) for c, kind in (("length", "long"), ("leaf", "string"), ("stretch", "long"), ("r", "long"))}
    both = lost.select("key", "length", "leaf", "stretch", none["r"]).unionByName(spans.select(F.col("low").alias("key"), none["length"], none["leaf"], none["stretch"], "r"))
    filled = _running(both)
    return known.where("range_no is not null").unionByName(filled.where("leaf is not null").select("key", "length", "leaf", F.coalesce("filled", F.lit(0).cast("long")).alias("range_no"), "stretch"))


def _running(both: DataFrame) -> DataFrame:
    """both with ``filled``: the largest r at or before each key, in two steps like the prefix sums."""
    parts = store.materialise(both.repartitionByRange("key").withColumn("_part", F.spark_partition_id()), "as-of")
    heads = parts.groupBy("_part").agg(F.max("r").alias("_top")).select("_part", F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_base"))
    within = Window.partitionBy("_part").orderBy("key", F.col("leaf").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("_here", F.max("r").over(within)).join(F.broadcast(heads), "_part").withColumn("filled", F.greatest("_here", "_base"))


def mismatches(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Ranges (number) that differ between two trees, and (level, nodes compared) of the way down from the roots."""
    tops = [t.agg(F.max("level")).first()[0] for t in (left, right)]
    spark, visited = left.sparkSession, []
    if None in tops:  # an empty archive has no root: all of the other differs
        other = left if tops[1] is None else right
        return other.where("level = 0").select("number"), visited
    top = max(tops)
    open_ = spark.createDataFrame([(0,)], "number long")
    for level in range(top, -1, -1):
        a = left.where(F.col("level") == level).select("number", F.col("digest").alias("da"))
        b = right.where(F.col("level") == level).select("number", F.col("digest").alias("db"))
        # trees of different heights: the lower one's missing levels differ everywhere
        differ = a.join(open_, "number", "left_semi").join(b.join(open_, "number", "left_semi"), "number", "full")
        differ = store.materialise(differ.where(~F.col("da").eqNullSafe(F.col("db"))).select("number"), "differ")
        visited.append((level, differ.count()))
        if level:
            open_ = differ.select(F.explode(F.sequence(F.col("number") * fanout, F.col("number") * fanout + fanout - 1)).alias("number"))
    return differ, visited


def fixity(damaged: DataFrame, records: DataFrame) -> DataFrame:
    """Every record of the reference and every added one: damaged's rows, and the rest as intact."""
    rest = records.join(damaged.where("status != 'added'").select("offset"), "offset", "left_anti")
    return damaged.unionByName(rest.select("key", "offset", "length", "range_no", "leaf", F.col("leaf").alias("replica_leaf"), F.lit("intact").alias("status")))


def audit(records: DataFrame, nodes: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(key, offset, length, range_no, leaf, replica_leaf, status) of damaged records; offset and length are the manifest's.

    status: changed, missing (from the replica), added (unknown to the reference).
    """
    theirs = store.materialise(replica_records(records, replica), "replica")
    ranges, _ = mismatches(nodes, tree(theirs, fanout), fanout)
    bad = store.materialise(ranges.select(F.col("number").alias("range_no")), "bad-ranges")
    a = records.join(bad, "range_no", "left_semi").select("key", "offset", "length", "range_no", "leaf")
    b = theirs.join(bad, "range_no", "left_semi").select(F.col("key").alias("k"), F.col("range_no").alias("r"), F.col("leaf").alias("replica_leaf"))
    # equal records are told apart by their number, over all ranges, as a replica has those of a key in the first of its ranges
    a = a.withColumn("copy", F.row_number().over(Window.partitionBy("key", "leaf").orderBy("offset")))
    b = b.withColumn("copy_", F.row_number().over(Window.partitionBy("k", "replica_leaf").orderBy("r")))
    same = a["key"].eqNullSafe(b["k"]) & (a["leaf"] == b["replica_leaf"]) & (a["copy"] == b["copy_"])
    lost, new = a.join(b, same, "left_anti"), b.join(a, same, "left_anti")
    # of one key, damaged records pair up in the order of their digests
    lost = lost.withColumn("nth", F.row_number().over(Window.partitionBy("range_no", "key").orderBy("leaf", "offset")))
    new = new.withColumn("n", F.row_number().over(Window.partitionBy("r", "k").orderBy("replica_leaf")))
    both = lost.join(new, lost["key"].eqNullSafe(new["k"]) & (lost["range_no"] == new["r"]) & (lost["nth"] == new["n"]), "full")
    status = F.when(F.col("leaf").isNull(), "added").when(F.col("replica_leaf").isNull(), "missing").otherwise("changed")
    return both.select(F.coalesce("key", "k").alias("key"), "offset", "length", F.coalesce("range_no", "r").alias("range_no"), "leaf", "replica_leaf", status.alias("status"))
