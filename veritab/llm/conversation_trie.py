"""Operator 11: prefix trie of conversations, by heavy-path decomposition.

A node is a distinct sequence of the first d turns (role and text); its name is d and two 64-bit hashes, running xors of hashes of each turn with its place.

1. Turns are numbered, and the names of all prefixes are running totals along each conversation. Prefixes of one name make a node,
   called by its smallest conversation and its depth.
2. Each node's largest child (most conversations, then the smallest conversation) continues its path; other children begin paths of their own. A running
   pass along the conversations tells each node's path and its level, the number of lighter children down to it. A lighter child has at most half of its
   parent's conversations, so there are log2(conversations) levels at most.
3. From the last level up: values are summed along each path from its end, and the sum at a path's first node is attached to the parent
   on the level above, for the next round.

All passes along conversations and paths are `running` totals, so neither a long conversation nor a long path is one task. Nodes that hold more
than a thousandth of all rows (fewer than 1,000 of them) are broadcast to the rows, so a turn that very many conversations share isn't one task either.

Null conv_id: the turn takes no part. Null role or text counts as empty, null turns come first, and turns of one number go by role, then text;
repeated rows are turns each. Very long texts are hashed whole. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import batch, shared_dir, table, written
from veritab.llm.running import running

_NODE = ["depth", "k1", "k2"]
_BLOCK = 100_000  # places of a conversation that are joined as one


def numbered(conversations: DataFrame) -> DataFrame:
    """conv, place (from 0), bytes (of the text), t1, t2 (hashes of role and text) of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text")).where("conv is not null")
    hashes = [F.xxhash64(F.lit(salt), "role", "text").alias(f"t{salt}") for salt in (1, 2)]
    turns = turns.select("conv", "turn", "role", "text", F.lit(1).cast("long").alias("place"), F.octet_length("text").cast("long").alias("bytes"), *hashes)
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    places = running(turns, ["conv"], order, {"place": "add"}, drop=["turn", "role", "text"])
    return written(places.withColumn("place", F.col("place") - 1), "turns")


def whole(turns: DataFrame) -> DataFrame:
    """The conversations as they are: conv, depth, bytes, t1, t2, end (the last turn); depth 0 for each conversation's root."""
    n = turns.groupBy("conv").agg(F.count("*").alias("n"))
    return _with_roots(n.withColumn("length", F.col("n")), turns.select("conv", (F.col("place") + 1).alias("depth"), "bytes", "t1", "t2"))


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Conversation c as the first h turns of c - c % group, then its own after its first h; h = crc32(c) % most. Columns as in `whole`."""
    n = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = n.withColumns({"base": F.col("conv") - F.col("conv") % group, "h": F.crc32(F.col("conv").cast("string").cast("binary")) % most})
    have = n.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(have, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    first = turns.where(F.col("place") < most - 1).withColumnRenamed("conv", "base")
    head = convs.join(first, "base").where("place < h").select("conv", (F.col("place") + 1).alias("depth"), "bytes", "t1", "t2")
    # a long conversation is joined in blocks
    blocks = convs.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / _BLOCK).cast("int"))))
    own = turns.withColumn("block", F.floor(F.col("place") / _BLOCK).cast("int")).join(blocks, ["conv", "block"]).where("place >= h")
    tail = own.select("conv", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "bytes", "t1", "t2")
    return _with_roots(convs, head.unionByName(tail))


def _with_roots(convs: DataFrame, rows: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    root = convs.select("conv", *(zero.alias(c) for c in ("depth", "bytes", "t1", "t2")), F.col("length").alias("length"))
    # the row at the conversation's length is its end: roots carry the length along
    return root.unionByName(rows.withColumn("length", F.lit(None).cast("long")))


def prefix_trie(rows: DataFrame) -> DataFrame:
    """Nodes of the trie: conv, depth, parent, n_convs, n_children, n_leaves, saved (bytes that sharing saves), ends_sha256.

    rows: conv, depth, bytes, t1, t2 and length (at depth 0).
    """
    hashed = [F.when(F.col("depth") == 0, 0).otherwise(F.xxhash64(F.lit(salt), "depth", "t1", "t2")).alias(f"k{salt}") for salt in (1, 2)]
    rows = rows.select("conv", "depth", "bytes", "length", *hashed).withColumns({"x1": F.col("k1"), "x2": F.col("k2")})
    named = written(running(rows, ["conv"], [F.col("depth").asc()], {"k1": "xor", "k2": "xor", "length": "last"}), "prefixes")
    nodes = _nodes(named)
    light = ~F.col("heavy") & (F.col("depth") > 0)
    first = light | (F.col("depth") == 0)
    tree = _at_nodes(named, nodes).select(
        "conv", "depth", "node", "n_convs", "n_children", "bytes", (F.col("depth") == F.col("length")).alias("end"), light.cast("long").alias("level"),
        F.when(first, F.col("node")).alias("path_conv"), F.when(first, F.col("depth")).alias("path_depth"),
        F.when(first, F.col("node")).alias("up_conv"), F.when(first, F.col("depth")).alias("up_depth"), F.col("node").alias("parent"),
    )
    modes = {"level": "add", "path_conv": "last", "path_depth": "last", "up_conv": "before", "up_depth": "before", "parent": "before"}
    tree = written(running(tree, ["conv"], [F.col("depth").asc()], modes), "paths")
    own = tree.where("conv = node").drop("node", "end")
    own = own.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")}).drop("bytes")
    sums = _summed(own).select("conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved")
    ends = hashed_lists(tree.where("end").select("node", "depth", "conv")).withColumnRenamed("node", "conv")
    return sums.join(ends, ["conv", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def _nodes(named: DataFrame) -> DataFrame:
    """depth, k1, k2, node (smallest conversation), n_convs, n_children, heavy (the largest child of its parent)."""
    up = {"up1": F.col("k1").bitwiseXOR(F.col("x1")), "up2": F.col("k2").bitwiseXOR(F.col("x2"))}
    groups = named.withColumns(up).groupBy(*_NODE).agg(F.count("*").alias("n_convs"), F.min("conv").alias("node"), F.max("up1").alias("up1"), F.max("up2").alias("up2"))
    groups = written(groups, "trie-groups")
    largest = F.max(F.struct("n_convs", (-F.col("node")).alias("first"), "k1", "k2")).alias("largest")
    below = groups.where("depth > 0").select((F.col("depth") - 1).alias("at"), "up1", "up2", "n_convs", "node", "k1", "k2").groupBy("at", "up1", "up2")
    below = below.agg(F.count("*").alias("n_children"), largest)
    children = below.select(F.col("at").alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2"), "n_children")
    heavy = below.select((F.col("at") + 1).alias("depth"), "largest.k1", "largest.k2", F.lit(True).alias("heavy"))
    nodes = groups.drop("up1", "up2").join(children, _NODE, "left").join(heavy, _NODE, "left")
    return written(nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "heavy": F.coalesce("heavy", F.lit(False))}), "trie-nodes")


def _at_nodes(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each row with its node. Nodes of more than a thousandth of the rows, of which there are fewer than 1,000, are broadcast."""
    rows = nodes.agg(F.sum("n_convs")).first()[0] or 0
    hot = nodes.where(F.col("n_convs") * 1000 > rows)
    cold = named.join(F.broadcast(hot.select(*_NODE)), _NODE, "left_anti").join(nodes.where(F.col("n_convs") * 1000 <= rows), _NODE)
    return named.join(F.broadcast(hot), _NODE).unionByName(cold)


def _summed(own: DataFrame) -> DataFrame:
    """Suffix sums along paths, a round for each level from the last one up."""
    spark = own.sparkSession
    path = shared_dir(spark, "trie-levels")
    own.write.partitionBy("level").parquet(path)
    own = spark.read.schema(own.schema).parquet(path)
    last = own.agg(F.max("level")).first()[0]
    done, attached = None, None
    for level in range(last or 0, -1, -1):
        here = own.where(F.col("level") == level).drop("level").withColumn("is_node", F.lit(True))
        if attached is not None:
            here = here.unionByName(attached, allowMissingColumns=True)
        order = [F.col("depth").desc(), F.col("is_node").asc()]
        summed = running(here, ["path_conv", "path_depth"], order, {"n_leaves": "add", "saved": "add"}).where("is_node")
        done = summed if done is None else done.unionByName(summed)
        to = summed.where("depth = path_depth").groupBy(F.col("up_conv").alias("path_conv"), F.col("up_depth").alias("path_depth"), (F.col("depth") - 1).alias("depth"))
        attached = to.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")).withColumn("is_node", F.lit(False))
    return done


def hashed_lists(ends: DataFrame, most: int = 500) -> DataFrame:
    """node, depth, ends_sha256: of each node's conversations in ascending order, joined by commas.

    Sorted ranges make pieces of at most `most` conversations; a node's pieces stream through one hash.
    """
    pieces = ends.repartitionByRange("node", "depth", "conv").sortWithinPartitions("node", "depth", "conv")
    pieces = pieces.mapInArrow(_pieces(most), "node long, depth long, first long, piece string")
    return pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(_hashed, "node long, depth long, ends_sha256 string")


def _pieces(most: int):
    schema = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("piece", pa.string())])

    def run(batches):
        for rb in batches:
            out: list[list] = []
            for node, depth, conv in zip(*(rb.column(c).to_pylist() for c in ("node", "depth", "conv"))):
                if out and out[-1][:2] == [node, depth] and len(out[-1][3]) < most:
                    out[-1][3].append(str(conv))
                else:
                    out.append([node, depth, conv, [str(conv)]])
            yield batch(schema, [[r[0] for r in out], [r[1] for r in out], [r[2] for r in out], [",".join(r[3]) for r in out]])

    return run


def _hashed(batches):
    schema = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    at, digest = None, None
    for rb in batches:
        out = []
        for node, depth, piece in zip(*(rb.column(c).to_pylist() for c in ("node", "depth", "piece"))):
            if at == (node, depth):
                digest.update(b",")
            else:
                if at:
                    out.append((*at, digest.hexdigest()))
                at, digest = (node, depth), hashlib.sha256()
            digest.update(piece.encode())
        yield batch(schema, [list(c) for c in zip(*out)] if out else [[], [], []])
    if at:
        yield batch(schema, [[at[0]], [at[1]], [digest.hexdigest()]])


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are; columns as in `prefix_trie`."""
    return prefix_trie(whole(numbered(conversations)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie(rebuilt(numbered(table(spark, sf_dir, "conversations"))))
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"
    )


ORACLE_SQL = r"""
WITH t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, x) - 1 AS p, r, x
           FROM (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT c, c - c % 5 AS b, xor(list_reduce([4294967295] || flatten(list_transform(string_split(c::VARCHAR, ''), lambda y: [ascii(y)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
             lambda y, z: CASE WHEN z >= 0 THEN xor(y, z) ELSE xor(y // 2, 3988292384 * (y % 2)) END), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM t)),
b AS (SELECT c.c, 0 AS part, t.p, r, x FROM c JOIN t ON t.c = c.b AND t.p < c.h UNION ALL SELECT c.c, 1, t.p, r, x FROM c JOIN t ON t.c = c.c AND t.p >= c.h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, r, x FROM b),
q AS (SELECT c, d, x, md5(string_agg(md5(r) || md5(x), '') OVER (PARTITION BY c ORDER BY d)) AS k FROM s UNION ALL SELECT c, 0, '', '' FROM c),
n AS (SELECT d, k, min(c) AS conv, count(*) AS n_convs, octet_length(encode(any_value(x))) AS bytes FROM q GROUP BY d, k),
m AS (SELECT q.c, q.d, n.conv, n.n_convs, n.bytes FROM q JOIN n ON q.d = n.d AND q.k = n.k),
o AS (SELECT * FROM m WHERE c = conv),
e AS (SELECT o.*, u.conv AS parent FROM o LEFT JOIN m u ON u.c = o.conv AND u.d = o.d - 1),
f AS (SELECT parent AS conv, d - 1 AS d, count(*) AS n_children FROM e WHERE d > 0 GROUP BY 1, 2),
g AS (SELECT e.*, coalesce(n_children, 0) AS n_children FROM e LEFT JOIN f ON e.conv = f.conv AND e.d = f.d),
a AS (SELECT m.conv, m.d, count(*) FILTER (WHERE g.n_children = 0) AS n_leaves, sum((g.n_convs - 1) * g.bytes) AS saved FROM g JOIN m ON m.c = g.conv AND m.d <= g.d GROUP BY 1, 2),
l AS (SELECT conv, d, string_agg(c::VARCHAR, ',' ORDER BY c) AS ends FROM (SELECT *, max(d) OVER (PARTITION BY c) AS top FROM m) WHERE d = top GROUP BY 1, 2)
SELECT g.conv AS conv_id, g.d AS depth, parent AS parent_conv_id, g.n_convs, g.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM g JOIN a ON g.conv = a.conv AND g.d = a.d LEFT JOIN l ON g.conv = l.conv AND g.d = l.d
"""
