"""Rules that a table's rows obey: evidence signatures, minimal covers, entropy trees.

A row's evidence is the set of predicates that hold in it. Rules depend only on the different
evidence sets and their counts, so one pass reduces the table to weighted signatures, from which supports, covers and
trees are counted.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.operators import covers
from veritab.operators.predicates import Predicate
from veritab.sources.staging import staged


#: predicates in one number of a grouping key
_BITS = 62
#: predicates beyond which one generated method for all of them is too long for the JVM to compile
_MANY = 30


def _set_bits(key: str, start: int, bits: int) -> Column:
    """start plus each place of a key's set bits, ascending."""
    return F.filter(F.sequence(F.lit(start), F.lit(start + bits - 1)), lambda j: F.getbit(key, j - start) == 1)


def signatures(df: DataFrame, predicates: Sequence[Predicate], keep_empty: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """sig (ascending predicate numbers), w (rows with exactly those); for each value of the columns in `by`.

    Rows are grouped by whole numbers with a bit for each predicate that holds, which partial aggregation keeps in a hash table; only
    the groups are turned to arrays.
    """
    held = [F.when(p.column, F.lit(1 << i % _BITS)).otherwise(F.lit(0)).cast("long") for i, p in enumerate(predicates)]
    keys = {f"_bits{k}": reduce(Column.bitwiseOR, held[i : i + _BITS]) for k, i in enumerate(range(0, len(held), _BITS))}
    # copies of the keys: what is asked of the groups isn't then pushed down to the rows
    copies = [F.max(k).alias(f"{k}_of_group") for k in keys]
    apart = {}
    if len(held) > _MANY:
        # always 0: Spark generates split methods for a projection with a function of higher order, four times as fast here
        apart = {"_apart": F.size(F.filter(F.array(F.isnull(df.columns[0])), lambda _: F.lit(False)))}
    groups = df.select(*by, *(c.alias(n) for n, c in (keys | apart).items())).groupBy(*by, *keys, *apart).agg(F.count("*").alias("w"), *copies)
    keys = [f"{k}_of_group" for k in keys]
    if not keep_empty:
        groups = groups.where(reduce(Column.__or__, [F.col(k) != 0 for k in keys], F.lit(False)))
    arrays = [_set_bits(k, i, min(_BITS, len(held) - i)) for k, i in zip(keys, range(0, len(held), _BITS))]
    return groups.select(*by, (F.concat(*arrays) if arrays else F.array().cast("array<int>")).alias("sig"), "w")


def file_signatures(spark: SparkSession, path: str, predicates: Sequence[Predicate], folder: str, kind: str = "parquet") -> DataFrame:
    """sig, w of the rows of all files under a path, with evidence; the evidence of each file is kept in a folder, and only new or changed files are read.

    What is kept is named by the predicates' texts; a file by its name, length and time of change. A run writes its signatures first and then the files that they
    are of, so signatures of a run that broke off don't count. Evidence of files that are gone doesn't count either.
    """
    texts = json.dumps([p.text for p in predicates])
    base = f"{folder.rstrip('/')}/evidence-{hashlib.sha256(texts.encode()).hexdigest()[:32]}"
    name = F.sha2(F.to_json(F.struct("path", "length", "modificationTime")), 256).alias("file")
    files = staged(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", name))
    done = _kept(spark, f"{base}/files", "file string, run string")
    new = files.join(done, "file", "left_anti")
    paths = [r.path for r in new.select("path").collect()]  # names of files, as any listing has them
    if paths:
        run = uuid.uuid4().hex
        rows = spark.read.format(kind).load(paths).withColumn("_path", F.col("_metadata.file_path"))
        found = signatures(rows, predicates, by=["_path"]).join(new.withColumnRenamed("path", "_path"), "_path").select("file", "sig", "w")
        found.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{base}/signatures")
        new.select("file").withColumn("run", F.lit(run)).write.mode("append").parquet(f"{base}/files")
        done = _kept(spark, f"{base}/files", "file string, run string")
    kept = _kept(spark, f"{base}/signatures", "file string, sig array<int>, w long, run string")
    # a file that two runs took at once counts once
    chosen = done.join(files.select("file").distinct(), "file", "left_semi").groupBy("file").agg(F.min("run").alias("run"))
    return kept.join(chosen, ["file", "run"], "left_semi").groupBy("sig").agg(F.sum("w").alias("w"))


def _kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def supports(sigs: DataFrame, predicates: Sequence[Predicate], rows: int) -> DataFrame:
    """predicate, text, support: share of the rows in which it holds. sigs may lack the rows with none."""
    names = F.array(*(F.lit(p.text) for p in predicates))
    held = sigs.select(F.explode("sig").alias("predicate"), "w").groupBy("predicate").agg(F.sum("w").alias("held"))
    every = sigs.sparkSession.range(len(predicates)).select(F.col("id").cast("int").alias("predicate"))
    joined = every.join(held, "predicate", "left")
    return joined.select("predicate", F.element_at(names, F.col("predicate") + 1).alias("text"), (F.coalesce("held", F.lit(0)) / F.lit(max(rows, 1))).alias("support"))


def minimal_covers(sigs: DataFrame, most_literals: int, most_signatures: int = 20_000, most_rules: int | None = None, first: int | None = None) -> DataFrame:
    """clause: minimal sets of predicates of which every signature holds at least one (so their disjunction holds on every row).

    Subtrees of the search are dealt to tasks with packed bitmaps of the signatures, at most `most_signatures`; more are an error.
    first: only so many clauses, the first in the search's order, whatever the number of tasks. most_rules ends the search after the first
    clause size with which that many are found (whole sizes: none of a size is left out).
    """
    if most_rules is None:
        return covers.covers(sigs, most_literals, most_signatures, first)
    sigs = staged(sigs.select("sig"))
    for size in range(most_literals + 1):
        found = covers.covers(sigs, size, most_signatures)
        if size == most_literals or found.count() >= most_rules:
            return found


def clause_support(clauses: DataFrame, sigs: DataFrame, rows: int) -> DataFrame:
    """clause, support: the share of all rows on which it holds. sigs may lack the rows with none."""
    held = sigs.select("sig", "w", F.explode("sig").alias("p"))
    met = clauses.select("clause", F.explode("clause").alias("p")).join(held, "p").select("clause", "sig", "w").distinct()
    found = met.groupBy("clause").agg(F.sum("w").alias("held"))
    return clauses.join(found, "clause", "left").select("clause", (F.coalesce("held", F.lit(0)) / F.lit(max(rows, 1))).alias("support"))


def clause_text(clauses: DataFrame, predicates: Sequence[Predicate]) -> DataFrame:
    names = F.array(*(F.lit(p.text) for p in predicates))
    return clauses.withColumn("rule", F.array_join(F.transform("clause", lambda i: F.element_at(names, i + 1)), " or "))


def without_tautologies(clauses: DataFrame, predicates: Sequence[Predicate]) -> DataFrame:
    """Without clauses that hold on any row: two literals compare the same sides with opposite operators."""
    opposite = {"=": "!=", "!=": "=", ">": "<=", "<=": ">", "<": ">=", ">=": "<"}
    at = {p.parts: i for i, p in enumerate(predicates) if p.parts}
    pairs = [(i, j) for (a, op, b), i in at.items() if (j := at.get((a, opposite[op], b))) is not None and i < j]
    for i, j in pairs:
        clauses = clauses.where(~(F.array_contains("clause", i) & F.array_contains("clause", j)))
    return clauses


def entropy_trees(sigs: DataFrame, targets: Sequence[int], depth: int = 3, exclude: dict[int, Sequence[int]] | None = None) -> DataFrame:
    """Leaves of a tree for each target, which tells whether that predicate holds: target, path (literals, p or -p-1 for not p), w, share.

    All nodes of a level of all trees are split in one pass: counts by target, node and predicate, and the split with the least entropy. A node that is
    pure, at full depth or without a split that gains stays a leaf. A tree doesn't split by its target nor by what `exclude` names for it. The splits of a
    level, at most 2 ** depth for each target, are broadcast to the signatures.
    """

    def entropy(n, k):
        p = k / n
        one = lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(0.0)
        return n * (one(p) + one(1 - p))

    tree, sigs = ["target", "path"], staged(sigs)
    each = F.array(*(F.struct(F.lit(t).alias("target"), F.array(*map(F.lit, [t, *(exclude or {}).get(t, ())])).alias("skip")) for t in targets))
    rows = sigs.select("sig", "w", F.explode(each).alias("t")).select("sig", "w", "t.target", "t.skip", F.array_contains("sig", F.col("t.target")).cast("long").alias("y"))
    rows = rows.withColumn("path", F.array().cast("array<int>"))
    leaves = None
    for level in range(depth + 1):
        nodes = rows.groupBy(*tree).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("k"))
        if level == depth:
            splits = nodes.withColumn("p", F.lit(None).cast("int"))
        else:
            nodes = staged(nodes)
            counts = rows.select(*tree, "w", "y", F.explode(F.array_except("sig", "skip")).alias("p")).groupBy(*tree, "p").agg(F.sum("w").alias("n1"), F.sum(F.col("w") * F.col("y")).alias("k1"))
            both = counts.join(nodes, tree).where("n1 < n and k > 0 and k < n")
            after = entropy(F.col("n1"), F.col("k1")) + entropy(F.col("n") - F.col("n1"), F.col("k") - F.col("k1"))
            gains = both.withColumn("after", F.round(after, 9)).where(F.col("after") < entropy(F.col("n"), F.col("k")) - 1e-9)
            best = gains.groupBy(*tree).agg(F.min(F.struct("after", "p"))["p"].alias("p"))
            splits = staged(nodes.join(best, tree, "left"))
        kept = splits.where("p is null").select(*tree, F.col("n").alias("w"), F.round(F.col("k") / F.col("n"), 6).alias("share"))
        leaves = kept if leaves is None else leaves.unionByName(kept)
        side = F.when(F.array_contains("sig", F.col("p")), F.col("p")).otherwise(-F.col("p") - 1)
        rows = rows.join(F.broadcast(splits.where("p is not null").select(*tree, "p")), tree)
        rows = rows.select("sig", "w", "target", "skip", "y", F.concat("path", F.array(side)).alias("path"))
    return leaves


def entropy_tree(sigs: DataFrame, target: int, depth: int = 3, exclude: Sequence[int] = ()) -> DataFrame:
    """The tree of one target: path, w, share."""
    return entropy_trees(sigs, [target], depth, {target: exclude}).drop("target")


def tree_rules(leaves: DataFrame, target: int) -> DataFrame:
    """Pure leaves as implications: path -> target (or not target)."""
    return leaves.where("share = 0 or share = 1").select("path", F.when(F.col("share") == 1, F.lit(target)).otherwise(F.lit(-target - 1)).alias("implies"), "w")
