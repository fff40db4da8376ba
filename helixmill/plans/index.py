"""The index: genomes, their minimizers, a tree of branches, and a Bloom filter for each branch, as Parquet tables.

build_index writes the tables and, last of all, the metadata, so an unfinished index isn't taken for a whole one.
"""

from __future__ import annotations

import json
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from helixmill.functions.lineage import cut
from helixmill.functions.parameters import DEFAULT_FPP, MAX_SHARDS, MIN_GENOMES, kmer_parameters, sample_size, shard_capacity
from helixmill.operators import bloom
from helixmill.operators.clustering import SEED, Similarities, Tree, build_tree, mean_std, tree_frame, union_cardinalities, within_capacity
from helixmill.operators.minimizers import minimizers
from helixmill.operators.similarity import cardinalities, sample_pairs, signature_jaccard, signatures

#: What an index must have been built with (fixed values of this format).
FORMAT = {"format": "2", "minimizer": "canonical-2bit", "window": "step-adjacent-mmers", "bloom": "prime-bits-segments", "bloom_hash": "murmur2-32-seeds-0-1", "probe": "double-hash-zero-step-to-one"}
SKETCH = 1024
#: Minimizers that one genome of an index holds; a larger set is divided, and each part is a genome under the same name.
MOST_MINIMIZERS = 2_147_483_647 - 64_424_509


def coerced_fpp(fpp: float) -> float:
    return fpp if 0 < fpp < 1 else DEFAULT_FPP


class Sketches:
    """Threshold samples of the genomes' sets and their MinHash signatures at the driver: about `size` hashes and some bytes of each, so memory follows the genomes' number only."""

    def __init__(self, mz: DataFrame, sizes: DataFrame, size: int = SKETCH):
        t = sizes.select("genome_id", "n_minimizers").toArrow()
        self.n = dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist()))
        # the JVM's hash chooses who is sent; genomes of up to `size` minimizers are sent whole
        share = F.least(F.lit(1.0), F.lit(float(size)) / F.col("n_minimizers"))
        small = (F.shiftrightunsigned(F.xxhash64("mz"), 1) / float(1 << 63)) < share
        self.rows = cut(mz.join(sizes.select("genome_id", "n_minimizers"), "genome_id").where(small).groupBy("genome_id", "n_minimizers").agg(F.array_sort(F.collect_list("mz")).alias("mz")))
        t = self.rows.select("genome_id", "mz").toArrow()
        lists = t.column("mz").combine_chunks() if len(t) else None
        self.share = {g: min(1.0, size / n) for g, n in self.n.items()}
        self.held = {g: lists[i].values.to_numpy(zero_copy_only=False) for i, g in enumerate(t.column("genome_id").to_pylist())}
        t = signatures(mz).toArrow()
        self.signature = {g: np.frombuffer(x, np.uint8) for g, x in zip(t.column("genome_id").to_pylist(), t.column("signature").to_pylist())}
        self.size = size

    def score(self, a: int, b: int) -> float:
        x, y = (self.held.get(i, np.zeros(0, np.int64)) for i in (a, b))
        met = len(np.intersect1d(x, y, assume_unique=True)) / min(self.share.get(a, 1.0), self.share.get(b, 1.0))
        return scored(met, self.n.get(a, 0), self.n.get(b, 0))

    def weak(self, a: int, b: int) -> float:
        """The second sketch's similarity, for pairs whose samples share nothing."""
        x, y = self.signature.get(a), self.signature.get(b)
        if x is None or y is None:
            return 0.0
        return signature_jaccard(float((x == y).mean()))

    def scores(self, pairs: DataFrame) -> dict[tuple[int, int], float]:
        """The scores of many pairs (a, b), found by the executors from the samples."""
        one = self.rows.select(F.col("genome_id").alias("a"), F.col("n_minimizers").alias("na"), F.col("mz").alias("x"))
        other = self.rows.select(F.col("genome_id").alias("b"), F.col("n_minimizers").alias("nb"), F.col("mz").alias("y"))
        met = pairs.join(one, "a").join(other, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("met"))
        t = met.toArrow()  # three numbers a pair; their number is that of the sample
        out = {}
        for a, b, n in zip(*(t.column(c).to_pylist() for c in ("a", "b", "met"))):
            out[a, b] = scored(n / min(self.share[a], self.share[b]), self.n[a], self.n[b])
        return out


def scored(met: float, a: int, b: int) -> float:
    if met <= 0:
        return 0.0
    cosine = min(1.0, met / np.sqrt(float(a) * b))
    return float(1 / (1 - np.log(cosine)))


def divided(mz: DataFrame, genomes: DataFrame, most: int = MOST_MINIMIZERS) -> tuple[DataFrame, DataFrame]:
    """mz (genome_id, mz) and genomes (genome_id, name), with sets above `most` divided evenly by hash under new ids after the known ones."""
    large = cardinalities(mz).where(F.col("n_minimizers") > most).select("genome_id", F.ceil(F.col("n_minimizers") * 1.02 / most).cast("int").alias("parts")).collect()
    if not large:
        return mz, genomes
    spark, first = mz.sparkSession, genomes.agg(F.max("genome_id")).first()[0] + 1
    rows = []
    for r in sorted(large):
        for part in range(r["parts"]):
            rows.append((r["genome_id"], part, r["parts"], r["genome_id"] if part == 0 else first))
            first += part > 0
    parts = F.broadcast(spark.createDataFrame(rows, "genome_id int, part int, parts int, new int"))  # a few rows for each divided genome
    which = F.pmod(F.xxhash64("mz"), F.col("parts"))
    new_mz = mz.join(parts.where("part = 0").select("genome_id", "parts"), "genome_id", "left").withColumn("part", F.coalesce(which, F.lit(0)).cast("int"))
    renamed = new_mz.join(parts.select("genome_id", "part", "new"), ["genome_id", "part"], "left").select(F.coalesce("new", "genome_id").alias("genome_id"), "mz")
    more = genomes.join(parts.where("part > 0"), "genome_id").select(F.col("new").alias("genome_id"), "name")
    return renamed, genomes.select("genome_id", "name").unionByName(more)


def _write(df: DataFrame, path: str, name: str) -> DataFrame:
    df.write.mode("errorifexists").parquet(f"{path}/{name}")
    return df.sparkSession.read.parquet(f"{path}/{name}")


class Phases:
    """Seconds of each phase of a build."""

    def __init__(self):
        self.seconds: dict[str, float] = {}
        self.began = time.monotonic()

    def done(self, name: str) -> None:
        now = time.monotonic()
        self.seconds[name] = round(now - self.began, 3)
        self.began = now


def levels_of(spark: SparkSession, tree: Tree) -> DataFrame:
    """(filter_id, level): how far below the root a branch is."""
    level = {0: 0}
    rows = []
    for node, _, filter_id, child, _ in tree.branches:  # a node's branches stand before those below it
        rows.append((filter_id, level[node]))
        if child is not None:
            level[child] = level[node] + 1
    return spark.createDataFrame(rows, "filter_id int, level int")


def build_index(spark: SparkSession, genomes: DataFrame, path: str, k: int = 29, fpp: float = DEFAULT_FPP, seed: int = SEED, max_set: int = MOST_MINIMIZERS, max_filter: int | None = None, sets: DataFrame | None = None) -> dict:
    """Builds an index of genomes (genome_id, name, seq) at path, which must not hold one; returns the metadata, with the seconds of each phase.

    sets: the genomes' distinct minimizers (genome_id, mz) for k, where they are made already, as from files in ranges; no seq is needed then.
    Genomes are told apart by genome_id, which must not repeat. A cluster whose sets have more minimizers together than a
    filter takes (max_filter) is divided into sibling branches.
    """
    k, step, m = kmer_parameters(k)
    fpp = coerced_fpp(fpp)
    if twice := genomes.groupBy("genome_id").agg(F.count("*").alias("n")).where("n > 1").head():
        raise ValueError(f"genome {twice['genome_id']} is there {twice['n']} times")
    phases = Phases()
    written = _write(minimizers(genomes, "genome_id", "seq", k) if sets is None else sets.select("genome_id", "mz"), path, "genome_minimizers")
    mz, genomes = divided(written, genomes, max_set)
    if mz is not written:
        mz = _write(mz, path, "divided_minimizers")
    sizes = cardinalities(mz)
    listed = _write(genomes.join(sizes, "genome_id").select("genome_id", "name", "n_minimizers"), path, "genomes")
    ids = [r[0] for r in listed.select("genome_id").orderBy("genome_id").collect()]
    if len(ids) < MIN_GENOMES:
        raise ValueError(f"an index needs {MIN_GENOMES} genomes with minimizers at least, not {len(ids)}")
    phases.done("minimizers")
    sketches = Sketches(mz, listed)
    phases.done("sketches")
    number = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("at", T.LongType()), listed.schema["genome_id"]]))
    drawn = sample_pairs(spark, len(ids), sample_size(len(ids)), seed)
    for side in ("a", "b"):
        drawn = drawn.join(number.select(F.col("at").alias(side), F.col("genome_id").alias("__" + side)), side)
    known = sketches.scores(drawn.select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")))
    similar = Similarities(sketches.score, known, sketches.weak)
    phases.done("similarities")
    overall = mean_std([s for s in similar.known.values() if s > 0], len(ids))
    most = max_filter or MAX_SHARDS * shard_capacity(fpp)
    tree = build_tree(ids, similar, overall, seed, sketches.weak, within_capacity(sketches.n, most))
    branches = _write(tree_frame(spark, tree), path, "tree")
    phases.done("tree")
    members = branches.select("filter_id", F.explode("members").alias("genome_id"))
    capacities = union_cardinalities(members, mz, ["filter_id"])
    filters = _write(bloom.filter_table(spark, capacities, fpp), path, "filters")
    phases.done("capacities")
    inserted = members.join(mz, "genome_id").select("filter_id", "mz").distinct()
    segments = bloom.insert_segments(inserted, filters).join(levels_of(spark, tree), "filter_id")
    # a level's filters in a folder, by number: a descent reads what its level asks, by the folder and the files' statistics
    segments.repartitionByRange("level", "filter_id", "shard", "segment").sortWithinPartitions("level", "filter_id", "shard", "segment").write.mode("errorifexists").option("parquet.block.size", 16 << 20).partitionBy("level").parquet(f"{path}/filter_segments")
    stats = bloom.statistics(filters, spark.read.parquet(f"{path}/filter_segments").select("filter_id", "shard", "set_bits"))
    _write(bloom.effective_sizes(stats, members.groupBy("filter_id").agg(F.count("*").alias("n_members"))), path, "filter_sizes")
    phases.done("filters")
    metadata = FORMAT | {"k": k, "step": step, "m": m, "fpp": fpp, "seed": seed, "genomes": len(ids), "nodes": tree.nodes, "filters": len(tree.branches), "tree": tree.text() if len(ids) <= 10_000 else None, "seconds": phases.seconds, "complete": True}
    spark.createDataFrame([(json.dumps(metadata),)], "metadata string").coalesce(1).write.mode("errorifexists").text(f"{path}/metadata")
    return metadata


def open_index(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """Metadata and tables, or a ValueError if the index isn't complete or of another kind."""
    try:
        metadata = json.loads("".join(r[0] for r in spark.read.text(f"{path}/metadata").collect()))
    except Exception as e:  # noqa: BLE001  Spark has a class of its own for each way of not finding a path
        raise ValueError(f"no complete index at {path}") from e
    if metadata.get("complete") is not True:
        raise ValueError(f"the index at {path} isn't complete")
    for key, value in FORMAT.items():
        if metadata.get(key) != value:
            raise ValueError(f"the index at {path} has {key} {metadata.get(key)!r}, not {value!r}")
    if not (isinstance(metadata.get("k"), int) and isinstance(metadata.get("step"), int) and 0 < metadata["step"] < metadata["k"]):
        raise ValueError(f"the index at {path} has no valid k and step")
    return metadata, {t: spark.read.parquet(f"{path}/{t}") for t in ("genomes", "tree", "filters", "filter_segments", "filter_sizes")}
