"""What a collection of genomes is worth as a reference, before an index is built from it.

A genome whose minimizers are exactly those of another adds nothing to an index, and one with few minimizers of its own
can't be told from its neighbours. The job reads a table of genomes, one a row, and writes

- catalog, partitioned by source: a genome's bases and minimizers, how many of these no other genome has (n_own), the
  smallest id among the genomes with the same set (representative) and how many these are (n_copies);
- sources: the same of each source: bases, different minimizers, those that no other source has, genomes.

Defined cases: rows without an id are left out (and logged); rows that share an id are one genome, of the smallest source,
with all their minimizers and bases; a genome without minimizers represents itself and has no copies. A run replaces
what an earlier one wrote, so it can be repeated.

    python -m jobs.reference_catalog --input genomes.parquet --output catalog
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from helixmill.functions.hashing import murmur2_array
from helixmill.functions.lineage import scratch
from helixmill.operators.minimizers import minimizer_sets
from helixmill.operators.unions import pack, unpack
from jobs.common import arguments, log, said, sequences, settings_of

CATALOG = "genome_id long, n_bases long, n_minimizers long, n_own long, representative long, n_copies long, source string"
SOURCES = "source string, n_bases long, n_minimizers long, n_own long, n_genomes long"


#: Parts of all minimizers (a power of two); minimizers and genomes that a task packs together; counts that it adds up together.
PARTS, HELD, MEMBERS, COUNTED = 256, 1 << 22, 1 << 12, 1 << 22


def digested(sets: DataFrame) -> DataFrame:
    """sets (.., mz: ascending) with their sizes and a digest of 128 bits."""
    schema = T.StructType([*sets.schema, T.StructField("n_minimizers", T.LongType()), T.StructField("same", T.BinaryType())])

    def run(batches):
        for batch in batches:
            mz = batch.column("mz")
            flat, edge = mz.values.to_numpy(zero_copy_only=False), mz.offsets.to_numpy()
            same = [hashlib.blake2b(flat[x:y].tobytes(), digest_size=16).digest() for x, y in zip(edge.tolist(), edge[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(edge).astype(np.int64)), pa.array(same, pa.binary())], names=schema.names)

    return sets.mapInArrow(run, schema)


def in_parts(sets: DataFrame, parts: int = PARTS, most: int = HELD, members: int = MEMBERS) -> DataFrame:
    """Packed minimizers of sets (row, source, mz): the part, the first of some rows that follow each other, who of them holds each, their sources."""
    schema = T._parse_datatype_string("part int, base long, data binary, owner binary, sources array<string>, source_of binary")

    def packed(base, sources, held):
        values, owner = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint16), [len(x) for x in held])
        part = (murmur2_array(values, 0) & np.uint32(parts - 1)).astype(np.int32)
        order = np.argsort(values)
        order = order[np.argsort(part[order], kind="stable")]
        values, owner, part = values[order], owner[order], part[order]
        known, of = np.unique(np.array(sources, object), return_inverse=True)
        listed, of = known.tolist(), of.ravel().astype(np.uint16).tobytes()
        edge = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part)).tolist()
        rows = [(int(part[x]), base, pack(values[x:y]), owner[x:y].tobytes(), listed, of) for x, y in zip(edge, edge[1:])]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema.names)

    def run(batches):
        base, sources, held, n = 0, [], [], 0
        for batch in batches:
            mz = batch.column("mz")
            flat, edge = mz.values.to_numpy(zero_copy_only=False), mz.offsets.to_numpy()
            for i, (row, source) in enumerate(zip(batch.column("row").to_pylist(), batch.column("source").to_pylist())):
                if held and (row != base + len(held) or n >= most or len(held) == members):
                    if n:
                        yield packed(base, sources, held)
                    sources, held, n = [], [], 0
                base = base if held else row
                sources.append(source)
                held.append(flat[edge[i] : edge[i + 1]].copy())
                n += len(held[-1])
        if n:
            yield packed(base, sources, held)

    return sets.select("row", "source", "mz").mapInArrow(run, schema)


def held_by(packed: DataFrame, counted: int = COUNTED) -> DataFrame:
    """(row, source, n_minimizers, n_own), to be added up: of a row the minimizers that it alone has, of a source (row null) its different ones and those that no other has. A part is one task's."""
    schema = T._parse_datatype_string("row long, source string, n_minimizers long, n_own long")

    def run(batches):
        names: dict[str, int] = {}
        at_source = np.zeros((2, 0), np.int64)
        before, held, rows, n = None, [], [], 0

        def settle():
            """The rows that have minimizers of their own in a part; adds to the sources' counts."""
            nonlocal at_source
            values, row, source = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(values)
            values, row, source = values[order], row[order], source[order]
            start = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
            size = np.diff(start, append=len(values))
            once = start[size == 1]
            several = np.repeat(size > 1, size)
            pair = np.unique(np.repeat(np.arange(len(start)), size)[several] * len(names) + source[several])
            of, value = pair % len(names), pair // len(names)
            new = np.append(True, value[1:] != value[:-1])[: len(value)]
            lone = new & np.append(new[1:], True)[: len(value)]
            count = lambda x: np.bincount(x, minlength=len(names))
            at_source = np.pad(at_source, ((0, 0), (0, len(names) - at_source.shape[1])))
            at_source += [count(source[once]) + count(of), count(source[once]) + count(of[lone])]
            return row[once]

        def made(row, source, n_minimizers, n_own):
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(source, pa.string()), pa.array(n_minimizers, pa.int64()), pa.array(n_own, pa.int64())], names=schema.names)

        def of_rows():
            row, own = np.unique(np.concatenate(rows), return_counts=True)
            return made(row, [None] * len(row), [None] * len(row), own)

        for batch in batches:
            for i, part in enumerate(batch.column("part").to_pylist()):
                if part != before and held:
                    rows.append(settle())
                    n, held = n + len(rows[-1]), []
                    if n >= counted:
                        yield of_rows()
                        rows, n = [], 0
                before = part
                data, owner, of = (batch.column(c)[i].as_buffer() for c in ("data", "owner", "source_of"))
                known = np.array([names.setdefault(x, len(names)) for x in batch.column("sources")[i].as_py()], np.int64)
                owner = np.frombuffer(owner, np.uint16).astype(np.int64)
                held.append((unpack(data), batch.column("base")[i].as_py() + owner, known[np.frombuffer(of, np.uint16)][owner]))
        if held:
            rows.append(settle())
            yield of_rows()
            yield made([None] * len(names), list(names), *at_source)

    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def catalog_of(genomes: DataFrame, k: int, keep) -> tuple[DataFrame, DataFrame]:
    """(catalog, sources) of genomes (genome_id, source, seq).

    Minimizers are shuffled once, packed; a part of them tells who holds each, and gives no more than counts.
    """
    numbered = lambda df: keep(df.withColumn("row", F.monotonically_increasing_id()))
    sets = minimizer_sets(genomes.withColumn("n_bases", F.length("seq").cast("long")), ["genome_id", "source", "n_bases"], "seq", k)
    listed = numbered(digested(sets))
    repeated = listed.groupBy("genome_id").agg(F.count("*").alias("rows")).where("rows > 1").select("genome_id")
    if not repeated.isEmpty():
        union = F.array_sort(F.array_distinct(F.flatten(F.collect_list("mz"))))
        whole = listed.join(repeated, "genome_id", "left_semi").groupBy("genome_id").agg(F.min("source").alias("source"), F.sum("n_bases").alias("n_bases"), union.alias("mz"))
        listed = numbered(listed.drop("row").join(repeated, "genome_id", "left_anti").unionByName(digested(whole)))
    counts = held_by(in_parts(listed))
    counts = keep(counts.groupBy("row", "source").agg(F.sum("n_minimizers").alias("n_minimizers"), F.sum("n_own").alias("n_own")))
    groups = listed.where("n_minimizers > 0").groupBy("n_minimizers", "same").agg(F.min("genome_id").alias("representative"), F.count("*").alias("n_copies"))
    zero = F.lit(0).cast("long")
    catalog = listed.drop("mz").join(groups, ["n_minimizers", "same"], "left").join(counts.where("row is not null").select("row", "n_own"), "row", "left")
    catalog = catalog.select("genome_id", "n_bases", "n_minimizers", F.coalesce("n_own", zero).alias("n_own"), F.coalesce("representative", "genome_id").alias("representative"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"), "source")
    sources = listed.groupBy("source").agg(F.sum("n_bases").alias("n_bases"), F.count("*").alias("n_genomes")).join(counts.where("row is null").select("source", "n_minimizers", "n_own"), "source", "left")
    return catalog, sources.select("source", "n_bases", F.coalesce("n_minimizers", zero).alias("n_minimizers"), F.coalesce("n_own", zero).alias("n_own"), "n_genomes")


def run(spark: SparkSession, input: str, output: str, settings: dict | None = None) -> dict[str, int]:
    """Writes output/catalog and output/sources from the table at input; returns the rows read and written."""
    settings = settings or settings_of("reference_catalog")
    table = sequences(spark.read.parquet(input), settings)
    rows = {r["known"]: r["n"] for r in table.groupBy(F.col("genome_id").isNotNull().alias("known")).agg(F.count("*").alias("n")).collect()}
    said("read", input, sum(rows.values()))
    if rows.get(False):
        log.info("left out %d rows without an id", rows[False])
    with scratch(spark) as keep:
        catalog, sources = catalog_of(table.where("genome_id is not null"), settings["k"], keep)
        # by ranges, so that a source of any size is as many files as it needs
        catalog.repartitionByRange("source", "genome_id").write.mode("overwrite").partitionBy("source").parquet(f"{output}/catalog")
        sources.coalesce(1).write.mode("overwrite").parquet(f"{output}/sources")
    written = {"read": sum(rows.values()), "catalog": spark.read.schema(CATALOG).parquet(f"{output}/catalog").count(), "sources": spark.read.schema(SOURCES).parquet(f"{output}/sources").count()}
    for name in ("catalog", "sources"):
        said("wrote", f"{output}/{name}", written[name])
    return written


def output_of(spark: SparkSession, output: str) -> DataFrame:
    """Both tables as rows of one: of a genome, and (genome_id null) of a source, whose n_copies are its genomes."""
    genomes = spark.read.schema(CATALOG).parquet(f"{output}/catalog").select("source", "genome_id", "n_bases", "n_minimizers", "n_own", "representative", "n_copies")
    none = F.lit(None).cast("long")
    sources = spark.read.schema(SOURCES).parquet(f"{output}/sources").select("source", none.alias("genome_id"), "n_bases", "n_minimizers", "n_own", none.alias("representative"), F.col("n_genomes").alias("n_copies"))
    return genomes.unionByName(sources)


def main() -> None:
    paths, settings = arguments("reference_catalog", __doc__.partition("\n")[0], {"input": "Parquet table of genomes", "output": "folder for catalog and sources"})
    spark = SparkSession.builder.appName("reference_catalog").getOrCreate()
    try:
        run(spark, **paths, settings=settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
