"""FASTA as DataFrames of genomes: one per record, or one per file with its contigs joined.

Lines come from Spark's text reader (which also reads gzip), so any store that Spark reads will do. A file of up to
WHOLE_BYTES is one row and split in its own task; of a larger one lines are rows from the start, read by many tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from helixmill.functions.lineage import cut
from helixmill.functions.parameters import kmer_parameters
from helixmill.functions.sequences import clean_sequence, genome_name

#: Endings of genome files, and marks of files that hold something else (fixed values).
ENDINGS = (".fna", ".fa", ".fasta", ".fas")
NOT_GENOMES = ("_cds_from_genomic", "_rna_from_genomic", "_protein", "translated_cds", ".faa")


def is_genome_file(path: Column) -> Column:
    """By its lower-cased name: an ending of a genome file, gzipped or not, and no mark of another kind."""
    name = F.lower(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1))
    ending = name.rlike(r"\.(?:" + "|".join(e[1:] for e in ENDINGS) + r")(?:\.gz)?$")
    other = F.lit(False)
    for mark in NOT_GENOMES:
        other = other | F.contains(name, F.lit(mark))
    return ending & ~other


def _joined(parts: str, order: str, text: str) -> Column:
    """The texts of an array of structs that begin with their order, joined in it.

    The order is read again after sorting: a field that nothing reads is pruned, also from below the sort.
    """
    return F.array_join(F.transform(F.array_sort(parts), lambda x: F.when(x[order].isNotNull(), x[text])), "")


def records_of(lines: DataFrame, ranged: bool = False) -> DataFrame:
    """(path, record, header, seq) of a line table (path, line_no, line); text before a path's first header is skipped.

    Headers are counted up within a path in one task, or, if ranged, within ranges of its lines, to which the counts of the
    ranges before are added: so that a file of any size is many tasks' work, for a copy of the lines on disk.
    """
    header = F.col("line").startswith(">")
    upto = lambda *keys: Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    if ranged:
        placed = cut(lines.repartitionByRange("path", "line_no").withColumn("__part", F.spark_partition_id()))
        counts = placed.groupBy("path", "__part").agg(F.count_if(header).alias("n"))
        before = counts.select("path", "__part", (F.sum("n").over(Window.partitionBy("path").orderBy("__part")) - F.col("n")).alias("__before"))  # a row for each path and range
        inner = placed.withColumn("record", F.sum(header.cast("long")).over(upto("path", "__part")))
        numbered = inner.join(before, ["path", "__part"]).withColumn("record", F.col("record") + F.col("__before"))
    else:
        numbered = lines.withColumn("record", F.sum(header.cast("long")).over(upto("path")))
    part = F.when(~header, F.struct("line_no", clean_sequence(F.col("line")).alias("line")))
    grouped = numbered.where("record > 0").groupBy("path", "record").agg(F.max(F.when(header, F.col("line"))).alias("header"), F.collect_list(part).alias("parts"))
    return grouped.select("path", "record", "header", _joined("parts", "line_no", "line").alias("seq"))


def joined_contigs(records: DataFrame) -> DataFrame:
    """One row for each path: the first header, and all records' sequences in order with nothing between."""
    parts = F.array_sort(F.collect_list(F.struct("record", "seq", "header")))
    return records.groupBy("path").agg(parts.alias("parts")).select("path", F.col("parts")[0]["header"].alias("header"), F.size("parts").cast("long").alias("n_contigs"), _joined("parts", "record", "seq").alias("seq"))


def numbered_genomes(genomes: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """genome_id from 0 in the given order, name, seq; limit <= 0 is none.

    Ids are dense, so their order is a global one: partitions are range-sorted, counted, and numbered from those counts.
    """
    ranged = genomes.select(*order, genome_name(F.col("header")).alias("name"), "seq").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() % (1 << 33)))
    before = placed.groupBy("__part").agg(F.count("*").alias("n")).select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # one row a partition
    out = placed.join(F.broadcast(before), "__part").select((F.col("__before") + F.col("__at")).cast("int").alias("genome_id"), "name", "seq")
    return out.where(F.col("genome_id") < limit) if limit and limit > 0 else out


#: Files up to this size (gzipped ones up to an eighth) are read whole, a row each; of larger ones lines are rows from the start.
WHOLE_BYTES = 1 << 30


def by_size(spark: SparkSession, path: str, whole_bytes: int | None = None) -> tuple[list[str], list[str]]:
    """The files below path that may be read whole, and the larger ones."""
    most = WHOLE_BYTES if whole_bytes is None else whole_bytes
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    small, large = [], []
    for r in files.collect():  # names and sizes
        (small if r["length"] <= (most // 8 if r["path"].endswith(".gz") else most) else large).append(r["path"])
    return small, large


def whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, whole)"""
    if not paths:
        return spark.createDataFrame([], "path string, whole string")
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("whole"))


def streamed_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, line_no, line) of files of any size: a split's lines are numbered from its first byte on, of which each takes one at least."""

    def number(batches):
        before, at = None, 0
        for batch in batches:
            key = list(zip(batch.column("path").to_pylist(), batch.column("block").to_pylist()))
            numbers = []
            for k in key:
                if k != before:
                    before, at = k, k[1]
                numbers.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(numbers, pa.int64()), batch.column("value")], names=["path", "line_no", "line"])

    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    return lines.mapInArrow(number, "path string, line_no long, line string")


def read_lines(spark: SparkSession, path: str, whole_bytes: int | None = None) -> DataFrame:
    """(path, line_no, line) of text files, in their order."""
    small, large = by_size(spark, path, whole_bytes)

    def split(batches):
        for batch in batches:
            for name, whole in zip(batch.column("path").to_pylist(), batch.column("whole").to_pylist()):
                lines = whole.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                if lines and lines[-1] == "":
                    lines.pop()
                for at in range(0, len(lines), 100_000):
                    part = lines[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.string())], names=["path", "line_no", "line"])

    out = whole_files(spark, small).mapInArrow(split, "path string, line_no long, line string")
    return out.unionByName(streamed_lines(spark, large)) if large else out


def read_fasta(spark: SparkSession, path: str, mode: str = "record", limit: int | None = None, k: int = 29, whole_bytes: int | None = None) -> DataFrame:
    """genome_id, name, seq. mode "record": every record is a genome; "file": every genome file below path is one.

    Genomes without minimizers (too short, or of other letters) get no id.
    """
    lines, large = read_lines(spark, path, whole_bytes), by_size(spark, path, whole_bytes)[1]
    if mode == "file":
        lines = lines.where(is_genome_file(F.col("path")))
    elif mode != "record":
        raise ValueError(f"unknown mode {mode!r}")
    records = records_of(lines, bool(large))
    genomes = joined_contigs(records).withColumn("record", F.lit(0)) if mode == "file" else records
    k, _, m = kmer_parameters(k)
    # minimizers need k letters, and m in a row that are bases
    some = (F.length("seq") >= k) & F.col("seq").rlike(f"[ACGTUacgtu]{{{m}}}")
    return numbered_genomes(genomes.where(some), ["path", "record"], limit)
