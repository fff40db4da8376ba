"""Classification of arriving FASTQ files: each micro-batch is classified against the index, and adds to the totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from helixmill.functions.lineage import cut
from helixmill.operators.classification import DEFAULT_THRESHOLD, coerced_lg, genome_summary, read_rows, summarized
from helixmill.operators.sketches import counter_estimates, merged, registers
from helixmill.plans.classify import classify_sets, read_sets
from helixmill.plans.index import open_index
from helixmill.sources.fastq import reads_of
from helixmill.streaming import totals

EXACT = "genome_id int, mz long, n long"
REGISTERS = "genome_id int, bucket long, rank int, n long"


def genome_totals(spark: SparkSession, out: str, index: str, lg: int | None = None) -> DataFrame | None:
    """The genomes' summary over all batches so far, as one batch of all their reads would have it; None before the first."""
    size = None if lg is None else coerced_lg(lg)
    held = totals.latest(spark, f"{out}/totals", EXACT if size is None else REGISTERS)
    if held is None:
        return None
    if size is None:
        counted = held.groupBy("genome_id").agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_hits"))
    else:
        counted = counter_estimates(held, ["genome_id"], size).withColumnRenamed("n", "n_hits")
    return summarized(counted, open_index(spark, index)[1]["genomes"])


def classify_arriving(spark: SparkSession, folder: str, index: str, out: str, checkpoint: str, threshold: float = DEFAULT_THRESHOLD, trigger: dict | None = None, lg: int | None = None, files: int = 1000) -> StreamingQuery:
    """Starts a query that writes a batch's rows to out/reads/batch=N, its genomes to out/genomes/batch=N, and adds its hits to out/totals (see genome_totals).

    A batch that is run again overwrites its own rows and counts once. lg: the totals are registers, whose size the reads
    don't change, instead of the genomes' minimizers that were met.
    """
    source = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).load(folder)
    arriving = source.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("whole"))

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        metadata, tables = open_index(session, index)
        decided, hits = classify_sets(read_sets(reads_of(batch), metadata["k"]), tables, threshold)
        decided, hits = cut(decided), cut(hits)
        read_rows(decided, tables["genomes"]).write.mode("overwrite").parquet(f"{out}/reads/batch={number}")
        genome_summary(hits, tables["genomes"]).write.mode("overwrite").parquet(f"{out}/genomes/batch={number}")
        schema = EXACT if lg is None else REGISTERS
        new = hits.groupBy("genome_id", "mz").agg(F.count("*").alias("n")) if lg is None else registers(hits, ["genome_id"], coerced_lg(lg))
        known = totals.before(session, f"{out}/totals", number, schema)
        both = new if known is None else known.unionByName(new)
        summed = both.groupBy("genome_id", "mz").agg(F.sum("n").alias("n")) if lg is None else merged(both, ["genome_id"])
        totals.put(summed.select(*[x.split()[0] for x in schema.split(", ")]), f"{out}/totals", number)

    return arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
