"""Screening of arriving reads against a panel of reference genomes, with totals that grow by what is new.

Each run takes the Parquet files that have come since the last one (a file stream with a checkpoint, until nothing is left),
cuts their sequences into reads, and gives each read to the genome of the panel that it matches best. It writes

- reads/batch=N, partitioned by source: a row for each read;
- totals, in two halves in turn: the matched minimizers of each genome with their numbers, over all batches so far;
- panel: the reference's minimizers, as they were when the first batch came; later batches use them;
- summary: reads, different and all matched minimizers, coverage and depth of each genome, over all batches.

A batch that is run again, because a run broke off before its commit, writes what it wrote before: its reads replace those
of the same number, and its totals start from the half that the batch before has written. So every read counts once.

Defined cases: rows without an id are left out; rows that share an id are reads under the same names, each counted; a sequence
too short for a minimizer has no reads; null and empty sources are `unknown`; without any arrived rows the summary is empty.

    python -m jobs.arriving_reads --arriving reads/ --reference panel.parquet --output out --checkpoint marks
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixmill.functions.lineage import scratch
from helixmill.operators.classification import accepted, best_by_hits
from helixmill.operators.minimizers import minimizer_sets, minimizers
from helixmill.streaming import totals
from helixmill.streaming.totals import table_at
from jobs.common import arguments, log, said, sequences, settings_of

READS = "read_id string, genome_id long, hits long, n_minimizers long, confidence double, accepted boolean, batch int, source string"
PANEL = "genome_id long, mz long"
#: mz is null in a row that counts a genome's reads.
TOTALS = "genome_id long, mz long, n long"
SUMMARY = "genome_id long, n_reads long, n_distinct long, n_hits long, coverage double, depth double"


def reads_of(rows: DataFrame, settings: dict) -> DataFrame:
    """(read_id, source, seq): each sequence in cuts, one after the other; a last one too short for a minimizer is left out."""
    k, size = settings["k"], settings["read_bases"]
    whole = sequences(rows, settings).where(F.col("genome_id").isNotNull() & (F.length("seq") >= k))
    cuts = whole.select("genome_id", "source", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - k, F.lit(size))).alias("at"))
    return cuts.select(F.concat(F.lit("@"), F.col("genome_id"), F.lit("_"), F.col("at")).alias("read_id"), "source", F.substring(F.col("seq"), F.col("at") + 1, F.lit(size)).alias("seq"))


def panel_of(reference: DataFrame, settings: dict) -> DataFrame:
    """(genome_id, mz) of the reference's rows; those that share an id are one genome."""
    own = {"id": settings["reference_id"], "text": settings["reference_text"], "source": settings["reference_text"], "alphabet": settings["alphabet"]}
    genomes = sequences(reference, own).where("genome_id is not null").select(F.col("genome_id").cast("long").alias("genome_id"), "seq")
    return minimizers(genomes, "genome_id", "seq", settings["k"]).distinct()


def classified(sets: DataFrame, panel: DataFrame, threshold: float, keep) -> tuple[DataFrame, DataFrame]:
    """(reads' rows, accepted hits (genome_id, mz, n)) of sets (read_key, read_id, source, mz) against the panel (genome_id, mz)."""
    membership = panel.select(F.col("genome_id").alias("branch"), "mz")
    branches = membership.groupBy("branch").agg(F.count("*").alias("n_elements")).select(F.lit(0).alias("node_id"), "branch", F.col("branch").alias("child_ord"), "n_elements")
    sizes = sets.select(F.col("read_key").alias("read_id"), F.lit(0).alias("node_id"), F.size("mz").cast("long").alias("n_minimizers"))
    met = keep(sets.select(F.col("read_key").alias("read_id"), F.explode("mz").alias("mz")).join(membership, "mz"))
    hits = met.groupBy("read_id", F.lit(0).alias("node_id"), "branch").agg(F.count("*").alias("hits"))
    best = best_by_hits(hits, sizes, branches).select(F.col("read_id").alias("read_key"), F.col("branch").alias("genome_id"), "hits", "score")
    named = sets.select("read_key", "read_id", "source", F.size("mz").cast("long").alias("n_minimizers"))
    decided = keep(accepted(named.join(best, "read_key", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long"))), threshold))
    own = decided.where("accepted").select(F.col("read_key").alias("read_id"), F.col("genome_id").alias("branch"))
    new = met.join(own, ["read_id", "branch"]).groupBy(F.col("branch").alias("genome_id"), "mz").agg(F.count("*").alias("n"))
    counted = own.groupBy(F.col("branch").alias("genome_id")).agg(F.count("*").alias("n")).select("genome_id", F.lit(None).cast("long").alias("mz"), "n")
    rows = decided.select("read_id", F.when(F.col("accepted"), F.col("genome_id")).alias("genome_id"), "hits", "n_minimizers", F.col("confidence").cast("double").alias("confidence"), "accepted", "source")
    return rows, new.unionByName(counted)


def take_batch(batch: DataFrame, number: int, reference: str, output: str, settings: dict) -> None:
    spark = batch.sparkSession
    with scratch(spark) as keep:
        if number == 0:
            panel = panel_of(spark.read.parquet(reference), settings)
            panel.write.mode("overwrite").parquet(f"{output}/panel")
            said("wrote", f"{output}/panel", spark.read.schema(PANEL).parquet(f"{output}/panel").count())
        panel = spark.read.schema(PANEL).parquet(f"{output}/panel")
        reads = reads_of(batch, settings).withColumn("read_key", F.monotonically_increasing_id())
        sets = keep(minimizer_sets(reads, ["read_key", "read_id", "source"], "seq", settings["k"]))
        rows, new = classified(sets, panel, settings["threshold"], keep)
        rows.repartitionByRange("source", "read_id").write.mode("overwrite").partitionBy("source").parquet(f"{output}/reads/batch={number}")
        before = totals.before(spark, f"{output}/totals", number, TOTALS)
        both = new if before is None else before.unionByName(new)
        totals.put(both.groupBy("genome_id", "mz").agg(F.sum("n").alias("n")), f"{output}/totals", number)
        log.info("batch %d: read %d rows, wrote %d reads", number, batch.count(), sets.count())


def summary_of(spark: SparkSession, output: str) -> DataFrame | None:
    """The summary over all batches so far, None before the first."""
    held = totals.latest(spark, f"{output}/totals", TOTALS)
    if held is None:
        return None
    sizes = spark.read.schema(PANEL).parquet(f"{output}/panel").groupBy("genome_id").agg(F.count("*").alias("n_minimizers"))
    known = held.groupBy("genome_id").agg(F.sum(F.when(F.col("mz").isNull(), F.col("n"))).alias("n_reads"), F.count("mz").alias("n_distinct"), F.sum(F.when(F.col("mz").isNotNull(), F.col("n"))).alias("n_hits"))
    return known.join(sizes, "genome_id").select("genome_id", "n_reads", "n_distinct", "n_hits", (100.0 * F.col("n_distinct") / F.col("n_minimizers")).alias("coverage"), (F.col("n_hits") / F.col("n_distinct")).alias("depth"))


def run(spark: SparkSession, arriving: str, reference: str, output: str, checkpoint: str, settings: dict | None = None) -> dict[str, int]:
    """Takes what has arrived since the last run with this checkpoint; returns the batches of this run, and the rows of all reads and of the summary."""
    settings = settings or settings_of("arriving_reads")
    schema = f"`{settings['id']}` long, `{settings['text']}` string, `{settings['source']}` string"
    batches: list[int] = []

    def take(batch: DataFrame, number: int) -> None:
        take_batch(batch, number, reference, output, settings)
        batches.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["files"]).parquet(arriving)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    summary = summary_of(spark, output)
    if summary is None:
        summary = spark.createDataFrame([], SUMMARY)
    summary.coalesce(1).write.mode("overwrite").parquet(f"{output}/summary")
    reads = table_at(spark, f"{output}/reads", READS)
    out = {"batches": len(batches), "reads": reads.count() if reads is not None else 0, "summary": spark.read.schema(SUMMARY).parquet(f"{output}/summary").count()}
    log.info("took %d batches from %s", out["batches"], arriving)
    for name in ("reads", "summary"):
        said("stands at", f"{output}/{name}", out[name])
    return out


def output_of(spark: SparkSession, output: str) -> DataFrame:
    """All reads, and (read_id null) the summary's genomes: their reads as hits, their different minimizers as n_minimizers."""
    reads = spark.read.schema(READS).parquet(f"{output}/reads").select("source", "read_id", "genome_id", "hits", "n_minimizers", F.round("confidence", 5).alias("confidence"), F.lit(None).cast("double").alias("coverage"), F.lit(None).cast("double").alias("depth"))
    none = F.lit(None).cast("string")
    genomes = spark.read.schema(SUMMARY).parquet(f"{output}/summary").select(none.alias("source"), none.alias("read_id"), "genome_id", F.col("n_reads").alias("hits"), F.col("n_distinct").alias("n_minimizers"), F.lit(None).cast("double").alias("confidence"), F.round("coverage", 6).alias("coverage"), F.round("depth", 6).alias("depth"))
    return reads.unionByName(genomes)


def main() -> None:
    names = {"arriving": "folder (or pattern of paths) that Parquet tables of sequences arrive in", "reference": "Parquet table of the panel's genomes", "output": "folder for reads, totals and summary", "checkpoint": "folder for the marks of what was taken"}
    paths, settings = arguments("arriving_reads", __doc__.partition("\n")[0], names)
    spark = SparkSession.builder.appName("arriving_reads").getOrCreate()
    try:
        run(spark, **paths, settings=settings)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
