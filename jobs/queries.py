"""The jobs as registered queries: each runs twice into one new folder, and its whole output is what comes back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from helixmill.functions.lineage import shared_dir
from helixmill.plans.oracles import dna, minimizers, using
from jobs import arriving_reads, reference_catalog
from jobs.common import settings_of


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/helixmill-{name}-{uuid.uuid4().hex}"


def job1_reference_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = new_folder(spark, "job1")
    for _ in range(2):
        reference_catalog.run(spark, f"{sf_dir}/documents.parquet", output)
    return reference_catalog.output_of(spark, output)


def job2_arriving_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job2")
    for _ in range(2):
        # a pattern, as a file stream takes a folder or a pattern, and the table may be a single file
        arriving_reads.run(spark, f"{sf_dir}/documents.parque[t]", f"{sf_dir}/benchmark.parquet", f"{folder}/output", f"{folder}/checkpoint")
    return arriving_reads.output_of(spark, f"{folder}/output")


QUERIES = {f.__name__: f for f in (job1_reference_catalog, job2_arriving_reads)}

SOURCE = "coalesce(nullif(source, ''), 'unknown') AS source"
GENOMES = f"g AS (SELECT doc_id AS genome_id, {SOURCE}, {dna('text')} AS seq FROM documents WHERE doc_id IS NOT NULL)"
JOB1 = using(
    GENOMES,
    minimizers("g", "genome_id", "gm"),
    "listed AS (SELECT genome_id, min(source) AS source, CAST(sum(length(seq)) AS BIGINT) AS n_bases FROM g GROUP BY genome_id)",
    "sets AS (SELECT genome_id, count(*) AS n_minimizers, md5(string_agg(mz, ',' ORDER BY mz)) AS same FROM gm GROUP BY genome_id)",
    "groups AS (SELECT same, min(genome_id) AS representative, count(*) AS n_copies FROM sets GROUP BY same)",
    "held AS (SELECT mz, count(*) AS n, count(DISTINCT source) AS n_sources, min(genome_id) AS one, min(source) AS source FROM gm JOIN listed USING (genome_id) GROUP BY mz)",
    "own AS (SELECT one AS genome_id, count(*) AS n_own FROM held WHERE n = 1 GROUP BY one)",
    "own_source AS (SELECT source, count(*) AS n_own FROM held WHERE n_sources = 1 GROUP BY source)",
    "at_source AS (SELECT source, count(DISTINCT mz) AS n_minimizers FROM gm JOIN listed USING (genome_id) GROUP BY source)",
) + """SELECT source, genome_id, n_bases, coalesce(n_minimizers, 0) AS n_minimizers, coalesce(n_own, 0) AS n_own, coalesce(representative, genome_id) AS representative, coalesce(n_copies, 1) AS n_copies
FROM listed LEFT JOIN sets USING (genome_id) LEFT JOIN groups USING (same) LEFT JOIN own USING (genome_id)
UNION ALL SELECT source, NULL, CAST(sum(n_bases) AS BIGINT), coalesce(any_value(n_minimizers), 0), coalesce(any_value(n_own), 0), NULL, count(*) FROM listed LEFT JOIN at_source USING (source) LEFT JOIN own_source USING (source) GROUP BY source"""

S = settings_of("arriving_reads")
JOB2 = using(
    GENOMES,
    f"cuts AS (SELECT genome_id, source, seq, unnest(range(0, length(seq) - {S['k']} + 1, {S['read_bases']})) AS p0 FROM g WHERE length(seq) >= {S['k']})",
    f"r AS (SELECT '@' || genome_id || '_' || p0 AS read_id, source, substr(seq, CAST(p0 + 1 AS BIGINT), {S['read_bases']}) AS seq FROM cuts)",
    minimizers("r", "read_id", "rm"),
    f"it AS (SELECT item_id AS genome_id, {dna('text')} AS seq FROM benchmark WHERE item_id IS NOT NULL)",
    minimizers("it", "genome_id", "im"),
    "sizes AS (SELECT genome_id, count(*) AS n_elements, sum(count(*)) OVER () AS total FROM im GROUP BY genome_id)",
    "rn AS (SELECT read_id, count(*) AS n_minimizers FROM rm GROUP BY read_id)",
    "hit AS (SELECT read_id, genome_id, count(*) AS hits FROM rm JOIN im USING (mz) GROUP BY ALL)",
    "scored AS (SELECT read_id, genome_id, hits, CAST(sqrt(CAST(hits AS DOUBLE)) * (hits / (CAST(n_minimizers AS DOUBLE) * n_elements / total)) AS REAL) AS score FROM hit JOIN rn USING (read_id) JOIN sizes USING (genome_id))",
    "best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY score DESC, genome_id) = 1)",
    "sure AS (SELECT *, CAST(CAST(score AS DOUBLE) / CAST(CAST(1 AS REAL) + score AS DOUBLE) AS REAL) AS confidence FROM best)",
    f"decided AS (SELECT source, read_id, CASE WHEN confidence >= CAST({S['threshold']} AS REAL) THEN genome_id END AS genome_id, coalesce(hits, 0) AS hits, coalesce(n_minimizers, 0) AS n_minimizers, coalesce(confidence, 0) AS confidence FROM r LEFT JOIN rn USING (read_id) LEFT JOIN sure USING (read_id))",
    "own AS (SELECT genome_id, count(DISTINCT mz) AS n_distinct, count(*) AS n_hits, count(DISTINCT read_id) AS n_reads FROM decided JOIN rm USING (read_id) JOIN im USING (genome_id, mz) GROUP BY genome_id)",
) + """SELECT source, read_id, genome_id, hits, n_minimizers, round(CAST(confidence AS DOUBLE), 5) AS confidence, CAST(NULL AS DOUBLE) AS coverage, CAST(NULL AS DOUBLE) AS depth FROM decided
UNION ALL SELECT NULL, NULL, genome_id, n_reads, n_distinct, NULL, round(100.0 * n_distinct / CAST(n_elements AS DOUBLE), 6), round(n_hits / CAST(n_distinct AS DOUBLE), 6) FROM own JOIN sizes USING (genome_id)"""

ORACLES = {"job1_reference_catalog": JOB1, "job2_arriving_reads": JOB2}
