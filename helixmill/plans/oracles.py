"""ANSI SQL for the registered queries, written for DuckDB: the same results by another road."""

from __future__ import annotations

from helixmill.functions.hashing import FMIX, GOLDEN
from helixmill.functions.parameters import DEFAULT_FPP
from helixmill.functions.sequences import LETTERS, NUCLEOTIDES
from helixmill.plans.queries import COUNTER_LG, DOCUMENT_FILTERS, FILE_IDS, FEW_K, FIRST_GENOMES, FIRST_READS, K, PATH_ENDINGS, READ_BASES, RETAINED, SEED, SKETCH_K, SLOTS, THRESHOLD

M32, MURMUR = (1 << 32) - 1, 0x5BD1E995


def dna(text: str) -> str:
    return f"regexp_replace(translate(coalesce({text}, ''), '{LETTERS}', '{NUCLEOTIDES}'), '[^acgt]+', '', 'g')"


GENOMES = f"g AS (SELECT doc_id AS genome_id, '>doc_' || doc_id AS name, {dna('text')} AS seq, CAST(substr(source, 4) AS INTEGER) AS filter_id FROM documents)"
READS = f"""r0 AS (SELECT genome_id, seq, unnest(range(0, length(seq) - {K} + 1, {READ_BASES})) AS p0 FROM g WHERE length(seq) >= {K}),
r AS (SELECT '@' || genome_id || '_' || p0 AS read_id, substr(seq, CAST(p0 + 1 AS BIGINT), {READ_BASES}) AS seq FROM r0)"""


def mer_steps(source: str, key: str, tag: str) -> str:
    """CTEs that end in {tag}: key, pos, can (canonical 25-mers), by doubling over windows."""
    w = f"OVER (PARTITION BY {key} ORDER BY pos)"
    lead = lambda x, n: f"lead({x}, {n}) {w}"
    steps = [f"{tag}0 AS (SELECT {key}, unnest(range(1, length(seq) + 1)) AS pos, unnest(string_split(seq, '')) AS c FROM {source} WHERE length(seq) >= {K})"]
    steps.append(f"{tag}1 AS (SELECT {key}, pos, CAST(instr('acgt', c) - 1 AS BIGINT) AS f1, CAST(4 - instr('acgt', c) AS BIGINT) AS r1 FROM {tag}0)")
    for a in (1, 2, 4, 8):
        keep = ", f1, r1" + (", f8, r8" if a == 8 else "") if a > 1 else ", f1, r1"
        steps.append(f"{tag}{2 * a} AS (SELECT {key}, pos{keep}, f{a} * {4**a} + {lead(f'f{a}', a)} AS f{2 * a}, {lead(f'r{a}', a)} * {4**a} + r{a} AS r{2 * a} FROM {tag}{a})")
    steps.append(f"{tag}24 AS (SELECT {key}, pos, f1, r1, f16 * {4**8} + {lead('f8', 16)} AS f24, {lead('r8', 16)} * {4**16} + r16 AS r24 FROM {tag}16)")
    steps.append(f"{tag}25 AS (SELECT {key}, pos, f24 * 4 + {lead('f1', 24)} AS f, {lead('r1', 24)} * {4**24} + r24 AS r FROM {tag}24)")
    steps.append(f"{tag} AS (SELECT {key}, pos, least(f, r) AS can FROM {tag}25 WHERE f IS NOT NULL)")
    return ",\n".join(steps)


def minimizers(source: str, key: str, out: str) -> str:
    return f"""{mer_steps(source, key, out + '_m')},
{out}_w AS (SELECT {key}, min(can) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS mz, lead(can, 3) OVER (PARTITION BY {key} ORDER BY pos) AS whole FROM {out}_m),
{out} AS (SELECT DISTINCT {key}, mz FROM {out}_w WHERE whole IS NOT NULL)"""


def murmur_steps(source: str, columns: str, out: str) -> str:
    """CTEs that end in {out}: the columns and h0, h1 of mz."""
    turn = lambda w: f"((({w}) & 255) << 24) | (((({w}) >> 8) & 255) << 16) | (((({w}) >> 16) & 255) << 8) | ((({w}) >> 24) & 255)"
    mul = lambda x: f"(({x}) * {MURMUR}) & {M32}"
    a = f"{out}_a AS (SELECT {columns}, {mul(turn('mz >> 32'))} AS a, {mul(turn(f'mz & {M32}'))} AS b FROM {source})"
    b = f"{out}_b AS (SELECT {columns}, {mul('xor(a, a >> 24)')} AS a, {mul('xor(b, b >> 24)')} AS b FROM {out}_a)"
    first = [(s ^ 8) * MURMUR & M32 for s in (0, 1)]
    c = f"{out}_c AS (SELECT {columns}, " + ", ".join(f"xor({mul(f'xor({first[s]}, a)')}, b) AS x{s}" for s in (0, 1)) + f" FROM {out}_b)"
    d = f"{out}_d AS (SELECT {columns}, " + ", ".join(f"{mul(f'xor(x{s}, x{s} >> 13)')} AS x{s}" for s in (0, 1)) + f" FROM {out}_c)"
    return ",\n".join([a, b, c, d, f"{out} AS (SELECT {columns}, xor(x0, x0 >> 15) AS h0, xor(x1, x1 >> 15) AS h1 FROM {out}_d)"])


def finalizer_sql(value: str) -> str:
    """The seeded 64-bit finalizer of a long that isn't negative, as a signed long."""
    z = f"xor(CAST({value} AS UBIGINT), CAST({GOLDEN} AS UBIGINT))"
    steps, name = [], "z0"
    steps.append(f"z0 AS (SELECT {value}, {z} AS z FROM u)")
    for i, factor in enumerate(FMIX):
        steps.append(f"z{i + 1} AS (SELECT {value}, CAST((CAST(xor(z, z >> 33) AS UHUGEINT) * CAST({factor} AS UHUGEINT)) % CAST({1 << 64} AS UHUGEINT) AS UBIGINT) AS z FROM {name})")
        name = f"z{i + 1}"
    return ", ".join([*steps, f"zz AS (SELECT {value}, CAST(xor(z, z >> 33) AS HUGEINT) AS z FROM {name})"])


def using(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


G_MZ = ",\n".join([GENOMES, minimizers("g", "genome_id", "gm")])
SIZES = "n AS (SELECT genome_id, count(*) AS n_minimizers FROM gm GROUP BY genome_id)"
SHARED = "sh AS (SELECT x.genome_id AS a, y.genome_id AS b, count(*) AS shared FROM gm x JOIN gm y ON x.mz = y.mz AND x.genome_id < y.genome_id GROUP BY 1, 2)"
SCORES = """sc AS (SELECT a, b, 1 / (1 - ln(least(1.0, shared / sqrt(CAST(x.n_minimizers AS DOUBLE) * CAST(y.n_minimizers AS DOUBLE))))) AS score, shared / CAST(x.n_minimizers + y.n_minimizers - shared AS DOUBLE) AS jaccard
FROM sh JOIN n x ON x.genome_id = a JOIN n y ON y.genome_id = b)"""
SIMILAR = ",\n".join([G_MZ, SIZES, SHARED, SCORES])
draw = lambda x: f"CAST('0x' || substr(md5('{SEED}:' || i || ':{x}'), 1, 12) AS BIGINT) % (SELECT count(*) FROM documents)"

def pairs_of(target: object, draws: object) -> str:
    return f"""d0 AS (SELECT range AS i FROM range({draws})), d1 AS (SELECT i, {draw('x')} AS x, {draw('y')} AS y FROM d0),
drawn AS (SELECT least(x, y) AS a, greatest(x, y) AS b, min(i) AS turn FROM d1 WHERE x <> y GROUP BY 1, 2 ORDER BY turn LIMIT {target}),
ids AS (SELECT range AS i FROM range((SELECT count(*) FROM documents))),
every AS (SELECT x.i AS a, y.i AS b FROM ids x JOIN ids y ON x.i < y.i WHERE (SELECT count(*) FROM ids) * ((SELECT count(*) FROM ids) - 1) / 2 <= {target}),
pairs AS (SELECT a, b FROM every UNION ALL SELECT a, b FROM drawn WHERE NOT EXISTS (SELECT 1 FROM every))"""


def classes_of(pairs: str) -> str:
    return f"""{G_MZ},
{pairs},
met AS (SELECT DISTINCT p.a, p.b FROM pairs p JOIN gm x ON x.genome_id = p.a JOIN gm y ON y.genome_id = p.b AND y.mz = x.mz),
classes AS (SELECT p.a, p.b, CASE WHEN met.a IS NULL THEN 1 ELSE 2 END AS class FROM pairs p LEFT JOIN met ON met.a = p.a AND met.b = p.b)"""


SIZED = "(SELECT CAST(floor(1000 + count(*) * pow(ln(count(*)), 2)) AS BIGINT) FROM documents)"
PAIRS = pairs_of(SIZED, f"2 * {SIZED} + 64")
CLASSES = classes_of(PAIRS)
F_MZ = "fm AS (SELECT DISTINCT filter_id, mz FROM gm JOIN g USING (genome_id))"
CAPS = "caps AS (SELECT filter_id, count(*) AS capacity FROM fm GROUP BY filter_id)"
FILTERS = f"""want AS (SELECT filter_id, capacity, greatest(2, CAST(ceil(-(capacity * ln({DEFAULT_FPP})) / pow(ln(2), 2)) AS BIGINT)) AS want FROM caps),
cand AS (SELECT filter_id, capacity, want + unnest(range(0, 500)) AS c FROM want),
few AS (SELECT range AS q FROM range(2, 100) WHERE NOT EXISTS (SELECT 1 FROM range(2, 10) t(x) WHERE x < range AND range % x = 0)),
primes AS (SELECT range AS q FROM range(2, 30000) WHERE NOT EXISTS (SELECT 1 FROM range(2, 174) t(x) WHERE x < range AND range % x = 0)),
odd AS (SELECT * FROM cand WHERE NOT EXISTS (SELECT 1 FROM few WHERE q < c AND c % q = 0)),
fl AS (SELECT filter_id, capacity, 1 AS shards, min(c) AS bits FROM odd WHERE NOT EXISTS (SELECT 1 FROM primes WHERE q < c AND c % q = 0) GROUP BY filter_id, capacity),
filters AS (SELECT filter_id, capacity, shards, bits, CAST(ceil(bits / CAST(capacity AS DOUBLE) * ln(2)) AS INTEGER) AS hashes FROM fl)"""
BLOOM = ",\n".join([G_MZ, F_MZ, CAPS, FILTERS, murmur_steps("fm", "filter_id, mz", "hm")])
PROBES = "probes AS (SELECT filter_id, mz, unnest(range(0, hashes)) AS i, h0 % bits AS p, greatest(h1 % bits, 1) AS st, bits FROM hm JOIN filters USING (filter_id)), bit AS (SELECT filter_id, mz, (p + i * st) % bits AS bit FROM probes)"
SET_BITS = "sb AS (SELECT filter_id, count(DISTINCT bit) AS set_bits FROM bit GROUP BY filter_id)"
ESTIMATE = "est AS (SELECT filter_id, capacity, bits, hashes, set_bits, CAST(round(-CAST(bits AS DOUBLE) / hashes * ln(1 - CAST(set_bits AS DOUBLE) / bits)) AS BIGINT) AS estimate FROM sb JOIN filters USING (filter_id))"
STATS = ",\n".join([BLOOM, PROBES, SET_BITS, ESTIMATE])
ITEMS = f"it AS (SELECT item_id, {dna('text')} AS seq FROM benchmark)"
I_MZ = ",\n".join([ITEMS, minimizers("it", "item_id", "im")])
LEVEL1 = f"""{G_MZ},
{READS},
{minimizers('r', 'read_id', 'rm')},
{F_MZ},
{CAPS},
rn AS (SELECT read_id, count(*) AS n_minimizers FROM rm GROUP BY read_id),
hits1 AS (SELECT read_id, filter_id, count(*) AS hits FROM rm JOIN fm USING (mz) GROUP BY 1, 2),
all1 AS (SELECT rn.read_id, n_minimizers, caps.filter_id, coalesce(hits, 0) AS hits, capacity, (SELECT sum(capacity) FROM caps) AS total FROM rn CROSS JOIN caps LEFT JOIN hits1 ON hits1.read_id = rn.read_id AND hits1.filter_id = caps.filter_id),
sc1 AS (SELECT *, CAST(sqrt(CAST(hits AS DOUBLE)) * (hits / (CAST(n_minimizers AS DOUBLE) * capacity / total)) AS REAL) AS score FROM all1),
top1 AS (SELECT * FROM sc1 QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY score DESC, filter_id) = 1)"""
LEVEL2 = f"""{LEVEL1},
{SIZES},
tot2 AS (SELECT filter_id, sum(n_minimizers) AS total FROM n JOIN g USING (genome_id) GROUP BY filter_id),
hit2 AS (SELECT t.read_id, t.filter_id, t.n_minimizers, gm.genome_id, rm.mz FROM top1 t JOIN rm USING (read_id) JOIN gm ON gm.mz = rm.mz JOIN g ON g.genome_id = gm.genome_id AND g.filter_id = t.filter_id WHERE t.hits > 0),
cnt2 AS (SELECT read_id, filter_id, n_minimizers, genome_id, count(*) AS hits FROM hit2 GROUP BY ALL),
sc2 AS (SELECT read_id, c.genome_id, hits, c.n_minimizers, CAST(sqrt(CAST(hits AS DOUBLE)) * (hits / (CAST(c.n_minimizers AS DOUBLE) * n.n_minimizers / total)) AS REAL) AS score FROM cnt2 c JOIN n ON n.genome_id = c.genome_id JOIN tot2 USING (filter_id)),
top2 AS (SELECT * FROM sc2 QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY score DESC, genome_id) = 1),
acc AS (SELECT *, CAST(CAST(score AS DOUBLE) / CAST(CAST(1 AS REAL) + score AS DOUBLE) AS REAL) AS conf, CAST(hits / CAST(n_minimizers AS DOUBLE) AS REAL) AS match FROM top2),
ok AS (SELECT *, hits > 0 AND conf >= CAST({THRESHOLD} AS REAL) AS accepted FROM acc)"""
SUMMARY = f"""{LEVEL2},
own AS (SELECT hit2.genome_id, hit2.mz FROM hit2 JOIN ok ON ok.read_id = hit2.read_id AND ok.genome_id = hit2.genome_id WHERE accepted),
su AS (SELECT genome_id, count(DISTINCT mz) AS n_distinct, count(*) AS n_hits FROM own GROUP BY genome_id)"""
estimate = lambda below, theta: f"CAST(CASE WHEN {theta} IS NULL THEN {below} ELSE round(({below}) * 9223372036854775808.0 / CAST({theta} AS DOUBLE)) END AS BIGINT)"
SKETCHES = ",\n".join([G_MZ, murmur_steps("gm", "genome_id, mz", "hg"), f"sk AS (SELECT genome_id, (h0 << 31) | (h1 >> 1) AS u FROM hg QUALIFY row_number() OVER (PARTITION BY genome_id ORDER BY (h0 << 31) | (h1 >> 1)) <= {SKETCH_K})"])
THRESHOLDS = f"th AS (SELECT genome_id, count(*) AS n, CASE WHEN count(*) = {SKETCH_K} THEN max(u) END AS theta FROM sk GROUP BY genome_id)"
UNIONS = f"""un AS (SELECT filter_id, u FROM (SELECT DISTINCT filter_id, u FROM sk JOIN g USING (genome_id)) QUALIFY row_number() OVER (PARTITION BY filter_id ORDER BY u) <= {SKETCH_K}),
ul AS (SELECT filter_id, min(theta) AS least FROM th JOIN g USING (genome_id) GROUP BY filter_id),
ut AS (SELECT filter_id, least(any_value(least), CASE WHEN count(*) = {SKETCH_K} THEN max(u) END) AS theta FROM un JOIN ul USING (filter_id) GROUP BY filter_id)"""
SKETCHED_PAIRS = f"kp AS (SELECT a, b, least(x.theta, y.theta) AS theta, {estimate('x.n - CASE WHEN x.theta IS NULL THEN 0 ELSE 1 END', 'x.theta')} AS n_a, {estimate('y.n - CASE WHEN y.theta IS NULL THEN 0 ELSE 1 END', 'y.theta')} AS n_b FROM pairs JOIN th x ON x.genome_id = a JOIN th y ON y.genome_id = b)"

SIGNED = ",\n".join([
    f"vt AS (SELECT genome_id, t, (h0 + t * (h1 | 1)) & {SLOTS - 1} AS slot, xor(mz, (t + 1) << 51) AS mz FROM hg, range({SLOTS}) turns(t))",
    murmur_steps("vt", "genome_id, slot, t", "vh"),
    "sg AS (SELECT genome_id, slot, min((t << 32) | h0) AS least FROM vh GROUP BY 1, 2)",
    "eq AS (SELECT a, b, count(*) AS equal FROM pairs JOIN sg x ON x.genome_id = a JOIN sg y ON y.genome_id = b AND y.slot = x.slot AND y.least = x.least GROUP BY 1, 2)",
])
FEW = f"""fk AS (SELECT genome_id, u FROM sk QUALIFY row_number() OVER (PARTITION BY genome_id ORDER BY u) <= {FEW_K}),
ft AS (SELECT genome_id, CASE WHEN count(*) = {FEW_K} THEN max(u) END AS theta FROM fk GROUP BY genome_id),
fs AS (SELECT DISTINCT a, b FROM pairs JOIN ft s ON s.genome_id = a JOIN ft t ON t.genome_id = b JOIN fk x ON x.genome_id = a JOIN fk y ON y.genome_id = b AND y.u = x.u WHERE least(s.theta, t.theta) IS NULL OR x.u < least(s.theta, t.theta))"""


def registers_sql(source: str, key: str) -> str:
    return f"reg AS (SELECT {key}, h0 & {(1 << COUNTER_LG) - 1} AS bucket, max(CASE WHEN h1 = 0 THEN 33 ELSE 33 - length(bin(h1)) END) AS rank, count(*) AS n FROM {source} GROUP BY 1, 2)"


def counter_sql() -> str:
    m = float(1 << COUNTER_LG)
    raw = f"({0.7213 / (1 + 1.079 / m) * m * m!r} / (s + ({m} - held)))"
    return f"CAST(round(CASE WHEN {raw} <= {2.5 * m} AND held < {m} THEN {m} * ln({m} / ({m} - held)) ELSE {raw} END) AS BIGINT)"


STAGED = 5
#: Reads as numbers: the genome's, then the place of the cut.
READ_PLACES = 1 << 24
NUMBERED_READS = f"""r0 AS (SELECT genome_id, seq, unnest(range(0, length(seq) - {K} + 1, {READ_BASES})) AS p0 FROM g WHERE length(seq) >= {K}),
r AS (SELECT genome_id * {READ_PLACES} + p0 AS rk, substr(seq, CAST(p0 + 1 AS BIGINT), {READ_BASES}) AS seq FROM r0)"""


def held_by_filters(pairs: str, out: str) -> str:
    """CTEs that end in {out}: (mz, filter_id) of the distinct pairs that the filters hold, by ever more of their probes."""
    steps = [f"{out}_u AS (SELECT DISTINCT mz FROM {pairs})", murmur_steps(f"{out}_u", "mz", f"{out}_h")]
    steps.append(f"{out}_0 AS (SELECT mz, filter_id, h0 % bits AS p, greatest(h1 % bits, 1) AS st, bits, hashes FROM {pairs} JOIN {out}_h USING (mz) JOIN filters USING (filter_id))")
    for i in range(STAGED):
        steps.append(f"{out}_{i + 1} AS (SELECT x.* FROM {out}_{i} x SEMI JOIN db ON db.filter_id = x.filter_id AND db.bit = (x.p + {i} * x.st) % x.bits)")
    steps.append(f"{out}_r AS (SELECT mz, filter_id, (p + unnest(range({STAGED}, hashes)) * st) % bits AS bit FROM {out}_{STAGED})")
    steps.append(f"{out}_m AS (SELECT DISTINCT mz, filter_id FROM {out}_r ANTI JOIN db USING (filter_id, bit))")
    steps.append(f"{out} AS (SELECT mz, filter_id FROM {out}_{STAGED} ANTI JOIN {out}_m USING (mz, filter_id))")
    return ",\n".join(steps)


INDEX = f"""{G_MZ},
{SIZES},
gg AS (SELECT genome_id, name, g.filter_id AS src FROM g JOIN n USING (genome_id)),
el AS (SELECT DISTINCT src AS filter_id, mz FROM gm JOIN gg USING (genome_id) UNION ALL SELECT genome_id + {DOCUMENT_FILTERS}, mz FROM gm),
caps AS (SELECT filter_id, count(*) AS capacity FROM el GROUP BY filter_id),
{FILTERS},
{murmur_steps("el", "filter_id, mz", "hm")},
{PROBES},
{SET_BITS},
{ESTIMATE},
db AS (SELECT DISTINCT filter_id, bit FROM bit),
mem AS (SELECT src AS filter_id, count(*) AS n_members FROM gg GROUP BY src),
sz AS (SELECT filter_id, CASE WHEN coalesce(n_members, 1) = 1 THEN capacity ELSE CAST(floor(CAST((CAST(capacity AS REAL) + CAST(estimate AS REAL)) / CAST(2 AS REAL) AS DOUBLE) + 0.5) AS BIGINT) END AS n_elements FROM est LEFT JOIN mem USING (filter_id)),
{NUMBERED_READS},
{minimizers('r', 'rk', 'rm')},
rn AS (SELECT rk, count(*) AS n_minimizers FROM rm GROUP BY rk),
pairs1 AS (SELECT mz, filter_id FROM (SELECT DISTINCT mz FROM rm) CROSS JOIN mem),
{held_by_filters("pairs1", "in1")},
hits1 AS (SELECT rk, filter_id, count(*) AS hits FROM rm JOIN in1 USING (mz) GROUP BY 1, 2)"""
BY_FILTERS = f"""{INDEX},
tot1 AS (SELECT sum(n_elements) AS total FROM sz JOIN mem USING (filter_id)),
sc1 AS (SELECT rk, filter_id, CAST(sqrt(CAST(hits AS DOUBLE)) * (hits / (CAST(n_minimizers AS DOUBLE) * n_elements / (SELECT total FROM tot1))) AS REAL) AS score FROM hits1 JOIN rn USING (rk) JOIN sz USING (filter_id)),
top1 AS (SELECT rk, filter_id AS src FROM sc1 QUALIFY row_number() OVER (PARTITION BY rk ORDER BY score DESC, filter_id) = 1),
own2 AS (SELECT rk, src, mz FROM top1 JOIN rm USING (rk)),
pairs2 AS (SELECT mz, genome_id + {DOCUMENT_FILTERS} AS filter_id FROM (SELECT DISTINCT src, mz FROM own2) JOIN gg USING (src)),
{held_by_filters("pairs2", "in2")},
hits2 AS (SELECT rk, src, genome_id, count(*) AS hits FROM own2 JOIN in2 USING (mz) JOIN gg USING (src) WHERE filter_id = genome_id + {DOCUMENT_FILTERS} GROUP BY ALL),
tot2 AS (SELECT src, sum(n_elements) AS total FROM gg JOIN sz ON sz.filter_id = genome_id + {DOCUMENT_FILTERS} GROUP BY src),
sc2 AS (SELECT rk, genome_id, hits, CAST(sqrt(CAST(hits AS DOUBLE)) * (hits / (CAST(n_minimizers AS DOUBLE) * n_elements / total)) AS REAL) AS score FROM hits2 JOIN rn USING (rk) JOIN sz ON sz.filter_id = genome_id + {DOCUMENT_FILTERS} JOIN tot2 USING (src)),
top2 AS (SELECT *, CAST(CAST(score AS DOUBLE) / CAST(CAST(1 AS REAL) + score AS DOUBLE) AS REAL) AS conf FROM sc2 QUALIFY row_number() OVER (PARTITION BY rk ORDER BY score DESC, genome_id) = 1)"""
CLEAN = r"regexp_replace({}, '\s+', '', 'g')"
RECORDS = f"""rec AS (SELECT source AS path, doc_id, {CLEAN.format("array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT starts_with(x, '>')), '')")} AS seq FROM documents),
num AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY doc_id) AS record, doc_id, seq FROM rec)"""
GRID = ",\n".join([GENOMES, "grid AS (SELECT genome_id, length(seq) % 40 AS zero, genome_id % 40 AS positive FROM g)"])
WEIGHT = "CASE WHEN positive <= 0 THEN 0.0 WHEN zero <= 0 THEN 1.0 ELSE 0.5 + 0.5 * ln(positive / zero) / (1 + abs(ln(positive / zero))) END"
ENDING_LIST = ", ".join(f"'{e}'" for e in PATH_ENDINGS)

ORACLES = {
    "scan_fasta": using(RECORDS) + "SELECT path, record, '>doc - ' || doc_id AS name, length(seq) AS n_bases, md5(seq) AS seq_md5 FROM num",
    "contig_concat": using(RECORDS) + "SELECT path, '>doc - ' || min(doc_id) AS name, count(*) AS n_contigs, CAST(sum(length(seq)) AS BIGINT) AS n_bases FROM num GROUP BY path",
    "genome_file_filter": f"SELECT path FROM (SELECT source || '/doc_' || doc_id || list_extract([{ENDING_LIST}], CAST(doc_id % {len(PATH_ENDINGS)} + 1 AS INTEGER)) AS path FROM documents) WHERE regexp_matches(lower(path), '\\.(fna|fa|fasta|fas)(\\.gz)?$') AND NOT regexp_matches(lower(path), '_cds_from_genomic|_rna_from_genomic|_protein|translated_cds|\\.faa')",
    "clean_seq": f"SELECT doc_id, length({CLEAN.format('text')}) AS n_bases, md5({CLEAN.format('text')}) AS seq_md5 FROM documents",
    "chunk_equiv": using(G_MZ) + "SELECT genome_id, count(*) AS n_minimizers, CAST(sum(mz % 1000003) AS BIGINT) AS mz_sum FROM gm GROUP BY genome_id",
    "fasta_ranges": using(G_MZ, "own AS (SELECT genome_id, count(*) AS n, CAST(sum(mz % 1000003) AS BIGINT) AS s FROM gm GROUP BY genome_id)") + "SELECT name, length(seq) AS n_bases, coalesce(n, 0) AS n_minimizers, coalesce(s, 0) AS mz_sum FROM g LEFT JOIN own USING (genome_id)",
    "limit_genomes": using(GENOMES) + f"SELECT genome_id, name, length(seq) AS n_bases FROM g WHERE length(seq) >= {K} ORDER BY genome_id LIMIT {FIRST_GENOMES}",
    "scan_fastq": using(GENOMES) + f"SELECT 'src' || filter_id || '_' || genome_id // {FILE_IDS} AS path, row_number() OVER (PARTITION BY filter_id, genome_id // {FILE_IDS} ORDER BY genome_id) - 1 AS read_ord, '@' || genome_id AS read_id, length(seq) AS n_bases, md5(seq) AS seq_md5 FROM g WHERE length(seq) >= {K}",
    "fastq_ranges": using(GENOMES) + f"SELECT 'src' || filter_id || '_' || genome_id // {FILE_IDS} AS path, row_number() OVER (PARTITION BY filter_id, genome_id // {FILE_IDS} ORDER BY genome_id) - 1 AS read_ord, '@' || genome_id AS read_id, length(seq) AS n_bases, md5(seq) AS seq_md5 FROM g WHERE length(seq) >= {K}",
    "fastq_lenient": using(GENOMES)
    + f"""SELECT path, read_id, concat_ws('; ', CASE WHEN stray AND NOT coalesce(after_short, false) THEN 'skipped 1 lines' END, CASE WHEN short THEN 'sequence ' || n || ', quality ' || CASE WHEN coalesce(stray_next, false) THEN {1 + len('stray line')} ELSE 1 END END) AS parse_warning
FROM (SELECT *, lag(short) OVER w AS after_short, lead(stray) OVER w AS stray_next FROM (SELECT 'src' || filter_id || '_' || genome_id // {FILE_IDS} AS path, genome_id, '@' || genome_id AS read_id, length(seq) AS n, genome_id % 5 = 1 AS stray, genome_id % 7 = 3 AS short FROM g WHERE length(seq) >= {K}) WINDOW w AS (PARTITION BY path ORDER BY genome_id))
WHERE short OR (stray AND NOT coalesce(after_short, false))""",
    "limit_reads": using(GENOMES, READS) + f"SELECT read_id, length(seq) AS n_bases FROM r ORDER BY read_id LIMIT {FIRST_READS}",
    "kmer_params": using(GENOMES) + "SELECT genome_id, asked, CAST(k AS INTEGER) AS k, CAST(step AS INTEGER) AS step, CAST(k - step AS INTEGER) AS m FROM (SELECT genome_id, asked, k, CAST(floor(sqrt(k)) AS BIGINT) - CAST(floor(sqrt(k)) AS BIGINT) % 2 AS step FROM (SELECT genome_id, asked, least(greatest(CASE WHEN asked % 2 = 0 THEN asked + 1 ELSE asked END, 11), 37) AS k FROM (SELECT genome_id, length(seq) % 60 + 1 AS asked FROM g)))",
    "canonical_mmers": using(GENOMES, mer_steps("g", "genome_id", "c")) + "SELECT genome_id, count(*) AS n_mmers, CAST(sum(can % 1000003) AS BIGINT) AS mmer_sum, min(can) AS least, max(can) AS greatest FROM c GROUP BY genome_id",
    "minimizers": using(G_MZ) + "SELECT genome_id, mz FROM gm",
    "murmur2_pair": using(I_MZ, "u AS (SELECT DISTINCT mz FROM im)", murmur_steps("u", "mz", "h")) + "SELECT mz, h0, h1 FROM h",
    "fmix64": using(I_MZ, "u AS (SELECT DISTINCT mz FROM im)", finalizer_sql("mz")) + f"SELECT mz, CAST(CASE WHEN z >= {1 << 63} THEN z - {1 << 64} ELSE z END AS BIGINT) AS mixed FROM zz",
    "pair_key": "SELECT doc_id AS x, doc_id * 7919 % 1009 AS y, (least(doc_id, doc_id * 7919 % 1009) << 32) | greatest(doc_id, doc_id * 7919 % 1009) AS pair_key FROM documents",
    "csv_escape": """SELECT doc_id, md5(CASE WHEN regexp_matches(text, '[,"\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS field_md5 FROM documents""",
    "genome_card": using(G_MZ, SIZES) + "SELECT genome_id, n_minimizers FROM n",
    "cosine_log_similarity": using(SIMILAR) + "SELECT a, b, round(score, 9) AS score FROM sc",
    "jaccard": using(SIMILAR) + "SELECT a, b, round(jaccard, 9) AS jaccard FROM sc",
    "pair_sample": using(PAIRS) + "SELECT a, b FROM pairs",
    "pair_classes": using(CLASSES) + "SELECT a, b, class FROM classes",
    "calibration_counts": using(CLASSES) + "SELECT count(*) FILTER (class = 1) AS zero, count(*) FILTER (class = 2) AS positive, count(*) AS pairs FROM classes",
    "similarity_stats": using(SIMILAR) + "SELECT count(*) AS n, round(CASE WHEN count(*) < 2 THEN -1 ELSE avg(score) END, 9) AS mean, round(CASE WHEN count(*) < 2 THEN -1 ELSE stddev_samp(score) END, 9) AS std FROM sc",
    "positive_percentile": using(SIMILAR) + "SELECT a, b, round(cume_dist() OVER (ORDER BY round(score, 9)), 9) AS percentile FROM sc",
    "cluster_union_card": using(G_MZ, "ff AS (SELECT filter_id, mz, min(genome_id) AS genome_id FROM gm JOIN g USING (genome_id) GROUP BY filter_id, mz), fn AS (SELECT filter_id, genome_id, count(*) AS new FROM ff GROUP BY 1, 2)")
    + "SELECT g.filter_id, g.genome_id, CAST(sum(coalesce(new, 0)) OVER (PARTITION BY g.filter_id ORDER BY g.genome_id) AS BIGINT) AS running FROM g LEFT JOIN fn ON fn.filter_id = g.filter_id AND fn.genome_id = g.genome_id",
    "sample_size": "SELECT n, CAST(floor(1000 + n * pow(ln(n), 2)) AS BIGINT) AS pairs FROM (SELECT count(*) OVER (PARTITION BY source ORDER BY doc_id) + 1 AS n FROM documents)",
    "growth_weight": using(GRID) + f"SELECT genome_id, zero, positive, round({WEIGHT}, 9) AS weight FROM grid",
    "leader_limit": using(GRID) + f"SELECT genome_id, zero, positive, CASE WHEN n <= 1 THEN n ELSE greatest(1, least(n, CAST(ceil(sqrt(n) + (n - sqrt(n)) * ({WEIGHT})) AS BIGINT))) END AS leaders FROM (SELECT *, zero * 40 + positive AS n FROM grid)",
    "adaptive_bound": using(GRID) + "SELECT genome_id, zero, positive, CASE WHEN n <= 1 THEN n ELSE least(n, greatest(2, CAST(ceil(least((1 + greatest(0.0, (0.375 - positive / 64.0) / 0.125) + greatest(0.0, (zero / 128.0 - 0.125) / 0.125)) * ln(1 + n), sqrt(n))) AS BIGINT))) END AS clusters FROM (SELECT *, zero * 97 + 1 AS n FROM grid)",
    "retain_topk": f"SELECT source AS cluster, count(*) % 5 AS size FROM documents GROUP BY source ORDER BY size DESC, md5('{SEED}:' || source) LIMIT {RETAINED}",
    "best_cluster": using(G_MZ, F_MZ, I_MZ) + "SELECT item, cluster, score FROM (SELECT item_id AS item, filter_id AS cluster, CAST(count(*) AS DOUBLE) AS score FROM im JOIN fm USING (mz) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, cluster) = 1",
    "partition_check": "SELECT (SELECT count(*) FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 23 <> 0 AND doc_id % 29 = 0) AS foreign, (SELECT count(*) FROM documents WHERE doc_id % 17 = 0) AS duplicate, (SELECT count(*) FROM documents WHERE doc_id % 17 <> 0 AND (doc_id % 23 = 0 OR doc_id % 29 = 0)) AS missing",
    "tree_paths": "SELECT CAST(doc_id + 1000 AS INTEGER) AS filter_id, substr(source, 4) || '/' || doc_id AS path, CAST(doc_id AS INTEGER) AS genome_id FROM documents",
    "bloom_sizing": using(G_MZ, F_MZ, CAPS, FILTERS) + "SELECT filter_id, capacity, shards, bits, hashes FROM filters",
    "bloom_probes": using(BLOOM, PROBES) + "SELECT filter_id, 0 AS shard, count(*) AS n_probes, CAST(sum(bit) AS BIGINT) AS bit_sum FROM bit GROUP BY filter_id",
    "bloom_bits": using(STATS) + "SELECT filter_id, 0 AS shard, set_bits FROM sb",
    "bloom_contains": using(STATS, I_MZ, murmur_steps("im", "item_id, mz", "hi"), "ip AS (SELECT item_id, filter_id, mz, hashes, (h0 % bits + unnest(range(0, hashes)) * greatest(h1 % bits, 1)) % bits AS bit FROM hi CROSS JOIN filters), db AS (SELECT DISTINCT filter_id, bit FROM bit), ic AS (SELECT item_id, filter_id, mz FROM ip JOIN db USING (filter_id, bit) GROUP BY item_id, filter_id, mz, hashes HAVING count(*) = hashes)")
    + "SELECT item_id, filter_id, count(*) AS hits FROM ic GROUP BY 1, 2",
    "bloom_estimate": using(STATS) + "SELECT filter_id, set_bits, estimate FROM est",
    "bloom_fpp": using(G_MZ, F_MZ, CAPS, FILTERS, "ins AS (SELECT filter_id, count(*) AS inserted FROM gm JOIN g USING (genome_id) GROUP BY filter_id)") + "SELECT filter_id, inserted, round(pow(1 - exp(-hashes * CAST(inserted AS DOUBLE) / bits), hashes), 9) AS rate FROM ins JOIN filters USING (filter_id)",
    "filter_capacity": using(G_MZ, F_MZ, CAPS) + "SELECT filter_id, capacity FROM caps",
    "cluster_elements": using(STATS, "mem AS (SELECT filter_id, count(*) AS n_members FROM g GROUP BY filter_id)") + "SELECT filter_id, CASE WHEN n_members = 1 THEN capacity ELSE CAST(floor(CAST((CAST(capacity AS REAL) + CAST(estimate AS REAL)) / CAST(2 AS REAL) AS DOUBLE) + 0.5) AS BIGINT) END AS n_elements FROM est JOIN mem USING (filter_id)",
    "read_minimizers": using(GENOMES, READS, minimizers("r", "read_id", "rm")) + "SELECT read_id, count(*) AS n_minimizers, CAST(sum(mz % 1000003) AS BIGINT) AS mz_sum FROM rm GROUP BY read_id",
    "node_hits": using(LEVEL1) + "SELECT read_id, filter_id, hits FROM all1",
    "match_score": using(LEVEL1) + "SELECT read_id, filter_id, round(CAST(score AS DOUBLE), 4) AS score FROM sc1",
    "best_child": using(LEVEL1) + "SELECT read_id, filter_id, hits, round(CAST(score AS DOUBLE), 4) AS score FROM top1",
    "classify_reads": using(LEVEL2) + "SELECT read_id, genome_id, hits, n_minimizers, round(CAST(score AS DOUBLE), 4) AS score FROM top2",
    "accept_reads": using(LEVEL2) + "SELECT read_id, accepted, round(CAST(conf AS DOUBLE), 5) AS confidence, round(CAST(match AS DOUBLE), 5) AS perc_match FROM ok",
    "class_reads": using(LEVEL2) + "SELECT read_id, CASE WHEN accepted THEN name ELSE '?' END AS geno_id, hits || '.0|' || n_minimizers AS matches FROM ok JOIN g USING (genome_id)",
    "class_genomes": using(SUMMARY) + "SELECT genome_id, name, round(least(100.0, 100.0 * n_distinct / CAST(n_minimizers AS DOUBLE)), 6) AS coverage, round(n_hits / CAST(n_distinct AS DOUBLE), 6) AS depth FROM su JOIN n USING (genome_id) JOIN g USING (genome_id)",
    "index_hits": using(INDEX) + f"SELECT '@' || (rk // {READ_PLACES}) || '_' || (rk % {READ_PLACES}) AS read_id, filter_id, hits FROM hits1",
    "index_classify": using(BY_FILTERS) + f"""SELECT '@' || (r.rk // {READ_PLACES}) AS read_id, CASE WHEN conf >= CAST({THRESHOLD} AS REAL) THEN name ELSE '?' END AS geno_id, coalesce(hits, 0) || '.0|' || coalesce(n_minimizers, 0) AS matches, round(coalesce(CAST(conf AS DOUBLE), 0), 5) AS confidence
FROM r LEFT JOIN rn USING (rk) LEFT JOIN top2 USING (rk) LEFT JOIN gg USING (genome_id)""",
    "theta_card": using(SKETCHES, THRESHOLDS) + f"SELECT genome_id, {estimate('n - CASE WHEN theta IS NULL THEN 0 ELSE 1 END', 'theta')} AS estimate FROM th",
    "sketch_rows": using(SKETCHES) + "SELECT genome_id, count(*) AS n, min(u) AS least, max(u) AS greatest, CAST(sum(u % 1000003) AS BIGINT) AS u_sum FROM sk GROUP BY genome_id",
    "union_sketch": using(SKETCHES, THRESHOLDS, UNIONS) + f"SELECT filter_id, {estimate('count(*)', 'theta')} AS estimate FROM un JOIN ut USING (filter_id) WHERE theta IS NULL OR u < theta GROUP BY filter_id, theta",
    "sketch_similarity": using(SKETCHES, THRESHOLDS, PAIRS, SKETCHED_PAIRS) + f"SELECT a, b, n_a, n_b, {estimate('count(*)', 'theta')} AS shared FROM kp JOIN sk x ON x.genome_id = a JOIN sk y ON y.genome_id = b AND y.u = x.u WHERE theta IS NULL OR x.u < theta GROUP BY a, b, n_a, n_b, theta",
    "slot_rows": using(SKETCHES, PAIRS, SIGNED) + "SELECT genome_id, count(*) AS n_slots, max(least) AS last, CAST(sum((least % 1000003) * (slot + 1)) AS BIGINT) AS place_sum FROM sg GROUP BY genome_id",
    "slot_jaccard": using(SKETCHES, PAIRS, SIGNED) + f"SELECT a, b, equal, round(equal / {float(SLOTS)}, 9) AS jaccard FROM eq",
    "pair_classes_sketch": using(SKETCHES, PAIRS, SIGNED, FEW) + "SELECT p.a, p.b, CASE WHEN fs.a IS NOT NULL THEN 2 WHEN eq.a IS NOT NULL THEN 3 ELSE 1 END AS class FROM pairs p LEFT JOIN fs ON fs.a = p.a AND fs.b = p.b LEFT JOIN eq ON eq.a = p.a AND eq.b = p.b",
    "counter_rows": using(G_MZ, F_MZ, murmur_steps("fm", "filter_id, mz", "hm"), registers_sql("hm", "filter_id")) + "SELECT filter_id, count(*) AS held, CAST(sum(rank) AS BIGINT) AS rank_sum, CAST(sum(bucket * rank) AS BIGINT) AS place_sum, CAST(sum(n) AS BIGINT) AS n FROM reg GROUP BY filter_id",
    "genome_coverage_sketch": using(SUMMARY, murmur_steps("own", "genome_id, mz", "hm"), registers_sql("hm", "genome_id")) + f"SELECT genome_id, {counter_sql()} AS n_distinct FROM (SELECT genome_id, sum(pow(2.0, -rank)) AS s, count(*) AS held FROM reg GROUP BY genome_id)",
    "genome_coverage": using(SUMMARY) + "SELECT genome_id, n_distinct, n_hits FROM su",
}
