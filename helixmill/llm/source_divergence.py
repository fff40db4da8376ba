"""Source divergence audit: how far the sources of a language are from each other, and the terms that set a source apart.

Shares of terms are whole numbers of billionths, smoothed, so every sum is exact whatever its order. For two sources with
smoothed shares p and, for a term that a source lacks, its base share b, the distance over all V kept terms is

    V |b1 - b2|  +  the sum over occurring terms of  |p1 - p2| - |b1 - b2|.

The sum is split by how many groups hold a term. Heavy terms (more than LIGHT_GROUPS groups) fill dense numpy tiles: blocks
of terms by tiles of sources, one group of rows each, of bounded size. Light terms are taken from sparse postings: what a
source's own terms add against another's base needs only a histogram of its shares (prefix sums, one search for a base);
terms that both sources have are then corrected pair by pair, within the few groups of a posting. The partial sums meet
in one aggregation.

Defined cases: null text, lang and source are ''. A text without terms counts as a document and makes its group occur. A
language without kept terms has pairs of value 0 and no terms; one with a single source has no pairs. Repeated rows and ids
count as often as they stand there. Further columns, of any name, are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from helixmill.llm.common import LOWER, chunks, keep, spans, text_bytes

MIN_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Groups that a light term is in, at most; pairs of a posting are bounded by its square.
LIGHT_GROUPS = 16
#: Terms of a dense block, about; terms whose shares make one histogram; sources of a tile.
BLOCK, LIGHT_BLOCK, TILE = 2048, 1 << 16, 128
#: Text bytes whose terms are counted together.
PIECE = 8 << 20

IS_TERM = np.zeros(256, bool)
IS_TERM[65:91] = IS_TERM[97:123] = IS_TERM[128:] = True

COUNTS = "lang string, source string, term string, n long, docs long"


def _count(data: np.ndarray, offsets: np.ndarray, group: np.ndarray):
    """(group, dictionary of terms, code, n, docs) of some rows' text: each term of each group once."""
    own = LOWER[data]
    is_term = IS_TERM[own]
    starts, ends = spans(is_term, offsets)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(own[is_term])]).dictionary_encode()
    width = max(1, len(words.dictionary))
    doc = np.searchsorted(offsets, starts, "right") - 1
    seen, times = np.unique(doc * width + words.indices.to_numpy(), return_counts=True)
    key = group[seen // width] * width + seen % width
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    edge = np.flatnonzero(np.diff(key, prepend=-1))
    sums = np.add.reduceat(times, edge) if len(edge) else times
    return key[edge] // width, words.dictionary, key[edge] % width, sums, np.diff(np.append(edge, len(key)))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group; pieces of text are counted before anything is shuffled."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            names = [batch.column(c).dictionary_encode() for c in ("lang", "source")]
            codes = [x.indices.to_numpy() for x in names]
            n_sources = max(1, len(names[1].dictionary))
            group = codes[0].astype(np.int64) * n_sources + codes[1]
            for a, b in chunks(offsets, PIECE):
                owner, words, code, n, n_docs = _count(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], group[a:b])
                columns = [names[0].dictionary.take(pa.array(owner // n_sources)), names[1].dictionary.take(pa.array(owner % n_sources)), words.take(pa.array(code)).cast(pa.string()), pa.array(n, pa.int64()), pa.array(n_docs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    parts = _named(docs, text, lang, source).mapInArrow(run, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _named(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))])


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """counts of terms that a language has in min_docs documents, with lang_n (occurrences there), n_groups (groups that hold the term) and first (one row of each term)."""
    term = Window.partitionBy("lang", "term")
    out = counts.withColumns({"lang_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "n_groups": F.count("*").over(term), "first": F.min("source").over(term) == F.col("source")})
    return out.where(F.col("lang_docs") >= min_docs).drop("docs", "lang_docs")


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE (n + SMOOTHING) / (total + SMOOTHING v)), without overflow; 0 where no term is kept."""
    wide = lambda x: x.cast("decimal(20,0)")
    below = F.nullif(wide(total + SMOOTHING * v), wide(F.lit(0)))
    return F.coalesce(F.call_function("div", wide(n + SMOOTHING) * F.lit(SCALE).cast("decimal(10,0)"), below) + 1, F.lit(0).cast("long"))


def audit_tables(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, terms). groups: lang, source, idx (of the source in its language), tile, v, heavy, light, base, lang_total, n_tiles.
    terms: a row for each kept term of each group, with n, p (the group's share), q (the language's) and n_groups."""
    kept = keep(kept_terms(term_counts(docs, text, lang, source), min_docs), "divergence-terms")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    light = F.col("n_groups") <= LIGHT_GROUPS
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("v"), F.count_if(F.col("first") & ~light).alias("heavy"), F.count_if(F.col("first") & light).alias("light"))
    named = _named(docs, text, lang, source).select("lang", "source").distinct()
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total", "lang_total", "v", "heavy", "light")}
    groups = named.join(own, ["lang", "source"], "left").join(langs, "lang", "left").withColumns(zero)
    groups = groups.withColumns({"idx": F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1, "base": share(F.lit(0).cast("long"), F.col("total"), F.col("v"))})
    groups = groups.withColumns({"tile": F.expr(f"idx div {TILE}"), "n_tiles": F.expr(f"max(idx) over (partition by lang) div {TILE} + 1")})
    groups = keep(groups, "divergence-groups")
    terms = kept.drop("first").join(groups.select("lang", "source", "idx", "tile", "n_tiles", "total", "lang_total", "v", "heavy", "light"), ["lang", "source"])
    return groups, terms.withColumns({"p": share(F.col("n"), F.col("total"), F.col("v")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("v"))})


def distinctive_terms(terms: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): terms that a group has more often than its language, by how much more."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    found = terms.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


# ---- pairs of sources ----

PARTS = "lang string, a long, b long, value long"


def _to_tiles(rows: DataFrame) -> DataFrame:
    """rows (tile, n_tiles, more), once for every pair of tiles (i <= j) that has theirs."""
    other = rows.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tiles") - 1)))
    return other.withColumns({"i": F.least("tile", "__other"), "j": F.greatest("tile", "__other")}).drop("__other", "n_tiles")


def _pairs(left: np.ndarray, right: np.ndarray, same: bool, sums: np.ndarray, lang: str) -> pa.Table:
    """The sums of a tile pair as rows with a < b."""
    x, y = np.triu_indices(len(left), 1) if same else (np.repeat(np.arange(len(left)), len(right)), np.tile(np.arange(len(right)), len(left)))
    a, b = left[x], right[y]
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a), "b": pa.array(b), "value": pa.array(sums[x, y])})


def _tile(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """A block's part of the sums, for the sources of two tiles. Rows without a share (p) give the sources' bases."""
    lang, i, j, block = (k.as_py() for k in key)
    column = lambda c: rows.column(c).to_numpy()
    idx, tile, base = (column(c) for c in ("idx", "tile", "base"))
    m = column("m")
    is_base = m == 0
    order = np.argsort(idx[is_base])
    known, bases, tiles = idx[is_base][order], base[is_base][order], tile[is_base][order]
    left, right = np.flatnonzero(tiles == i), np.flatnonzero(tiles == j)
    apart = np.abs(bases[left][:, None] - bases[right][None, :])
    sums = np.zeros((len(left), len(right)), np.int64)
    at, p = np.searchsorted(known, idx[~is_base]), column("p")[~is_base]
    if block >= 0:  # heavy: a dense matrix of shares
        term = rows.column("term").filter(pa.array(~is_base)).combine_chunks().dictionary_encode()
        shares = np.repeat(bases[:, None], len(term.dictionary), 1)
        shares[at, term.indices.to_numpy()] = p
        for k, x in enumerate(left):
            sums[k] = np.abs(shares[x] - shares[right]).sum(1)
        sums -= len(term.dictionary) * apart
    else:
        sums += _one_sided(at, p, m[~is_base], left, right, bases)
        if i == j:
            sums += sums.T.copy()
        else:
            sums += _one_sided(at, p, m[~is_base], right, left, bases).T
        if block == -1:  # the first one adds what all terms would, were they in neither group
            sums += rows.column("v")[0].as_py() * apart
    return _pairs(known[left], known[right], i == j, sums, lang)


def _one_sided(at: np.ndarray, p: np.ndarray, m: np.ndarray, own: np.ndarray, others: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """For each source of own, the sum of m (|p - b| - |its base - b|) over its histogram rows, for the base b of each of others."""
    out = np.zeros((len(own), len(others)), np.int64)
    order = np.lexsort((p, at))
    at, p, m = at[order], p[order], m[order]
    for k, x in enumerate(own):
        a, b = np.searchsorted(at, [x, x + 1])
        q, n = p[a:b], m[a:b]
        count, weight = (np.concatenate([[0], np.cumsum(y)]) for y in (n, n * q))
        cut, theirs = np.searchsorted(q, bases[others]), bases[others]
        out[k] = weight[-1] - 2 * weight[cut] - theirs * (count[-1] - 2 * count[cut]) - count[-1] * np.abs(bases[x] - theirs)
    return out


def _corrections(batches) -> Iterator[pa.RecordBatch]:
    """For light terms (lang, postings: structs of idx, p and base, by idx): what pairs that both have a term are off by, summed over a batch."""
    for batch in batches:
        langs, lists = batch.column("lang").dictionary_encode(), batch.column("postings")
        sizes, flat = lists.value_lengths().to_numpy(), lists.flatten()
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        idx, p, base = (flat.field(c).to_numpy() for c in ("idx", "p", "base"))
        codes, keys, values = langs.indices.to_numpy(), [], []
        for size in np.unique(sizes[sizes > 1]):
            rows = np.flatnonzero(sizes == size)
            cell = starts[rows][:, None] + np.arange(size)
            x, y = np.triu_indices(size, 1)
            a, b = cell[:, x].ravel(), cell[:, y].ravel()
            keys.append(np.stack([np.repeat(codes[rows], len(x)), idx[a], idx[b]], 1))
            values.append(np.abs(p[a] - p[b]) + np.abs(base[a] - base[b]) - np.abs(p[a] - base[b]) - np.abs(p[b] - base[a]))
        if keys:
            key, inverse = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
            sums = np.zeros(len(key), np.int64)
            np.add.at(sums, inverse.ravel(), np.concatenate(values))
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key[:, 0])), pa.array(key[:, 1]), pa.array(key[:, 2]), pa.array(sums)], names=["lang", "a", "b", "value"])


def source_distances(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): the distance to each other source of the language; the farthest first."""
    light = F.col("n_groups") <= LIGHT_GROUPS
    blocks = F.ceil(F.col("heavy") / BLOCK)
    light_blocks = F.greatest(F.lit(1), F.ceil(F.col("light") / LIGHT_BLOCK))
    by = lambda n: F.pmod(F.xxhash64("term"), n)
    none = F.lit(0).cast("long")
    columns = ["lang", "idx", "tile", "n_tiles", "block", "term", "p", "m", "base", "v"]
    dense = terms.where(~light).select("lang", "idx", "tile", "n_tiles", by(blocks).alias("block"), "term", "p", F.lit(1).cast("long").alias("m"), none.alias("base"), "v")
    sparse = terms.where(light).groupBy("lang", "idx", "tile", "n_tiles", (-1 - by(light_blocks)).alias("block"), "p", "v").agg(F.count("*").alias("m"))
    sparse = sparse.select("lang", "idx", "tile", "n_tiles", "block", F.lit(None).cast("string").alias("term"), "p", "m", none.alias("base"), "v")
    bases = groups.withColumn("block", F.explode(F.sequence(-light_blocks, blocks - 1))).select("lang", "idx", "tile", "n_tiles", "block", F.lit(None).cast("string").alias("term"), none.alias("p"), none.alias("m"), "base", "v")
    rows = _to_tiles(dense.unionByName(sparse).unionByName(bases).select(*columns))
    tiled = rows.groupBy("lang", "i", "j", "block").applyInArrow(_tile, PARTS)
    posted = terms.where(light & (F.col("n_groups") > 1)).withColumn("base", share(none, F.col("total"), F.col("v")))
    postings = posted.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("idx", "p", "base"))).alias("postings"))
    corrected = postings.select("lang", "postings").mapInArrow(_corrections, PARTS)
    sums = tiled.unionByName(corrected).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("o")).select("lang", "o.x", "o.y", "value")
    names = lambda key, name: groups.select("lang", F.col("idx").alias(key), F.col("source").alias(name))
    out = both.join(names("x", "source"), ["lang", "x"]).join(names("y", "item"), ["lang", "y"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return out.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(order))


def divergence_report(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    groups, terms = audit_tables(docs, text, lang, source, min_docs)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(source_distances(groups, terms), "pair").unionByName(part(distinctive_terms(terms, top), "term"))
