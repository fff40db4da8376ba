"""Benchmark decontamination with suffix arrays over the training documents.

Words are runs of ASCII digits, letters (A-Z lower-cased) and all other non-ASCII characters. Each shard (some whole
documents of a task) gets a suffix array of its words, ordered through the window's length by prefix doubling; every
suffix of every test item is looked up in it by binary search. What equals a whole window gives the location, runs of
consecutive windows give the longest verbatim match, and documents with a hit are contaminated.

The test items are broadcast in blocks of bounded size (BLOCK_BYTES; an item isn't divided). A task holds one block at a
time and asks the shard's suffix array, which is built once, with each; so documents are read once, and nothing depends on
the benchmark fitting in memory. The more blocks there are, the larger the shards (up to LARGE_SHARDS times).

Defined cases: null and wordless texts have no words and no hits; an item with fewer words than a window is one
window, without words none; items with equal texts all count; an item without an id counts for hits and the longest
match and is a null in `items`, one more item in the report's number and none in its list of ids; repeated rows are judged alike; further columns are
kept (columns with the result's names are replaced). Matches never cross documents. No shuffle, no key, no skew.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from helixmill.llm.common import LOWER, append_columns, lists, span_hashes, spans, text_bytes

WINDOW = 10
BLOCK_BYTES = 4 << 20  # of item text; a block's arrays take some ten times that in a worker

#: Text bytes of a shard with a suffix array of its own (a text is not divided), and how many times that with many blocks.
SHARD_BYTES, LARGE_SHARDS = 1 << 20, 8

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_starts", T.ArrayType(T.LongType())),
        T.StructField("hit_ends", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.ArrayType(T.LongType())),
        T.StructField("longest_at", T.ArrayType(T.LongType())),
    ]
)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, and each row's first word's index (n + 1 of them)."""
    low = LOWER[data]
    starts, ends = spans(WORD_BYTE[low], offsets)
    return span_hashes(low, starts, ends), np.searchsorted(starts, offsets)


@dataclass
class Block:
    """Some items' words; where their distinct windows begin and how long those are; and (item, place in the item) of each window's uses."""

    names: list[str]
    words: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    use_at: np.ndarray
    use_item: np.ndarray
    use_place: np.ndarray


def block_of(items: list[tuple[str, str]], width: int) -> Block:
    data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
    words, first = words_of(data, offsets)
    per = np.diff(first)
    size = np.minimum(per, width)
    starts, item = expand(first[:-1], np.where(per > 0, per - size + 1, 0))
    lengths = size[item]
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    step = np.arange(width)
    table = np.where(step[None, :] < lengths[:, None], padded[starts[:, None] + step], 0)
    distinct, one, which = np.unique(np.column_stack([table, lengths.astype(np.uint64)]), axis=0, return_index=True, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")
    use_at = np.searchsorted(which.ravel()[order], np.arange(len(distinct) + 1))
    small = lambda x: x.astype(np.int32)  # noqa: E731  a block is far below 2**31 words
    return Block([n for n, _ in items], words, small(starts[one]), small(lengths[one]), small(use_at), small(item[order]), small((starts - first[item])[order]))


def suffix_array(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary, words by number (0 between rows and at the end), and positions in the order of their next `width` words."""
    vocabulary, number = np.unique(words, return_inverse=True)
    n = len(words) + len(first) - 1
    placed = np.arange(len(words)) + np.repeat(np.arange(len(first) - 1), np.diff(first))
    numbers = np.zeros(n + width, np.int64)
    numbers[placed] = number + 1
    depth, ranks = 1, numbers[:n].copy()
    while depth < width:
        further = min(depth, width - depth)  # the last step overlaps: what it compares twice is equal anyway
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - further)] = ranks[further:]
        key = ranks * (int(ranks.max(initial=0)) + 1) + nxt
        _, ranks = np.unique(key, return_inverse=True)
        depth += further
    return vocabulary, numbers, np.argsort(ranks, kind="stable")


def ranges(numbers: np.ndarray, order: np.ndarray, asked: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each asked word sequence, where in the order the suffixes begin and end that start with it."""
    width = asked.shape[1]
    step = np.arange(width)
    unused = step[None, :] >= lengths[:, None]

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            differ = numbers[order[mid][:, None] + step] - asked[open_]
            differ[unused[open_]] = 0
            at = (differ != 0).argmax(axis=1)
            sign = differ[np.arange(len(open_)), at]
            right = sign <= 0 if after else sign < 0
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        return low

    return bound(False), bound(True)


def expand(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of begin..begin+count-1 in turn, and which each comes from."""
    source = np.repeat(np.arange(len(count)), count)
    return begin[source] + np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count), source


class Shard:
    """The words of some documents with their suffix array; hits and matches are gathered block by block."""

    def __init__(self, words: np.ndarray, first: np.ndarray, width: int):
        self.width, self.rows, self.row_at = width, len(first) - 1, first + np.arange(len(first))
        self.vocabulary, self.numbers, self.order = suffix_array(words, first, width)
        self.cover = np.zeros(len(self.numbers) + 1, np.int64)
        self.matches: list[tuple[np.ndarray, ...]] = []

    def ask(self, block: Block) -> None:
        """Looks up all windows of a block: (document, item's name, longest match, its place) of those that meet."""
        if not len(self.vocabulary) or not len(block.lengths):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, block.words), len(self.vocabulary) - 1)
        unknown = np.concatenate([[0], np.cumsum(self.vocabulary[at] != block.words)])
        asked = np.flatnonzero(unknown[block.starts + block.lengths] == unknown[block.starts])
        lengths = block.lengths[asked].astype(np.int64)
        place = np.minimum(block.starts[asked].astype(np.int64)[:, None] + np.arange(self.width), len(at) - 1)
        low, high = ranges(self.numbers, self.order, at[place] + 1, lengths)
        found, source = expand(low, high - low)
        if not len(found):
            return
        window, position, length = asked[source], self.order[found], lengths[source]
        np.add.at(self.cover, position, 1)
        np.add.at(self.cover, position + length, -1)
        # uses of the windows: runs of consecutive places on one diagonal are one verbatim match
        use, hit = expand(block.use_at[window].astype(np.int64), (block.use_at[window + 1] - block.use_at[window]).astype(np.int64))
        item, place, where, length = block.use_item[use], block.use_place[use], position[hit], length[hit]
        d = np.searchsorted(self.row_at, where, "right") - 1
        turn = np.lexsort((where, where - place, item, d))
        d, item, place, where, length = d[turn], item[turn], place[turn], where[turn], length[turn]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (where[1:] != where[:-1] + 1) | (place[1:] != place[:-1] + 1)
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(d)) - 1
        size = where[last] + length[last] - where[begin]
        best = np.lexsort((where[begin], -size, item[begin], d[begin]))
        bd, bi = d[begin][best], item[begin][best]
        top = np.ones(len(bd), bool)
        top[1:] = (bd[1:] != bd[:-1]) | (bi[1:] != bi[:-1])
        self.matches.append((bd[top], np.array(block.names, object)[bi[top]], size[best][top], (where[begin][best] - self.row_at[bd])[top]))

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of hit words: document, start, end."""
        inside = np.concatenate([[False], np.cumsum(self.cover)[:-1] > 0, [False]])
        change = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = change[::2], change[1::2]  # in places that count a gap after each row
        doc = np.searchsorted(self.row_at, starts, "right") - 1
        return doc, starts - self.row_at[doc], ends - self.row_at[doc]

    def met(self) -> list[np.ndarray]:
        """All matches by document: document, item's name, length, place."""
        if not self.matches:
            return [np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        joined = [np.concatenate(x) for x in zip(*self.matches)]
        order = np.argsort(joined[0], kind="stable")
        return [x[order] for x in joined]


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_words, hit_starts/hit_ends (runs of hit words), items (ids as text), and each item's longest match and its place."""
    items = items.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.length("id"), F.lit(0)) + 16)).first()[0] or 0
    n = max(1, -(-2 * size // block_bytes) if size > block_bytes else 1)
    part = lambda k: items if n == 1 else items.where(F.pmod(F.xxhash64(F.coalesce("id", "text")), F.lit(n)) == k)
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(block_of([tuple(r) for r in part(k).collect()], width)) for k in range(n)]

    def start():
        def work(data, offsets):
            words, first = words_of(data, offsets)
            shard = Shard(words, first, width)
            for block in sent:
                shard.ask(block.value)
                if n > 1:
                    vars(block).pop("_value", None)  # a task holds one block at a time
            (doc, a, b), (met, names, size, at) = shard.hits(), shard.met()
            per, of = np.bincount(doc, minlength=shard.rows), np.bincount(met, minlength=shard.rows)
            return [pa.array(np.diff(first)), lists(a, per), lists(b, per), lists(pa.array(names, pa.string()), of), lists(size, of), lists(at, of)]

        return work

    return append_columns(docs, text, FIELDS, start, drop, SHARD_BYTES * min(n, LARGE_SHARDS))


def remove_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    return find_contamination(docs, items, **options).where(F.size("items") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def contamination_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The digest columns of the registered query."""
    found = find_contamination(docs.select("doc_id", "text"), items, drop=("text",), **options)
    hit = F.aggregate(F.zip_with("hit_starts", "hit_ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    ids = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.coalesce(F.array_max("longest"), F.lit(0)).alias("longest_match"),
    )
