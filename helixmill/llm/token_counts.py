"""Unigram token counts by dynamic programming over a trie of pre-tokens.

A task's distinct pre-tokens go into a trie (walked as the sorted list, with the nodes of the current path on a
stack). A node's forward score, the best unigram score of its prefix, is computed once however many pre-tokens share
the prefix, and a pre-token's token count is stored at its terminal. Documents then add up the counts of their
pre-tokens; a worker holds on to the counts of a bounded number of them from one trie to the next. At each byte only those
lengths are tried that pieces with these last three bytes have. The vocabulary is a byte-level one with ranks; a piece of rank r scores -ln(r + 2) - ln(ln(size)), a
Zipf prior, since a rank list carries no probabilities. Equal scores prefer fewer tokens.

Defined cases: a null or empty text has no tokens; repeated rows count alike; a very long pre-token costs some lookups a
byte; further columns are kept, but those named as the result's, which replace them. Row-local: no shuffle, no key, and
whole texts always.
"""

from __future__ import annotations

import hashlib
import json
import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from helixmill.llm.common import append_columns

#: Text bytes whose distinct pre-tokens share one trie; bounds a task's memory.
TRIE_BYTES = 8 << 20

#: Pre-tokens whose counts a worker holds on to, at most (and those of one trie more).
HELD_TOKENS = 600_000

FIELDS = T.StructType([T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("log_score", T.DoubleType())])


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def parse_ranks(vocabulary: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Pieces with their ids, and special tokens with theirs, from a byte-level vocabulary file's content."""
    found = json.loads(vocabulary)
    special = {t["content"]: t["id"] for t in found.get("added_tokens", [])}
    letters = byte_letters()
    return {bytes(letters[c] for c in piece): i for piece, i in found["model"]["vocab"].items() if piece not in special}, special


@lru_cache(maxsize=2)
def read_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    with open(path, encoding="utf-8") as f:
        return parse_ranks(f.read())


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def piece_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    norm = math.log(math.log(max(3, len(ranks))))
    return {piece: -math.log(rank + 2) - norm for piece, rank in ranks.items()}


def lengths_by_end(scores: dict[bytes, float]) -> dict[bytes, tuple[int, ...]]:
    """The lengths (from 3 on, ascending) of the pieces that end in three bytes."""
    out: dict[bytes, set[int]] = {}
    for piece in scores:
        if len(piece) > 2:
            out.setdefault(piece[-3:], set()).add(len(piece))
    return {end: tuple(sorted(n)) for end, n in out.items()}


def trie_counts(pretokens, scores: dict[bytes, float], lengths: dict[bytes, tuple[int, ...]]) -> dict[bytes, tuple[int, float]]:
    """Each distinct pre-token's tokens and score; prefixes that several share are scored once."""
    out: dict[bytes, tuple[int, float]] = {}
    best, count = [0.0], [0]  # by node of the current path
    before = b""
    get, sizes, low, short = scores.get, lengths.get, float("-inf"), (1, 2)
    for token in sorted(pretokens):
        n = min(len(before), len(token))
        if before[:n] == token[:n]:
            shared = n
        else:
            shared = next(i for i in range(n) if before[i] != token[i])
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(token) + 1):
            top, used = low, 0
            for size in short[:end] + (sizes(token[end - 3 : end], ()) if end > 2 else ()):
                if size > end:
                    break
                s, begin = get(token[end - size : end]), end - size
                if s is not None and best[begin] > low:
                    s += best[begin]
                    if s > top or (s == top and count[begin] + 1 < used):
                        top, used = s, count[begin] + 1
            best.append(top)
            count.append(used)
        out[token] = (count[-1], best[-1])
        before = token
    return out


_tables: dict[str, tuple] = {}


def tables(key: str, ranks: dict[bytes, int], pattern: str) -> tuple:
    """Scores, lengths, the splitter, and what is held of pre-tokens' counts and scores; one vocabulary's stay in a worker from task to task."""
    if key not in _tables:
        import regex

        _tables.clear()
        scores = piece_scores(ranks)
        _tables[key] = scores, lengths_by_end(scores), regex.compile(pattern).findall, {}, {}
    return _tables[key]


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_pretokens, n_tokens and log_score, under the vocabulary at `path` (read here, sent to the tasks)."""
    ranks, _ = read_ranks(path or vocabulary_path())
    pattern = split_pattern()
    key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast((key, ranks, pattern))

    def start():
        scores, lengths, find, tokens, score = tables(*sent.value)

        def work(data, offsets):
            whole = data.tobytes()
            rows = [find(whole[a:b].decode("utf-8", "replace")) for a, b in zip(offsets, offsets[1:])]
            if len(tokens) > HELD_TOKENS:
                tokens.clear()
                score.clear()
            coded = {t.encode(): t for t in {t for row in rows for t in row}.difference(tokens)}
            for k, (n, s) in trie_counts(coded, scores, lengths).items():
                tokens[coded[k]], score[coded[k]] = n, s
            return [pa.array([len(r) for r in rows], pa.int64()), pa.array([sum(map(tokens.__getitem__, r)) for r in rows], pa.int64()), pa.array([math.fsum(map(score.__getitem__, r)) for r in rows], pa.float64())]

        return work

    return append_columns(docs, text, FIELDS, start, drop, TRIE_BYTES)


def token_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The digest columns of the registered query."""
    return count_tokens(docs.select("doc_id", "text"), path, drop=("text",))
