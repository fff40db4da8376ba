"""The source divergence audit against plain dictionaries, with tiles, blocks and light terms of every size."""

import random
import re
from collections import Counter, defaultdict

import pytest

from helixmill.llm import source_divergence as sd

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, min_docs, top=sd.TOP):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs:
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        whole = sum(groups.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + sd.SCALE * (c[t] + sd.SMOOTHING) // (total + sd.SMOOTHING * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def audit(spark, rows, schema=SCHEMA, **options):
    out = sd.divergence_report(spark.createDataFrame(rows, schema), **options)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in out.collect())


def made(n, sources, seed):
    """Texts in which some words are everywhere and others in few sources; '' and None among languages, sources and texts."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = min(rng.randrange(sources), rng.randrange(sources))
        words = [rng.choice(["The", "the", "of", "Ünd", "ünd", "日本"]) for _ in range(rng.randrange(12))] + [f"own{'abcdefghij'[s % 10]}{'xyz'[rng.randrange(3)]}"] * rng.randrange(4) + [f"pair{'pqrstuv'[(s + rng.randrange(2)) % 7]}"]
        rng.shuffle(words)
        text = None if i % 17 == 0 else "" if i % 19 == 0 else rng.choice([" ", "1", ",\n", "-"]).join(words)
        rows.append((i, text, rng.choice(["en", "de", None, ""]), f"s{s}" if s else rng.choice([None, ""])))
    return rows


@pytest.mark.parametrize(("light", "tile", "block", "light_block"), [(16, 128, 2048, 1 << 16), (2, 2, 3, 2), (0, 3, 1, 1), (1000, 1, 2048, 4)])
def test_equals_brute_force(spark, monkeypatch, light, tile, block, light_block):
    for name, value in {"LIGHT_GROUPS": light, "TILE": tile, "BLOCK": block, "LIGHT_BLOCK": light_block}.items():
        monkeypatch.setattr(sd, name, value)
    rows = made(400, 9, light)
    want = brute(rows, 5, 7)
    assert sum(r[2] == "pair" and r[4] > 0 for r in want) > 50 and sum(r[2] == "term" for r in want) > 50
    assert audit(spark, rows, min_docs=5, top=7) == want


def test_pieces_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 64)
    rows = made(120, 4, 1) + [(900, "long word " * 20_000, "en", "s1"), (901, "x" * 300_000, "en", "s2")]
    assert audit(spark, rows, min_docs=3) == brute(rows, 3)


def test_nothing_kept(spark):
    rows = [(1, "one two", "en", "a"), (2, None, "en", "b"), (3, "", "de", "a"), (3, "", "de", "a")]
    assert audit(spark, rows, min_docs=3) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert audit(spark, [], min_docs=3) == []


def test_ties_and_repeated_rows(spark):
    """Equal values rank by the UTF-8 of the item; rows given twice count twice."""
    rows = [(1, "a b", "en", s) for s in ("é", "z", "a", "Z")] * 2
    got = audit(spark, rows, min_docs=2)
    assert got == brute(rows, 2)
    assert [r[3] for r in sorted(got, key=lambda r: r[5]) if r[1] == "a"] == ["Z", "z", "é"]


def test_other_columns_clash(spark):
    names = ["n", "p", "q", "m", "i", "j", "idx", "block", "term", "docs", "a.b", "value"]
    rows = made(80, 3, 2)
    wide = [(*r, *[str(k) for k in range(len(names))]) for r in rows]
    schema = SCHEMA + "".join(f", `{c}` string" for c in names)
    assert audit(spark, wide, schema, min_docs=3) == brute(rows, 3)
