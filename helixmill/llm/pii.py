"""Personal data by patterns, checksums and context words, on DataFrame functions only.

Patterns propose spans, leftmost and without overlap within a kind. Validators confirm them: number ranges for
addresses, Luhn for cards, digit counts for phones, mod-97 for bank accounts. Context words near a span raise its
score; kinds without a checksum (`ssn`, `secret`) need such words. Positions are code points, ends exclusive.

What is kept of a match are its ends, so time follows the text and the number of its spans, not their product.
Every pattern starts at \\G and skips forward itself, so a text is walked once; quantifiers that can run over long
stretches are possessive. Texts without the characters that a kind needs are not searched for it.

Defined cases: a null text is empty and has no spans; repeated rows are judged alike; other columns are kept, but one
named pii, which the result's replaces. All is row-local: no shuffle, no key, no skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "secret", "ssn")

#: Characters of a bank account number by its country (fixed values).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "(?:" + "|".join(rf"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items()) + ")"

#: kind: (cheap need, what may not precede a first character, pattern)
PATTERNS = {
    "email": ("@", "[A-Za-z0-9._%+-]", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", "[0-9]", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"(?:[0-9][\x20-]?){12}", "", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", "", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": (r"[A-Z]{2}[0-9]{2}", "[A-Za-z0-9_]", IBAN + "(?![A-Za-z0-9_])"),
    "secret": (r"[A-Za-z0-9_/+=-]{20}", "[A-Za-z0-9_/+=-]", r"[A-Za-z0-9_/+=-]{20,}+"),
    "ssn": (r"[0-9]-[0-9]{2}-[0-9]", "[0-9-]", r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
#: Words that speak for a kind when they stand near (fixed values).
CONTEXT = {
    "email": r"(?i)e-?mail|contact|mailto|write to",
    "ip": r"(?i)\bip\b|address|host|server|login",
    "card": r"(?i)card|visa|master|amex|credit|payment",
    "phone": r"(?i)phone|tel\b|call|mobile|fax|contact",
    "iban": r"(?i)iban|account|bank|konto|transfer",
    "secret": r"(?i)token|secret|password|passwd|api[-_ ]?key|credential",
    "ssn": r"(?i)ssn|social security|tax id",
}
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "secret": 0.2, "ssn": 0.2}
CONTEXT_BONUS, CONTEXT_CHARS, THRESHOLD = 0.4, 40, 0.5
#: Elements of an array that a fold gathers at a time, and characters that a text is cut into before many of its parts are taken.
BLOCK, CUT = 256, 1024
#: Spans up to which a text is looked at again for each.
FEW = 64

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")),
        lambda a, d: F.struct(
            (a["sum"] + F.when(a["i"] % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).alias("sum"),
            (a["i"] + 1).alias("i"),
        ),
        lambda a: a["sum"],
    )
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number's check digits hold; letters count as 10 to 35."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    value = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return value == 1


def confirmed(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda x: F.length(F.regexp_replace(x, "^0+(?=[0-9])", "")).between(1, 3) & (F.regexp_extract(x, "([0-9]{1,3})$", 1).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(found)
    if kind == "secret":
        return found.rlike("[0-9]") & found.rlike("[A-Za-z]")
    return F.lit(True)


def spans_of(kind: str, text: Column) -> Column:
    """The confirmed spans of a kind with their scores."""
    need, before, pattern = PATTERNS[kind]
    skip = rf"(?:|.*?(?<!{before}))" if before else ".*?"
    stretch = rf"(?s)\G{skip}({pattern})"
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(stretch), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(stretch), F.lit(1)).alias("found"))
    spans = let(parts, lambda parts: F.when(F.size(parts) <= FEW, few_spans(kind, parts, text)).otherwise(many_spans(kind, parts, text)))
    return F.when(text.rlike(need), spans).otherwise(F.array().cast(SPAN))


def span(kind: str, start: Column, end: Column, near: Column) -> Column:
    score = F.lit(BASE_SCORE[kind]) + F.when(near.rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)
    return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score"))


def few_spans(kind: str, parts: Column, text: Column) -> Column:
    """The confirmed ones of a few stretches; each looks at the text for what stands near."""
    none = F.array().cast("array<struct<end:int,found:string>>")
    ends = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["all"])).alias("at"),
            F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(x["all"])).alias("end"), x["found"].alias("found")))).alias("spans"),
        ),
        lambda a: a["spans"],
    )

    def scored(x: Column) -> Column:
        start = x["end"] - F.length(x["found"])
        return span(kind, start, x["end"], F.concat(F.substring(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS))), F.lit(" "), F.substring(text, x["end"] + 1, F.lit(CONTEXT_CHARS))))

    return sure(kind, F.transform(F.filter(ends, lambda x: confirmed(kind, x["found"])), scored))


def sure(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda x: x["score"] >= THRESHOLD) if kind in EXTRA_KINDS else spans


def many_spans(kind: str, parts: Column, text: Column) -> Column:
    """The same of any number of stretches: only their ends and lengths are kept, so none looks at the text again."""
    short = F.transform(
        parts,
        lambda x: F.struct(
            F.length(x["all"]).alias("size"),
            x["found"].alias("found"),
            first_chars(x["all"]).alias("head"),
            last_chars(x["all"]).alias("tail"),
            last_chars(F.left(x["all"], F.length(x["all"]) - F.length(x["found"]))).alias("skip"),
        ),
    )
    return let(short, lambda parts: let(placed(parts), lambda spans: scored_spans(kind, spans, text)))


def first_chars(x: Column) -> Column:
    return F.substring(x, 1, CONTEXT_CHARS)


def last_chars(x: Column) -> Column:
    return F.substr(x, F.lit(-CONTEXT_CHARS))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold(values: Column, start: Column, kind: str, step) -> Column:
    """Like an aggregate whose state is a number and an array of `kind` that step(at, x) -> (at, elements) adds to, as that array.

    An array that grows in a fold is copied at each step, so blocks of elements are folded for themselves, and their arrays joined once."""

    def run(values: Column, start: Column, kind: str, step) -> Column:
        def add(a: Column, x: Column) -> Column:
            at, more = step(a["at"], x)
            return F.struct(at.alias("at"), F.concat(a["out"], more).alias("out"))

        return F.aggregate(values, F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out")), add)

    def whole(values: Column) -> Column:
        n = F.ceil(F.size(values) / BLOCK).cast("int")
        numbers = F.slice(F.sequence(F.lit(0), n), 1, n)

        def block(at: Column, b: Column) -> tuple[Column, Column]:
            own = run(F.slice(values, b * BLOCK + 1, BLOCK), at, kind, step)
            return own["at"], F.array(own["out"])

        return run(numbers, start, f"array<{kind}>", block)

    return let(values, lambda v: let(whole(v), lambda done: F.struct(done["at"].alias("at"), F.flatten(done["out"]).alias("out"))))


def placed(parts: Column) -> Column:
    """parts (size, more) with `end`, the sum of the sizes up to them."""
    ends = fold(parts, F.lit(0), "int", lambda at, x: (at + x["size"], F.array(at + x["size"])))["out"]
    return F.zip_with(parts, ends, lambda x, end: x.withField("end", end))


def scored_spans(kind: str, parts: Column, text: Column) -> Column:
    """The confirmed ones of a kind's stretches as spans. What stands near is put together from the ends of neighbours, which have 2 characters at least."""
    n = CONTEXT_CHARS // 2
    joined_ = lambda some, name: F.array_join(F.transform(some, lambda y: y[name]), "")

    def scored(x: Column, i: Column, rest: Column) -> Column:
        before = F.when(F.length(x["skip"]) == CONTEXT_CHARS, x["skip"]).otherwise(last_chars(F.concat(joined_(F.slice(parts, F.greatest(i - n, F.lit(0)) + 1, F.least(i, F.lit(n))), "tail"), x["skip"])))
        after = first_chars(F.concat(joined_(F.slice(parts, i + 2, n), "head"), F.when(i + n >= F.size(parts) - 1, rest).otherwise("")))
        return F.when(confirmed(kind, x["found"]), span(kind, x["end"] - F.length(x["found"]), x["end"], F.concat(before, F.lit(" "), after)))

    rest = first_chars(F.substr(text, F.get(parts, F.size(parts) - 1)["end"] + 1))
    return sure(kind, F.filter(let(rest, lambda rest: F.transform(parts, lambda x, i: scored(x, i, rest))), lambda x: x.isNotNull()))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `pii`: array of (kind, start, end, score), by kind as listed, then by start."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("pii", F.concat(*[spans_of(k, t) for k in BASE_KINDS + EXTRA_KINDS]))


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of `text` replaced by its kind in brackets; spans that overlap go as one, under the first's kind."""
    found = find_pii(docs, text)
    ordered = F.array_sort(F.transform("pii", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    source = F.col(f"`{text}`")
    kind = "struct<a:int,b:int,name:string>"
    gap = lambda a, b, name: F.array(F.struct(a.alias("a"), b.alias("b"), F.concat(F.lit("["), F.upper(name), F.lit("]")).alias("name")))
    step = lambda at, x: (F.greatest(at, x["end"]), F.when(x["start"] >= at, gap(at, x["start"], x["kind"])).otherwise(F.array().cast(f"array<{kind}>")))
    cuts = F.regexp_extract_all(source, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    few = let(fold(ordered, F.lit(0), kind, step), lambda done: F.concat(F.array_join(F.transform(done["out"], lambda x: F.concat(F.substring(source, x["a"] + 1, x["b"] - x["a"]), x["name"])), ""), F.substring(source, done["at"] + 1, F.length(source))))
    many = let(fold(ordered, F.lit(0), kind, step), lambda done: let(cuts, lambda cuts: _rebuilt(done, cuts)))
    return found.withColumn(text, F.when(F.size("pii") == 0, source).when(F.size("pii") <= FEW, few).otherwise(many))


def _rebuilt(done: Column, cuts: Column) -> Column:
    """The text, given in cuts, with the gaps (a, b) between the spans, each followed by a name, and what is behind the last span."""

    def part(a: Column, b: Column) -> Column:
        first = F.floor(a / CUT).cast("int")
        whole = F.array_join(F.slice(cuts, first + 1, F.floor(b / CUT).cast("int") - first + 1), "")
        return F.substring(whole, a - first * CUT + 1, b - a)

    end = F.size(cuts) * CUT
    return F.concat(F.array_join(F.transform(done["out"], lambda x: F.concat(part(x["a"], x["b"]), x["name"])), ""), part(done["at"], end))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    found = find_pii(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))
