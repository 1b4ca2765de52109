"""Personal data: fixed patterns, and bootstrapped contextual extraction.

What the fixed patterns find are the seeds. An identifier (a word with an at sign, a word with digits, or groups of
digits side by side) and its lexical patterns (two words on one side, or the next word and the class of
the identifier) make the edges of a graph. Spark scores it in rounds: a pattern's confidence in a kind is the share of
its instances known to be of that kind, those of other kinds counted in full and unknown ones in part; an
instance's score is what its confident patterns say together, and instances above a threshold are known
from the next round on, until no more are found. Those that no fixed pattern found are added as spans x_<kind>.

Texts are read once, in Python on Arrow batches; what is kept of a document is its spans and the few
identifiers.
"""

from __future__ import annotations

import bisect
import re
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import broadcast_up_to, written

KINDS = ("email", "ip", "card", "phone")
#: A pattern needs so many distinct known instances of a kind, and this confidence.
LEAST_SEEDS = 5
LEAST_CONFIDENCE = 0.75
#: An instance of no known kind counts so much against a pattern.
UNKNOWN = 0.25
#: An instance needs this score, one minus the product of what its patterns leave open.
LEAST_SCORE = 0.9
#: An identifier has an at sign or so many digits.
LEAST_DIGITS = 3
#: Up to so many patterns or found instances are broadcast, by count.
MAX_BROADCAST = 100_000

SPAN = "struct<kind:string,start:int,end:int>"
TOKEN = "struct<kind:string,start:int,end:int,value:string,patterns:array<string>>"

# The patterns of the kinds.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IDENTIFYING = re.compile(r"[0-9@]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
NUMERIC = re.compile(r"[(+]*[0-9][0-9().,/+-]*")
EDGES = ".,;:!?()[]{}<>\"'#$%&*|=-"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[str, int, int]]:
    # the leftmost match before an at sign starts where its local characters do
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All (kind, start, end) by kind as listed, then start."""
    found = _emails(text)
    if not re.search("[0-9]", text):
        return found
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def class_of(value: str) -> str:
    return "mail" if "@" in value else "mixed" if any(c.isalpha() for c in value) else "digits"


def identifier_tokens(text: str, spans: list[tuple[str, int, int]]) -> list[tuple]:
    """(kind or None, start, end, value, patterns): every base span, and the other identifiers outside of them."""
    if not IDENTIFYING.search(text):
        return []
    words = [m.span() for m in WORDS.finditer(text)]
    starts = [a for a, _ in words]
    taken = sorted((s, e, k) for k, s, e in spans)
    plain = lambda s: s.strip(EDGES).lower()

    def token(kind: str | None, s: int, e: int) -> tuple:
        first, last = bisect.bisect_right(starts, s) - 1, bisect.bisect_left(starts, e) - 1
        left = [plain(text[slice(*words[k])]) if k >= 0 else "^" for k in (first - 2, first - 1)]
        right = [plain(text[slice(*words[k])]) if k < len(words) else "$" for k in (last + 1, last + 2)]
        if own := plain(text[words[first][0] : s]):  # what is joined to it, as in tel:123
            left = [left[1], own]
        if own := plain(text[e : words[last][1]]):
            right = [own, right[0]]
        value = text[s:e]
        held = class_of(value)
        return kind, s, e, value, [f"< {left[0]} {left[1]}", f"> {right[0]} {right[1]}", f"<{held} {left[1]}", f">{held} {right[0]}"]

    out, j, k = [token(kind, s, e) for s, e, kind in taken], 0, 0
    while k < len(words):
        a, b = words[k]
        k += 1
        while j < len(taken) and taken[j][1] <= a:
            j += 1
        room = taken[j][0] if j < len(taken) else len(text)
        if b > room or not IDENTIFYING.search(text, a, b):
            continue
        if NUMERIC.fullmatch(text, a, b):  # with the groups of digits beside it
            while k < len(words) and words[k][0] == b + 1 and words[k][1] <= room and NUMERIC.fullmatch(text, *words[k]):
                b = words[k][1]
                k += 1
        value = text[a:b].strip(EDGES)
        if "@" in value[1:-1] or sum(c.isdigit() for c in value) >= LEAST_DIGITS:
            s = text.index(value, a)
            out.append(token(None, s, s + len(value)))
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base, tokens) of every row, written once; row numbers the rows."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        token = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
        kind = pa.struct([("base", pa.list_(span)), ("tokens", pa.list_(token))])
        names = ("kind", "start", "end", "value", "patterns")
        for texts in batches:
            rows = []
            for t in texts:
                text = t.as_py() or ""
                spans = base_spans(text)
                rows.append({"base": [dict(zip(names[:3], s, strict=True)) for s in spans], "tokens": [dict(zip(names, x, strict=True)) for x in identifier_tokens(text, spans)]})
            yield pa.array(rows, kind)

    found = F.arrow_udf(scan, f"base array<{SPAN}>, tokens array<{TOKEN}>", F.ArrowUDFType.SCALAR_ITER)(F.col("text").cast("string"))
    return written(docs.select("doc_id", found.alias("x")).select("doc_id", F.monotonically_increasing_id().alias("row"), "x.*"))


def discovered(tokens: DataFrame) -> DataFrame:
    """(value, kind): what no fixed pattern found, of rows (kind, value, patterns)."""
    edges = written(tokens.select("value", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("kind").alias("seed")))
    seeds = written(edges.filter("seed is not null").groupBy("value").agg(F.max("seed").alias("kind")))
    open_ = written(edges.filter("seed is null").join(seeds.select("value"), "value", "left_anti").select("pattern", "value"))
    size = written(edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") > LEAST_SEEDS))
    found = None
    while True:
        known = seeds if found is None else seeds.unionByName(found)
        of = edges.select("pattern", "value").join(known, "value").groupBy("pattern", "kind").agg(F.count("*").alias("known"))
        every = of.groupBy("pattern").agg(F.sum("known").alias("all_known"))
        strong = of.filter(F.col("known") >= LEAST_SEEDS).join(every, "pattern").join(size, "pattern")
        against = F.col("all_known") - F.col("known") + UNKNOWN * (F.col("n") - F.col("all_known"))
        strong = strong.withColumn("confidence", F.col("known") / (F.col("known") + against + 1)).filter(F.col("confidence") >= LEAST_CONFIDENCE)
        strong = broadcast_up_to(written(strong.select("pattern", "kind", "confidence")), MAX_BROADCAST)
        # one side of an instance counts once, by its more confident pattern
        sides = open_.join(strong, "pattern").groupBy("value", "kind", F.substring("pattern", 1, 1).alias("side")).agg(F.max("confidence").alias("confidence"))
        score = 1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))
        new = sides.groupBy("value", "kind").agg(score.alias("score")).filter(F.col("score") >= LEAST_SCORE)
        new = new.groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        new = written(new if found is None else new.join(found.select("value"), "value", "left_anti"))
        if new.isEmpty():
            return new if found is None else found
        found = new if found is None else written(found.unionByName(new))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row of ``docs`` (doc_id, text; other columns aren't read): arrays of
    struct(kind, start, end), code points with the end exclusive, by kind as listed, then start; spans has
    the base ones, then those found by context, x_<kind>.

    A null text counts as empty and has no spans. Repeated rows have the same. An empty table gives an
    empty one.
    """
    rows = scanned(docs)
    found = discovered(rows.select(F.explode("tokens").alias("t")).select("t.*"))
    if found.isEmpty():
        return rows.select("doc_id", "base", F.col("base").alias("spans"))
    more = rows.select("row", F.explode("tokens").alias("t")).filter("t.kind is null").select("row", "t.start", "t.end", "t.value")
    more = more.join(broadcast_up_to(found, MAX_BROADCAST), "value")
    span = F.struct(F.concat(F.lit("x_"), "kind").alias("kind"), "start", "end")
    more = more.groupBy("row").agg(F.collect_list(span).alias("more"))
    out = rows.join(more, "row", "left")
    rank = lambda x: F.array_position(F.array(*[F.lit(f"x_{k}") for k in KINDS]), x["kind"])
    keyed = F.sort_array(F.transform("more", lambda x: F.struct(rank(x).alias("r"), x["start"].alias("s"), x.alias("x"))))
    added = F.transform(keyed, lambda x: x["x"])
    return out.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", added)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
