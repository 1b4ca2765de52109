"""Secrets in texts: fixed patterns, and character Markov models. DataFrame operations only.

Two order-1 models over characters are trained from labelled samples. Random strings: what the fixed patterns found
in the corpus, and strings made from digests in the usual alphabets. Ordinary identifiers: the corpus's own long words, and
names made by rule from words, dates, counters, versions and paths, so that digits and marks are known to be ordinary there.
Corpus samples are counted over all documents; a model is half of each source, whatever the corpus's size. A
candidate token that no fixed pattern covers is a secret if its log-likelihood ratio for each character is above a threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import given_back, set_apart, text_of

#: Kind, pattern, least length, and the group whose length counts.
PATTERNS = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
)
#: A candidate of the models: this many of these characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Words from this length on are samples of ordinary identifiers.
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z_-]{9,}"
#: Mean log ratio for each character, in nats.
MARGIN = 0.45
#: So many samples of each kind are made by rule.
MADE = 12_000
#: Parts of ordinary identifiers.
PARTS = (
    "user", "order", "session", "report", "image", "build", "release", "test", "page", "post", "item", "config", "index", "backup", "invoice", "customer", "product", "service", "request", "response",
    "message", "account", "address", "template", "library", "module", "package", "version", "update", "delete", "create", "number", "value", "table", "column", "record", "object", "string", "length", "default",
    "example", "download", "article", "category", "comment", "archive", "summary", "internal", "public", "private", "server", "client", "network", "storage", "document", "section", "handler", "manager", "factory", "how",
    "to", "the", "of", "and", "with", "for", "from", "get", "set", "is", "id", "key", "file", "data", "time", "date", "name", "type", "list", "view",
)
#: The models' states; any other character is the last one.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1


def matches(text: str, kind: str, pattern: str, least: int = 0, group: int = 0) -> Column:
    """array<struct(kind, start, end, value)> of the leftmost non-overlapping matches in a text column, in
    code points, without those whose group is shorter than ``least``. Positions are the summed lengths of
    what lies between matches and of the matches."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))
    between = F.split(F.col(text), pattern, -1)
    each = F.arrays_zip(found.alias("m"), value.alias("v"), F.slice(between, F.lit(1), F.size(found)).alias("b"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["v"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    walked = F.aggregate(each, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda a: a["spans"])
    return F.when(F.regexp_like(F.col(text), F.lit(pattern)), walked).otherwise(none)


def with_base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with __text and __base: all matches of PATTERNS, by start, then kind as listed."""
    docs = docs.withColumn("__text", text_of(F.col("text").cast("string")))
    docs = docs.withColumns({f"__{k}": matches("__text", k, p, least, g) for k, p, least, g in PATTERNS})
    return docs.withColumn("__base", ordered(F.concat(*[F.col(f"__{k}") for k, *_ in PATTERNS]))).drop(*[f"__{k}" for k, *_ in PATTERNS])


def ordered(spans: Column) -> Column:
    ranks = [k for k, *_ in PATTERNS] + ["markov"]
    rank = lambda x: F.array_position(F.array(*map(F.lit, ranks)), x["kind"])
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value")))
    return F.sort_array(keyed)


def written_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _states(token: Column) -> Column:
    """A token's states, 0 to STATES - 1."""
    return F.transform(F.array_remove(F.split(token, ""), ""), lambda c: F.pmod(F.instr(F.lit(ALPHABET), c) - 1, F.lit(STATES)))


def _steps(token: Column) -> Column:
    """The transitions of a token as from * STATES + to; the start counts as from the last state."""
    s = _states(token)
    return F.zip_with(F.concat(F.array(F.lit(STATES - 1)), F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))), s, lambda a, b: a * STATES + b)


def made_samples(spark: SparkSession, n: int = MADE, seed: str = "train") -> DataFrame:
    """(random, s): ``n`` strings of each kind, made by rule from digests of 0 .. n - 1 and ``seed``."""
    rows = spark.range(n).select("id", *[F.sha2(F.concat_ws("-", F.lit(seed), F.lit(k), "id"), 512).alias(k) for k in ("a", "b")])
    turn = lambda options, by: F.get(F.array(*options), F.pmod(by, F.lit(len(options))))
    number = lambda k, below: F.pmod(F.xxhash64("b", F.lit(k)), F.lit(below))

    digits = F.base64(F.unhex("a"))
    plain = F.translate(digits, "+/=", "")
    alphabets = (digits, plain, F.translate(digits, "+/=", "-_"), F.lower(plain), F.upper(plain), F.col("a"))
    random = F.substring(turn(alphabets, F.col("id")), F.lit(1), (20 + number(0, 45)).cast("int"))

    part = lambda k: F.get(F.array(*map(F.lit, PARTS)), number(k, len(PARTS)).cast("int"))
    padded = lambda x, width: F.lpad(x.cast("string"), width, "0")
    year, month, day = (1990 + number(10, 45)).cast("string"), padded(1 + number(11, 12), 2), padded(1 + number(12, 28), 2)
    count, large = number(13, 10_000).cast("string"), number(14, 1_000_000_000).cast("string")
    joined = lambda sep, *x: F.concat_ws(sep, *x)
    uuid = F.concat_ws("-", *[F.substring("b", i, m) for i, m in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    names = (
        joined("_", part(1), part(2), part(3), part(4)),
        joined("-", part(1), part(2), year, month, day, part(3)),
        F.concat(part(1), *[F.initcap(part(k)) for k in (2, 3, 4, 5)]),
        joined("/", part(1), year, part(2), joined("-", part(3), part(4), part(5), part(6))),
        F.upper(joined("_", part(1), part(2), part(3), count)),
        F.concat(part(1), part(2), part(3), part(4), part(5)),
        joined("_", F.concat(part(1), count), part(2), F.concat(part(3), number(15, 100).cast("string")), part(4)),
        joined("=", joined("-", part(1), part(2)), joined("_", part(3), part(4), count)),
        joined("-", F.concat(year, month, day), F.concat(padded(number(16, 24), 2), padded(number(17, 60), 2), padded(number(18, 60), 2)), part(1), count),
        joined("-", part(1), part(2), F.concat(F.lit("v"), number(19, 30).cast("string")), number(20, 30).cast("string"), number(21, 100).cast("string"), F.lit("x86_64")),
        joined("/", part(1), part(2), F.concat(year, month), joined("_", part(3), padded(number(22, 5000), 6))),
        joined("-", F.initcap(part(1)), F.upper(part(2)), large, part(3)),
        uuid,
        uuid,
        F.repeat(F.expr(f"substring('{ALPHABET}', 1 + pmod(xxhash64(b, 23), {STATES - 1}), 1)"), (20 + number(24, 40)).cast("int")),
    )
    kinds = F.array(F.struct(F.lit(True).alias("random"), random.alias("s")), F.struct(F.lit(False).alias("random"), turn(names, F.col("id")).alias("s")))
    return rows.select(F.explode(kinds).alias("x")).select("x.*")


def train(docs: DataFrame, smoothing: float = 0.5) -> list[float]:
    """The log ratio random / ordinary of each of STATES * STATES transitions. A source without samples is
    uniform."""
    rows = with_base_spans(docs.select("text"))
    found = F.transform("__base", lambda x: F.struct(F.lit(True).alias("random"), x["value"].alias("s")))
    words = F.transform(F.regexp_extract_all("__text", F.lit(ORDINARY), F.lit(0)), lambda w: F.struct(F.lit(False).alias("random"), w.alias("s")))
    samples = rows.select(F.explode(F.concat(found, words)).alias("x")).select(F.lit(0).alias("source"), "x.*")
    samples = samples.unionByName(made_samples(docs.sparkSession).withColumn("source", F.lit(1)))
    steps = samples.select("random", "source", F.explode(_steps(F.col("s"))).alias("t")).groupBy("random", "source", "t").agg(F.count("*").alias("n"))
    count: dict[tuple, dict[int, int]] = {(r, s): {} for r in (True, False) for s in (0, 1)}
    for row in steps.collect():  # 4 * STATES * STATES rows at most
        count[row.random, row.source][row.t] = row.n

    def shares(held: dict[int, int], a: int) -> list[float]:
        seen = [held.get(a * STATES + b, 0) + smoothing for b in range(STATES)]
        return [n / sum(seen) for n in seen]

    out = []
    for a in range(STATES):
        of = {r: [(x + y) / 2 for x, y in zip(shares(count[r, 0], a), shares(count[r, 1], a), strict=True)] for r in (True, False)}
        out += [round(math.log(x / y), 4) for x, y in zip(of[True], of[False], strict=True)]
    return out


def ratio(token: Column, weights: list[float]) -> Column:
    """The mean log ratio of a token's characters."""
    held = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")  # folded to one literal
    return F.aggregate(_steps(token), F.lit(0.0), lambda a, t: a + F.get(held, t)) / F.length(token)


def find(docs: DataFrame, weights: list[float], margin: float = MARGIN) -> DataFrame:
    """All rows of ``docs`` with base and spans: arrays of struct(start, rank, end, kind, value), ordered by
    start, then kind as listed; value is the secret itself. spans has the base ones and the models'.

    A null text counts as empty and has no spans. Repeated rows have the same. Columns of those names are
    replaced. An empty table gives an empty one.
    """
    docs, own = set_apart(docs, ("text",), ("base", "spans"))
    rows = with_base_spans(docs)
    rows = rows.withColumn("__more", matches("__text", "markov", CANDIDATE, 20))
    free = lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    more = F.filter("__more", lambda x: free(x) & (ratio(x["value"], weights) > margin))
    rows = rows.withColumns({"base": F.col("__base"), "spans": F.when(F.size("__more") > 0, ordered(F.concat(_plain("__base"), more))).otherwise(F.col("__base"))})
    return given_back(rows.drop("__text", "__base", "__more"), own)


def _plain(spans: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
