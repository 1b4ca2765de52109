"""Document fingerprints by closed syncmers. DataFrame operations only.

The units of every text are its words, a word of over PIECE characters in pieces of so many (texts without spaces have units too), with K - 1
blanks before and after them (so that the shortest text has anchors). A k-mer of units is an anchor if the least hash among its inner s-mers
stands at its first or last place. That depends on the k-mer alone, so an edit moves no anchor outside the
k-mers that it touches, and the same passage has the same anchors wherever it stands.

A fingerprint is all anchors of a text in order, each 28 bits of hash and 4 of the distance from the one before. Two fingerprints are
matched by position: anchors in both are laid out in the order of the one text, and those count that keep the
distance of a neighbour, or of the texts' beginnings, in the other; the same words in another order are not alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.llm.common import text_of, written

K = 5
S = 2
PIECE = 8
#: Documents with ids in one run of so many, a power of two, share a task when each looks for the next.
RUN = 256


def _range(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def units_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))


def with_anchors(docs: DataFrame, text: Column, out: str, k: int = K, s: int = S) -> DataFrame:
    """``docs`` with a column ``out``: array<int> of the anchors of a text, in order. A text without units has none; any other has at least one in each
    k - s neighbouring k-mers, and so a distance fits in 4 bits."""
    h, m, i_ = f"__{out}_h", f"__{out}_m", f"__{out}_i"
    at = lambda column, i: F.get(F.col(column), i)
    docs = docs.withColumn(h, F.transform(units_of(text), lambda w: F.xxhash64(w)))
    blanks = F.array_repeat(F.lit(0).cast("long"), k - 1)
    docs = docs.withColumn(h, F.when(F.size(h) > 0, F.concat(blanks, h, blanks)).otherwise(F.col(h)))
    docs = docs.withColumn(m, F.transform(_range(F.size(h) - (s - 1)), lambda i: F.xxhash64(*[at(h, i + j) for j in range(s)])))
    width = k - s + 1

    def closed(i: Column) -> Column:
        least = F.least(*[at(m, i + j) for j in range(width)])
        return (at(m, i) == least) | (at(m, i + width - 1) == least)

    docs = docs.withColumn(i_, F.filter(_range(F.size(h) - (k - 1)), closed))

    def packed(i: Column, n: Column) -> Column:
        kmer = F.shiftrightunsigned(F.xxhash64(*[at(h, i + j) for j in range(k)]), 36).cast("int")
        return F.shiftleft(kmer, 4).bitwiseOR(i - F.coalesce(F.get(i_, n - 1), F.lit(-1)))

    return docs.withColumn(out, F.transform(i_, packed)).drop(h, m, i_)


_LOW = (1 << 31) - 1


def _hash(x: Column) -> Column:
    return F.shiftright(x, 32)


def _by_hash(docs: DataFrame, anchors: Column, out: str) -> DataFrame:
    """``docs`` with a column ``out``: of each hash among ``anchors`` the first place, sorted, as numbers with the hash above 32 bits."""
    placed = F.sort_array(F.transform(anchors, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 4).cast("long"), 32) + i))
    docs = docs.withColumn(f"_{out}", placed)
    return docs.withColumn(out, F.filter(f"_{out}", lambda x, i: (i == 0) | (_hash(x) != _hash(F.get(f"_{out}", i - 1))))).drop(f"_{out}")


def with_likeness(docs: DataFrame, a: Column, b: Column, out: str) -> DataFrame:
    """``docs`` with a column ``out``: of the different anchors of ``a`` and ``b``, the share that both have at matching places; 1 for two empty
    ones. An anchor's place is its number in the text; one that occurs again counts at its first place."""
    docs = _by_hash(_by_hash(docs, a, "__a"), b, "__b")
    both = F.sort_array(F.concat("__a", F.transform("__b", lambda x: x.bitwiseOR(F.lit(1 << 31)))))
    docs = docs.withColumn("__m", both)
    other = lambda i: F.get("__m", i + 1)
    shared = F.filter(F.transform("__m", lambda x, i: F.when(_hash(x) == _hash(other(i)), F.shiftleft(x.bitwiseAND(F.lit(_LOW)), 32) + other(i).bitwiseAND(F.lit(_LOW)))), lambda x: x.isNotNull())
    docs = docs.withColumn("__m", F.sort_array(shared))
    # how far the other's place is from its own
    moved = F.transform("__m", lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)) - F.shiftright(x, 32))
    docs = docs.withColumn("__d", moved)
    at = lambda i: F.get("__d", i)
    kept = F.filter("__d", lambda d, i: (d == 0) | F.coalesce(d == at(i + 1), F.lit(False)) | (F.when(i > 0, d == at(i - 1)).otherwise(False)))
    docs = docs.withColumn("__n", F.size(kept))
    share = F.coalesce(F.try_divide(F.col("__n").cast("double"), F.size("__a") + F.size("__b") - F.col("__n")), F.lit(1.0))
    return docs.withColumn(out, share).drop("__a", "__b", "__m", "__d", "__n")


def fingerprint(anchors: Column) -> Column:
    """The anchors as a string: for each 7 hex digits of hash and one of the distance from the one before."""
    return F.array_join(F.transform(anchors, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def following(values: DataFrame) -> DataFrame:
    """(v, to) for distinct rows (v): the next larger one, after the largest the smallest. Dealt out by range; each part passes its
    first value on, so that only one row a part meets in one task."""
    parts = written(values.repartitionByRange("v").select("v", F.spark_partition_id().alias("part")))
    firsts = parts.groupBy("part").agg(F.min("v").alias("first"))
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(whole)).alias("after"))
    own = parts.withColumn("to", F.lead("v").over(Window.partitionBy("part").orderBy("v")))
    return own.join(F.broadcast(firsts), "part").select("v", F.coalesce("to", "after").alias("to"))


def with_next(docs: DataFrame, columns: list[str], run: int = RUN) -> DataFrame:
    """``docs`` with next_<column> of the row that follows by doc_id; the first follows the last.

    Rows are dealt out by runs of ids, and each run finds its rows' followers. A run's last row needs the
    first row of the next run that has any. Equal ids follow each other in the order of ``columns``. Null ids come first, in the
    order of a hash of the first of ``columns``.
    """
    spread = F.xxhash64(columns[0]).bitwiseAND(F.lit((1 << 40) - 1)) - (1 << 62)
    number = lambda x: F.shiftright(x, run.bit_length() - 1)  # noqa: E731  rounds down, below zero too
    runs = docs.withColumn("__order", F.coalesce(F.col("doc_id").cast("long"), spread))
    runs = runs.withColumn("__run", number(F.col("__order")))
    to = following(runs.select(F.col("__run").alias("v")).distinct()).select(F.col("v").alias("__run"), F.col("to").alias("__to"))
    # with doc_id, all three readers below need the same columns, and share one exchange
    w = Window.partitionBy("__run").orderBy("__order", "doc_id", *columns)
    runs = runs.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns} | {"__next": F.lead(F.lit(1)).over(w), "__first": F.lag(F.lit(1)).over(w).isNull()})
    last = runs.filter("__next is null").join(to, "__run").drop(*[f"next_{c}" for c in columns])
    firsts = runs.filter("__first").select(F.col("__run").alias("__to"), *[F.col(c).alias(f"next_{c}") for c in columns])
    last = last.join(firsts, "__to").drop("__to")
    out = runs.filter("__next is not null").unionByName(last)
    return out.drop("__run", "__next", "__first", "__order")


def with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_anchors) of
    every row of ``docs`` (doc_id, text; other columns aren't read).

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many, or all, of the
    next document's. A null text counts as empty; an empty text's fingerprint is empty, and two empty
    ones are alike. near_edited and near_next are the likeness of the fingerprints that are returned. A lone document follows itself. Repeated rows follow
    each other.
    """
    rows = docs.select("doc_id", text_of(F.col("text").cast("string")).alias("text"))
    rows = with_next(with_anchors(rows, F.col("text"), "anchors"), ["text", "anchors"])
    n = F.length("text")
    quarter = F.floor(n / F.lit(4)).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    rows = rows.withColumn("edited", edited).withColumn("n_chars", n.cast("long"))
    rows = with_anchors(rows, F.col("edited"), "edited_anchors")
    for other in ("edited", "next"):
        rows = with_likeness(rows, F.col("anchors"), F.col(f"{other}_anchors"), f"near_{other}")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("anchors")).alias("fingerprint"),
        fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.size("anchors").cast("long").alias("n_anchors"),
    )
