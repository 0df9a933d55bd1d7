"""Merkle-tree fingerprints of documents, by DataFrame functions alone.

A text's sections are its lines; a section's paragraphs are its sentences, cut behind
every word whose checksum is divisible by ``CUT`` too, and after ``LONGEST`` words. So
what a word is put before, or taken from, changes one or two paragraphs, and the same
places are cut behind it. Leaves are the SHA-256 of paragraphs, section nodes hash their leaves, the root hashes the section
nodes, all of them whole. The fingerprint writes the tree out: the root, then for each
section the first 16 digits of its node, and of its leaves with the paragraph's length
after them. Roots test equality; sections and leaves that differ locate edits;
likeness weighs paragraphs by length.

Defined results: null text counts as empty (one section without a paragraph);
the likeness of two empty texts is 1; of equal texts 1; rows with a null ``doc_id``
come last in descending order; rows with equal ``doc_id`` follow each other in the
order of the input; a single row is its own next; an empty table gives no rows; very long texts
are hashed whole; other columns, whatever their names, are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bucketed, parts, staged

#: One word of so many ends a paragraph; and the most words of one.
CUT, LONGEST = 4, 32
#: Stands behind a word that ends a paragraph; where a text has it itself, it stands twice.
_MARK = "\u0001"
#: A paragraph: words, the marks that end a sentence, and a cut; or marks and spaces alone. Sections end at line breaks.
_PARAGRAPH = rf"(?:[^ .!?{_MARK}]+ ?){{1,{LONGEST}}}[.!?]*{_MARK}? ?|[.!? {_MARK}]+"
_SHORT = 16


def leaf(paragraph: Column) -> Column:
    """SHA-256 of a paragraph, then its length, in hexadecimal digits."""
    return F.concat(F.sha2(paragraph.cast("binary"), 256), F.lower(F.hex(F.length(paragraph))))


def sections(text: Column) -> Column:
    """Array of sections, each an array of leaves."""

    def marked(section: Column) -> Column:
        words = F.split(section, " ")
        return F.array_join(F.transform(words, lambda w: F.when(F.crc32(w.cast("binary")) % CUT == 0, F.concat(w, F.lit(_MARK))).otherwise(w)), " ")

    whole = F.replace(text, F.lit(_MARK), F.lit(2 * _MARK))
    return F.transform(F.split(whole, "\n"), lambda s: F.transform(F.regexp_extract_all(marked(s), F.lit(_PARAGRAPH), F.lit(0)), leaf))


def fingerprint(tree: Column) -> Column:
    """The tree as text: ``root;node:leaf,leaf;node:leaf``, from ``sections``."""
    nodes = F.transform(tree, lambda s: F.concat(F.sha2(F.array_join(s, ",").cast("binary"), 256), F.lit(":"), F.array_join(F.transform(s, lambda x: F.concat(F.substring(x, 1, _SHORT), F.substring(x, 65, _SHORT))), ",")))
    written = F.transform(nodes, lambda n: F.concat(F.substring(n, 1, _SHORT), F.substring(n, 65, 1 << 30)))
    roots = F.array_join(F.transform(nodes, lambda n: F.substring(n, 1, 64)), "")
    return F.concat(F.sha2(roots.cast("binary"), 256), F.lit(";"), F.array_join(written, ";"))


def leaves(print_: Column) -> Column:
    """The distinct leaves that a fingerprint names, as the words they are written with."""
    return F.array_distinct(F.flatten(F.transform(F.slice(F.split(print_, ";"), 2, 1 << 30), lambda s: F.split(F.substring(s, 18, 1 << 30), ","))))


def _weight(words: Column) -> Column:
    """Lengths of the paragraphs of leaves (one at least each)."""
    length = lambda w: F.coalesce(F.conv(F.substring(w, _SHORT + 1, 16), 16, 10).cast("long"), F.lit(0).cast("long"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.greatest(F.lit(1).cast("long"), length(w)))


def likeness(a: Column, b: Column) -> Column:
    """Share of length that two sets of leaves have in common, 0 to 1 (1 for equal sets)."""
    total = _weight(a) + _weight(b)
    return F.when(a == b, F.lit(1.0)).otherwise(2.0 * _weight(F.array_intersect(a, b)) / total)


def differing(a: Column, b: Column) -> Column:
    """Where the tree ``b`` differs from ``a``: ``array<struct<section int, paragraph int>>`` in ``b``,
    counted from 0; whole sections that ``a`` has anywhere are passed over."""
    known = F.slice(F.split(a, ";"), 2, 1 << 30)
    nodes = F.transform(known, lambda s: F.substring(s, 1, 16))
    old = leaves(a)

    def edits(s: Column, k: Column) -> Column:
        words = F.transform(F.split(F.substring(s, 18, 1 << 30), ","), lambda w, i: F.struct(k.cast("int").alias("section"), i.cast("int").alias("paragraph"), w.alias("leaf")))
        fresh = F.filter(words, lambda x: ~F.array_contains(old, x["leaf"]))
        return F.when(F.array_contains(nodes, F.substring(s, 1, 16)), F.slice(fresh, 1, 0)).otherwise(fresh)

    return F.transform(F.flatten(F.transform(F.slice(F.split(b, ";"), 2, 1 << 30), edits)), lambda x: F.struct(x["section"], x["paragraph"]))


def with_next(docs: DataFrame, rows_a_part: int = 2000, **made: Column) -> DataFrame:
    """``doc_id, text``, the columns ``made`` of them, and ``next``, a struct of the next row's text and columns by
    descending ``doc_id``; the last one's is the first.

    Rows go to ranges and are written there once. Within a range they follow each other; the last row of a range
    gets the first one of the range that comes next. Rows of one id are dealt by their place in the input, so that
    no id fills a task.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("at"))
    n = parts(docs.count(), rows_a_part)
    dealt = rows.repartitionByRange(n, F.desc_nulls_last("doc_id"), "at").withColumn("part", F.spark_partition_id())
    found = bucketed(dealt, "ranges", min(n, 20_000), "part", moved=False)
    place = F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id"), "at")  # ascending: by descending id, nulls last
    ends = found.groupBy("part").agg(F.min_by("text", place).alias("head"), F.max_by(F.struct("doc_id", "text", "at"), place).alias("tail"))
    ends = staged(ends, "ends")  # two rows of each range
    order = Window.orderBy("part")  # of a number for each range
    after = ends.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("after"))
    both = ["text", *made]
    heads = ends.select(F.col("part").alias("after"), F.col("head").alias("text")).withColumns(made).select("after", F.struct(*both).alias("next"))
    tails = ends.select("part", "tail.doc_id", "tail.text").withColumns(made).join(after, "part").join(heads, "after").select("doc_id", *both, "next")
    near = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), "at")
    inner = found.withColumns(made).withColumn("next", F.lead(F.struct(*both)).over(near)).where("next is not null").select("doc_id", *both, "next")
    return inner.unionByName(tails)


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    rows = with_next(docs, fingerprint=fingerprint(sections(F.col("text"))))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))})
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", fingerprint(sections(F.col("edited"))).alias("edited_fingerprint"), F.col("next.fingerprint").alias("next_fingerprint"))
    # arrays of one row stand behind an explode, so that they are worked out once
    one = F.explode(F.array(F.struct(*[leaves(F.col(p)).alias(p) for p in ("fingerprint", "edited_fingerprint", "next_fingerprint")]))).alias("sets")
    rows = rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", one)
    own = F.col("sets.fingerprint")
    near = {c: likeness(own, F.col(f"sets.{p}")).alias(c) for c, p in (("near_edited", "edited_fingerprint"), ("near_next", "next_fingerprint"))}
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near.values())
