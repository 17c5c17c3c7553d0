"""Merkle fingerprints of documents.

A text is cut into pieces: sentences and lines, the longer ones every ``PIECE`` characters. A piece's digest is a leaf.
Leaves in a row are a paragraph, which ends after a leaf whose digest starts with one of ``ENDS`` (one in eight), and
paragraphs are a section in the same way; the root is over the sections. So cuts depend on content alone, and an
inserted sentence changes its own paragraph and section, not those after it. Equal roots mean equal texts. Where roots
differ, sections that the other text lacks lead to differing paragraphs and pieces (``differences``), and the share of
common leaves is the likeness of two trees. All is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed

PIECE, ENDS = 96, ("0", "8")
PIECES = rf"[^.!?\n]{{1,{PIECE}}}[.!?\n ]*|[.!?\n ]+"
#: Documents in a bucket, about, when documents are put in order.
BUCKET = 4096


def leaves(text: Column) -> Column:
    """Digests of the text's pieces; none for a null or empty text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECES), F.lit(0))
    return F.transform(found, lambda x: F.md5(x.cast("binary")))


def ends(nodes: str) -> Column:
    """Numbers (from 1) of the last nodes of an array column's groups, which is bound as a lambda variable and so made once a row."""
    last = " or ".join(f"startswith(ns[k - 1], '{x}')" for x in ENDS)
    return F.expr(f"transform(array({nodes}), ns -> case when size(ns) = 0 then cast(array() as array<int>) else filter(sequence(1, size(ns)), k -> k = size(ns) or {last}) end)[0]")


def parents(nodes: str, stops: str) -> Column:
    """Digests of the groups of nodes that end at ``stops``."""
    return F.expr(f"transform(array(named_struct('ns', {nodes}, 'es', {stops})), g -> transform(g.es, (e, i) -> md5(cast(array_join(slice(g.ns, coalesce(get(g.es, i - 1), 0) + 1, e - coalesce(get(g.es, i - 1), 0)), '') as binary))))[0]")


def tree(docs: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds leaves, paragraphs, sections (arrays of digests), paragraph_ends, section_ends and root of a text column, with ``prefix`` before their names."""
    made = docs.withColumn(f"{prefix}leaves", leaves(F.col(text)))
    for below, name in (("leaves", "paragraph"), ("paragraphs", "section")):
        made = made.withColumn(f"{prefix}{name}_ends", ends(f"{prefix}{below}"))
        made = made.withColumn(f"{prefix}{name}s", parents(f"{prefix}{below}", f"{prefix}{name}_ends"))
    return made.withColumn(f"{prefix}root", F.sha2(F.array_join(f"{prefix}sections", "").cast("binary"), 256))


def likeness(a: str, b: str) -> Column:
    """Common leaves of two trees over all their leaves (1 for equal roots; 0 if just one has leaves)."""
    common = F.size(F.array_intersect(f"{a}leaves", f"{b}leaves"))
    every = F.size(F.array_union(f"{a}leaves", f"{b}leaves"))
    return F.when(F.col(f"{a}root") == F.col(f"{b}root"), F.lit(1.0)).otherwise(common / F.greatest(every, F.lit(1)))


def differences(a: str, b: str) -> Column:
    """Numbers (from 0) of the leaves of tree ``a`` that ``b`` lacks, looked for only under sections and paragraphs that ``b`` lacks.

    Where ``b`` has all leaves of such a paragraph (in another order or number), they are all given. What only ``b`` has
    is found by asking the other way round.
    """
    lacks = lambda level, k: f"not array_contains({b}{level}, {a}{level}[{k}])"
    under = lambda level, k: f"sequence(coalesce(get({a}{level}_ends, {k} - 1), 0), {a}{level}_ends[{k}] - 1)"
    return F.expr(f"""
        case when {a}root = {b}root or size({a}sections) = 0 then cast(array() as array<int>) else
        flatten(transform(filter(sequence(0, size({a}sections) - 1), s -> {lacks("sections", "s")}),
            s -> flatten(transform(filter({under("section", "s")}, p -> {lacks("paragraphs", "p")}),
                p -> transform(array(filter({under("paragraph", "p")}, i -> {lacks("leaves", "i")})),
                    own -> case when size(own) > 0 then own else {under("paragraph", "p")} end)[0])))) end""")


def with_next(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, text (null: empty) and next_text, the text of the next lower doc_id; after the lowest comes the highest.

    Documents are ordered in buckets of about so many rows (see ``bucketed``), and each bucket gets the head of the next
    one; only one row per bucket is ordered in one task. Rows with one doc_id come in the order of a hash of their texts,
    rows without one last.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie")), bucket)
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.col("tie"))
    heads = rows.groupBy("bucket").agg(F.max_by("text", order).alias("head"))
    every = Window.orderBy(F.col("bucket").desc())
    names = rows.select("bucket").distinct()
    following = names.select("bucket", F.lead("bucket").over(every).alias("after"), F.max("bucket").over(Window.partitionBy()).alias("top")).select("bucket", F.coalesce("after", "top").alias("after"))
    next_heads = following.join(heads.withColumnRenamed("bucket", "after"), "after").select("bucket", "head")
    within = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    led = rows.select("doc_id", "text", "bucket", F.lead("text").over(within).alias("next"))
    return led.join(next_heads, "bucket").select("doc_id", "text", F.coalesce("next", "head").alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited (the last half replaced by the start of the next document), and trees of the text, the edited and the next text.

    Null texts are empty ones, which have no leaves and one common root. Only doc_id and text are read; an empty table
    gives no rows, and a single row is its own next document. A long text's tree is in its row.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs).withColumn("edited", edited)
    for column, prefix in (("text", ""), ("edited", "edited_"), ("next_text", "next_")):
        rows = tree(rows, column, prefix)
    return rows
