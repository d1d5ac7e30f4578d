"""Document fingerprints: a Merkle tree over phrases, paragraphs and sections.

A text is cut, without losing a character, into words with the white space behind them. A phrase ends at a word whose
hash is divisible by ``PHRASE``, a paragraph at a line break, a section at a blank line or at a paragraph whose hash is
divisible by ``SECTION``: all cuts follow from the content next to them, so an edit changes the nodes around it and no
others. A paragraph's node is the SHA-256 of its text, a section's that of its paragraphs' nodes, the root that of the
sections' nodes; phrases have 64 bits. Equal roots mean equal texts. Differing trees are walked down from the sections
to the first differing phrase, which locates an edit, and are as alike as the share of text in phrases that both hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


PHRASE, SECTION = 4, 8
#: Word ends: before a character that follows white space, and after full-width punctuation.
WORD_END = r"(?<=\s)(?=\S)|(?<=[。！？；：，、])(?=[\s\S])"
WEIGHT_BITS = 20
MARK, ESC = "\u0001", "\u0002"
NO_ID = -(1 << 63)
#: Bytes of text that a bucket of consecutive ids holds on average.
BUCKET_BYTES = 128 << 20


def _none() -> Column:
    return F.array().cast("array<string>")


def _groups(items: Column, ends_here) -> Column:
    """Texts of the groups that end with the items of ``ends_here``: marked, joined and split, in time linear in their length."""
    marked = F.transform(items, lambda x, i: F.when(ends_here(x) & (i < F.size(items) - 1), F.concat(x, F.lit(MARK))).otherwise(x))
    return F.when(F.size(items) > 0, F.split(F.array_join(marked, ""), MARK, -1)).otherwise(_none())


def _escaped(text: Column) -> Column:
    """A one-to-one image of the text without ``MARK``; only texts that hold ``MARK`` or ``ESC`` change."""
    safe = F.replace(F.replace(text, F.lit(ESC), F.lit(ESC + "2")), F.lit(MARK), F.lit(ESC + "1"))
    return F.when(text.rlike(f"[{MARK}{ESC}]"), safe).otherwise(text)


def _length(text: Column) -> Column:
    """Code points before escaping."""
    return F.length(text) - F.when(F.contains(text, F.lit(ESC)), F.length(text) - F.length(F.replace(text, F.lit(ESC), F.lit("")))).otherwise(0)


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def add_tree(df: DataFrame, text: str, p: str) -> DataFrame:
    """Columns ``<p>root, <p>sections, <p>section_ends, <p>paragraphs, <p>paragraph_ends, <p>phrases, <p>sizes``.

    Nodes of each level in order; the ends count the nodes of the level below up to each node's last. A phrase is 44 bits
    of its hash and its length (20 bits), ``sizes`` are the exact lengths in code points. A null text is an empty one:
    no nodes, and the root is the SHA-256 of nothing. Columns of these names are replaced.
    """
    c = lambda name: F.col(f"{p}{name}")
    own = F.coalesce(F.col(text), F.lit(""))
    ends_line = lambda t: F.contains(t, F.lit("\n"))
    ends_phrase = lambda w: (F.xxhash64(w).bitwiseAND(PHRASE - 1) == 0) | ends_line(w)
    ends_section = lambda t: (F.xxhash64(t).bitwiseAND(SECTION - 1) == 0) | t.rlike(r"\n\s*\n")
    df = df.withColumn(f"{p}words", F.when(F.length(own) > 0, F.split(_escaped(own), WORD_END, -1)).otherwise(_none()))
    df = df.withColumn(f"{p}texts", _groups(c("words"), ends_phrase)).drop(f"{p}words")
    df = df.withColumn(f"{p}paragraph_ends", F.filter(F.transform(c("texts"), lambda x, i: F.when(
        ends_line(x) | (i == F.size(c("texts")) - 1), i + 1)), lambda e: e.isNotNull())).withColumn(f"{p}lines", _groups(c("texts"), ends_line))
    df = df.withColumn(f"{p}cuts", F.transform(c("lines"), ends_section)).withColumn(f"{p}paragraphs", F.transform(c("lines"), _sha)).drop(f"{p}lines")
    many = F.size(c("paragraphs"))
    df = df.withColumn(f"{p}section_ends", F.filter(F.transform(c("cuts"), lambda x, i: F.when(x | (i == many - 1), i + 1)), lambda e: e.isNotNull()))
    last = F.transform(c("paragraphs"), lambda h, i: F.when(F.get(c("cuts"), i) & (i < many - 1), F.concat(h, F.lit(MARK))).otherwise(h))
    df = df.withColumn(f"{p}sections", F.when(many > 0, F.transform(F.split(F.array_join(last, ""), MARK, -1), _sha)).otherwise(_none())).drop(f"{p}cuts")
    df = df.withColumn(f"{p}root", _sha(F.array_join(c("sections"), "")))
    top = F.lit((1 << WEIGHT_BITS) - 1).cast("long")
    return df.withColumn(f"{p}phrases", F.transform(c("texts"), lambda t: F.shiftleft(F.shiftright(F.xxhash64(t), WEIGHT_BITS), WEIGHT_BITS)
                         .bitwiseOR(F.least(_length(t).cast("long"), top)))).withColumn(
        f"{p}sizes", F.transform(c("texts"), _length)).drop(f"{p}texts")


def _weight(phrases: Column) -> Column:
    return F.aggregate(phrases, F.lit(0).cast("long"), lambda s, x: s + x.bitwiseAND((1 << WEIGHT_BITS) - 1))


def likeness(a: str, b: str) -> Column:
    """Twice the text in phrases of both trees over the text in the distinct phrases of either: 1 for equal roots, 0 if nothing is shared."""
    pa, pb = F.col(f"{a}phrases"), F.col(f"{b}phrases")
    both = _weight(F.array_distinct(pa)) + _weight(F.array_distinct(pb))
    return F.when(F.col(f"{a}root") == F.col(f"{b}root"), 1.0).otherwise(2.0 * _weight(F.array_intersect(pa, pb)) / both)


def _same(a: Column, b: Column) -> Column:
    """Leading items that are equal."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    return F.when(at == 0, F.size(a)).otherwise(at - 1)


def _rest(a: Column, n: Column) -> Column:
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def first_difference(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Column ``out``: where in text ``a``, in code points, the first phrase lies that differs from ``b``; null for equal roots.

    Equal leading sections are skipped whole, then equal paragraphs of the first differing section, then equal phrases.
    """
    skipped = lambda ends, n: F.when(F.col(n) == 0, 0).otherwise(F.get(ends, F.col(n) - 1))
    df = df.withColumn("__n", _same(F.col(f"{a}sections"), F.col(f"{b}sections")))
    for level, ends in (("paragraphs", f"{a}section_ends"), ("phrases", f"{a}paragraph_ends")):
        df = df.withColumn("__m", skipped(F.col(ends), "__n"))
        df = df.withColumn("__n", F.col("__m") + _same(_rest(F.col(f"{a}{level}"), F.col("__m")), _rest(F.col(f"{b}{level}"), F.col("__m"))))
    at = F.aggregate(F.slice(F.col(f"{a}sizes"), F.lit(1), F.col("__n")), F.lit(0).cast("long"), lambda s, x: s + x)
    return df.withColumn(out, F.when(F.col(f"{a}root") != F.col(f"{b}root"), at)).drop("__n", "__m")


def _bucket(x: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above ``x``, looked up in two steps."""
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    if not parts:
        return F.lit(0)
    heads = F.expr("array(" + ", ".join(f"{q[0]}L" if q[0] != NO_ID else f"cast('{NO_ID}' as bigint)" for q in parts) + ")")
    rows = F.expr("array(" + ", ".join("array(" + ", ".join(f"{v}L" if v != NO_ID else f"cast('{NO_ID}' as bigint)" for v in q) + ")" for q in parts) + ")")
    part = F.size(F.filter(heads, lambda v: v <= x))
    return F.when(part == 0, 0).otherwise((part - 1) * step + F.size(F.filter(F.get(rows, part - 1), lambda v: v <= x)))


def with_next(docs: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """``doc_id, text, next_text``: the text of the next row by ascending ``doc_id``, of the first one after the last.

    Rows go to buckets of consecutive ids, at least four for each shuffle partition of the session; the first rows of a
    bucket also go to the bucket before it (those of the first to the last), so the texts are shuffled once and no
    task sees more than its bucket. Rows of one id follow each other by text hash and share a bucket. A null id comes
    before all others. Null texts are empty. Results don't depend on ``n_buckets``.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own = own.withColumn("__id", F.coalesce("doc_id", F.lit(NO_ID)))
    if n_buckets is None:
        held = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(held / BUCKET_BYTES))
    cuts = own.agg(F.percentile_approx("__id", [i / n_buckets for i in range(1, n_buckets)], max(10000, 10 * n_buckets))).first()[0] if n_buckets > 1 else None
    own = own.withColumn("__bucket", _bucket(F.col("__id"), sorted(set(cuts or []))))
    firsts = sorted(tuple(r) for r in own.groupBy("__bucket").agg(F.min("__id")).collect())  # a row per bucket
    guests = [(fid, firsts[k - 1][0], k == 0) for k, (_, fid) in enumerate(firsts)]
    guests = spark.createDataFrame(guests, "__first long, __to int, __wrap boolean")
    places = F.array(F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("g")),
                     F.when(F.col("__to").isNotNull(), F.struct(F.col("__to").alias("b"), F.when(F.col("__wrap"), 2).otherwise(1).alias("g"))))
    dealt = (own.join(F.broadcast(guests), F.col("__id") == F.col("__first"), "left")
             .select("doc_id", "__id", "text", F.explode(F.filter(places, lambda x: x.isNotNull())).alias("p"))
             .select("doc_id", "__id", "text", "p.b", "p.g"))
    order = Window.partitionBy("b").orderBy("g", "__id", F.xxhash64("text"))
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("g = 0").select("doc_id", "text", "next_text")


def fingerprint_edits(docs: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, and that of an edited text, with the likeness of both and of the next document's.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_sections, n_paragraphs,
    edit_from``. The edited text has its last ``floor(n_chars / 4)`` code points replaced by the first as many of the
    next document (see ``with_next``). ``edit_from`` is where the first differing phrase starts, null if nothing changed.
    Null texts are empty; two empty texts are alike by 1, an empty and another one by 0. Null and repeated ids keep all
    their rows; other columns are ignored. An empty table gives an empty result.
    """
    df = with_next(docs, n_buckets)
    quarter = F.floor(F.length("text") / 4).cast("int")
    df = df.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.length("text") - quarter), F.substr("next_text", F.lit(1), quarter)))
    df = add_tree(df, "text", "o_")
    df = add_tree(df, "edited", "e_")
    df = add_tree(df, "next_text", "n_")
    df = first_difference(df, "o_", "e_", "edit_from")
    return df.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), _sha(F.col("edited")).alias("edited_sha256"),
        F.col("o_root").alias("fingerprint"), F.col("e_root").alias("edited_fingerprint"),
        likeness("o_", "e_").alias("near_edited"), likeness("o_", "n_").alias("near_next"),
        F.size("o_sections").cast("long").alias("n_sections"), F.size("o_paragraphs").cast("long").alias("n_paragraphs"), "edit_from")
