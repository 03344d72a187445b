"""I-Match fingerprints over randomised lexicons, in DataFrame functions only.

Terms are words hashed into a fixed number of slots.  The lexicon is the slots whose inverse document
frequency lies in a band, kept as one bitmap of fixed size.  A fingerprint is a list of hashes: one of
all distinct lexicon terms of a text in order, and one for each random part of the lexicon, parts of
several sizes, so that some survive small edits and some large ones.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm.store import partitions, settle

SLOT_BITS = 22
# Band of document frequency, as shares of all documents: idf = -ln(share) between 3.9 and 6.9.
RAREST, COMMONEST = 1e-3, 0.02
# The lexicon is dealt at random into 4, each of these into 4 parts, and so on.
LEVELS, WAYS = 3, 4
EMPTY = "-"
LAST = (1 << 63) - 1


def terms(text: Column) -> Column:
    """Distinct slots of the lower-cased words of a text; letters and digits make words."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(found, lambda w: F.xxhash64(w).bitwiseAND((1 << SLOT_BITS) - 1).cast("int")))


def lexicon(docs: DataFrame, text_col: str, rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """One row: the bitmap of slots in the band as words of 64 bits.  Its size is fixed, whatever the corpus."""
    total = docs.count()
    low, high = max(2, int(rarest * total)), max(2, int(commonest * total))
    slots = docs.select(F.explode(terms(F.col(text_col))).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("df"))
    used = slots.where(F.col("df").between(low, high)).select(F.shiftright("slot", 6).alias("word"), (F.col("slot") % 64).alias("bit"))
    bits = used.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    every = docs.sparkSession.range(1 << (SLOT_BITS - 6)).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = bits.unionAll(every).groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"])
    return settle(words.agg(packed.alias("bitmap")))


def _share(column: str, level: int, way: int) -> Column:
    """The hashes whose two bits of this level name the part."""
    return F.filter(column, lambda h: F.shiftrightunsigned(h, 2 * level).bitwiseAND(WAYS - 1) == way)


def _hash(column: str, digits: int) -> Column:
    return F.when(F.size(column) == 0, EMPTY).otherwise(F.right(F.lower(F.hex(F.xxhash64(column))), F.lit(digits)))


def with_fingerprint(df: DataFrame, text: Column, bitmap: DataFrame, name: str) -> DataFrame:
    """Adds array ``name`` of one hash for each part, EMPTY for a part without terms."""
    df = df.withColumn("_bitmap", bitmap.scalar()).withColumn("_slots", terms(text))
    known = F.filter("_slots", lambda s: F.getbit(F.get("_bitmap", F.shiftright(s, 6)), s.bitwiseAND(63)) == 1)
    df = df.withColumn("_known", known)
    df = df.withColumn("_terms", F.array_sort(F.when(F.size("_known") > 0, F.col("_known")).otherwise(F.col("_slots"))))
    df = df.withColumn("_part", F.transform("_terms", lambda t: F.xxhash64(t)))
    hashes, parts = [_hash("_part", 16)], ["_part"]
    for level in range(LEVELS):
        made = {f"{part}{way}": _share(part, level, way) for part in parts for way in range(WAYS)}
        df = df.withColumns(made)
        parts = list(made)
        hashes += [_hash(part, 4) for part in parts]
    helpers = [c for c in df.columns if c.startswith("_part")]
    return df.withColumn(name, F.array(*hashes)).drop("_bitmap", "_slots", "_known", "_terms", *helpers)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the parts that are not empty in both; 1 for two texts without any term."""
    same = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: (p["x"] == p["y"]) & (p["x"] != EMPTY)))
    used = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: (p["x"] != EMPTY) | (p["y"] != EMPTY)))
    return F.when(used == 0, 1.0).otherwise(same / used)


def beside_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t, next_t, block, at): every text beside the next one by ascending id, after the last the first.

    Ids are cut into ranges of about equal numbers of rows.  Each range also gets the first row of the
    one after it, so the texts move once and no task sees more than its range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(LAST)))
    wanted = 4 * partitions(spark)
    cuts = rows.select(F.percentile_approx("at", [i / wanted for i in range(1, wanted)], 100 * wanted)).first()[0] or [0]
    edges = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    rows = Bucketizer(splits=edges, inputCol="place", outputCol="block").transform(rows.withColumn("place", F.col("at").cast("double")))
    rows = rows.withColumn("block", F.col("block").cast("int")).drop("place")
    # At most one row for each range: what it begins with, and the range before it (before the first: the last).
    begins = rows.groupBy("block").agg(F.min("at").alias("at"))
    ordered = Window.orderBy("block")
    last = F.max("block").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    begins = settle(begins.select("at", F.coalesce(F.lag("block").over(ordered), last).alias("before")))
    both = rows.join(F.broadcast(begins), "at", "left")
    here = F.struct(F.col("block").alias("block"), F.lit(0).alias("copy"))
    there = F.struct(F.col("before").alias("block"), F.lit(1).alias("copy"))
    both = both.withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))))
    return both.select("doc_id", "t", "at", "to.block", "to.copy")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).  The edited
    text has its last floor(n_chars / 2) code points replaced by the first as many of the next document.
    Null texts are empty; rows with a null id come after all others; rows that repeat an id follow each
    other in order of their texts.  Texts may be of any length; an empty table gives an empty one;
    other columns are not read.
    """
    bitmap = lexicon(docs, text_col, rarest, commonest)
    rows = beside_next(docs, id_col, text_col)
    rows = with_fingerprint(rows, F.col("t"), bitmap, "own")
    ahead = Window.partitionBy("block").orderBy("copy", "at", "t")
    rows = rows.withColumn("next_t", F.lead("t").over(ahead)).withColumn("next_own", F.lead("own").over(ahead)).where("copy = 0")
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("t", n - half), F.left("next_t", half))
    rows = rows.withColumn("edited", edited)
    rows = with_fingerprint(rows, F.col("edited"), bitmap, "other")
    return rows.select(
        F.col("doc_id").alias(id_col),
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.concat_ws(".", "own").alias("fingerprint"),
        F.concat_ws(".", "other").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
