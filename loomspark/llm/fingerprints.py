"""Document fingerprints by winnowing, in DataFrame functions only.

Units are runs of non-space characters, cut to eight at most from the run's start, lower-cased A-Z not applied. Where
that start would decide over much text, each code point is a unit: in scripts without spaces, and in runs of over 64
characters (base64, long URLs), so that equal substrings have equal units wherever they start. Hashes of k = 4 units are rolled up by doubling (each position's hash comes from two hashes of half the
length), the least of each window of w = 8 is taken by doubling too, rightmost on ties, and its position kept. A run
of w + k - 1 = 11 units that two texts share is always found; in a run of 9 to 64 characters they share its units only
from its start on.

Defined cases: null and empty texts have an empty fingerprint and are alike (1.0) to empty ones only; a text of fewer
than k units has one hash of all it has; rows that repeat a doc_id are one step in the order of ids, and the least of their texts
is the next one's; rows without an id have no place in that order and no row here; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm.common import cut

UNIT = r"[^\x20\x09-\x0D]{1,8}"
#: A character of a script without spaces, and one of a run of over 64 characters (from its start on, each behind the last).
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
LONG = r"(?:\G(?!^)|(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]{65}))[^\x20\x09-\x0D]"
K_DOUBLINGS, W_DOUBLINGS = 2, 3
#: What texts hold that have any of the former, and of the latter.
HIGH, RUN = r"[\u0E00-\uFFFF\x{10000}-\x{10FFFF}]", r"[^\x20\x09-\x0D]{65}"
_POS = 31


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _doubled(a: Column, step: int, combine) -> Column:
    """combine(a[i], a[i + step]) for all i that have both; fewer entries become their least."""
    return _let(a, lambda v: F.when(F.size(v) > step, F.transform(F.sequence(F.lit(0), F.size(v) - step - 1), lambda i: combine(F.get(v, i), F.get(v, i + step)))).when(F.size(v) == 0, v).otherwise(F.array(F.array_min(v))))


def winnowed(text: Column) -> Column:
    """array<long> of packed picks (32 bits of hash, then the position counted down), in order of position."""
    # most texts have neither, which a plain search tells
    unspaced = _let(F.coalesce(text, F.lit("")), lambda t: F.when(t.rlike(HIGH), F.regexp_replace(t, UNSPACED, " $0 ")).otherwise(t))
    apart = _let(unspaced, lambda t: F.when(t.rlike(RUN), F.regexp_replace(t, LONG, " $0 ")).otherwise(t))
    grams = F.transform(F.regexp_extract_all(apart, F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))
    # fewer than four units: one hash of all
    grams = _let(grams, lambda v: F.when((F.size(v) > 0) & (F.size(v) < 2**K_DOUBLINGS), F.array(F.xxhash64(v))).otherwise(_rolled(v)))
    packed = F.transform(grams, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 64 - 32), _POS).bitwiseOR(F.lit(2**_POS - 1) - i.cast("long")))
    for d in range(W_DOUBLINGS):
        packed = _doubled(packed, 2**d, F.least)
    return F.array_distinct(packed)


def _rolled(v: Column) -> Column:
    for d in range(K_DOUBLINGS):
        v = _doubled(v, 2**d, lambda x, y: F.xxhash64(x, y))
    return v


def _hashes(picks: Column) -> Column:
    return F.array_distinct(F.transform(picks, lambda p: F.shiftrightunsigned(p, _POS)))


def shown(picks: Column) -> Column:
    """hash@position, comma-joined."""
    return F.array_join(F.transform(picks, lambda p: F.concat(F.lower(F.hex(F.shiftrightunsigned(p, _POS))), F.lit("@"), (F.lit(2**_POS - 1) - p.bitwiseAND(F.lit(2**_POS - 1))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two hash sets; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union).cast("double")


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns fingerprint (text) and picks (array<long>)."""
    out = docs.withColumn("picks", winnowed(F.col(text_col)))
    return out.withColumn("fingerprint", shown(F.col("picks")))


def successors(ids: DataFrame) -> DataFrame:
    """(id, next_id) in ascending order of distinct ids, the last one's being the first, without one global sort task."""
    spread = cut(ids.select("id").distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    ends = spread.groupBy("part").agg(F.min("id").alias("first"))
    # a row for each partition
    after = Window.orderBy("part")
    ends = ends.withColumn("after", F.coalesce(F.lead("first").over(after), F.min("first").over(Window.partitionBy())))
    inside = spread.withColumn("next_id", F.lead("id").over(Window.partitionBy("part").orderBy("id")))
    return inside.join(F.broadcast(ends), "part").select("id", F.coalesce("next_id", "after").alias("next_id"))


def edited_likeness(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The digest of each row's text, of its edited text, and their likenesses."""
    # one shuffle of the texts serves every step below: all are by id
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartition("id")
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    order = successors(docs.select(F.col(id_col).alias("id")))
    # what each document has to lend: the head that the document before it needs
    need = text.groupBy("id").agg(F.max(quarter).alias("k")).join(order, "id").select(F.col("next_id").alias("id"), "k", F.col("id").alias("to_id"))
    heads = text.join(need, "id").groupBy("to_id").agg(F.min(F.expr("substring(text, 1, k)")).alias("head")).withColumnRenamed("to_id", "id")
    both = text.join(heads, "id").withColumn("n", F.char_length("text")).withColumn("k", quarter)
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n - k))"), F.expr("substring(head, 1, k)")))
    both = both.select("id", "n", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), winnowed(F.col("text")).alias("picks"), winnowed(F.col("edited")).alias("edited_picks"))
    own = text.select("id", _hashes(winnowed(F.col("text"))).alias("next_hashes")).groupBy("id").agg(F.min("next_hashes").alias("next_hashes")).withColumnRenamed("id", "next_id")
    nexts = own.join(order.select("next_id", F.col("id").alias("to_id")), "next_id").select(F.col("to_id").alias("id"), "next_hashes")
    out = both.join(nexts, "id")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        shown(F.col("picks")).alias("fingerprint"),
        shown(F.col("edited_picks")).alias("edited_fingerprint"),
        likeness(_hashes(F.col("picks")), _hashes(F.col("edited_picks"))).alias("near_edited"),
        likeness(_hashes(F.col("picks")), F.col("next_hashes")).alias("near_next"),
    )
