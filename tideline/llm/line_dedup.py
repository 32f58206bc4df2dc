"""Line deduplication over the corpus: a line that many documents share stays in one of them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialised, packed, unpacked

#: stripped at both ends of a line: space, and tab to carriage return
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: keys in at least 1/HOT_KEYS of all pairs of repeated key and document; there can't be more of them than this
HOT_KEYS = 4096


def line_key(line: Column) -> Column:
    """What equal lines share: the line without blanks at its ends, A-Z lower-cased and no other letter."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() would fold other letters too, so that it is only used where there are none; it is much faster than translate()
    return F.when(F.char_length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(value: Column, names: tuple[str, str]) -> list[Column]:
    """128 bits of XXH64 under two seeds."""
    return [F.xxhash64(F.lit(seed), value).alias(name) for seed, name in enumerate(names, 1)]


def _lines(value: Column) -> Column:
    return F.split(F.coalesce(value, F.lit("")), "\n", -1)


def drop_lines(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", min_docs: int = 3, min_length: int = 20, carry: list[str] | None = None) -> DataFrame:
    """Columns `carry` (default: id_col), n_lines, n_dropped and kept: the text without lines that at least min_docs documents share.

    A document is what one id names: rows of equal id count once, and the rows of the largest id that holds a key keep
    its lines; others lose all lines of the key. Keys of fewer than min_length code points are never dropped. Equal
    keys are told by 128 bits of hash. A null or empty text is one empty line; a null id is a document of its own,
    smaller than all others; repeated rows are all returned; an empty table gives an empty one; columns outside
    `carry` are neither read nor in the way.

    Only hashes and positions of lines cross the first exchanges. Distinct (key, document) pairs are made before keys
    are counted, so that no key's lines meet in one task. Then the few keys that hold a large part of all pairs, no
    more than HOT_KEYS of them, are joined by broadcast, all others by an exchange in which none is large. Texts
    move once, split into lines, to meet the positions that they lose.
    """
    carry = [id_col] if carry is None else carry
    row = [F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")]
    spread = docs.select(*row).select("id", *_hashes(F.col("text"), ("t1", "t2")), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = spread.select("id", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_length)
    lines = materialised(keyed.select("id", "t1", "t2", "pos", *_hashes(F.col("key"), ("h1", "h2"))), "lines")

    pairs = lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    counted = pairs.groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs)
    repeated = materialised(counted, "repeated")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_KEYS >= total
    hot, cold = repeated.where(is_hot).select("h1", "h2", F.col("last").alias("hot_last"), F.lit(True).alias("hot")), repeated.where(~is_hot)

    tried = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    of_hot = tried.where("hot").select("id", "t1", "t2", "pos", F.col("hot_last").alias("last"))
    of_cold = tried.where("hot is null").select("id", "t1", "t2", "pos", "h1", "h2").join(cold, ["h1", "h2"]).select("id", "t1", "t2", "pos", "last")
    lost = of_hot.unionByName(of_cold).where(~F.col("id").eqNullSafe(F.col("last")))
    gone = lost.groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("gone")).withColumnRenamed("id", "gone_id")

    # rows too short to lose a line need no partner: a number of their own spreads them, however many are equal
    t1, t2 = _hashes(F.col("text"), ("t1", "t2"))
    whole = docs.select(*row, packed(carry).alias("rest")).select("rest", "id", F.when(F.char_length("text") < min_length, F.monotonically_increasing_id()).otherwise(t1).alias("t1"), t2, _lines(F.col("text")).alias("lines"))
    joined = whole.join(gone, (whole.t1 == gone.t1) & (whole.t2 == gone.t2) & whole.id.eqNullSafe(gone.gone_id), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return joined.select(*unpacked(carry), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
