"""Importance resampling toward a target distribution: hashed n-grams from a table of word positions, and Gumbel top-k.

``posexplode`` makes a row per word and position; window ``lead`` within a document puts the following words beside it,
so that a feature of each order is a concatenation in its row. Features hash to buckets, buckets are counted in the raw
and in the target texts, and the gain of a bucket is the logarithm of its smoothed odds. A document's weight is the sum
of its gains, joined from a table of as many rows as there are buckets. The documents drawn have the largest weights
plus Gumbel noise, that is a sample without replacement by weight. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import lower_ascii, materialise, ranked

#: Words are runs of anything but these characters: ASCII other than digits and small letters (A-Z are lowered before).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORDER, BUCKETS, SCALE, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 1000, 10, 20, 2024


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def position_table(rows: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """(key, pos, word): a row per word; a text without words has one row of nulls."""
    return rows.select(*key, F.posexplode_outer(words(F.col(text_col))).alias("pos", "word"))


def features(rows: DataFrame, key: list[str], text_col: str, order: int, buckets: int) -> DataFrame:
    """(key, more, bucket): a row per run of 1 + ``more`` words, up to ``order`` words; (key, 0, null) for texts without words.

    Single words need no neighbours, so ``order`` 1 needs no window and no shuffle of words.
    """
    table = position_table(rows, key, text_col)
    if order == 1:
        table = table.select(*key, F.lit(0).alias("more"), F.col("word").alias("run"))
    else:
        following = Window.partitionBy(*key).orderBy("pos")
        runs = [F.col("word")]
        for j in range(1, order):
            runs.append(F.concat(runs[-1], F.lit(" "), F.lead("word", j).over(following)))  # null past the end
        table = table.select(*key, F.array(*runs).alias("runs")).select(*key, F.posexplode(F.array_compact("runs")).alias("more", "run")).unionAll(table.where("word IS NULL").select(*key, F.lit(0), F.col("word")))
    return table.select(*key, "more", F.pmod(F.crc32(F.col("run").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))


def gains(raw: DataFrame, target: DataFrame, text_col: str, target_text: str, order: int, buckets: int, scale: int) -> DataFrame:
    """(bucket, gain) of every bucket that a raw text meets, ``buckets`` rows at most, written once."""
    row = lambda df, text: df.select(F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    count = lambda df, text, n: features(row(df, text), ["_row"], "_text", order, buckets).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias(n))
    both = count(raw, text_col, "s").select("bucket", "s", F.lit(0).cast("long").alias("t")).unionAll(count(target, target_text, "t").select("bucket", F.lit(0).cast("long").alias("s"), "t"))
    counts = materialise(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "resampling-counts")
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    d = lambda c, more: (F.col(c) + F.lit(more)).cast("double")
    odds = (d("t", 1) * d("all_s", buckets)) / (d("s", 1) * d("all_t", buckets))
    return counts.where("s > 0").crossJoin(F.broadcast(total)).select("bucket", F.floor(F.lit(float(scale)) * F.log(odds)).cast("long").alias("gain"))  # total: one row


def noise(row_id: Column, seed: int, scale: int) -> Column:
    """floor of scale times Gumbel noise that depends on the seed and the id only; a null id is taken as no text."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(float(-scale)) * F.log(-F.log(share))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", order: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_features, weight, score, rank, n_words; rank is null for what isn't drawn.

    Of the N rows with ``least_words`` words or more floor(percent * N / 100) are drawn, those of largest score, equal
    scores by the smaller id; rows that repeat an id are drawn each by its own text. Null and empty texts and texts
    without words have no features and weight 0; texts of any length are read whole. An id may be null: it comes first
    among equal scores. Without target texts, or with an empty ``docs``, the gains come from the smoothing alone, or
    there are no rows. Other columns aren't read, whatever their names. Rows are numbered where they are read, so a lost
    task must read its rows in the same order again, as it does from a table.
    """
    if buckets < 1 or order < 1 or not 0 <= percent <= 100:
        raise ValueError("order and buckets must be positive and percent within 0 and 100")
    table = F.broadcast(materialise(gains(docs, target, text_col, target_text, order, buckets, scale), "resampling-gains"))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    met = features(rows, ["_row", "_id"], "_text", order, buckets).join(table, "bucket", "left")
    single = F.count(F.when(F.col("more") == 0, F.col("bucket")))
    summed = met.groupBy("_row", "_id").agg(F.count("bucket").alias("n_features"), single.alias("n_words"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    scored = materialise(summed.withColumn("score", F.col("weight") + noise(F.col("_id"), seed, scale)), "resampling-scores")

    able = scored.where(F.col("n_words") >= least_words)
    wanted = percent * able.count() // 100
    order_ = [F.col("score").desc(), F.col("_id").asc_nulls_first(), F.col("_row").asc()]
    placed = ranked(able, order_, "rank").withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    out = placed.select(*rest.columns).unionAll(rest)
    return out.select(F.col("_id").alias(id_col), "n_features", "weight", "score", "rank", "n_words")
