"""Set similarity with a prefix filter: which small sets a large one holds enough of.

A set of n words of which at least t must be held has, whatever they are, l of any n - t + l of its words among them. So only that
many of its words are indexed, the rarest ones over all that is searched: its most common words, stop-words above all, have no
lists. What shares l words in the lists, half of t, is verified by the few common ones that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import held, sized

#: Words that a list may have before it's split, and what rounding may take off a share.
SPLIT, NOISE = 50_000, 1e-9


def prefixes(sets: DataFrame, frequencies: DataFrame, least: float) -> DataFrame:
    """(rid, words, without repeats) and (word, df) -> (rid, needed, few, word, listed): each set's words, whether they are listed, the
    words that a share of `least` needs, and how many of the listed ones. Of equally rare words the first by code points is listed."""
    words = sets.select("rid", F.size("words").alias("n"), F.explode("words").alias("word")).join(frequencies, "word", "left")
    place = F.row_number().over(Window.partitionBy("rid").orderBy(F.coalesce("df", F.lit(0)), "word"))
    needed = F.greatest(F.ceil(F.col("n") * least - NOISE), F.lit(1)).cast("int")
    rows = words.withColumn("_k", place).withColumn("needed", needed).withColumn("few", F.ceil(F.col("needed") / 2).cast("int"))
    return rows.select("rid", "n", "needed", "few", "word", (F.col("_k") <= F.col("n") - F.col("needed") + F.col("few")).alias("listed"))


def held_share(large: DataFrame, small: DataFrame, least: float) -> DataFrame:
    """large (lid, words) and small (rid, words), arrays without repeats -> (lid, rid, score): the share of small's words that large
    holds, where it is `least` (above 0) or more. Ids are unique; sets without words meet nothing.

    Words that no small set has are dropped first. Lists, or the large sets' words, are broadcast up to a checked size, so that the other
    side is counted where it lies. Beyond it a word's list is spread over parts, as many as its frequency asks for, so that no task gets the whole list of
    a common word.
    """
    vocabulary = sized(small.select(F.explode("words").alias("word")).distinct())
    # explode_outer, as explode would have the optimizer filter by the words' size first, and make them twice.
    words = held(large.select("lid", F.explode_outer("words").alias("word")).join(vocabulary, "word", "left_semi"), "words")
    frequencies = held(words.groupBy("word").agg(F.count("*").alias("df")), "frequencies")
    ranked = held(prefixes(small, frequencies, least), "prefixes")
    parts = F.greatest(F.ceil(F.col("df") / SPLIT), F.lit(1)).cast("int")
    common = sized(frequencies.where(F.col("df") > SPLIT).select("word", parts.alias("parts")))
    spread = words.join(common, "word", "left").select("lid", "word", F.pmod(F.xxhash64("lid"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    lists = ranked.where("listed").join(frequencies, "word").select("rid", "n", "needed", "few", "word", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    met = sized(spread).join(sized(lists), ["word", "part"]).groupBy("lid", "rid", "n", "needed", "few").agg(F.count("*").cast("int").alias("shared")).where(F.col("shared") >= F.col("few"))
    rest = ranked.where("NOT listed").groupBy("rid").agg(F.collect_list("word").alias("_rest"))
    unlisted = sized(ranked.where("NOT listed").select("word").distinct())
    kept = words.join(unlisted, "word", "left_semi").groupBy("lid").agg(F.collect_list("word").alias("_kept"))
    both = met.join(sized(rest), "rid", "left").join(sized(kept), "lid", "left")
    shared = F.col("shared") + F.coalesce(F.size(F.array_intersect("_kept", "_rest")), F.lit(0))
    return both.withColumn("_s", shared).where(F.col("_s") >= F.col("needed")).select("lid", "rid", (F.col("_s") / F.col("n")).alias("score"))
