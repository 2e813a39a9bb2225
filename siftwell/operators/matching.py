"""Joins by what texts contain and by how names differ: anchors first, then the condition itself.

No pair is made that doesn't share an anchor: a rare token for containment, a spelling with letters
left out for close names, a hashed piece for key material. Every match is verified, so anchors cost no rightness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import redact as R
from siftwell.tables import dealt, tasks_for, written

#: Length of the pieces by which key material is found again, and groups that the texts of a hot piece are dealt to.
PIECE, SALTS = 16, 16
#: Characters of the anchor of a needle that has no whole token inside.
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text, read in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def contained(needles: DataFrame, needle_id: str, texts: DataFrame, text_id: str) -> DataFrame:
    """(needle_id, text_id) where the text of texts(text_id, text) contains the needle of needles(needle_id, needle).

    A needle's tokens but for its first and last stand whole in every text that contains it; the one in the
    fewest texts is its anchor. Needles without such a token are anchored by their rarest GRAM characters,
    shorter ones by themselves. Null and empty needles and null texts meet nothing; repeated rows meet once.
    """
    own = needles.where(F.length("needle") > 0).select(needle_id, "needle").distinct()
    inner = F.split("needle", r"\s+", -1)
    inner = F.filter(F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0))), lambda t: t != "")
    own = own.withColumn("_tokens", F.array_distinct(inner)).withColumn("_short", F.size("_tokens") == 0)
    held = texts.where(F.col("text").isNotNull()).select(text_id, "text")

    def met(part: DataFrame, anchors: Column, of_text: Column) -> DataFrame:
        named = part.select(needle_id, "needle", F.explode(anchors).alias("_anchor"))
        asked = named.select("_anchor").distinct()
        places = held.select(text_id, F.explode(of_text).alias("_anchor")).join(asked, "_anchor", "left_semi").distinct()
        often = places.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_n"))
        rarest = named.join(often, "_anchor", "left").groupBy(needle_id, "needle").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_anchor")).alias("a")).where("a.n > 0")
        pairs = rarest.select(needle_id, "needle", F.col("a._anchor").alias("_anchor")).join(places, "_anchor").select(needle_id, "needle", text_id)
        return pairs.join(held, text_id).where(F.contains("text", F.col("needle"))).select(needle_id, text_id)

    out = met(own.where("not _short"), F.col("_tokens"), F.array_distinct(F.split("text", r"\s+", -1)))
    short = own.where("_short").withColumn("_len", F.least(F.length("needle"), F.lit(GRAM)))
    for n in sorted(r["_len"] for r in short.select("_len").distinct().collect()):  # at most GRAM lengths
        out = out.unionByName(met(short.where(F.col("_len") == n), _grams(F.col("needle"), n), _grams(F.col("text"), n)))
    return out.distinct()


def spellings(name: Column, most: int) -> Column:
    """A name and all that is left of it without up to `most` of its characters."""
    out = F.array(name)
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))))))
    return out


def close_names(wanted: DataFrame, names: DataFrame, most: int = 2, best: int = 3) -> DataFrame:
    """(wanted, name, distance, place): the `best` names nearest to each wanted name, within `most` edits (insert, drop or change a character).

    Names within k edits share a spelling with at most k characters left out, so they meet by equal
    spellings and are then measured. Ties go to the smaller name; null names meet nothing.
    """
    own = wanted.where("wanted is not null").select("wanted").distinct().withColumn("_s", F.explode(spellings(F.col("wanted"), most)))
    known = names.where("name is not null").select("name").distinct().withColumn("_s", F.explode(spellings(F.col("name"), most)))
    pairs = own.join(known, "_s").select("wanted", "name").distinct().withColumn("distance", F.levenshtein("wanted", "name")).where(F.col("distance") <= most)
    order = Window.partitionBy("wanted").orderBy("distance", "name")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= best)


def key_pieces(texts: DataFrame) -> DataFrame:
    """(piece): PIECE characters each of the private keys in texts(text), one after another and the last of each run."""
    runs = F.flatten(F.transform(R.private_keys(F.col("text")), lambda k: F.regexp_extract_all(F.regexp_replace(k, F.lit("-----[^-]*-----"), F.lit("")), F.lit(rf"[A-Za-z0-9+/=]{{{PIECE},}}"), F.lit(0))))
    run = texts.select(F.explode(F.array_distinct(runs)).alias("run"))
    starts = F.array_union(F.sequence(F.lit(1), F.length("run") - PIECE + 1, F.lit(PIECE)), F.array(F.length("run") - PIECE + 1))
    return run.select("run", F.explode(starts).alias("i")).select(F.substring(F.col("run"), F.col("i"), F.lit(PIECE)).alias("piece")).distinct()


def key_material(texts: DataFrame, text_id: str, pieces: DataFrame) -> DataFrame:
    """(text_id, piece): the known pieces of keys that stand anywhere in texts(text_id, text), however they were moved or wrapped.

    Runs of key characters in the texts are stored, cut at every offset and meet the pieces by equality, in as many
    partitions as there are cuts to share; the texts of one piece are dealt to SALTS groups, as a third of all may
    hold it. The pieces are the side that is held, so cuts stream past and only those that are pieces are told apart.
    """
    runs = texts.select(text_id, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"[A-Za-z0-9+/=]{{{PIECE},}}"), F.lit(0)))).alias("run"))
    runs = written(runs, "key-runs")
    known = written(pieces.select("piece").distinct(), "key-pieces")
    n = max(tasks_for(runs, 64 * (F.length("run") - PIECE + 1)), tasks_for(known, F.lit(128 * SALTS)))
    cut = runs.select(text_id, F.explode(_grams(F.col("run"), PIECE)).alias("piece")).withColumn("_salt", F.pmod(F.xxhash64(text_id), F.lit(SALTS)).cast("int"))
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = dealt(cut, n, "piece", "_salt").join(dealt(known, n, "piece", "_salt").hint("shuffle_hash"), ["piece", "_salt"])
    return met.select(text_id, "piece").distinct()
