"""Token sequences: ids from a vocabulary table, masks, padding, shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import append_and_pad
from .ordered import ranked, running


def tokenise_rows(df: DataFrame, key: Sequence[str], words: Column, vocabulary: DataFrame, unknown: int,
                  name: str = "tokens") -> DataFrame:
    """Ids of each row's words by a join with ``vocabulary`` (word, id); order is kept.

    Distinct words meet the vocabulary, so a frequent word is one row per task, not a hot join key.
    """
    rows = df.select(*key, F.posexplode(words).alias("_pos", "word"))
    used = rows.select("word").distinct().join(vocabulary.select("word", "id"), "word", "left")
    ids = rows.join(used, "word", "left").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(
        "_pos", F.coalesce("id", F.lit(unknown)).alias("id")))).alias("_l"))
    return ids.select(*key, F.transform("_l", lambda s: s["id"]).alias(name))


def detokenise(tokens: Column, vocabulary: dict[int, str], unknown: str = "<unk>") -> Column:
    """Words of an id array from a small vocabulary held as a literal map."""
    table = F.create_map(*[F.lit(x) for kv in vocabulary.items() for x in kv])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(unknown)))


# Type id of each token of a member.
TOKEN_TYPES = {"Format": 0, "Mon": 1, "Ability": 2, "Item": 3, "Move": 4, "Nature": 5, "EV": 6, "IV": 7, "Tera Type": 8}


def team_sequence(fmt: Column, members: Column, n_moves: int = 4) -> Column:
    """Tokens of a team with type ids: the format, then name, ability, item, tera type and moves of each
    member.  ``members`` is an array of struct (name, ability, item, tera_type, moves); unknown stays null.
    """
    cell = lambda value, kind: F.struct(F.concat(F.lit(f"{kind}: "), value).alias("token"),
                                        F.lit(TOKEN_TYPES[kind]).alias("type"))
    one = lambda m: F.concat(
        F.array(cell(m["name"], "Mon"), cell(m["ability"], "Ability"), cell(m["item"], "Item"),
                cell(m["tera_type"], "Tera Type")),
        F.transform(F.sequence(F.lit(1), F.lit(n_moves)), lambda i: cell(F.try_element_at(m["moves"], i), "Move")))
    return F.concat(F.array(cell(fmt, "Format")), F.flatten(F.transform(members, one)))


def prediction_mask(x: Column, y: Column) -> Column:
    """True where a token is hidden in x and known in y."""
    return F.zip_with(x, y, lambda a, b: a["token"].isNull() & b["token"].isNotNull())


def pad_batches(df: DataFrame, batch: Sequence[str], tokens: str, end: int, pad: int, cap: int | None = None) -> DataFrame:
    """Token arrays with an end marker, padded to the longest of the batch or a cap; true lengths kept."""
    longest = df.groupBy(*batch).agg((F.max(F.size(tokens)) + 1).alias("_len"))
    length = F.col("_len") if cap is None else F.least(F.col("_len"), F.lit(cap))
    rows = df.join(longest, [*batch])
    return rows.withColumn("length", F.least(F.size(tokens) + 1, length)).withColumn(
        tokens, append_and_pad(F.col(tokens), F.lit(end), length, F.lit(pad))).drop("_len")


def shards(steps: DataFrame, battle: str, seg: str, step: str, tokens: str, per_shard: int,
           battle_seg: Column) -> DataFrame:
    """Steps with shard number, token count and token offset inside the shard.

    Battles are numbered in id order and packed ``per_shard`` to a shard.  The flat array of a shard is
    its steps in order; it stays in rows, so a shard of any length is written by many tasks.
    """
    ids = ranked(steps.select(battle).distinct(), [], battle_seg, [battle], "_i")
    ids = ids.select(battle, F.floor((F.col("_i") - 1) / per_shard).alias("shard"))
    rows = steps.join(ids, battle).withColumn("n_tokens", F.size(tokens).cast("bigint")).withColumn(
        "_seg", F.struct(F.col(battle).alias("b"), F.col(seg).alias("s")))
    out = running(rows, ["shard"], "_seg", [battle, step], {"_upto": ("sum", F.col("n_tokens"))})
    return out.withColumn("token_offset", F.col("_upto") - F.col("n_tokens")).drop("_upto", "_seg")


def shard_summary(packed: DataFrame, battle: str) -> DataFrame:
    """Battles, states, tokens and longest state per shard."""
    per = packed.groupBy("shard", battle).agg(F.count("*").alias("_s"), F.sum("n_tokens").alias("_t"),
                                              F.max("n_tokens").alias("_m"))
    return per.groupBy("shard").agg(F.count("*").alias("battles"), F.sum("_s").alias("states"),
                                    F.sum("_t").alias("tokens"), F.max("_m").alias("longest"))
