"""Logged conversations: fold cumulative snapshots, render what is maximal. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import text_or_empty

_SALTS = (17, 1_000_003)
OPENING, CLOSING = "<|im_start|>", "<|im_end|>"


def _turns(rows: DataFrame) -> DataFrame:
    """The four columns under own names, and two hashes of what was said by whom."""
    said = (F.col("role").isNull(), text_or_empty("role"), F.col("text").isNull(), text_or_empty("text"))
    return rows.select(
        F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("role").alias("_role"), F.col("text").alias("_text"),
        *[F.xxhash64(F.lit(s), *said).alias(f"_h{i}") for i, s in enumerate(_SALTS)])


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """One row for each turn: conversation, position, number of turns, 128-bit hash of all turns so far.

    The hash rolls: each turn adds (by xor) the hash of its position and content. Texts
    themselves are not shuffled.
    """
    turns = _turns(rows).drop("_text")
    whole = W.partitionBy("_conv")
    order = whole.orderBy("_turn", "_role", "_h0", "_h1")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = turns.withColumn("_pos", F.row_number().over(order))
    return placed.select(
        "_conv", "_pos", F.count(F.lit(1)).over(whole).alias("_n"),
        *[F.bit_xor(F.xxhash64(F.lit(s), "_pos", "_h0", "_h1")).over(so_far).alias(f"_p{i}") for i, s in enumerate(_SALTS)])


def maximal_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns``, ``n_copies`` of conversations that begin no longer one.

    Conversations with the same turns are one, named by the smallest id. Both sides of the
    anti-join hold each hash once, so common openings don't make it uneven.
    """
    hashed = prefix_hashes(rows)
    finals = (
        hashed.where("_pos = _n").groupBy("_n", "_p0", "_p1")
        .agg(F.min("_conv").alias("conv_id"), F.count(F.lit(1)).alias("n_copies")))
    proper = hashed.where("_pos < _n").select(F.col("_pos").alias("_n").cast("bigint"), "_p0", "_p1").distinct()
    kept = finals.join(proper, ["_n", "_p0", "_p1"], "left_anti")
    return kept.select("conv_id", F.col("_n").alias("n_turns"), "n_copies")


def _shown(text: Column) -> Column:
    """A text that holds no marker of the template: a blank splits each one found in it."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def format_chats(rows: DataFrame) -> DataFrame:
    """Collapse snapshots of ``conv_id, turn, role, text`` and render the rest.

    Returns ``conv_id``, ``n_turns``, ``n_copies``, ``rendered``: turns in order, each between an opening
    mark with its role and a closing mark. A log that is the beginning of a longer one goes.

    Turns are ordered by turn, then role, then content; a repeated row is a turn of its
    own. Rows without conv_id are one conversation. A null role is shown as ``unknown``, a
    null text as empty, and neither equals the written word. No rows, no result;
    further columns are ignored. A conversation is one result row, so its turns meet there.
    """
    kept = maximal_conversations(rows).withColumnRenamed("conv_id", "_kept")
    turns = _turns(rows)
    mine = turns.join(kept, turns["_conv"].eqNullSafe(kept["_kept"]))
    ordered = F.sort_array(F.collect_list(F.struct("_turn", "_role", "_h0", "_h1", "_text")))
    line = lambda t: F.concat(
        F.lit(OPENING), _shown(F.coalesce(t["_role"], F.lit("unknown"))), F.lit("\n"), _shown(F.coalesce(t["_text"], F.lit(""))),
        F.lit(CLOSING + "\n"))
    return mine.groupBy(F.col("_conv").alias("conv_id"), F.col("n_turns"), F.col("n_copies")).agg(
        F.array_join(F.transform(ordered, line), "").alias("rendered"))
