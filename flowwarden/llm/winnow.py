"""Document fingerprints by winnowing. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import staged, text_or_empty

#: A match of GRAM + WINDOW - 1 words is always found, one shorter than GRAM words never.
GRAM, WINDOW = 5, 4
#: Words end at white space; in scripts written without blanks each character is a word.
_WORD_ENDS = r"\s+|(?<=[぀-ヿ㐀-鿿가-힯])"
_PLACE_BITS = 31
#: Bytes of text in a block of neighbours.
BLOCK_BYTES = 128 << 20


def with_marks(df: DataFrame, text: Column, gram: int = GRAM, window: int = WINDOW, name: str = "marks") -> DataFrame:
    """Add ``name``: the text's marks in order, each a 32-bit gram hash above a 31-bit place.

    Every gram of ``gram`` words is hashed; of each ``window`` consecutive hashes the smallest is
    kept, of equal ones the rightmost (places count down inside a mark, so the smallest
    number is that one); a hash that several windows choose is one mark. Texts of fewer
    words are one gram, texts of fewer grams one window. Null and empty texts have no mark.
    """
    words, grams = f"_{name}_words", f"_{name}_grams"
    top = (1 << _PLACE_BITS) - 1
    df = df.withColumn(words, F.split(F.nullif(text, F.lit("")), _WORD_ENDS, -1))
    df = df.withColumn(grams, F.expr(
        f"transform(sequence(1, greatest(size({words}) - {gram - 1}, 1)), i -> "
        f"shiftleft(xxhash64(slice({words}, i, {gram})) & 4294967295L, {_PLACE_BITS}) | ({top}L - i))"))
    least, width, step = grams, 1, 0
    while width < window:
        shift, step = min(width, window - width), step + 1
        name_now = f"_{name}_{step}"
        df = df.withColumn(name_now, F.expr(f"zip_with({least}, slice({least}, {shift + 1}, size({least})), (a, b) -> least(a, b))"))
        least, width = name_now, width + shift
    chosen = F.expr(f"array_distinct(slice({least}, 1, greatest(size({grams}) - {window - 1}, 1)))")
    df = df.withColumn(name, F.when(F.col(words).isNull(), F.array().cast("array<bigint>")).otherwise(chosen))
    return df.drop(words, grams, *[f"_{name}_{i + 1}" for i in range(step)])


def places(marks: Column) -> Column:
    """Word numbers, from 0, at which the marked grams begin."""
    top = (1 << _PLACE_BITS) - 1
    return F.transform(marks, lambda m: (F.lit(top) - m.bitwiseAND(F.lit(top)) - 1).cast("int"))


def hashes(marks: Column) -> Column:
    """The distinct gram hashes, shifted into 32 signed bits."""
    return F.array_distinct(F.transform(marks, lambda m: (F.shiftright(m, _PLACE_BITS) - (1 << 31)).cast("int")))


def digest(marks: Column) -> Column:
    """A fingerprint as text: 32 hex digits over hashes and places."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(s), marks)), 16, "0") for s in (3, 5)]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes; of two empty ones 1."""
    common = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - common
    return F.when(either == 0, 1.0).otherwise(common / either)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``key``, ``place``, ``hash``: one row for each mark of each document.

    Null and empty texts give no rows; repeated rows give theirs again, null keys keep
    theirs. Texts are read whole; other columns are ignored, whatever their names.
    """
    marked = with_marks(docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text")), F.col("_text"), gram, window, "_marks")
    # outer: else the optimiser tests the array's size below, and so builds it anew for every word
    rows = marked.select("_key", F.explode_outer("_marks").alias("_mark")).where("_mark is not null")
    one = F.array("_mark")
    return rows.select(F.col("_key").alias(key), F.get(places(one), 0).alias("place"), F.shiftright("_mark", _PLACE_BITS).alias("hash"))


def _block_of(me: Column, firsts: Column) -> Column:
    """How many of the descending ``firsts`` are not below ``me``, less one; by halving, so that many blocks cost little."""
    step = F.struct(F.lit(0).alias("lo"), F.size(firsts).alias("hi"))

    def halved(s: Column, _: Column) -> Column:
        middle = F.call_function("div", s["lo"] + s["hi"], F.lit(2)).cast("int")
        above = F.get(firsts, middle) >= me
        narrower = F.struct(F.when(above, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(middle).alias("hi"))
        return F.when(s["lo"] < s["hi"], narrower).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(firsts) + 1)).cast("int")), step, halved)["lo"] - 1


def with_next(rows: DataFrame, order: list[str], carry: list[str], blocks: int) -> DataFrame:
    """Add ``next_<c>`` of the next row by descending ``order``, nulls last; after the last, the first.

    No two rows are equal in ``order``, and ``rows`` are stored, so that they read the same each time.
    A range partitioning of ``order`` alone gives the first row of each of about ``blocks`` equal
    blocks. Rows then move once, to their block; the first row of a block goes also to
    the end of the one before, so a window in each block sees every next row.
    """
    me = F.struct(*order)
    dealt = rows.select(*order).repartitionByRange(blocks, *[F.desc_nulls_last(c) for c in order]).withColumn("_part", F.spark_partition_id())
    firsts = dealt.groupBy("_part").agg(F.max(me).alias("_first")).agg(F.sort_array(F.collect_list("_first"), asc=False).alias("_firsts"))
    placed = rows.join(F.broadcast(firsts), F.lit(True)).withColumn("_block", _block_of(me, F.col("_firsts")))   # one row, of one entry a block
    before = F.pmod(F.col("_block") - 1, F.size("_firsts"))
    own, again = (F.struct(b.alias("_block"), F.lit(g).alias("_again")) for b, g in ((F.col("_block"), False), (before, True)))
    homes = F.when(me == F.get("_firsts", F.col("_block")), F.array(own, again)).otherwise(F.array(own))
    placed = placed.select(*rows.columns, F.explode_outer(homes).alias("_home")).select(*rows.columns, "_home.*")
    down = W.partitionBy("_block").orderBy("_again", *[F.desc_nulls_last(c) for c in order])
    beside = placed.withColumns({f"next_{c}": F.lead(c).over(down) for c in carry})
    return beside.where(~F.col("_again")).drop("_block", "_again")


def compared_with_edits(docs: DataFrame, blocks: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited one, and how alike they are.

    Edited: the last half of the text's characters (rounded down) replaced by as many first ones
    of the next document in descending key order (fewer if it is shorter; after the last: the first).

    Returns ``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.
    Null texts count as empty. Null keys come last in the descending order; rows of equal
    keys are ordered by a hash of the text, equal rows as they are read, which changes no result.
    A single row is its own next. No rows, no result. Other columns are ignored, whatever their names.

    Rows are numbered and written once; neighbours meet in blocks of some ``BLOCK_BYTES``, ``blocks`` of them at
    least, which cut through rows of one key and through copies.
    """
    plain = staged(docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text")).withColumns({
        "_tie": F.xxhash64("_text"), "_copy": F.monotonically_increasing_id(), "_size": F.octet_length("_text")}), "numbered")
    size = plain.agg(F.sum(F.col("_size").cast("bigint"))).first()[0] or 0
    marked = with_marks(plain, F.col("_text"), name="_marks")
    marked = marked.select("_key", "_tie", "_copy", "_text", digest(F.col("_marks")).alias("_print"), hashes(F.col("_marks")).alias("_set"))
    beside = with_next(marked, ["_key", "_tie", "_copy"], ["_text", "_set"], max(blocks, size // BLOCK_BYTES))
    n = F.char_length("_text")
    half = F.call_function("div", n, F.lit(2)).cast("int")
    beside = beside.withColumn("_edited", F.concat(F.left("_text", n - half), F.left("next__text", half)))
    beside = beside.select("_key", "_print", "_set", "next__set", "_edited", n.cast("bigint").alias("_n"))
    both = with_marks(beside, F.col("_edited"), name="_edits").withColumn("_edited_set", hashes(F.col("_edits")))
    return both.select(
        F.col("_key").alias(key), F.col("_n").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        F.col("_print").alias("fingerprint"), digest(F.col("_edits")).alias("edited_fingerprint"),
        likeness(F.col("_set"), F.col("_edited_set")).alias("near_edited"), likeness(F.col("_set"), F.col("next__set")).alias("near_next"))
