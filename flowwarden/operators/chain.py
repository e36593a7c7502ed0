"""Tamper-evident threat log: SHA-256 chained blocks that build and verify in parallel.

One endless chain would have to be hashed by one task. Here the log is a chain per
*segment*, a span of ``SEGMENT_SPAN`` consecutive flow ids, so a segment never holds more
blocks than that whatever the source or hour distribution is. The last hashes of
``SEGMENT_SPAN`` neighbouring segments are chained in turn, and so on up to one root
hash, which seals the whole log. ``flow_id`` must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..fixed_values import (
    GENESIS_MESSAGE, GENESIS_PREVIOUS_HASH, KEY_FEATURES, LOG_PAGE_SIZE, LOG_VIEW_DEFAULTS, SEVERITY_LEVELS,
)
from ..schema import CATEGORICAL_FEATURES, NETWORK_FEATURES_SCHEMA
from .detect import INTRUSION, PROB, only, summarise_action
from .detect import alerts as make_alerts
from .ranking import running_totals

SEGMENT_SPAN = 1000
SEP = "|"
TIME_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DATA_COLUMNS = [
    "intrusion_probability", "severity_level", "severity_name", "priority", "action_summary",
    "immediate_actions", "monitoring_actions", "network_features",
]


def segment_of(flow_id: Column, span: int = SEGMENT_SPAN) -> Column:
    return F.call_function("div", flow_id, F.lit(span)).cast("bigint")


def _plain(c: Column) -> Column:
    """Field text for hashing: separator and escape escaped, null told from empty."""
    text = F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit(SEP), F.lit("\\" + SEP))
    return F.coalesce(text, F.lit("\\N"))


def timed(entries: DataFrame) -> DataFrame:
    """Entries with their ``timestamp`` (text), null where none is known."""
    return entries if "timestamp" in entries.columns else entries.withColumn("timestamp", F.lit(None).cast("string"))


def payload() -> Column:
    """Canonical text of a log entry: its time, integers, texts, numbers with nine decimals, lists with their separator escaped."""
    def number(c):
        return c.cast("decimal(38,9)")

    def listed(c):
        escaped = F.transform(c, lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit(";"), F.lit("\\;")))
        return F.array_join(escaped, "; ")

    fields = [
        F.col("timestamp"), F.col("sample_index"), number(F.col("intrusion_probability")), F.col("severity_level"),
        F.col("severity_name"), F.col("priority"), F.col("action_summary"),
        listed("immediate_actions"), listed("monitoring_actions"),
    ]
    for f in NETWORK_FEATURES_SCHEMA.fieldNames():
        c = F.col(f"network_features.{f}")
        fields.append(c if f in CATEGORICAL_FEATURES or f.endswith("_ip") else number(c))
    return F.concat_ws(SEP, *[_plain(c) for c in fields])


def block_hash(previous: Column, index: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(SEP, previous, index.cast("string"), text), 256)


def genesis_text(segment: Column) -> Column:
    return F.concat(F.lit(GENESIS_MESSAGE + " "), segment.cast("string"))


def genesis_hash(segment: Column, time: Column | None = None) -> Column:
    """Hash of a first block; in the log it bears the time of the segment's first entry."""
    text = genesis_text(segment) if time is None else F.concat_ws(SEP, _plain(time), genesis_text(segment))
    return block_hash(F.lit(GENESIS_PREVIOUS_HASH), F.lit(0), text)


def _linked(items: Column, text, start: Column, first_index: Column | int = 1) -> Column:
    """Hashes of a sorted array chained from ``start``; element i is block ``first_index + i``."""
    first = F.lit(first_index) if isinstance(first_index, int) else first_index
    return F.aggregate(
        items, F.array(start),
        lambda done, x: F.concat(done, F.array(block_hash(
            F.element_at(done, -1), first + F.size(done) - 1, text(x)))))


def append_entries(alerts: DataFrame, span: int = SEGMENT_SPAN, heads: DataFrame | None = None) -> DataFrame:
    """Chain the alerts of every segment: the new blocks, a genesis block included where the segment is new.

    ``heads`` (``segment, last_index, head``, a row for each segment of a stored log) continues that log:
    a segment found there goes on from its last block. Without it every segment starts anew.
    One shuffle on the segment; hashing stays in the JVM and a task holds the new entries of a segment
    at a time, at most ``span`` if ids are unique.
    """
    alerts = timed(alerts)
    segment = F.col("segment") if "segment" in alerts.columns else segment_of(F.col("sample_index"), span)
    entry = F.struct("sample_index", payload().alias("payload"), "timestamp", F.struct(*DATA_COLUMNS).alias("data"))
    grouped = alerts.select(segment.alias("segment"), entry.alias("e")).groupBy("segment").agg(
        F.sort_array(F.collect_list("e")).alias("entries"))
    begun = F.get("entries", F.lit(0))["timestamp"]
    if heads is None:
        start, first, continued = genesis_hash(F.col("segment"), begun), F.lit(1), F.lit(False)
    else:
        grouped = grouped.join(heads.select("segment", "last_index", "head"), "segment", "left")
        start = F.coalesce("head", genesis_hash(F.col("segment"), begun))
        first, continued = F.coalesce("last_index", F.lit(0)).cast("int") + 1, F.col("head").isNotNull()
    hashed = grouped.withColumns({"first": first, "continued": continued, "begun": begun}).withColumn(
        "hashes", _linked(F.col("entries"), lambda x: x["payload"], start, F.col("first")))
    # the outer form: a plain explode would filter on the array's size and so hash the chain twice
    blocks = hashed.select(
        "segment", "first", "continued", "begun", F.posexplode_outer("hashes").alias("at", "hash"), "entries", "hashes")
    # null at the place of the genesis block, or of the stored block that the new ones follow
    mine = F.when(F.col("at") > 0, F.get("entries", F.col("at") - 1))
    return blocks.where("at > 0 OR NOT continued").select(
        "segment", (F.col("at") + F.col("first") - 1).alias("block_index"),
        F.when(F.col("at") == 0, F.col("begun")).otherwise(mine["timestamp"]).alias("timestamp"),
        mine["sample_index"].alias("sample_index"),
        *[mine["data"][c].alias(c) for c in DATA_COLUMNS],
        F.when(F.col("at") == 0, F.lit(GENESIS_PREVIOUS_HASH)).otherwise(F.get("hashes", F.col("at") - 1)).alias("previous_hash"),
        "hash",
    )


def placed_alerts(graded: DataFrame, span: int = SEGMENT_SPAN, at: str | None = None) -> DataFrame:
    """Log entries of the flagged flows, each on the partition of its ``segment``.

    An entry bears the time of its flow (``ts``), or ``at``, the time of the run, where flows have none. Texts and lists are many times larger than the numbers they follow from, so the flows
    move to their segment first and are worded there; grouping then needs no further shuffle.
    """
    needed = ["flow_id", "src_id", *KEY_FEATURES, PROB, "predicted_class", "severity_level", "severity_name",
              "priority", "response"]
    time = F.date_format("ts", TIME_TEXT) if "ts" in graded.columns else F.lit(at).cast("string")
    slim = only(graded, INTRUSION).where("severity_level > 0").select(
        *[f"`{c}`" for c in needed if c in graded.columns], segment_of(F.col("flow_id"), span).alias("segment"), time.alias("timestamp"))
    return make_alerts(summarise_action(slim.repartition("segment")), keep=("segment", "timestamp"))


def append_flows(graded: DataFrame, span: int = SEGMENT_SPAN, heads: DataFrame | None = None, at: str | None = None) -> DataFrame:
    """Chain the flagged flows of a graded table, on top of a stored log's ``heads`` if there are any."""
    return append_entries(placed_alerts(graded, span, at), span, heads)


def segment_heads(log: DataFrame) -> DataFrame:
    """Last block of every segment."""
    return log.groupBy("segment").agg(
        F.max("block_index").cast("bigint").alias("last_index"),
        F.max_by("hash", "block_index").alias("head"))


def merged_heads(before: DataFrame | None, now: DataFrame) -> DataFrame:
    """The later head of each segment of two tables of heads."""
    both = now if before is None else before.unionByName(now)
    return both.groupBy("segment").agg(F.max("last_index").alias("last_index"), F.max_by("head", "last_index").alias("head"))


def head_levels(log: DataFrame, span: int = SEGMENT_SPAN) -> int:
    """Levels needed so that no chain of heads, the root included, is longer than ``span``."""
    top = log.agg(F.max(F.abs("segment"))).first()[0] or 0
    levels = 0
    while top >= span:
        top, levels = top // span, levels + 1
    return levels


def chain_heads(log: DataFrame, levels: int | None = None, span: int = SEGMENT_SPAN) -> DataFrame:
    """Chain segment heads level by level up to one root; ``log`` may be a table of segment heads.

    Level k groups ``span`` neighbours of level k-1; the last level is the root. The number
    of levels follows from the largest segment unless given.
    """
    levels = head_levels(log, span) if levels is None else levels
    below = (log if "head" in log.columns else segment_heads(log)).select(F.col("segment").alias("id"), "head")
    out = None
    for level in range(1, levels + 2):
        group = segment_of(F.col("id"), span) if level <= levels else F.lit(0).cast("bigint")
        chained = below.select(group.alias("group"), F.struct("id", "head").alias("e")).groupBy("group").agg(
            F.sort_array(F.collect_list("e")).alias("heads"))
        text = lambda x: F.concat_ws(SEP, x["id"].cast("string"), x["head"])
        here = chained.select(
            F.lit(level).alias("level"), "group", F.size("heads").cast("bigint").alias("n_heads"),
            F.element_at(_linked(F.col("heads"), text, genesis_hash(F.col("group"))), -1).alias("hash"))
        out = here if out is None else out.unionByName(here)
        below = here.select(F.col("group").alias("id"), F.col("hash").alias("head"))
    return out


def check_blocks(log: DataFrame) -> DataFrame:
    """Every block with its two checks: own hash recomputed, link to its predecessor.

    One window per segment, no ordering across segments. Genesis blocks are rehashed too.
    """
    prev = W.partitionBy("segment").orderBy("block_index")
    log = timed(log)
    text = F.when(F.col("block_index") == 0, F.concat_ws(SEP, _plain(F.col("timestamp")), genesis_text(F.col("segment")))).otherwise(payload())
    own = block_hash(F.col("previous_hash"), F.col("block_index"), text)
    linked = F.when(F.col("block_index") == 0, F.col("previous_hash") == GENESIS_PREVIOUS_HASH).otherwise(
        (F.col("previous_hash") == F.lag("hash").over(prev))
        & (F.col("block_index") == F.lag("block_index").over(prev) + 1))
    return log.select(
        "segment", "block_index",
        F.coalesce(F.col("hash") == own, F.lit(False)).alias("hash_ok"),
        F.coalesce(linked, F.lit(False)).alias("link_ok"))


def verify_chain(log: DataFrame) -> DataFrame:
    """Per segment: number of blocks, first bad block (null if none) and validity."""
    bad = ~(F.col("hash_ok") & F.col("link_ok"))
    return check_blocks(log).groupBy("segment").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.min(F.when(bad, F.col("block_index"))).alias("first_bad_block"),
        (~F.bool_or(bad)).alias("is_valid"))


def verify_sealed(log: DataFrame, heads: DataFrame, span: int = SEGMENT_SPAN) -> DataFrame:
    """Levels and groups whose stored head hash no longer follows from the log.

    Catches what a chain cannot see by itself: blocks cut off its end, or a whole segment.
    """
    levels = heads.agg(F.max("level")).first()[0] - 1
    now = chain_heads(log, levels, span).withColumnRenamed("hash", "hash_now").drop("n_heads")
    return heads.join(now, ["level", "group"], "full_outer").where(
        ~F.col("hash").eqNullSafe(F.col("hash_now"))).select("level", "group", "hash", "hash_now")


def log_summary(log: DataFrame) -> DataFrame:
    """Totals of the log: blocks, alerts, segments, validity."""
    return verify_chain(log).agg(
        F.coalesce(F.sum("blocks"), F.lit(0)).alias("total_blocks"),
        F.coalesce(F.sum(F.col("blocks") - 1), F.lit(0)).alias("total_intrusions"),
        F.count(F.lit(1)).alias("segments"),
        F.coalesce(F.bool_and("is_valid"), F.lit(True)).alias("is_valid"))


def log_severity(log: DataFrame) -> DataFrame:
    """Alerts per risk name: the three risk levels, zero filled, others ignored."""
    names = [n for lvl, n, _, _ in SEVERITY_LEVELS if lvl > 0]
    entries = log.where(F.col("block_index") > 0)
    wide = entries.agg(*[F.count_if(F.col("severity_name") == n).alias(n) for n in names])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("severity_name"), F.col(n).alias("n")) for n in names])))


def log_view(log: DataFrame) -> DataFrame:
    """Flat view of the alert blocks with defaults for whatever is missing."""
    d = LOG_VIEW_DEFAULTS
    f = "network_features"
    return timed(log).where(F.col("block_index") > 0).select(
        "segment", F.col("block_index").alias("id"), "timestamp",
        F.coalesce(f"{f}.src_ip", F.lit(d["text"])).alias("source_ip"),
        F.coalesce(f"{f}.dst_ip", F.lit(d["text"])).alias("dest_ip"),
        F.coalesce(f"{f}.protocol_type", F.lit(d["text"])).alias("protocol"),
        F.coalesce("severity_name", F.lit(d["type"])).alias("type"),
        F.coalesce("intrusion_probability", F.lit(0.0)).alias("confidence"),
        F.coalesce("action_summary", F.lit("")).alias("action"),
        F.lit(d["status"]).alias("status"),
        F.coalesce("hash", F.lit("")).alias("hash"),
        F.coalesce("previous_hash", F.lit("")).alias("previous_hash"),
        F.coalesce("sample_index", F.lit(d["sample_index"])).cast("bigint").alias("sample_index"),
        F.coalesce("severity_level", F.lit(0)).cast("int").alias("severity_level"),
        F.coalesce("immediate_actions", F.array().cast("array<string>")).alias("immediate_actions"),
    )


def log_search(view: DataFrame, text: str = "") -> DataFrame:
    """Entries whose source or destination contains the text; no text keeps all."""
    if not text:
        return view
    return view.where(F.col("source_ip").contains(text) | F.col("dest_ip").contains(text))


def log_page(view: DataFrame, page: int = 1, size: int = LOG_PAGE_SIZE) -> DataFrame:
    """One page in log order with its position, plus the number of entries and pages.

    Segment counts locate the page; only segments that overlap it (at most ``size``) are
    ordered. A plain offset would make every task keep all rows before the page.
    """
    per_segment = view.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    first, last = (page - 1) * size, page * size
    spans = running_totals(per_segment, "segment", ["n"])
    hits = spans.where((F.col("n_before") < last) & (F.col("n_upto") > first)).select("segment", "n_before")
    total = per_segment.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    order = W.partitionBy("segment").orderBy("id")
    return (
        view.join(F.broadcast(hits), "segment")
        .withColumn("position", F.col("n_before") + F.row_number().over(order))
        .where((F.col("position") > first) & (F.col("position") <= last))
        .drop("n_before")
        .withColumn("total_entries", total)
        .withColumn("total_pages", F.ceil(F.col("total_entries") / F.lit(float(size))))
    )


def log_page_after(view: DataFrame, segment: int, block: int, size: int = LOG_PAGE_SIZE) -> DataFrame:
    """Next page after a known entry."""
    later = (F.col("segment") > segment) | ((F.col("segment") == segment) & (F.col("id") > block))
    return view.where(later).orderBy("segment", "id").limit(size)
