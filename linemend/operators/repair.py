"""Putting records that were split over several lines back together.

The rule: append lines, joined by one space, until the separators seen reach the number
the schema asks for; then the record is complete. If a line takes the count past that
number, the whole buffer is rejected. Blank lines where no record is pending are dropped.
An unfinished buffer at the end of a file is kept as a short record. A file in which no
record ever ends has another separator or schema: its lines stay lines, with status `unfit`.

The state of that rule after a line is the number of separators pending, 0..E-1. A line
with E or more separators always leaves 0, whatever was pending: it completes a record
or overflows one. So nearly every block of lines can be worked on alone:

* the *lead* of a block runs through its first such line and needs the state at entry;
* the *body* after it starts from 0 and is cut into records here, in one narrow pass;
* the *tail* is what the body leaves unfinished.

Only leads and tails, a few lines per block, are exchanged between tasks. A block
without such a line is all lead; its effect on the state is a map of E numbers, and maps
compose: within each split, over ranges of splits, and over the ranges of a file.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from ..functions import after_bytes, char_class, decode_utf8_lossy, separator_count
from ..session import settings, work_dir

# Line checks ------------------------------------------------------------------------


def expected_separators(lines: DataFrame, sep: str = "|") -> DataFrame:
    """(file, expected): separators on the first line of each file, to hold beside the schema."""
    order = F.struct("part", "id")
    return lines.groupBy("file").agg(F.min_by(separator_count(F.col("value"), sep), order).cast("long").alias("expected"))


def detect_bad_lines(lines: DataFrame, expected: Column | int, sep: str = "|") -> DataFrame:
    """Lines whose separator count is not the expected one."""
    counted = lines.withColumn("separators", separator_count(F.col("value"), sep))
    return counted.filter(F.col("separators") != _column(expected))


def first_bad_lines(lines: DataFrame, expected: Column | int, sep: str = "|") -> DataFrame:
    """The first bad line of each file that has one."""
    bad = detect_bad_lines(lines, expected, sep)
    first = F.min_by(F.struct("part", "id", "value", "separators"), F.struct("part", "id"))
    return bad.groupBy("file").agg(first.alias("line")).select("file", "line.*")


def file_status(lines: DataFrame, expected: Column | int, sep: str = "|") -> DataFrame:
    """(file, n_lines, n_bad, clean), pre-aggregated per task."""
    bad = separator_count(F.col("value"), sep) != _column(expected)
    return lines.groupBy("file").agg(
        F.count("*").alias("n_lines"), F.count_if(bad).alias("n_bad")
    ).withColumn("clean", F.col("n_bad") == 0)


def route_clean_or_repair(lines: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of clean files, which are records already, and lines that need the repair.

    `status` is `file_status` of the same lines: one row per file, so the join side is
    small and the adaptive planner broadcasts it if its measured size allows.
    """
    clean = status.filter("clean").select("file")
    return lines.join(clean, "file", "left_semi"), lines.join(clean, "file", "left_anti")


def clean_records(lines: DataFrame, expected: int) -> DataFrame:
    """Lines of clean files as outcomes of a repair that they do not need."""
    value = F.regexp_replace(decode_utf8_lossy(F.col("value")), r"\r\z", "")
    return lines.select(
        "file", "part", F.col("id").alias("seq"), F.lit(2).alias("zone"), F.lit(0).alias("rec"), value.alias("value"),
        F.lit(expected).alias("separators"), F.lit("record").alias("status"), F.lit(False).alias("suspect"), F.lit(True).alias("exact"),
    ).filter("value <> ''")


# Splitting blocks -------------------------------------------------------------------


def split_blocks(blocks: DataFrame, expected: Column | int, sep: str = "|", keep: Sequence[str] = ()) -> DataFrame:
    """Lead, body records and tail of each block, its effect on the pending count, and columns to keep.

    A body of clean lines only is split at line ends; any other is cut record by record.
    `exact` says that no body record has too many separators, so none need be counted again.
    """
    s = char_class(sep)
    e = F.col("expected").cast("string")
    lead_pattern = F.concat(F.lit(rf"\A(?:(?!(?:[^{s}\n]*+{s}){{"), e, F.lit(r"}+)[^\n]*+\n)*+[^\n]*+\n"))
    clean_pattern = F.concat(F.lit(rf"\A(?:(?:[^{s}\n]*+{s}){{"), e, F.lit(rf"}}+[^{s}\n]*+\n)++\z"))
    decoded = F.replace(decode_utf8_lossy(F.col("text")), F.lit("\r\n"), F.lit("\n"))

    synced, clean, rest = F.col("synced"), F.col("clean"), F.col("rest")
    lines = F.split(F.substring(rest.cast("binary"), F.lit(1), F.octet_length(rest) - 1).cast("string"), "\n")
    records = F.regexp_extract_all("rest", _record_pattern(F.col("expected"), s), F.lit(1))
    body_separators = separator_count(rest, sep) - separator_count(F.col("tail"), sep)
    return (
        blocks.select("file", "part", "seq", _column(expected).cast("int").alias("expected"), decoded.alias("text"), *keep)
        .withColumn("lead", F.call_function("regexp_extract", "text", lead_pattern, F.lit(0)))
        .withColumn("synced", F.col("lead") != "")
        .withColumn("rest", F.when(synced, after_bytes(F.col("text"), F.octet_length("lead"))).otherwise(""))
        .withColumn("clean", F.call_function("rlike", rest, clean_pattern))
        .withColumn("records", F.when(clean, lines).otherwise(records))
        .withColumn("tail", F.when(clean, "").otherwise(after_bytes(rest, _taken("records"))))
        .withColumn("lead", F.when(synced, F.col("lead")).otherwise(F.col("text")))
        .select(
            "file", "part", "seq", "expected", "synced", "lead", "tail", "records",
            F.when(clean, True).otherwise(body_separators == F.col("expected") * F.size("records")).alias("exact"),
            separator_count(F.col("lead"), sep).alias("lead_separators"),
            F.when(synced, F.array(separator_count(F.col("tail"), sep))).otherwise(_exit_map("lead", sep)).alias("exits"),
            *keep,
        )
    )


def stage_split(
    blocks: DataFrame, expected: Column | int, sep: str = "|", path: str | None = None, keep: Sequence[str] = (), by_file: bool = False
) -> DataFrame:
    """Write `split_blocks` once; later steps read only the columns they need, and with
    `by_file` only the files they ask for.

    Staging makes the cut points final: a lost task cannot see other blocks than the
    ones its neighbours were matched with. Without `by_file` the blocks lie in buckets by file and
    part, so that what is known of a part comes to its blocks and no text goes to the states.
    """
    split, path = split_blocks(blocks, expected, sep, keep), path or work_dir(blocks.sparkSession, "split")
    return _written(split, path, by_file) if by_file else _bucketed(split, path)


#: Files that a task writes side by side; a task of more buckets sorts the rest by bucket first.
OPEN_BUCKETS = 16


def _bucketed(df: DataFrame, path: str) -> DataFrame:
    """A table of the shared folder in as many buckets by (file, part) as a shuffle has partitions.

    Rows are written where they are: a task holds the blocks of a few parts, so it writes a few files.
    Only a table of the catalog can tell its buckets; the name is given back once it is read.
    """
    spark = df.sparkSession
    name = f"linemend_split_{uuid.uuid4().hex}"
    with settings(spark, spark__sql__maxConcurrentOutputFileWriters=str(OPEN_BUCKETS)):
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        _block_writer(df).bucketBy(buckets, "file", "part").option("path", path).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _written(df: DataFrame, path: str, by_file: bool = False) -> DataFrame:
    """A table in the shared folder."""
    _block_writer(df).partitionBy(*(["file"] if by_file else [])).parquet(path)
    # With the schema given, names of folders are not taken for numbers.
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _block_writer(df: DataFrame) -> DataFrameWriter:
    """Rows can be large, so the writer looks at its sizes often."""
    sizes = {"parquet.block.size": 32 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    return df.write.options(**sizes)


def _record_pattern(expected: Column, s: str) -> Column:
    """One record, its last line end left out: up to the end of the line that holds its
    expected-th separator.

    `\\G` keeps matches adjacent, so the scan stops at the first unfinished record.
    """
    return F.concat(F.lit(rf"\G((?:[^{s}]*+{s}){{"), expected.cast("string"), F.lit(r"}+[^\n]*+)\n"))


def _taken(records: str) -> Column:
    """Bytes of the text the records were taken from, with a line end each."""
    return F.when(F.size(records) > 0, F.octet_length(F.array_join(records, "\n")) + 1).otherwise(0)


def _exit_map(text: str, sep: str) -> Column:
    """Pending count after the text for each pending count 0..E-1 before it."""
    counts = F.transform(F.split(text, "\n"), lambda line: separator_count(line, sep))
    return F.aggregate(
        counts, F.expr(_COUNTS.format("expected")), lambda states, k: F.transform(states, lambda n: F.when(n + k < F.col("expected"), n + k).otherwise(0))
    )


# Entry states -----------------------------------------------------------------------

NO_BLOCK = -1

# Every count that can be pending.
_COUNTS = "sequence(0, greatest({} - 1, 0))"

# `s` is the state before block `b`: the pending count, and the block that opened the record.
_CLOSES = "s.entry + b.lead_separators >= b.expected"
_STEP = f"""named_struct(
  'entry', IF(size(b.exits) = 1, b.exits[0], get(b.exits, s.entry)),
  'open_part', IF({_CLOSES}, b.part, s.open_part),
  'open_seq', IF({_CLOSES}, b.seq, s.open_seq))"""

# The same for a group of blocks, whose step is one state or a state for each count before it.
_AFTER = "IF(size(b.step) = 1, b.step[0], get(b.step, s.entry))"
_MAPPED = f"""named_struct(
  'entry', {_AFTER}.entry,
  'open_part', IF({_AFTER}.open_part = {NO_BLOCK}, s.open_part, {_AFTER}.open_part),
  'open_seq', IF({_AFTER}.open_part = {NO_BLOCK}, s.open_seq, {_AFTER}.open_seq))"""

_BEGIN = f"named_struct('entry', 0, 'open_part', {NO_BLOCK}L, 'open_seq', {NO_BLOCK}L)"

# Splits are byte offsets (64 GB of text make a range), or begin with a task number above bit 40
# (1024 tasks make a range of ranges). Those of an archive, which one task inflates, are counted.
RANGE_BITS = (36, 14)


def entry_states(split: DataFrame) -> DataFrame:
    """(file, part, fits, states) of each part: whether any record of the file ends, and of each block
    (seq, entry, closes, opener): the pending count at its start, whether it closes a record, and
    the earlier block whose tail began the one pending.

    Works on a few integers per block and is itself as small. Steps are composed upwards in a
    tree, and the states handed down again, so that no group holds all splits of a large file.
    """
    parts = split.groupBy("file", "part").agg(
        F.expr("max(expected) AS expected"), F.expr("sort_array(collect_list(struct(seq, part, expected, lead_separators, exits))) AS items")
    )
    levels = [_composed(parts, _STEP)]
    for bits in RANGE_BITS:
        ranges = levels[-1].groupBy("file", F.expr(f"shiftright(part, {bits}) AS above")).agg(
            F.expr("max(expected) AS expected"), F.expr("sort_array(collect_list(struct(part, step))) AS items")
        )
        levels.append(_composed(ranges.withColumnRenamed("above", "part"), _MAPPED))
    whole = levels.pop().groupBy("file").agg(F.expr("sort_array(collect_list(struct(part, step))) AS items"))
    last = f"aggregate(items, {_BEGIN}, (s, b) -> {_MAPPED}).open_part <> {NO_BLOCK}"
    entries = _handed_down(whole.selectExpr("*", f"{_BEGIN} AS s", f"{last} AS fits"), _MAPPED, "b.part AS part")
    for level, bits in zip(reversed(levels), reversed(RANGE_BITS)):
        ranges = level.groupBy("file", F.expr(f"shiftright(part, {bits}) AS above")).agg(F.expr("sort_array(collect_list(struct(part, step))) AS items"))
        entries = _handed_down(ranges.withColumnRenamed("above", "part").join(entries, ["file", "part"]), _MAPPED, "b.part AS part")
    state = """named_struct('seq', x.b.seq, 'entry', x.s.entry, 'closes', x.s.entry + x.b.lead_separators >= x.b.expected,
      'opener', named_struct('part', x.s.open_part, 'seq', x.s.open_seq))"""
    return parts.drop("expected").join(entries, ["file", "part"]).selectExpr(
        "file", "part", "fits", f"transform({_before(_STEP)}, x -> {state}) AS states"
    )


def _composed(groups: DataFrame, step: str) -> DataFrame:
    """One step for the ordered items of each group: the state after them for each before."""
    after = f"""transform({_COUNTS.format("expected")}, n -> aggregate(items,
      named_struct('entry', n, 'open_part', {NO_BLOCK}L, 'open_seq', {NO_BLOCK}L), (s, b) -> {step}))"""
    return groups.selectExpr("file", "part", "expected", f"{after} AS step").withColumn(
        "step", F.expr("IF(size(array_distinct(step)) = 1, slice(step, 1, 1), step)")
    )


def _handed_down(groups: DataFrame, step: str, *columns: str) -> DataFrame:
    """The state before each item, given the state `s` before its group."""
    return groups.selectExpr("file", "fits", f"inline({_before(step)})").selectExpr("file", *columns, "s", "fits")


def _before(step: str) -> str:
    """Pairs of an item `b` and the state `s` before it."""
    return f"transform(items, (b, i) -> struct(b, aggregate(slice(items, 1, i), s, (s, b) -> {step}) AS s))"


def stage_states(split: DataFrame, path: str | None = None) -> DataFrame:
    """Write `entry_states`, which every kind of record at a block border is joined with."""
    return _written(entry_states(split), path or work_dir(split.sparkSession, "states"))


# Reassembly -------------------------------------------------------------------------

UNFIT_ZONE = 4


def reassemble_records(split: DataFrame, edges: DataFrame, sep: str = "|") -> DataFrame:
    """Every record, rejected record and unfinished rest of staged blocks, once each.

    `(part, seq, zone, rec)` is the order within a file. `status` is `record`, `overflow`,
    `short` or `unfit`; `suspect` marks records that begin with a line without separators, whose
    text may belong to the last field of the record before; `exact` is true for all records
    of a block that has no rejects.
    """
    raw = _within(split, 2).unionByName(_within(edges, 1)).unionByName(_spanning(edges)).unionByName(_unfit(edges))
    return _label(raw, sep)


def _within(blocks: DataFrame, zone: int) -> DataFrame:
    """Records that begin and end in one block. With no separators a blank line would be one."""
    return blocks.selectExpr(
        "file", "part", "seq", f"{zone} AS zone", "expected", "exact", "posexplode(records) AS (rec, raw)"
    ).filter("raw <> ''")


def stage_edges(
    split: DataFrame, states: DataFrame, sep: str = "|", path: str | None = None, by_file: bool = False
) -> DataFrame:
    """Write the leads, cut by what was pending, once for all kinds of records at block borders.

    States of a part that are too many to be broadcast go to the bucket of its blocks and are hashed there.
    """
    with settings(split.sparkSession, spark__sql__join__preferSortMergeJoin="false"):
        return _written(_edges(split, states, sep), path or work_dir(split.sparkSession, "edges"), by_file)


def _edges(split: DataFrame, states: DataFrame, sep: str) -> DataFrame:
    """Leads cut, by what was pending, into a closing text, whole records and an open rest."""
    s = char_class(sep)
    missing = (F.col("expected") - F.col("entry")).cast("string")
    closing = F.call_function("regexp_extract", "lead", F.concat(F.lit(rf"\A(?:[^{s}]*+{s}){{"), missing, F.lit(r"}+[^\n]*+\n")), F.lit(0))
    rest = after_bytes(F.col("lead"), F.octet_length("closing"))
    records = F.regexp_extract_all("rest", _record_pattern(F.col("expected"), s), F.lit(1))
    opening = F.when(F.col("synced"), F.col("tail")).otherwise(after_bytes(F.col("rest"), _taken("records")))
    own = F.get(F.filter("states", lambda state: state["seq"] == F.col("seq")), F.lit(0))
    return (
        split.join(states, ["file", "part"])
        .withColumn("own", own)
        .select("file", "part", "seq", "expected", "synced", "lead", "tail", "own.entry", "own.closes", "own.opener", "fits", F.expr("false AS exact"))
        .withColumn("closing", F.when(F.col("closes"), closing).otherwise(F.col("lead")))
        .withColumn("rest", rest)
        .withColumn("records", records)
        .withColumn("open", opening)
        .drop("synced", "lead", "tail", "rest", "entry")
    )


def _spanning(edges: DataFrame) -> DataFrame:
    """Records over block borders: a tail, any blocks inside the record, a closing text.

    Each group is the pieces of one record. The last group of a file has no closing text
    and is the unfinished rest.
    """
    edges = edges.filter("fits")
    closing = "struct(opener, 0 AS piece, closes, closing AS text)"
    opening = "struct(struct(part, seq) AS opener, 1 AS piece, false AS closes, open AS text)"
    return (
        edges.selectExpr("file", "part", "seq", "expected", f"inline(IF(closes AND open <> '', array({closing}, {opening}), array({closing})))")
        .groupBy("file", "opener")
        .agg(
            F.expr("max(struct(part, seq)) AS at"), F.expr("max(expected) AS expected"), F.expr("bool_or(closes) AS closed"),
            F.expr("sort_array(collect_list(struct(part, seq, piece, text))) AS pieces"),
        )
        .selectExpr(
            "file", "at.part AS part", "at.seq AS seq", "IF(closed, 0, 3) AS zone", "expected", "false AS exact", "0 AS rec",
            r"regexp_replace(array_join(pieces.text, ''), r'\n\z', '') AS raw",
        )
        .filter(r"NOT raw RLIKE r'\A\n*\z'")
    )


def _unfit(edges: DataFrame) -> DataFrame:
    """The lines, but for blank ones, of files in which no record ends: their blocks are all lead."""
    return edges.filter("NOT fits").selectExpr(
        "file", "part", "seq", f"{UNFIT_ZONE} AS zone", "expected", "exact", r"posexplode(split(closing, '\n')) AS (rec, raw)"
    ).filter("raw <> ''")


def _label(raw: DataFrame, sep: str) -> DataFrame:
    """Raw texts to outcomes: blank lines before a record dropped, lines joined by a space."""
    one_line = ~F.contains("raw", F.lit("\n"))
    lines = F.regexp_replace("raw", r"\A\n+", "")
    exact, expected = F.col("exact"), F.col("expected")
    count = F.when(exact, expected).otherwise(separator_count(F.col("raw"), sep))
    status = F.when(exact, "record").when(F.col("zone") == UNFIT_ZONE, "unfit").when(count > expected, "overflow").when(count < expected, "short").otherwise("record")
    starts_bare = F.col("raw").rlike(rf"\A\n*+[^{char_class(sep)}\n]++\n")
    return raw.select(
        "file", "part", "seq", "zone", "rec",
        F.when(one_line, F.col("raw")).otherwise(F.replace(lines, F.lit("\n"), F.lit(" "))).alias("value"),
        count.alias("separators"), status.alias("status"),
        F.when(one_line | (expected == 0), False).otherwise(starts_bare).alias("suspect"), "exact",
    )


def kept_records(outcome: DataFrame) -> DataFrame:
    """Complete records and unfinished rests."""
    return outcome.filter(~F.col("status").isin("overflow", "unfit"))


def reject_overflow(outcome: DataFrame) -> DataFrame:
    """Rejected buffers and lines with the reason. Blocks without any are passed over unread."""
    rejects = outcome.filter(~F.col("exact") & F.col("status").isin("overflow", "unfit"))
    reason = F.when(F.col("status") == "unfit", "schema does not fit").otherwise("more separators than the schema allows")
    return rejects.withColumn("reason", reason)


def repair_blocks(blocks: DataFrame, expected: Column | int, sep: str = "|", path: str | None = None) -> DataFrame:
    """Blocks to outcomes; split, states and edges are staged below `path` in the shared folder."""
    path = path or work_dir(blocks.sparkSession, "repair")
    return repair_split(stage_split(blocks, expected, sep, f"{path}/split"), path, sep)


def repair_split(split: DataFrame, path: str, sep: str = "|", by_file: bool = False) -> DataFrame:
    """Staged blocks of one or many files to outcomes."""
    states = stage_states(split, f"{path}/states")
    return reassemble_records(split, stage_edges(split, states, sep, f"{path}/edges", by_file), sep)


def _column(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
