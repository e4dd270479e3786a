"""Chat formatting by quotation linking.

Messages quote others with `>` before a line, nested `> >` or `>>`. A passage is a run of lines of one
level. Its lines are joined and normalised to lower-case words, so that it does not matter where a mail
program broke them, and its windows of five words (the whole passage where it is shorter) are hashed.
The hashes are joined to those of what messages of the same conversation wrote themselves: windows of
five words of each run of own lines, and lines and runs shorter than that as a whole. A passage comes
from the message that wrote most of its windows first, if that wrote at least a quarter of them; of
messages that wrote equally many, from the earliest. A message answers the source of its least nested
passage that has one; of passages of one level, the first.

Conversations are rebuilt as rows in reply order: each message without its quotes, behind the one it
answers, threads in the order of their first messages. Rows, not arrays, so a conversation may be of any
size. A window that a thousand messages write counts once for each conversation and hash, and only
conversations in which someone quotes are hashed.

Nulls: a null text has no lines and stays null; a null conversation or turn is linked with nothing.
Repeated rows stay, and answer alike; rows of one conversation and turn with different texts count as
one message that quotes and wrote all of it. Empty own text gives an empty string. A passage without
any word is no passage. A quote of fewer than five words out of the middle of a longer line has no
source. Time and memory are linear in a message's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from ..session import work_dir

WINDOW = 5
#: Least share of a passage's windows that its source wrote.
SHARE = 0.25

MARK = re.compile(r"(?:[ \t]*>)+ ?")
BREAK = re.compile(r"\r\n|\n|\r")
WORD = re.compile(r"\w+")
#: A line that only announces a quote.
ANNOUNCEMENT = re.compile(r"\s*(on\b.*\bwrote|.*\bschrieb|.*\ba écrit|.*\bescribió)\s*:\s*\Z", re.IGNORECASE)
LEADING = re.compile(r"\A[ \t\n\x0b\f\r]*\n")
BLANK = " \t\n\x0b\f\r"
#: Lines that may be quoted, as the JVM sees them; it knows more line ends than `BREAK`.
QUOTED = r"(?m)^[ \t]*>"


def runs(text: str) -> list[tuple[int, list[str]]]:
    """(level, lines without marks) of each run of lines of one level; announcements of quotes left out."""
    out: list[tuple[int, list[str]]] = []
    for line in BREAK.split(text):
        mark = MARK.match(line)
        level = mark.group().count(">") if mark else 0
        if level and out and out[-1][0] == 0 and ANNOUNCEMENT.match(out[-1][1][-1]):
            out[-1][1].pop()
            if not out[-1][1]:
                out.pop()
        if out and out[-1][0] == level:
            out[-1][1].append(line[mark.end() :] if mark else line)
        else:
            out.append((level, [line[mark.end() :] if mark else line]))
    return out


def own_text(text: str) -> str:
    """What the message adds itself."""
    kept = "\n".join(line for level, lines in runs(text) if not level for line in lines)
    return LEADING.sub("", kept).rstrip(BLANK)


def hashes(words: list[str]) -> set[int]:
    """Of all windows, or of the whole where it is shorter; signed 64-bit numbers."""
    grams = [words[i : i + WINDOW] for i in range(max(len(words) - WINDOW + 1, 1))] if words else []
    return {(xxhash.xxh64_intdigest(" ".join(gram)) ^ 1 << 63) - (1 << 63) for gram in grams}


def written(text: str) -> set[int]:
    """Hashes of what the message wrote itself."""
    out: set[int] = set()
    for level, lines in runs(text):
        if level == 0:
            words = [WORD.findall(line.lower()) for line in lines]
            out |= hashes([w for line in words for w in line])
            out.update(*(hashes(line) for line in words if len(line) < WINDOW))
    return out


def quoted(text: str) -> list[tuple[int, int, set[int]]]:
    """(number of the run, level, hashes) of each passage that has words."""
    found = ((i, level, hashes(WORD.findall("\n".join(lines).lower()))) for i, (level, lines) in enumerate(runs(text)) if level)
    return [passage for passage in found if passage[2]]


def _types(frame: DataFrame, *names: str) -> StructType:
    return StructType([frame.schema[name] for name in names])


def _quoted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", "turn", "version", "passage", "level", "size", "hashes"]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [(row, *passage) for row, text in enumerate(part.column(3).to_pylist()) for passage in quoted(text)]
            rows = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(i).take(rows) for i in range(3)]
                + [pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32())]
                + [pa.array([len(f[3]) for f in found], pa.int32()), pa.array([list(f[3]) for f in found], pa.list_(pa.int64()))],
                names,
            )


def _written_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = pa.array([list(written(text)) for text in part.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], ["conv", "turn", "hashes"])


def _own_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([None if text is None else own_text(text) for text in batch.column(3).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), texts], ["conv", "turn", "role", "text"])


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(conv, turn, version, passage, level, source): quoted passages and the turn that wrote them, null if none did.

    `version` tells texts of the same conversation and turn apart; `passage` counts the runs of a text.
    """
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(text_col).alias("text"))
    rows = rows.filter("conv is not null and turn is not null and text is not null")
    quoting = rows.filter(F.col("text").rlike(QUOTED))
    # One row of repeated ones, so that a passage's windows count once.
    versions = quoting.groupBy("conv", "turn", F.xxhash64("text").alias("version")).agg(F.first("text").alias("text"))
    schema = _types(versions, "conv", "turn", "version").add("passage", IntegerType()).add("level", IntegerType()).add("size", IntegerType())
    passages = versions.mapInArrow(_quoted_rows, schema.add("hashes", ArrayType(LongType())))
    windows = passages.select("conv", "turn", "version", "passage", "level", "size", F.explode("hashes").alias("hash"))

    asked = rows.join(quoting.select("conv").distinct(), "conv", "left_semi")
    own = asked.mapInArrow(_written_rows, _types(rows, "conv", "turn").add("hashes", ArrayType(LongType())))
    first = own.select("conv", "turn", F.explode("hashes").alias("hash")).groupBy("conv", "hash").agg(F.min("turn").alias("source"))

    matched = windows.join(first, ["conv", "hash"], "left").withColumn("source", F.when(F.col("source") < F.col("turn"), F.col("source")))
    key = ["conv", "turn", "version", "passage", "level"]
    votes = matched.groupBy(*key, "size", "source").agg(F.count("*").alias("n"))
    known = F.when(F.col("source").isNotNull() & (F.col("n") >= SHARE * F.col("size")), F.struct((-F.col("n")).alias("n"), "source"))
    return votes.groupBy(*key).agg(F.min(known).alias("best")).select(*key, F.col("best.source").alias("source"))


def _threads(parents: DataFrame) -> DataFrame:
    """(conv, turn, thread, depth) of messages that answer another, by doubling the way to the top.

    Every round halves what is left of each way, so a chain of n answers takes log2(n) rounds.
    """
    spark = parents.sparkSession
    up = parents.select("conv", "turn", F.col("parent").alias("top"), F.lit(1).alias("depth"))
    while True:
        path = work_dir(spark, "threads")
        up.write.parquet(path)
        up = spark.read.parquet(path)
        higher = up.select("conv", F.col("turn").alias("top"), F.col("top").alias("over"), F.col("depth").alias("more"))
        if up.join(higher, ["conv", "top"], "left_semi").isEmpty():
            return up.select("conv", "turn", F.col("top").alias("thread"), "depth")
        up = up.join(higher, ["conv", "top"], "left").select(
            "conv", "turn", F.coalesce("over", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
        )


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, thread, depth, turn, role, text, parent, n_quoted, n_linked) in reply order.

    `thread` is the turn that a chain of answers goes back to, itself for a message that answers
    none; `depth` counts the answers on the way.
    """
    spark, path = messages.sparkSession, work_dir(messages.sparkSession, "quoting")
    passages = link(messages, conv_col, turn_col, text_col)
    passages.groupBy("conv", "turn").agg(
        F.count("*").alias("n_quoted"),
        F.count("source").alias("n_linked"),
        F.min(F.when(F.col("source").isNotNull(), F.struct("level", "passage", "source")))["source"].alias("parent"),
    ).write.parquet(path)
    told = spark.read.parquet(path)
    threads = _threads(told.filter("parent is not null"))
    placed = told.join(threads, ["conv", "turn"], "left")
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    clean = rows.mapInArrow(_own_rows, _types(rows, "conv", "turn", "role").add("text", StringType()))
    return (
        clean.join(placed, ["conv", "turn"], "left")
        .select(
            "conv",
            F.coalesce("thread", "turn").alias("thread"),
            F.coalesce("depth", F.lit(0)).alias("depth"),
            "turn",
            "role",
            "text",
            "parent",
            F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"),
            F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        )
        .orderBy("conv", "thread", "depth", "turn")
    )
