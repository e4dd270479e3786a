"""Record repair against the rule applied one line at a time."""

import random

import pytest
from pyspark.sql import functions as F

from linemend.operators import repair
from linemend.session import settings
from linemend.sources import lines_of_rows, pack_blocks, scan_lines


def sequential(lines, expected):
    """(value, status, suspect) in file order."""
    out, buffer, count = [], [], 0

    def emit(status):
        suspect = expected > 0 and len(buffer) > 1 and "|" not in buffer[0]
        out.append((" ".join(buffer), status, suspect))

    for line in lines:
        if not buffer and line == "":
            continue
        buffer.append(line)
        count += line.count("|")
        if count >= expected:
            emit("record" if count == expected else "overflow")
            buffer, count = [], 0
    if not out:  # no record ends in this file
        return [(line, "unfit", False) for line in lines if line]
    if buffer:
        emit("short")
    return out


def outcomes(blocks, expected):
    rows = repair.repair_blocks(blocks, expected).collect()
    result = {}
    for row in sorted(rows, key=lambda r: (r["file"], r["part"], r["seq"], r["zone"], r["rec"])):
        result.setdefault(row["file"], []).append((row["value"], row["status"], row["suspect"]))
    return result


def random_lines(rng, expected):
    pieces = ["", "", "a", "b c", " ", "é", "x\r"]
    lines = []
    for _ in range(rng.randint(0, 14)):
        if rng.random() < rng.choice([0.1, 0.5, 0.9]):
            fields = [rng.choice(pieces) for _ in range(expected + 1)]
        else:
            fields = [rng.choice(pieces) for _ in range(rng.randint(1, expected + 2))]
        lines.append("|".join(fields).rstrip("\r"))
    return lines


@pytest.mark.parametrize("seed", range(4))
def test_random_files_in_random_blocks(spark, seed):
    rng = random.Random(seed)
    files, rows = {}, []
    for n in range(600):
        expected = rng.randint(0, 6)
        name = f"{expected}-{n}"
        files[name] = random_lines(rng, expected)
        part, seq, left = 0, 0, list(files[name])
        while left:
            cut = rng.choice([1, 1, 2, 3, 20])
            text = "".join(line + "\n" for line in left[:cut]).encode()
            rows.append((name, part, seq, text))
            left, seq = left[cut:], seq + rng.randint(1, 3)
            part += rng.random() < 0.4
    blocks = spark.createDataFrame(rows, "file string, part long, seq long, text binary").repartition(7)
    actual = outcomes(blocks, F.substring_index("file", "-", 1).cast("int"))
    for name, lines in files.items():
        assert actual.get(name, []) == sequential(lines, int(name.split("-")[0])), (name, lines)


CASES = {
    "clean": (["a|b|c"], [("a|b|c", "record", False)]),
    "break in field": (["a|b1", "b2|c"], [("a|b1 b2|c", "record", False)]),
    "two breaks": (["a", "x|b", "y|c"], [("a x|b y|c", "record", True)]),
    "blank inside": (["a|b", "", "z|c"], [("a|b  z|c", "record", False)]),
    "blank between": (["a|b|c", "", "d|e|f"], [("a|b|c", "record", False), ("d|e|f", "record", False)]),
    "break in last field": (["a|b|c1", "c2", "d|e|f"], [("a|b|c1", "record", False), ("c2 d|e|f", "record", True)]),
    "overflow": (["a|b", "c|d|e", "f|g|h"], [("a|b c|d|e", "overflow", False), ("f|g|h", "record", False)]),
    "short tail": (["a|b|c", "d|e"], [("a|b|c", "record", False), ("d|e", "short", False)]),
    "lone carriage return": (["a|b\rb|c"], [("a|b\rb|c", "record", False)]),
    "quotes": (['a|"x"y|c'], [('a|"x"y|c', "record", False)]),
}


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_cases(spark, block_bytes):
    rows = [(name, line) for name, (lines, _) in CASES.items() for line in lines]
    frame = spark.createDataFrame(rows, "file string, value string").coalesce(1)
    blocks = pack_blocks(lines_of_rows(frame, F.col("file"), F.col("value")), block_bytes)
    assert outcomes(blocks, 2) == {name: result for name, (_, result) in CASES.items()}


def test_text_files_in_many_splits(spark, tmp_path):
    """Breaks and blank lines at random places, Windows line ends, invalid bytes, small splits."""
    rng = random.Random(7)
    expected = []
    with open(tmp_path / "a.txt", "wb") as out:
        for n in range(4000):
            record = f"{n}|{'w' * rng.randint(0, 30)} {n}|äöü|end{n}"
            broken = record
            if rng.random() < 0.3:
                at = rng.randint(len(str(n)) + 1, record.rindex("|"))
                broken = record[:at] + "\r\n" * rng.randint(1, 3) + record[at:]
            expected.append(broken.replace("\r\n", " ").replace("äöü", "äöü�"))
            out.write(broken.replace("äöü", "äöü\xff").encode("utf-8").replace("\xff".encode(), b"\xff") + b"\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = scan_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 8
        blocks = pack_blocks(lines, 1000)
        rows = repair.repair_blocks(blocks, 3).orderBy("part", "seq", "zone", "rec").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["value"] for r in rows] == expected
    assert {r["status"] for r in rows} == {"record"}


def test_no_text_leaves_its_task_but_block_edges(spark):
    """The body of a block reaches the records without an exchange."""
    rows = spark.range(0, 20000, numPartitions=4).select(F.concat_ws("|", F.col("id").cast("string"), F.lit("x"), F.lit("y")).alias("value"))
    split = repair.stage_split(pack_blocks(lines_of_rows(rows, F.lit("f"), F.col("value")), 10_000), 2)
    edges = split.select(F.sum(F.length("lead") + F.length("tail"))).first()[0]
    body = split.select(F.sum(F.aggregate("records", F.lit(0), lambda n, r: n + F.length(r)))).first()[0]
    assert edges < body / 50
    plan = repair._label(repair._within(split, 2), "|")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema" in plan and "lead" not in plan
    assert repair.reassemble_records(split, repair.stage_edges(split, repair.stage_states(split))).count() == 20000


@pytest.mark.parametrize("block_bytes", [100, 4000])
def test_states_reach_blocks_without_moving_text(spark, monkeypatch, block_bytes):
    """Where the states can't be broadcast, they go to the buckets of the staged blocks."""
    lines = [piece for n in range(900) for piece in (f"a{n}|b", "c|d", f"e|f{n}")]
    frame = spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1)
    split = repair.stage_split(pack_blocks(lines_of_rows(frame, F.lit("f"), F.col("value")), block_bytes), 3)
    states = repair.stage_states(split)
    planned = []
    written = repair._written
    monkeypatch.setattr(repair, "_written", lambda df, *rest: planned.append(df) or written(df, *rest))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        edges = repair.stage_edges(split, states)
        plan = planned[0]._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "BroadcastHashJoin" not in plan
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    after = plan[plan.index("Exchange") :]
    assert len(exchanges) == 1 and "states" in after and "lead" not in after
    outcome = repair.reassemble_records(split, edges)
    rows = sorted(outcome.collect(), key=lambda r: (r["part"], r["seq"], r["zone"], r["rec"]))
    assert [(r["value"], r["status"], r["suspect"]) for r in rows] == sequential(lines, 3)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("linemend_split")]


def test_line_checks(spark):
    rows = [("f", 0, 0, "a|b|c"), ("f", 0, 1, "a|b"), ("f", 9, 0, "a"), ("g", 0, 0, "a|b|c"), ("g", 0, 1, "d|e|f")]
    lines = spark.createDataFrame(rows, "file string, part long, id long, value string")
    assert {tuple(r) for r in repair.expected_separators(lines).collect()} == {("f", 2), ("g", 2)}
    assert [(r["value"], r["separators"]) for r in repair.detect_bad_lines(lines, 2).collect()] == [("a|b", 1), ("a", 0)]
    assert [(r["file"], r["value"]) for r in repair.first_bad_lines(lines, 2).collect()] == [("f", "a|b")]
    status = repair.file_status(lines, 2)
    assert {tuple(r) for r in status.collect()} == {("f", 3, 2, False), ("g", 2, 0, True)}
    clean, broken = repair.route_clean_or_repair(lines, status)
    assert {r["file"] for r in clean.collect()} == {"g"} and {r["file"] for r in broken.collect()} == {"f"}


def test_other_separator(spark):
    frame = spark.createDataFrame([("a^b",), ("c|d^e",)], "value string").coalesce(1)
    blocks = pack_blocks(lines_of_rows(frame, F.lit("f"), F.col("value")))
    rows = repair.repair_blocks(blocks, 2, "^").collect()
    assert [r["value"] for r in rows] == ["a^b c|d^e"]


@pytest.mark.parametrize("block_bytes", [100, 5000, 1 << 20])
def test_file_without_any_separator_stays_lines(spark, block_bytes):
    rows = spark.range(0, 3000, numPartitions=3).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("value"))
    outcome = repair.repair_blocks(pack_blocks(lines_of_rows(rows, F.lit("f"), F.col("value")), block_bytes), 3)
    kept = sorted(outcome.collect(), key=lambda r: (r["part"], r["seq"], r["zone"], r["rec"]))
    assert [r["value"] for r in kept] == [f"line {n}" for n in range(3000)]
    assert {r["status"] for r in kept} == {"unfit"} and repair.kept_records(outcome).count() == 0
    assert {r["reason"] for r in repair.reject_overflow(outcome).collect()} == {"schema does not fit"}


@pytest.mark.parametrize("bits", [(1, 1), (2, 1), (40, 40)])
def test_states_in_ranges_of_any_width(spark, monkeypatch, bits):
    """Every record is broken and no line holds all separators, so states pass through all blocks."""
    monkeypatch.setattr(repair, "RANGE_BITS", bits)
    lines = [piece for n in range(60) for piece in (f"a{n}|b", "c|d", f"e|f{n}")]
    blocks = [("f", i // 2, i, f"{line}\n".encode()) for i, line in enumerate(lines)]
    frame = spark.createDataFrame(blocks, "file string, part long, seq long, text binary")
    assert outcomes(frame, 3)["f"] == sequential(lines, 3)
