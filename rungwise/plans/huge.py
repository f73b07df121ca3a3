"""One text over many tasks: its lines, strings and comments without reading it in one place.

A text comes as chunks in order. What a chunk does to the scanner is a function from the state
before it (in the open, in a string, in a comment of some depth) to the state after it. Functions of
neighbours compose, so the states in which all chunks start come out of a tree over the chunks: functions are composed
upwards, states handed down. Then every chunk is scanned once more, by itself, from its own state.

In a comment of unknown depth a chunk can do two things: close it, if it closes more than it
opens somewhere, and go on in the open from there, or change the depth. A function holds the state after
it for each depth that it closes, and the change for all greater ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rungwise.plans.asof import fresh
from rungwise.session import checkpointed, ship

#: States: in the open, in a string; from 1 on the depth of a comment.
OPEN, STRING = 0, -1
#: Chunks, or groups of them, that one task composes.
FAN = 256
#: Rows that leave a task together.
ROWS = 10_000
_MARK = re.compile(r'\(\*|\*\)|"')
#: What may be part of a mark: quotes, brackets and stars side by side, and at a chunk's edges.
_RUN = re.compile(r'["(*)]{2,}|"|\A[(*)]|[(*)]\Z')

Effect = list[int]  # from OPEN, from STRING, change of depth, then from each depth that is closed


def after(state: int, mark: str) -> int:
    if state == STRING:
        return OPEN if mark == '"' else STRING
    if state == OPEN:
        return {'"': STRING, "(*": 1, "*)": OPEN}[mark]
    return state + {'"': 0, "(*": 1, "*)": -1}[mark]


def starts_in(text: str, before: str) -> int:
    """1 if the chunk's first character is the second one of a mark. A star that follows a bracket is never the first one."""
    return int(text[:1] == "*" and before[-1:] == "(" or text[:1] == ")" and before[-1:] == "*" and before[-2:-1] != "(")


def marks(text: str, before: str, following: str) -> Iterator[tuple[int, str]]:
    """The marks that start in a chunk, the last one perhaps ending in the next chunk."""
    for m in _MARK.finditer(text + following, starts_in(text, before)):
        if m.start() < len(text):
            yield m.start(), m[0]


def thin(text: str) -> tuple[str, list[int]]:
    """A chunk for its marks alone: every stretch that holds no part of one is a space, whose length stands in the list. Never longer than the chunk, the list no longer than its marks and one."""
    parts, gaps, at = [], [], 0
    for m in _RUN.finditer(text):
        if m.start() > at:
            parts.append(" ")
            gaps.append(m.start() - at)
        parts.append(m[0])
        at = m.end()
    if at < len(text):
        parts.append(" ")
        gaps.append(len(text) - at)
    return "".join(parts), gaps


def places_in(text: str, gaps: list[int]) -> list[int]:
    """Where each character of a thin chunk stands in the chunk, and how long that is."""
    out, at, lengths = [], 0, iter(gaps)
    for c in text:
        out.append(at)
        at += next(lengths) if c == " " else 1
    return [*out, at]


def effect(text: str, before: str = "", following: str = "") -> Effect:
    """What a chunk does, given the two characters before it and the one after it."""
    state = [OPEN, STRING]  # of each start that is followed; those that have met are one from then on
    group = [0, 1]  # which of them a start has become: that from OPEN, from STRING, and from each depth closed
    depth = low = 0
    for _, mark in marks(text, before, following):
        state = [after(s, mark) for s in state]
        if mark != '"':
            depth += 1 if mark == "(*" else -1
        if depth < low:
            low = depth
            group.append(len(state))
            state.append(OPEN)
        if len({*state}) < len(state):
            first = {s: k for k, s in reversed(list(enumerate(state)))}
            kept = sorted(first.values())
            place = {k: n for n, k in enumerate(kept)}
            group = [place[first[state[g]]] for g in group]
            state = [state[k] for k in kept]
    out = [state[g] for g in group]
    return [out[0], out[1], depth, *out[2:]]


def applied(e: Effect, state: int) -> int:
    if state <= OPEN:
        return e[-state]
    return e[2 + state] if state <= len(e) - 3 else state + e[2]


def composed(first: Effect, then: Effect) -> Effect:
    closed = max(len(first) - 3, len(then) - 3 - first[2])
    return [applied(then, first[0]), applied(then, first[1]), first[2] + then[2], *(applied(then, applied(first, d)) for d in range(1, closed + 1))]


def chunks_of(texts: DataFrame, key: str, text: str = "text", size: int = 1 << 20) -> DataFrame:
    """key, part, text: each text in chunks of `size` characters. Null counts as empty, and an empty text is one empty chunk."""
    whole = F.coalesce(F.col(text), F.lit(""))
    cut = F.when(whole == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    return texts.select(key, F.posexplode(cut).alias("part", "text")).select(key, F.col("part").cast("long").alias("part"), "text")


def read_chunks(spark: SparkSession, path: str, size: int = 1 << 20) -> DataFrame:
    """source_id, part, text of files, each read in as many tasks as it has splits. Lines end in LF, each line of a file too."""
    ship(spark)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        at, n, count = None, 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([n], pa.int64()), pa.array(["".join(held)])], names=["source_id", "block", "n", "text"])

        for batch in batches:
            for path, block, line in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held and ((path, block) != at or count >= size):
                    yield flush()
                    held.clear()
                    n, count = (n + 1 if (path, block) == at else 0), 0
                at = path, block
                held.append(line + "\n")
                count += len(line) + 1
        if held:
            yield flush()

    found = lines.mapInArrow(run, "source_id string, block long, n long, text string")
    return found.select("source_id", F.struct("block", "n").alias("part"), "text")


def placed(chunks: DataFrame, key: str) -> DataFrame:
    """Chunks with `n` (from 0), `start` (characters before), `before` and `following` characters, `line` (LFs before) and `next_end`, where the line that a chunk leaves open ends.

    All but n, start and the like of a chunk stays where it is: windows run over these few numbers, a row for each chunk.
    """
    facts = chunks.select(
        key, "part", F.length("text").alias("size"), F.right("text", F.lit(2)).alias("tail"), F.left("text", F.lit(1)).alias("head"), F.regexp_count("text", F.lit("\n")).alias("ends"), (F.instr("text", "\n") - 1).alias("first_end")
    )
    order = Window.partitionBy(key).orderBy("part")
    so_far, onwards = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    facts = facts.withColumns({
        "n": F.row_number().over(order).cast("long") - 1, "start": F.coalesce(F.sum("size").over(so_far), F.lit(0)), "line": F.coalesce(F.sum("ends").over(so_far), F.lit(0)),
        "before": F.right(F.concat(F.coalesce(F.lag("tail", 2).over(order), F.lit("")), F.coalesce(F.lag("tail").over(order), F.lit(""))), F.lit(2)), "following": F.coalesce(F.lead("head").over(order), F.lit("")),
    })
    end = F.when(F.col("first_end") >= 0, F.col("start") + F.col("first_end"))
    total = F.sum("size").over(Window.partitionBy(key))
    return facts.withColumn("next_end", F.coalesce(F.first(end, ignorenulls=True).over(onwards), total)).withColumn("last", F.lead("n").over(order).isNull()).select(key, "part", "n", "start", "line", "before", "following", "next_end", "last")


def _grouped(rows: DataFrame, key: str, run, schema: str) -> DataFrame:
    """`run(n, columns)` over the rows of each key and group of FAN, in order. Groups follow each other in sorted partitions: most are a few rows, and a call from Spark for each would cost more than its work."""
    fields = T.StructType.fromDDL(schema).fields
    kinds = T.StructType([rows.schema[key], *fields])
    kind, arrow = to_arrow_type(rows.schema[key].dataType), {f.name: to_arrow_type(f.dataType) for f in fields}
    group = fresh(rows, "group")
    names = [c for c in rows.columns if c != key]

    def of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in names}
        keys: list = []
        out: dict[str, list] = {f.name: [] for f in fields}
        at: tuple | None = None

        def close() -> None:
            for c, made in run(at[1], held).items():
                out[c].extend(made)
            keys.extend([at[0]] * (len(out[fields[0].name]) - len(keys)))
            for c in names:
                held[c] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(out[c], arrow[c]) for c in out)], names=[key, *out])

        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in names}
            for row, now in enumerate(zip(batch.column(key).to_pylist(), batch.column(group).to_pylist(), strict=True)):
                if at is not None and now != at and not (now[1] == at[1] and now[0] != now[0] and at[0] != at[0]):
                    close()
                    if len(keys) >= ROWS:
                        yield batch_of()
                        keys.clear()
                        for c in out:
                            out[c] = []
                at = now
                for c in names:
                    held[c].append(columns[c][row])
        if at is not None:
            close()
        if keys:
            yield batch_of()

    grouped = rows.withColumn(group, F.floor(F.col("n") / FAN))
    return grouped.repartition(key, group).sortWithinPartitions(key, group, "n").mapInArrow(of_part, kinds)


def entry_states(effects: DataFrame, key: str) -> DataFrame:
    """key, n, state: in which state each chunk starts, from rows key, n, effect; chunks without effect may be left out. Work of a level is shared between groups of FAN; there are as many levels as FAN's powers in the longest text's chunks."""
    levels = [checkpointed(effects.select(key, "n", "effect"))]

    def up(group: int, rows: dict) -> dict:
        total = rows["effect"][0]
        for e in rows["effect"][1:]:
            total = composed(total, e)
        return {"n": [group], "effect": [total]}

    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most:
        levels.append(checkpointed(_grouped(levels[-1], key, up, "n long, effect array<int>")))
        most //= FAN
    states = levels[-1].select(key, "n", F.lit(OPEN).alias("state"))

    def down(group: int, rows: dict) -> dict:
        out = [rows["state"][0]]
        for e in rows["effect"][:-1]:
            out.append(applied(e, out[-1]))
        return {"n": rows["n"], "state": out}

    for level in reversed(levels[:-1]):
        held = states.select(key, F.col("n").alias("group"), "state")
        states = _grouped(level.withColumn("group", F.floor(F.col("n") / FAN)).join(held, [key, "group"]).drop("group"), key, down, "n long, state int")
    return states


def effects_of(chunks: DataFrame, key: str) -> DataFrame:
    """key, n, effect of chunks as marked() gives them; all others change nothing."""
    schema = T.StructType([chunks.schema[key], T.StructField("n", T.LongType()), T.StructField("effect", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [effect(*x) for x in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=[key, "n", "effect"])

    return chunks.select(key, "n", "text", "before", "following").mapInArrow(run, schema)


def pieces(text: str, before: str, following: str, state: int) -> Iterator[tuple[str, int | None, int | None]]:
    """(S or C, start, end) of the strings and comments of a chunk that starts in a state; start is None of one that began before, end of one that goes on. A doubled quote is no end, across chunks neither."""
    at = 0
    if state == OPEN and before[-1:] == '"' and text[:1] == '"':
        state, at = STRING, 1  # the quote before the chunk and this one are one doubled quote
    begun = None
    for k, mark in marks(text, before, following):
        if k < at:
            continue
        then = after(state, mark)
        if state == OPEN and then != OPEN:
            begun = k
        elif then == OPEN and state != OPEN:
            end = k + len(mark)
            if mark == '"' and (text[end : end + 1] or following if end >= len(text) else text[end]) == '"':
                if end >= len(text):
                    yield "S", begun, None
                    return
                at = end + 1  # skips the second quote
                continue
            yield ("S" if state == STRING else "C"), begun, end
            begun = None
        state = then
    if state != OPEN:
        yield ("S" if state == STRING else "C"), begun, None


def marked(chunks: DataFrame, key: str) -> DataFrame:
    """The chunks that hold marks or parts of them, as thin() gives them, with n, start, before and following as placed() gives them and the length of the whole text. Texts stay where they are: what is moved is a few bytes for each chunk and mark."""
    schema = T.StructType([chunks.schema[key], chunks.schema["part"], *T.StructType.fromDDL("size int, text string, gaps array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            thinned, gaps = zip(*map(thin, texts), strict=True) if texts else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, texts), pa.int32()), pa.array(thinned, pa.string()), pa.array(gaps, pa.list_(pa.int32()))], names=schema.names)

    order = Window.partitionBy(key).orderBy("part")
    tail = lambda k: F.coalesce(F.right(F.lag("text", k).over(order), F.lit(2)), F.lit(""))
    found = chunks.select(key, "part", "text").mapInArrow(run, schema).withColumns({
        "n": F.row_number().over(order).cast("long") - 1, "start": F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("size").over(Window.partitionBy(key)),
        "before": F.right(F.concat(tail(2), tail(1)), F.lit(2)), "following": F.coalesce(F.left(F.lead("text").over(order), F.lit(1)), F.lit("")),
    })
    return found.filter("text <> ' '").select(key, "n", "start", "total", "before", "following", "text", "gaps")


def opaque(chunks: DataFrame, key: str) -> DataFrame:
    """key, kind (S or C), start, end of every string and comment of texts in chunks (key, part, text), as a scan of each whole text gives them.

    Empty chunks count for nothing. No task holds more than a
    chunk, FAN of their effects, or a row for each chunk of one text.
    """
    ship(chunks.sparkSession)
    whole = checkpointed(marked(chunks.filter(F.length("text") > 0), key))
    states = entry_states(effects_of(whole, key), key)
    schema = T.StructType([chunks.schema[key], *T.StructType.fromDDL("n long, kind string, start long, end long, total long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for k, (n, start, total, text, gaps, before, following, state) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 9)), strict=True)):
                at = places_in(text, gaps)
                for kind, a, b in pieces(text, before, following, state):
                    rows.append(k)
                    out.append((n, kind, None if a is None else start + at[a], None if b is None else start + at[b - 1] + 1, total))
            if rows:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(columns[0], pa.int64()), pa.array(columns[1]), *(pa.array(c, pa.int64()) for c in columns[2:])], names=[f.name for f in schema])

    found = checkpointed(whole.join(states, [key, "n"]).select(key, "n", "start", "total", "text", "gaps", "before", "following", "state").mapInArrow(run, schema))
    inner = found.filter("start IS NOT NULL AND end IS NOT NULL").select(key, "kind", "start", "end")
    # what goes over an edge: its beginning, and the first end after it, a few rows for each chunk with marks
    order = Window.partitionBy(key).orderBy("n")
    closing = F.first("end", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    edge = found.filter("start IS NULL OR end IS NULL")
    # an edge row that both ends one and starts none has no start; rows of one chunk are in order of their places
    ordered = edge.withColumn("n", F.col("n") * 2 + F.when(F.col("start").isNull(), 0).otherwise(1))
    over = ordered.withColumn("end", closing).filter("start IS NOT NULL")
    return inner.unionByName(over.select(key, "kind", "start", F.coalesce("end", "total").alias("end")))


def lines(chunks: DataFrame, key: str) -> DataFrame:
    """key, line, start, length of every line of texts in chunks, as plans.positions.lines gives them of whole texts."""
    ship(chunks.sparkSession)
    filled = chunks.filter(F.length("text") > 0)
    empty = chunks.groupBy(key).agg(F.max(F.length("text")).alias("most")).filter("most = 0")
    schema = T.StructType([chunks.schema[key], *(T.StructField(c, T.LongType()) for c in ("line", "start", "length"))])
    whole = filled.join(placed(filled, key), [key, "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (n, start, line, text, next_end) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 6)), strict=True)):
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                begins = start + np.flatnonzero(points == 10) + 1
                ends = np.append(begins[1:] - 1, next_end)
                number = line + np.arange(len(begins)) + 2
                if n == 0:
                    first = begins[0] - 1 if len(begins) else next_end
                    begins, ends, number = np.append(0, begins), np.append(first, ends) if len(begins) else np.array([first]), np.append(1, number)
                m = len(begins)
                if m:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(m, k))), *(pa.array(x.astype(np.int64)) for x in (number, begins, ends[:m] - begins))], names=[key, "line", "start", "length"])

    found = whole.select(key, "n", "start", "line", "text", "next_end").mapInArrow(run, schema)
    one: list[Column] = [F.lit(x).cast("long").alias(c) for x, c in ((1, "line"), (0, "start"), (0, "length"))]
    return found.unionByName(empty.select(key, *one))
