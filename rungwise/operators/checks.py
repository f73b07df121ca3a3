"""Sources as documents, summaries, and robustness runs, each one stage over a table of sources."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rungwise.functions import coded, markers, render
from rungwise.functions.coded import FormatError
from rungwise.operators.parser import INTERACTORS, MODIFIERS, SECTIONS, SEQUENCE_WORDS, SHAPES, STEP_WORDS, parse
from rungwise.operators.scanner import SyntaxFault
from rungwise.operators.stage import deep, parse_source, text_of
from rungwise.session import ship

DOCUMENT = "source_id string, format string, original string, normalized string, char_map array<int>, repairs array<string>, repair_kinds array<string>, error string"
TEXT = "source_id string, start int, kind string, name string, text string"
RUN = "source_id string, success boolean, error_class string, error string, duration_ms double"
#: Classes of fault that a text may give without the engine being at fault.
EXPECTED = ("SyntaxFault", "FormatError", "RecursionError", "BudgetFault")


def _stage(sources: DataFrame, schema: str, row: Callable[[str, bytes | str | None], tuple], source_id: str, content: str) -> DataFrame:
    ship(sources.sparkSession)
    out = sources.sparkSession.createDataFrame([], schema).schema
    kinds = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(k.as_py() or "", c.as_py()) for k, c in zip(batch.column(0), batch.column(1), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return sources.select(F.col(source_id).cast("string"), F.col(content)).mapInArrow(run, out)


def plain_text(content: bytes | str | None) -> tuple[str, str]:
    """Wire format and text of one source, before markers are expanded."""
    if isinstance(content, bytes):
        return ("coded", coded.decode(content)) if content.startswith(coded.MARK) else ("plain", text_of(content))
    return "plain", content or ""


def documents(sources: DataFrame, source_id: str = "source_id", content: str = "content", table: dict[str, str] | None = None, always: bool = False) -> DataFrame:
    """Each source as text: original, normalized and, where the two differ, the map between them (-1: made up).

    `table` is another marker table; `always` expands texts that don't look compressed, too.
    A source that can't be decoded has an error and no normalized text.
    """

    def row(key: str, data: bytes | str | None) -> tuple:
        form, text = "plain", None
        try:
            form, text = plain_text(data)
            if not always and not markers.is_compressed(text):
                return key, form, text, text, None, [], [], None
            source, used = markers.expand(text, markers.MARKERS if table is None else table)
            return key, "compressed", text, source.normalized, source.offsets.tolist(), used, [markers.KINDS[r] for r in used], None
        except FormatError as fault:
            return key, form, text, None, None, [], [], str(fault)

    return _stage(sources, DOCUMENT, row, source_id, content)


def marker_facts(sources: DataFrame, source_id: str = "source_id", content: str = "content") -> DataFrame:
    """source_id, n_markers (outside strings and comments, which nest), compressed: whether the text looks like marker text."""

    def row(key: str, data: bytes | str | None) -> tuple:
        try:
            text = plain_text(data)[1]
        except FormatError:
            return key, None, None
        return key, *markers.facts(text)

    return _stage(sources, "source_id string, n_markers int, compressed boolean", row, source_id, content)


def texts(sources: DataFrame, source_id: str = "source_id", content: str = "content") -> DataFrame:
    """source_id, start, kind, name, text: every variable, record, mapping, layout, sequence and equation block as text for people; none of a source that doesn't parse."""
    kinds = to_arrow_schema(sources.sparkSession.createDataFrame([], TEXT).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                rows: list[tuple] = []
                try:
                    source, _, _ = markers.prepared(plain_text(data.as_py())[1])
                    with deep():
                        for n in parse(source.normalized).walk():
                            if (text := render.told(n, source.spans)) is not None:
                                rows.append((key.as_py() or "", source.spans(n)[0], n.kind, n.name, text))
                except (SyntaxFault, FormatError, RecursionError):
                    continue
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    ship(sources.sparkSession)
    return sources.select(F.col(source_id).cast("string"), F.col(content)).mapInArrow(run, TEXT)


def summaries(sources: DataFrame, source_id: str = "source_id", content: str = "content") -> DataFrame:
    """source_id, summary: the program's module tree as text for people, null where it doesn't parse."""

    def row(key: str, data: bytes | str | None) -> tuple:
        try:
            source, _, _ = markers.prepared(plain_text(data)[1])
            with deep():
                return key, render.module(parse(source.normalized).of("root")[0], source.spans)
        except (SyntaxFault, FormatError, RecursionError):
            return key, None

    return _stage(sources, "source_id string, summary string", row, source_id, content)


def runs(sources: DataFrame, source_id: str = "source_id", content: str = "content", budget: int | None = None) -> DataFrame:
    """One row per source: whether it parsed within its budget of steps, else its fault, and how long it took. Any exception is a row, also those that are the engine's."""

    def row(key: str, data: bytes | str | None) -> tuple:
        began = time.perf_counter()
        try:
            parse_source(key, data, failfast=True, budget=budget)
            fault = None
        except Exception as e:
            fault = e
        took = (time.perf_counter() - began) * 1000
        return key, fault is None, type(fault).__name__ if fault else None, str(fault) if fault else None, took

    return _stage(sources, RUN, row, source_id, content)


def crashes(found: DataFrame) -> DataFrame:
    """Runs that ended in a fault of the engine's."""
    return found.filter(~F.col("success") & ~F.col("error_class").isin(*EXPECTED))


def slow(found: DataFrame, limit_ms: float = 10_000) -> DataFrame:
    return found.filter(F.col("duration_ms") > limit_ms)


_SOUP = [*SECTIONS, *SEQUENCE_WORDS, *STEP_WORDS, *SHAPES, *INTERACTORS, *MODIFIERS, *"( ) : ; , = := => == <> + - * / . IF THEN ELSE ENDIF AND OR NOT True False 1 -2 3.5 1.0e3 (* *) \" \"text\" Name 'quoted' #01 #71 #zz é \n".split(" ")]


def soup(seed: int, length: int) -> str:
    """`length` characters of the language's words in random order, always the same for a seed."""
    r, parts, held = random.Random(seed), [], 0
    while held < length:
        parts.append(r.choice(_SOUP) + r.choice((" ", " ", "\n", "")))
        held += len(parts[-1])
    return "".join(parts)[:length]


def random_sources(spark: SparkSession, rounds: int, seed: int = 0, length: int = 500) -> DataFrame:
    """source_id, content of `rounds` random texts; round i has seed + i, zero being a seed like any other."""
    return soups(spark.range(rounds).select((F.col("id") + seed).alias("seed")), length)


def soups(seeds: DataFrame, length: int = 500) -> DataFrame:
    """source_id, content: a random text for every seed (a column `seed`)."""
    ship(seeds.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([f"random-{i}" for i in own]), pa.array([soup(i, length) for i in own])], names=["source_id", "content"])

    return seeds.select("seed").mapInArrow(run, "source_id string, content string")
