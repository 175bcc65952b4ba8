"""Function spans of source files.

Brace languages are matched by signature patterns and brace balance, as grouped and
windowed DataFrames over line rows; Python files go through the standard parser.

The lines that matter are found by expressions over a block of ``BLOCK_LINES`` lines and stored without their
text. A file of up to ``ROW_LINES`` lines is then matched inside its row, without a shuffle: one Arrow function
follows the braces of a batch of files at once. Of a longer file running sums and "next line that" searches are
answered inside a block first and then over one row per block, so no task ever follows a whole long file.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Callable, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from faultgrain.functions.paths import LANGUAGE_BY_SUFFIX
from faultgrain.functions.text import SPACE, WORD, first_match, line_count, split_lines
from faultgrain.plans.skew import lookup
from faultgrain.session import materialize

BLOCK_LINES = 4096
ROW_LINES = 512

# What a function signature looks like, group 1 is the name. A C-family
# signature is one or more type words, the name and a parameter list without ; { }.
# The run of type words is one character class between two required characters, which
# accepts the same lines as a repeated group but needs no recursion in Java.
_TYPE = rf"{WORD}:<>,\*&\[\]"
C_FAMILY = rf"^[{SPACE}]*[{_TYPE}][{_TYPE}{SPACE}]*[{SPACE}]([{WORD}]+)[{SPACE}]*\([^;{{}}]*\)"
GO = rf"^func[{SPACE}]+(?:\([{SPACE}]*[{WORD}]+[{SPACE}]+[{WORD}\*]+[{SPACE}]*\)[{SPACE}]+)?([{WORD}]+)[{SPACE}]*\("
RUST = rf"^[{SPACE}]*(?:pub[{SPACE}]+)?fn[{SPACE}]+([{WORD}]+)"

SIGNATURES = {
    "c": C_FAMILY,
    "cpp": C_FAMILY,
    "java": C_FAMILY,
    "javascript": C_FAMILY,
    "typescript": C_FAMILY,
    "go": GO,
    "rust": RUST,
}
# A line without this text cannot match the pattern.
_NEEDED = {C_FAMILY: "(", GO: "func", RUST: "fn"}


def _by_pattern(signatures: Mapping[str, str], line: Column, language: Column) -> dict[str, Column]:
    """Pattern -> cheap test whether a line can match it at all."""
    languages: dict[str, list[str]] = {}
    for name, pattern in signatures.items():
        languages.setdefault(pattern, []).append(name)
    return {
        pattern: language.isin(*names) & F.contains(line, F.lit(_NEEDED.get(pattern, "")))
        for pattern, names in languages.items()
    }


def is_signature(
    line: Column, language: Column, signatures: Mapping[str, str] = SIGNATURES
) -> Column:
    matches = F.lit(False)
    for pattern, possible in _by_pattern(signatures, line, language).items():
        matches = matches | (possible & line.rlike(pattern))
    return matches


def signature_name(
    line: Column, language: Column, signatures: Mapping[str, str] = SIGNATURES
) -> Column:
    """The function name of a signature line, else NULL."""
    return F.coalesce(
        *(
            F.when(possible, first_match(pattern, line))
            for pattern, possible in _by_pattern(signatures, line, language).items()
        )
    )


def explode_lines(files: DataFrame, text: str = "content") -> DataFrame:
    """One row per line: number ``n`` from 1, ``line`` and the file's line count ``last``.

    A file without lines keeps one row with NULL ``n``. The text is split in a projection
    of its own, below the generator, so it is split once per file and not once per line.
    """
    kept = [c for c in files.columns if c != text]
    split = files.select(*kept, split_lines(F.col(text)).alias("_lines"))
    counted = split.withColumn("last", F.size("_lines"))
    lines = counted.select(*kept, "last", F.posexplode_outer("_lines").alias("n", "line"))
    return lines.withColumn("n", F.col("n") + 1)


def with_last_line(lines: DataFrame) -> DataFrame:
    """Add ``last`` to a table of lines that does not carry its files' line counts."""
    last = lines.groupBy("path").agg(F.max("n").alias("last"))
    return lookup(lines, last, ["path"], ["n"], how="inner")


def brace_lines(lines: DataFrame, signatures: Mapping[str, str] = SIGNATURES) -> DataFrame:
    """Lines that can start, nest or end a span, without their text.

    ``lines`` has path, language, n, line and last. Other lines change no balance, so they
    are dropped before anything is shuffled; the last line of a file always stays, so the
    result has a row for every file.
    """
    line, language = F.col("line"), F.col("language")
    opened, closed = (F.length(line) - F.length(F.replace(line, F.lit(b))) for b in "{}")
    opens, closes = F.contains(line, F.lit("{")), F.contains(line, F.lit("}"))
    last = F.col("n").isNull() | (F.col("n") == F.col("last"))
    return lines.filter(last | opens | closes | is_signature(line, language, signatures)).select(
        "path",
        "language",
        F.floor((F.col("n") - 1) / BLOCK_LINES).cast("int").alias("block"),
        "n",
        "last",
        (opened - closed).alias("net"),
        opens.alias("opens"),
        signature_name(line, language, signatures).alias("name"),
    )


def _backwards(keys: list[str], order: str, end: int) -> WindowSpec:
    """The rows after the current one (``end`` -1) or from it on (0).

    Written as the rows before it in falling order: Spark adds row by row to a frame that
    grows, but aggregates a frame that shrinks anew for every row.
    """
    falling = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return falling.rowsBetween(Window.unboundedPreceding, end)


def _depth_in_block(rows: DataFrame) -> DataFrame:
    """Add the brace ``depth`` after each line and ``opening`` (n, depth), the next opening line.

    Both count from the start of the block. ``opening`` is the line itself when it holds an
    opening brace.
    """
    by_line = Window.partitionBy("path", "block").orderBy("n")
    so_far = by_line.rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("depth", F.sum("net").over(so_far).cast("int"))
        .withColumn("here", F.when(F.col("opens"), F.struct("n", "depth")))
        .withColumn("opening", F.min("here").over(_backwards(["path", "block"], "n", 0)))
    )


def _depth_in_file(rows: DataFrame) -> DataFrame:
    """``_depth_in_block`` continued over the blocks of a file, through one row per block."""
    local = _depth_in_block(rows)
    blocks = Window.partitionBy("path").orderBy("block")
    before = F.sum("_net").over(blocks.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min("_first").over(_backwards(["path"], "block", -1))
    per_block = (
        local.groupBy("path", "block")
        .agg(F.sum("net").alias("_net"), F.min("here").alias("_first"))
        .withColumn("_before", F.coalesce(before, F.lit(0)).cast("int"))
        .withColumn("_first", _raised("_first"))
        .withColumn("_later", later)
        .select("path", "block", "_before", "_later")
    )
    return (
        local.join(per_block, ["path", "block"])
        .withColumn("depth", F.col("_before") + F.col("depth"))
        .withColumn("opening", F.coalesce(_raised("opening"), F.col("_later")))
    )


def _raised(opening: str) -> Column:
    """An opening's depth counted from the start of its file instead of its block."""
    raised = F.struct(f"{opening}.n", (F.col(f"{opening}.depth") + F.col("_before")).alias("depth"))
    return F.when(F.col(opening).isNotNull(), raised)


def _span_points(rows: DataFrame) -> DataFrame:
    """Span starts and the lines that may end one, by depth ``level``.

    A line taking the depth from d to d - k passes the levels d - 1 .. d - k and may end a
    span at each of them. A start already knows its ``end`` when the opening line brings
    the depth back, or when nothing opens any more.
    """
    before = F.col("depth") - F.col("net")
    at_once = F.col("opening.depth") <= before
    end = F.when(F.col("opening").isNull(), F.col("last")).when(at_once, F.col("opening.n"))
    none = F.lit(None).cast("int")
    start = F.struct(before.alias("level"), none.alias("fall"), end.alias("end"), F.col("name"))
    falls = F.transform(
        F.sequence(F.col("depth"), before - 1),
        lambda level: F.struct(
            level.alias("level"), F.col("n").alias("fall"), none.alias("end"), F.lit(None).cast("string").alias("name")
        ),
    )
    nothing = F.array().cast("array<struct<level:int,fall:int,end:int,name:string>>")
    points = F.concat(
        F.when(F.col("net") < 0, falls).otherwise(nothing),
        F.when(F.col("name").isNotNull(), F.array(start)).otherwise(nothing),
    )
    return rows.select("path", "block", F.col("n").alias("start"), "last", F.inline(points))


def _with_next_fall(points: DataFrame) -> DataFrame:
    """Add ``near``, the next fall at the same level inside the block."""
    after = _backwards(["path", "block", "level"], "start", -1)
    return points.withColumn("near", F.min("fall").over(after))


def brace_spans(rows: DataFrame) -> DataFrame:
    """Spans (path, name, start, end) from the rows of ``brace_lines``.

    A span ends on the first line, from its first opening brace on, whose depth is back at
    the depth before the signature, or else on the last line. When the opening line does
    not end it, the end is the next line taking the depth down through that level: an
    ordered search among the lines of one (path, level), linear in the number of braces.

    Files of one block need a single shuffle and no join; only longer ones are followed
    from block to block.
    """
    rows = rows.filter("n IS NOT NULL")
    one_block = F.col("last") <= BLOCK_LINES
    short = _with_next_fall(_span_points(_depth_in_block(rows.filter(one_block))))
    short = short.withColumn("later", F.lit(None).cast("int"))

    points = _span_points(_depth_in_file(rows.filter(~one_block)))
    per_block = (
        points.groupBy("path", "level", "block")
        .agg(F.min("fall").alias("_first"))
        .withColumn("later", F.min("_first").over(_backwards(["path", "level"], "block", -1)))
        .drop("_first")
    )
    long = _with_next_fall(points).filter("name IS NOT NULL").join(per_block, ["path", "level", "block"])
    return (
        short.filter("name IS NOT NULL")
        .unionByName(long)
        .select("path", "name", "start", F.coalesce("end", "near", "later", "last").alias("end"))
    )


_SPAN_ARRAY = "array<struct<start:int,end:int,name:string>>"


def _defs(tree: ast.Module) -> list[tuple[int, int, str]]:
    """Every ``def`` by start line. Only statements hold any, so no expression is walked."""
    found, todo = [], [tree.body]
    while todo:
        for node in todo.pop():
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                found.append((node.lineno, node.end_lineno, node.name))
            for block in ("body", "orelse", "finalbody", "handlers", "cases"):
                if isinstance(inner := getattr(node, block, None), list) and inner:
                    todo.append(inner)
    return sorted(found, key=lambda span: span[0])


def _parse_python(text: str | None) -> list[tuple[int, int, str]] | None:
    try:
        return _defs(ast.parse(text))
    except (SyntaxError, TypeError, ValueError, RecursionError, MemoryError):
        return None


def _span_lists(first: np.ndarray, missing: np.ndarray | None, start: pa.Array, end: pa.Array, name: pa.Array) -> pa.Array:
    spans = pa.StructArray.from_arrays([start.cast(pa.int32()), end.cast(pa.int32()), name.cast(pa.string())], names=["start", "end", "name"])
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), spans, mask=None if missing is None else pa.array(missing))


def python_functions(text: Column) -> Column:
    """Spans of every ``def`` in a Python source, by start line; NULL when it does not parse."""

    @F.arrow_udf(_SPAN_ARRAY)
    def parse(texts: pa.Array) -> pa.Array:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            found = [_parse_python(text) for text in texts.to_pylist()]
        flat = [span for spans in found for span in spans or ()]
        first = np.cumsum([0, *(len(spans or ()) for spans in found)])
        missing = np.array([spans is None for spans in found], bool)
        start, end, name = zip(*flat) if flat else ((), (), ())
        return _span_lists(first, missing, pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(name, pa.string()))

    return parse(text)


def _marks(lines: Column, before: Column, language: Column, signatures: Mapping[str, str]) -> Column:
    """The lines that can start, nest or end a span: n (counted on from ``before``), net, opens and name, in order."""

    def mark(line: Column, place: Column) -> Column:
        opens, closes = F.contains(line, F.lit("{")), F.contains(line, F.lit("}"))
        opened, closed = (F.length(line) - F.length(F.replace(line, F.lit(b))) for b in "{}")
        net = F.when(opens, opened).otherwise(0) - F.when(closes, closed).otherwise(0)
        return F.struct(
            (before + place + 1).alias("n"), net.alias("net"), opens.alias("opens"), signature_name(line, language, signatures).alias("name")
        )

    return F.filter(F.transform(lines, mark), lambda m: m["opens"] | (m["net"] != 0) | m["name"].isNotNull())


def row_spans(marks: Column, last: Column) -> Column:
    """``brace_spans`` of whole files: the spans of each row's ``marks``, by start line."""

    @F.arrow_udf(_SPAN_ARRAY)
    def follow(marks: pa.Array, last: pa.Array) -> pa.Array:
        marks = marks.fill_null([])
        size = marks.value_lengths().to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        rows = marks.flatten()
        n, net = (rows.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("n", "net"))
        name, files = rows.field("name"), np.repeat(np.arange(len(size)), size)
        sums = np.concatenate([[0], np.cumsum(net)])
        depth = sums[1:] - sums[first[files]]
        start = np.flatnonzero(name.is_valid().to_numpy(zero_copy_only=False))
        file, level = files[start], (depth - net)[start]
        end = last.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[file]
        # The next line that opens, in the same file; it may end the span at once.
        opening = np.flatnonzero(rows.field("opens").to_numpy(zero_copy_only=False).astype(bool))
        if len(opening) and len(start):
            place = np.searchsorted(opening, start)
            at = opening[np.minimum(place, len(opening) - 1)]
            opened = (place < len(opening)) & (at < first[file + 1])
            at_once = opened & (depth[at] <= level)
            end[at_once] = n[at[at_once]]
            # Else the next line that takes the depth down through the level before the signature.
            falling = np.flatnonzero(net < 0)
            steps = -net[falling]
            fall = np.repeat(falling, steps)
            through = np.arange(len(fall)) - np.repeat(np.cumsum(steps) - steps, steps) + np.repeat(depth[falling], steps)
            low, high = int(depth.min()) - 1, int((depth - net).max()) + 1
            low = min(low, int((depth - net).min()))
            key = lambda file, level, row: (file * (high - low + 1) + level - low) * (len(n) + 1) + row
            falls = np.sort(key(files[fall], through, fall))
            after = opened & ~at_once
            wanted = key(file[after], level[after], at[after] + 1)
            found = np.searchsorted(falls, wanted)
            hit = np.append(falls, -1)[found]
            same = (hit >= 0) & (hit // (len(n) + 1) == wanted // (len(n) + 1))
            ends = end[after]
            ends[same] = n[hit[same] % (len(n) + 1)]
            end[after] = ends
        heads = np.concatenate([[0], np.cumsum(np.bincount(file, minlength=len(size)))])
        return _span_lists(heads, None, pa.array(n[start]), pa.array(end), name.take(pa.array(start)))

    return follow(marks, last)


# A handler turns files (path, language, content) into file index rows.
Handler = Callable[[DataFrame], DataFrame]


def python_handler(files: DataFrame) -> DataFrame:
    text = F.col("content")
    return files.select(
        "path",
        "language",
        line_count(text).alias("line_count"),
        python_functions(text).alias("functions"),
    )


def brace_marks(files: DataFrame, signatures: Mapping[str, str] = SIGNATURES) -> DataFrame:
    """A row per block of lines, one at least a file: path, language, last, block and the ``marks`` of its lines."""
    split = files.select("path", "language", split_lines(F.col("content")).alias("_lines")).withColumn("last", F.size("_lines"))
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("last") / BLOCK_LINES).cast("int") - 1, F.lit(0)))
    cut = F.transform(blocks, lambda block: F.slice("_lines", block * BLOCK_LINES + 1, F.lit(BLOCK_LINES)))
    cut = split.select("path", "language", "last", F.posexplode_outer(cut).alias("block", "_lines"))
    before = F.coalesce(F.col("block"), F.lit(0)) * BLOCK_LINES
    return cut.select("path", "language", "last", "block", _marks(F.col("_lines"), before, F.col("language"), signatures).alias("marks"))


def brace_handler(files: DataFrame) -> DataFrame:
    """The contents are read once; the few columns kept of them are written and reused."""
    marked = materialize(brace_marks(files), "brace-marks")
    short = F.coalesce(F.col("last") <= min(ROW_LINES, BLOCK_LINES), F.lit(True))
    columns = ["path", "language", F.col("last").alias("line_count")]
    in_rows = marked.filter(short).select(*columns, row_spans(F.col("marks"), F.col("last")).alias("functions"))
    long = marked.filter(~short)
    found = collect_functions(brace_spans(long.select("path", "block", "last", F.inline("marks"))))
    functions = F.coalesce("functions", F.array().cast(_SPAN_ARRAY))
    by_lines = long.filter("block = 0").join(found, "path", "left").select(*columns, functions.alias("functions"))
    return in_rows.unionByName(by_lines)


def unknown_handler(files: DataFrame) -> DataFrame:
    """For languages nothing can parse: counted lines, NULL functions."""
    return files.select(
        "path",
        "language",
        line_count(F.col("content")).alias("line_count"),
        F.lit(None).cast(_SPAN_ARRAY).alias("functions"),
    )


def collect_functions(spans: DataFrame) -> DataFrame:
    """Spans of a file as one array by start line (bounded by the size of one file)."""
    return spans.groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "name"))).alias("functions")
    )


HANDLERS: dict[str, Handler] = {
    "python": python_handler,
    **dict.fromkeys(SIGNATURES, brace_handler),
}


def index_files(files: DataFrame, handlers: Mapping[str, Handler] = HANDLERS) -> DataFrame:
    """Index rows from each language's handler; languages sharing one run together.

    A language without a handler gets NULL functions. Each part filters on ``language``, so
    a snapshot, which is stored by language, is read once over all parts.
    """
    languages_of: dict[Handler | None, list[str]] = {}
    for language in sorted(set(LANGUAGE_BY_SUFFIX.values())):
        languages_of.setdefault(handlers.get(language), []).append(language)
    parts = [
        (handler or unknown_handler)(files.filter(F.col("language").isin(*languages)))
        for handler, languages in languages_of.items()
    ]
    return reduce(DataFrame.unionByName, parts)
