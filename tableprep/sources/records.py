"""Records of text files that one task can't cut by itself.

A CSV field may hold line breaks, a JSON array and an XML document are one value
from the first byte to the last; still, one big file should be many tasks.  The files
are read as chunks that end in a separator (``lineSep`` of Spark's text source, which
cuts files at any byte), in two passes:

1. Each split is scanned from every scanner mode it might begin in (outside or inside
   of a quoted field, a string, a comment ...) and yields, for each, the mode it ends in and
   the change of depth.  These transitions compose; a prefix over the splits of each file gives
   the true mode and depth that each split begins in.  One small row a split reaches the
   driver, which holds as much for its own file splits.
2. Each split is scanned once more, from its true beginning, and its records are cut out.

A record that goes on over the end of its split comes as fragments, which are put
together by one small shuffle; only splits that begin or end inside of a record are
scanned for them.  What a task holds is a batch of chunks and one record.

A ``Grammar`` says what the modes are and where a record ends.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import TablePrepError

MAX_SPLITS = 1 << 20
HEAD_CHARS = 1 << 20  # of a file's first record, which pass 1 brings along
RECORD, HEAD, MIDDLE, TAIL = range(4)
LAST = 1 << 62  # row of the one record of a split that goes on beyond its end


class Grammar:
    """Chunks end in ``sep``; ``closed`` says whether the separator belongs to the record.

    A scanner state is (mode, depth).  A record ends behind a chunk if the state there is
    ``at_edge``."""

    sep = "\n"
    closed = False
    modes = 1

    def step(self, chunk: str, mode: int) -> tuple[int, int]:
        """The mode after a chunk and the change of depth."""
        raise NotImplementedError

    def at_edge(self, mode, depth):
        raise NotImplementedError

    def steps(self, chunks: pa.Array, mode: int) -> tuple[np.ndarray, np.ndarray]:
        """The mode after each of ``chunks`` and the change of depth up to there."""
        modes, depths, depth = [], [], 0
        for chunk in chunks.to_pylist():
            mode, change = self.step(chunk, mode)
            depth += change
            modes.append(mode)
            depths.append(depth)
        return np.array(modes, np.int64), np.array(depths, np.int64)

    def records(self, text: str, depth: int) -> list[str]:
        """The records in what lies between two edges, from ``depth`` on."""
        return [text]

    def check_end(self, path: str, mode: int, depth: int) -> None:
        """Raise if a file can't end in this state."""


class CsvGrammar(Grammar):
    """Lines; mode 1 is the inside of a quoted field.  A quote opens a field only as its first
    character, a doubled one stands for itself, and what follows a closing quote is read up
    to the next comma."""

    modes = 2
    QUOTED = re.compile(r'[^"]*(?:""[^"]*)*')

    def step(self, chunk, mode):
        at, size = 0, len(chunk)
        while True:
            if mode or chunk.startswith('"', at):
                at = self.QUOTED.match(chunk, at if mode else at + 1).end()
                if at == size:
                    return 1, 0
                mode, at = 0, at + 1
            at = chunk.find(",", at) + 1
            if not at:
                return 0, 0

    def steps(self, chunks, mode):
        modes = np.full(len(chunks), -1, np.int64)
        quotes = np.flatnonzero(pc.match_substring(chunks, '"').to_numpy(zero_copy_only=False))
        last = 0
        for i, chunk in zip(quotes.tolist(), chunks.take(pa.array(quotes)).to_pylist()):
            modes[last:i] = mode
            mode, _ = self.step(chunk, mode)
            modes[i], last = mode, i + 1
        modes[last:] = mode
        return modes, np.zeros(len(chunks), np.int64)

    def at_edge(self, mode, depth):
        return mode == 0


class JsonGrammar(Grammar):
    """An array of objects, in chunks up to a ``}``; mode 1 is the inside of a string.  Depth
    counts brackets and braces; an element ends where the depth is 1 again."""

    sep = "}"
    closed = True
    modes = 2
    STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
    REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
    FIRST, NEXT = re.compile(r"﻿?\s*\[\s*(?=\{)"), re.compile(r"\s*,\s*(?=\{)")
    EMPTY, END = re.compile(r"﻿?\s*\[\s*\]\s*\}\Z"), re.compile(r"\s*\]\s*\}\Z")

    def step(self, chunk, mode):
        text = chunk + "}"
        if mode:
            rest = self.REST.match(text)
            if rest is None:
                return 1, 0
            text = text[rest.end():]
        if '"' in text:
            text = self.STRING.sub("", text)
            mode = int('"' in text)
            text = text.partition('"')[0]
        else:
            mode = 0
        return mode, text.count("{") + text.count("[") - text.count("}") - text.count("]")

    def at_edge(self, mode, depth):
        return (mode == 0) & (depth <= 1)

    def records(self, text, depth):
        lead = (self.NEXT if depth else self.FIRST).match(text)
        if lead is not None:
            return [text[lead.end():]]
        if (self.END if depth else self.EMPTY).match(text):
            return []
        raise ValueError(f"not an array of objects near {text[:60]!r}")

    def check_end(self, path, mode, depth):
        if (mode, depth) != (0, -1):  # the last chunk has no separator of its own
            raise TablePrepError(f"broken JSON, or not an array of objects: {path}")


class XmlGrammar(Grammar):
    """Children of the root with one tag, in chunks up to its closing tag.  Modes 1 to 3 are the
    insides of a comment, a CDATA section and an instruction; depth counts open elements."""

    closed = True
    modes = 4
    CLOSE = (None, "-->", "]]>", "?>")
    TOKEN = re.compile(r"<!--|<!\[CDATA\[|<\?|<![A-Z][^>\[]*(?:\[[^\]]*\])?\s*>|<(/?)([^\s/>!?]+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
    OPEN = {"<!--": 1, "<![CDATA[": 2, "<?": 3}

    def __init__(self, tag: str):
        self.tag, self.sep = tag, f"</{tag}>"

    def tokens(self, text: str, mode: int = 0) -> Iterator[tuple[int, int, str, int]]:
        """(begin, end, name, change of depth) of each tag; ends with the mode as (-1, -1, "", mode)."""
        at = 0
        while True:
            if mode:
                end = text.find(self.CLOSE[mode], at)
                if end < 0:
                    break
                at, mode = end + len(self.CLOSE[mode]), 0
            token = self.TOKEN.search(text, at)
            if token is None:
                break
            at = token.end()
            mode = self.OPEN.get(token.group(), 0)
            if token.group(2):
                change = -1 if token.group(1) else 0 if token.group(3).endswith("/") else 1
                yield token.start(), at, token.group(2), change
        yield -1, -1, "", mode

    def step(self, chunk, mode):
        if mode and self.CLOSE[mode] not in chunk:
            return mode, 0
        depth = 0
        for _, end, _, change in self.tokens(chunk + self.sep, mode):
            if end < 0:
                mode = change
            else:
                depth += change
        return mode, depth

    def at_edge(self, mode, depth):
        return (mode == 0) & (depth <= 1)

    def records(self, text, depth):
        out, start = [], None
        for begin, end, name, change in self.tokens(text):
            if end < 0:
                break
            if depth == 1 and change >= 0 and name == self.tag:
                start = begin
            depth += change
            if depth == 1 and start is not None:
                out.append(text[start:end])
                start = None
        return out

    def child_names(self, record: str) -> set[str]:
        """Tags right under a record's element."""
        names, depth = set(), 0
        for _, end, name, change in self.tokens(record):
            if end >= 0 and change >= 0 and depth == 1:
                names.add(name)
            depth += change if end >= 0 else 0
        return names

    def check_end(self, path, mode, depth):
        if mode or depth not in (0, -1):  # the last chunk has no separator of its own
            raise TablePrepError(f"broken XML: {path}")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray, pa.Array, pa.RecordBatch]]:
    """Batches cut where the split changes: (path, block, rows, chunks, all columns)."""
    for batch in batches:
        if not len(batch):
            continue
        path, block = batch.column("path").dictionary_encode(), batch.column("block").to_numpy()
        code = path.indices.to_numpy()
        edges = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1), len(batch)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            yield path.dictionary[code[lo]].as_py(), int(block[lo]), batch.column("row").to_numpy()[lo:hi], batch.column("value").slice(lo, hi - lo), batch.slice(lo, hi - lo)


def chunks(spark: SparkSession, paths: list[str], grammar: Grammar) -> DataFrame:
    return spark.read.option("lineSep", grammar.sep).text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value")


class Split:
    """Where a split of a file begins and ends: (mode, depth) each."""

    def __init__(self, path: str, block: int, begin: tuple[int, int], end: tuple[int, int]):
        self.path, self.block, self.begin, self.end = path, block, begin, end


def scan(spark: SparkSession, paths: list[str], grammar: Grammar) -> tuple[list[Split], dict[str, tuple]]:
    """Pass 1: the splits with their states, and each file's first record that isn't blank, if
    its first split holds it: its text (``HEAD_CHARS`` of it), split and last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, size, done = None, [], 0, True
        for path, block, rows, values, _ in _runs(batches):
            if now is None or now[:2] != (path, block):
                if now is not None:
                    yield row(now, head)
                now, head, size, done = (path, block, [(m, 0) for m in range(grammar.modes)], None), [], 0, block != 0
            ends = [grammar.steps(values, mode) for mode, _ in now[2]]
            for i in range(0 if done else len(values)):
                value = values[i].as_py()
                if head or value.strip():
                    head.append(value)
                    size += len(value)
                    if grammar.at_edge(ends[0][0][i], ends[0][1][i] + now[2][0][1]) or size > HEAD_CHARS:
                        now, done = (*now[:3], int(rows[i])), True
                        break
            now = (path, block, [(int(modes[-1]), depth + int(depths[-1])) for (modes, depths), (_, depth) in zip(ends, now[2])], now[3])
        if now is not None:
            yield row(now, head)

    def row(now, head) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]]), pa.array([now[1]]), pa.array([[m for m, _ in now[2]]], pa.list_(pa.int64())),
             pa.array([[d for _, d in now[2]]], pa.list_(pa.int64())), pa.array([grammar.sep.join(head) if head else None], pa.string()),
             pa.array([now[3]], pa.int64())], ["path", "block", "modes", "depths", "head", "head_row"])

    schema = "path string, block bigint, modes array<bigint>, depths array<bigint>, head string, head_row bigint"
    # a limit here would run the splits in waves; the driver plans each of them anyway
    rows = chunks(spark, paths, grammar).mapInArrow(run, schema).collect()
    if len(rows) > MAX_SPLITS:
        raise TablePrepError(f"the files have more than {MAX_SPLITS} splits; raise spark.sql.files.maxPartitionBytes")
    splits, state, last, heads = [], (0, 0), None, {}
    for r in sorted(rows, key=lambda r: (r["path"], r["block"])):
        if r["path"] != last:
            if last is not None:
                grammar.check_end(last, *state)
            last, state = r["path"], (0, 0)
        end = (r["modes"][state[0]], state[1] + r["depths"][state[0]])
        splits.append(Split(r["path"], r["block"], state, end))
        state = end
        if r["head_row"] is not None:
            heads[r["path"]] = r["head"], 0, r["head_row"]
    if last is not None:
        grammar.check_end(last, *state)
    return splits, heads


def _cut(spark: SparkSession, table: DataFrame, grammar: Grammar, wanted: tuple[int, ...]) -> DataFrame:
    """Pass 2: the pieces of the kinds ``wanted`` in chunks joined with the states of their splits.
    ``depth`` is where a piece begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mode, depth, held, first, begun = None, 0, 0, [], None, (True, 0)

        def piece(kind: int) -> pa.RecordBatch:
            text = grammar.sep.join(held)
            return table_of([now[0]], [now[1]], [first], [kind], [begun[1]], [text])

        def table_of(path, block, row, kind, depth, text) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(path, pa.string()), pa.array(block, pa.int64()), pa.array(row, pa.int64()), pa.array(kind, pa.int32()),
                 pa.array(depth, pa.int64()), pa.array(text, pa.string())], ["path", "block", "row", "kind", "depth", "text"])

        for path, block, rows, values, columns in _runs(batches):
            state = columns.column("mode")[0].as_py(), columns.column("depth")[0].as_py()
            if now != (path, block):
                if now is not None and held:
                    out = piece(HEAD if begun[0] else MIDDLE)
                    if out.column("kind")[0].as_py() in wanted:
                        yield out
                now, (mode, depth), held, first = (path, block), state, [], None
                begun = (bool(grammar.at_edge(mode, depth)), depth)
            modes, depths = grammar.steps(values, mode)
            depths = depths + depth
            ends = np.flatnonzero(grammar.at_edge(modes, depths))
            lo = 0
            if len(ends) and (held or not begun[0]):  # what was open ends here
                if first is None:
                    first = int(rows[0])
                held += values.slice(0, ends[0] + 1).to_pylist()
                kind = RECORD if begun[0] else TAIL
                if kind in wanted:
                    yield piece(kind)
                held, first, lo = [], None, int(ends[0]) + 1
                begun, ends = (True, int(depths[lo - 1])), ends[1:]
            if len(ends):
                stop = int(ends[-1]) + 1
                offsets = np.concatenate([[0], ends + 1 - lo]).astype(np.int32)
                if RECORD in wanted:
                    text = pc.binary_join(pa.ListArray.from_arrays(offsets, values.slice(lo, stop - lo)), grammar.sep)
                    n, at = len(ends), lo + offsets[:-1]
                    before = np.concatenate([[begun[1]], depths[ends[:-1]]])
                    yield table_of([path] * n, [block] * n, rows[at], [RECORD] * n, before, text)
                begun, lo = (True, int(depths[stop - 1])), stop
            if lo < len(values):
                if first is None:
                    first = int(rows[lo])
                held += values.slice(lo).to_pylist()
            mode, depth = int(modes[-1]), int(depths[-1])
        if now is not None and held:
            out = piece(HEAD if begun[0] else MIDDLE)
            if out.column("kind")[0].as_py() in wanted:
                yield out

    return table.mapInArrow(run, "path string, block bigint, row bigint, kind int, depth bigint, text string")


def records(spark: SparkSession, paths: list[str], grammar: Grammar, splits: list[Split]) -> DataFrame:
    """Pass 2, over the very files of pass 1: (path, block, row, depth, text), one row a piece of text between two edges.
    ``block`` is the split in which it begins and ``row`` its order there, the same in every run;
    ``Grammar.records`` starts from ``depth``."""
    open_ends = set()
    for i, s in enumerate(splits):
        inside = not grammar.at_edge(*s.begin)
        last = i + 1 == len(splits) or splits[i + 1].path != s.path
        if inside:
            open_ends.add((s.path, s.block))
        if not grammar.at_edge(*s.end):
            open_ends.add((s.path, s.block))
            if not last:
                open_ends.add((splits[i + 1].path, splits[i + 1].block))
    rows = [(s.path, s.block, *s.begin, (s.path, s.block) in open_ends) for s in splits]
    states = F.broadcast(spark.createDataFrame(rows, "s_path string, s_block bigint, mode bigint, depth bigint, open boolean"))
    source = chunks(spark, paths, grammar)
    source = source.join(states, (F.col("path") == F.col("s_path")) & (F.col("block") == F.col("s_block")), "left")
    known = F.col("mode").isNotNull() | F.raise_error(
        F.concat(F.lit("a split was not there when its state was sought (spark.sql.files.minPartitionNum keeps splits the same): "), F.col("path"))).isNotNull()
    source = source.where(known).drop("s_path", "s_block")
    columns = ["path", "block", "row", "depth", "text"]
    whole = _cut(spark, source.drop("open"), grammar, (RECORD,)).select(*columns)
    if not open_ends:
        return whole
    pieces = _cut(spark, source.where("open").drop("open"), grammar, (HEAD, MIDDLE, TAIL))
    order = Window.partitionBy("path").orderBy("block", "row")
    chained = pieces.withColumn("chain", F.sum((F.col("kind") == HEAD).cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("block", "row", "depth", "text")))
    put = chained.groupBy("path", "chain").agg(parts.alias("parts")).select(
        "path", F.col("parts")[0]["block"].alias("block"), F.lit(LAST).alias("row"), F.col("parts")[0]["depth"].alias("depth"),
        F.array_join(F.col("parts.text"), grammar.sep).alias("text"))
    return whole.unionAll(put.select(*columns))


def not_blank() -> Column:
    return F.col("text").rlike(r"[^\x00-\x20]")


def later_heads(spark: SparkSession, paths: list[str], grammar: Grammar, splits: list[Split]) -> dict[str, tuple]:
    """The first records of files whose first split doesn't hold them whole."""
    place = F.struct("block", "row")
    first = records(spark, paths, grammar, splits).where(not_blank()).groupBy("path").agg(
        F.min_by("text", place).alias("text"), F.min(place).alias("at"))
    return {r["path"]: (r["text"], *r["at"]) for r in first.collect()}


def split_records(df: DataFrame, grammar: Grammar) -> DataFrame:
    """The records inside of each piece: (path, block, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [grammar.records(t + grammar.sep, d) for t, d in zip(batch.column("text").to_pylist(), batch.column("depth").to_pylist())]
            sizes = np.fromiter(map(len, out), np.int64, len(out))
            at = pa.array(np.repeat(np.arange(len(out)), sizes))
            nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("path", "block", "row")), pa.array(nth, pa.int64()),
                 pa.array([t for x in out for t in x], pa.string())], ["path", "block", "row", "nth", "text"])

    # a piece may hold several records, so those that end in their split are numbered anew
    found = df.mapInArrow(run, "path string, block bigint, row bigint, nth bigint, text string")
    row = F.when(F.col("row") == LAST, F.col("row") + F.col("nth")).otherwise(F.monotonically_increasing_id())
    return found.select("path", "block", row.alias("row"), "text")
