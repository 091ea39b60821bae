"""CSV records of files too large for one task, with line breaks inside quoted fields.

Lines are read in ordinary file splits. What a line does depends on the lines before it only through
one bit: whether it starts inside quotes. So each line is a function of that bit, by the parser's own
rule (a quote opens a field only at the field's start, and elsewhere in an unquoted field is plain
text); each split is the composition of its lines, one short row; and composing these over a file says
for every split whether it starts inside quotes. A second scan cuts the records. Only a record that
crosses a split border is put together from several splits; no other text moves.

Both scans follow one plan: they run at once, in a session of their own in which the size of a split is
a setting alone, so neither the executors present nor a later change of settings moves a border. A split that the
first scan did not see fails the second one. The records are written before anyone uses them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelake.sources.staging import stage

LONGEST_RECORD = (1 << 31) - 1  # bytes; no text of Spark is longer
_DETECTED_IN = 1 << 20  # the parser looks for the line separator in so many bytes
_SPLIT_SIZE = "spark.sql.files.maxPartitionBytes"
_FIELD_START, _PLAIN, _QUOTED, _QUOTE_SEEN = range(4)
_FLAGS = ("from_out", "from_in", "filled", "cr")
_SUMMARY = "file_id long, block long, length long, size long, bytes long, " + ", ".join(f"{f} boolean" for f in _FLAGS)
_PIECES = "file string, block long, record long, text string, head boolean, tail boolean, open boolean"


def planned_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of `spark` in which files are split into equal ranges of the present split size.

    Spark makes splits smaller when there are more cores than splits, but never below the cost of opening a
    file; with that as large as a split, borders depend on the files alone.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.get(name, None) != value:
            own.conf.set(name, value)
    own.conf.set("spark.sql.files.openCostInBytes", spark.conf.get(_SPLIT_SIZE))
    return own


def _ends_inside(value: Column, inside: bool) -> Column:
    """Whether a line that starts inside quotes or not ends inside them."""
    parts = F.split(value, '"')

    def text(state: Column, part: Column) -> Column:
        moved = F.when(F.endswith(part, F.lit(",")), F.lit(_FIELD_START)).otherwise(F.lit(_PLAIN))
        return F.when((part == "") | (state == _QUOTED), state).otherwise(moved)

    def quote(state: Column) -> Column:
        opened = F.when((state == _FIELD_START) | (state == _QUOTE_SEEN), F.lit(_QUOTED))
        return opened.when(state == _QUOTED, F.lit(_QUOTE_SEEN)).otherwise(F.lit(_PLAIN))

    first = text(F.lit(_QUOTED if inside else _FIELD_START), parts[0])
    # The state after a quote is kept apart, so each step reads its part once.
    last = F.aggregate(F.slice(parts, 2, F.size(parts)), first, lambda state, part: text(quote(state), part))
    return F.when(F.contains(value, F.lit('"')), last == _QUOTED).otherwise(F.lit(inside))


def _ends_with_returns(spark: SparkSession, files: Iterable[str]) -> list[str]:
    """Those of the files whose first line break, as the parser looks for it, is a carriage return alone."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for file in files:
        path = jvm.org.apache.hadoop.fs.Path(file)
        system = path.getFileSystem(conf)
        size = min(_DETECTED_IN, system.getFileStatus(path).getLen())
        stream = system.open(path)
        try:
            first = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(size))) if size else b""
        finally:
            stream.close()
        at = first.find(b"\r")
        if at >= 0 and b"\n" not in first[: at + 2]:
            found.append(file)
    return found


def _scan(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    lines = spark.read.option("lineSep", separator).text(paths)
    # In a file of carriage returns a line feed is a line break as well: inside quotes, where alone it may
    # stand (elsewhere the parser's answer hangs on its buffers), that makes no difference to the value.
    value = F.col("value") if separator == "\n" else F.explode(F.split("value", "\n", -1))
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.xxhash64("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("length"),
        F.col("_metadata.file_size").alias("size"),
        value.alias("value"),
    )
    return lines.withColumns({"from_out": _ends_inside(F.col("value"), False), "from_in": _ends_inside(F.col("value"), True)})


def _lines(spark: SparkSession, path: str) -> list[DataFrame]:
    """The lines of all files, in one frame for each way they end lines."""
    files = spark.read.text(path).inputFiles()
    returns = _ends_with_returns(spark, files)
    if not returns:
        return [_scan(spark, path, "\n")]
    others = [f for f in files if f not in set(returns)]
    return [_scan(spark, returns, "\r"), *([_scan(spark, others, "\n")] if others else [])]


def _segments(ids: np.ndarray, blocks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where the rows of a split begin and end."""
    borders = np.flatnonzero((np.diff(ids) != 0) | (np.diff(blocks) != 0)) + 1
    ends = [0, *borders.tolist(), len(ids)]
    return ((a, b) for a, b in zip(ends, ends[1:]) if a < b)


def _summaries(lines: DataFrame) -> list:
    """One row per split: its function, its bytes, whether it has text, and whether its first line ends in a carriage return."""
    columns = _SUMMARY.split(", ")
    names, types = [c.split()[0] for c in columns], [pa.int64() if c.endswith("long") else pa.bool_() for c in columns]

    def run(batches):
        splits: dict[tuple, list] = {}
        for batch in batches:
            ids, blocks, lengths, sizes, n_bytes, outs, ins, empty, cr = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for a, b in _segments(ids, blocks):
                key = tuple(int(x[a]) for x in (ids, blocks, lengths, sizes))
                own = splits.setdefault(key, [0, False, True, False, bool(cr[a])])
                own[0] += int(n_bytes[a:b].sum())
                for i in np.flatnonzero(outs[a:b] | ~ins[a:b].astype(bool)) + a:
                    after = (bool(outs[i]), bool(ins[i]))
                    own[1], own[2] = after[own[1]], after[own[2]]
                own[3] = own[3] or not bool(empty[a:b].all())
        yield _batch([(*key, *own) for key, own in splits.items()], names, types)

    flags = lines.select(
        "file_id",
        "block",
        "length",
        "size",
        (F.octet_length("value") + 1).cast("long").alias("bytes"),
        "from_out",
        "from_in",
        F.rtrim("value", F.lit("\r")).eqNullSafe("").alias("empty"),
        F.endswith("value", F.lit("\r")).alias("cr"),
    )
    return flags.mapInArrow(run, _SUMMARY).collect()


@dataclass
class _File:
    """What the cutting scan needs to know of a file; `blocks` are ascending."""

    crlf: bool = False
    header_block: int = -1
    blocks: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)
    #: What stands behind the last line of a file that ends inside quotes.
    end: str | None = None

    def starts_inside(self, block: int, length: int) -> bool:
        at = bisect_right(self.blocks, block) - 1
        if at < 0 or (self.blocks[at], self.lengths[at]) != (block, length):
            raise ValueError(f"the range at {block} of {length} bytes is not one of the planned ranges")
        return self.inside[at]


def _files(summaries: list) -> dict[int, _File]:
    """Compose the splits of each file; the list has a row per split, as the plan of the scan has."""
    files: dict[int, _File] = {}
    state: dict[int, bool] = {}
    missing: dict[int, int] = {}
    for s in sorted(summaries, key=lambda r: (r["file_id"], r["block"])):
        own = files.setdefault(s["file_id"], _File())
        if not own.blocks:
            own.crlf = s["cr"]
        if s["filled"] and own.header_block < 0:
            own.header_block = s["block"]
        inside = state.get(s["file_id"], False)
        own.blocks.append(s["block"])
        own.lengths.append(s["length"])
        own.inside.append(inside)
        state[s["file_id"]] = s["from_in"] if inside else s["from_out"]
        missing[s["file_id"]] = missing.get(s["file_id"], s["size"]) - s["bytes"]
    for file_id, inside in state.items():
        # Each line was counted with a break; a mark of three bytes at the start of a file is not part of a line.
        files[file_id].end = ("\n" if missing[file_id] in (0, 3) else "") if inside else None
    return files


class _Cutter:
    """Cuts the lines of one split after another into records.

    A record that begins in this split has its number among them, one that goes on from an earlier split -1,
    the first record of a file, its header, -2.
    """

    def __init__(self, files: dict[int, _File]):
        self._files = files
        self._key: tuple[str, int] | None = None
        self._body: list[str] = []

    def start(self, file: str, file_id: int, block: int, length: int) -> None:
        if self._key != (file, block):
            self._own = self._files[file_id]
            self._inside = self._head = self._own.starts_inside(block, length)
            self._key, self._block, self._record, self._size = (file, block), block, 0, 0
            self._header = block == self._own.header_block

    def cut(self, values: pa.StringArray, outs: np.ndarray, ins: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self._own.crlf:
            values = pc.replace_substring_regex(values, r"\r\z", "")
        after = np.empty(len(values), bool)
        state, done = self._inside, 0
        for i in np.flatnonzero(outs | ~ins).tolist():
            after[done:i] = state
            after[i] = state = bool(ins[i] if state else outs[i])
            done = i + 1
        after[done:] = state
        self._inside = state
        ends = np.flatnonzero(~after)
        firsts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        several = np.flatnonzero(firsts != ends).tolist()
        if len(ends) and (self._body or self._head) and not (several and several[0] == 0):
            several.insert(0, 0)
        done = 0
        for at in several:
            yield self._singles(values, ends[done:at])
            self._grow(values.slice(firsts[at], ends[at] + 1 - firsts[at]).to_pylist())
            yield self._close(False)
            done = at + 1
        yield self._singles(values, ends[done:])
        rest = int(ends[-1]) + 1 if len(ends) else 0
        self._grow(values.slice(rest).to_pylist())

    def finish(self) -> Iterator[pa.RecordBatch]:
        """The record that the split ends in, if it does not end between two."""
        if self._key is None or not (self._body or self._head):
            return
        last = self._block == self._own.blocks[-1] and self._own.end is not None
        yield self._close(not last, self._own.end if last else None)

    def _grow(self, lines: list[str]) -> None:
        self._body += lines
        self._size += sum(map(len, lines)) + len(lines)
        if self._size > LONGEST_RECORD:
            raise ValueError(f"a record of {self._key[0]} is longer than {LONGEST_RECORD} characters")

    def _singles(self, values: pa.StringArray, at: np.ndarray) -> pa.RecordBatch:
        """Records of one line each; empty lines are none."""
        texts = values.take(pa.array(at))
        texts = texts.filter(pc.not_equal(texts, ""))
        numbers = self._record + np.arange(len(texts))
        if self._header and len(texts):
            self._header = False
            numbers = np.concatenate(([-2], numbers[:-1]))
        self._record = int(numbers[-1]) + 1 if len(numbers) and numbers[-1] >= 0 else self._record
        return self._rows(texts, numbers, False, False, False)

    def _close(self, tail: bool, end: str | None = None) -> pa.RecordBatch:
        text = "\n".join(self._body) + (end or "")
        number = -1 if self._head else -2 if self._header else self._record
        self._header = self._header and self._head
        self._record += number >= 0
        made = self._rows(pa.array([text]), np.array([number]), self._head, tail, end is not None)
        self._body, self._size, self._head = [], 0, False
        return made

    def _rows(self, texts: pa.Array, numbers: np.ndarray, head: bool, tail: bool, open_: bool) -> pa.RecordBatch:
        n = len(texts)
        same = [pa.array(np.full(n, x)) for x in (head, tail, open_)]
        file, block = pa.array([self._key[0]] * n, pa.string()), pa.array(np.full(n, self._key[1], np.int64))
        columns = [file, block, pa.array(numbers.astype(np.int64)), pc.cast(texts, pa.string()), *same]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _PIECES.split(", ")])


def _cut(lines: DataFrame, files: dict[int, _File]) -> DataFrame:
    """Records, numbered within the split they start in; `head` and `tail` mark parts of longer ones.

    `open` marks one that the end of the file leaves inside quotes.
    """
    shared = lines.sparkSession.sparkContext.broadcast(files)

    def run(batches):
        cutter, split = _Cutter(shared.value), None
        for batch in batches:
            ids, blocks, lengths, outs, ins = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("file_id", "block", "length", "from_out", "from_in")
            )
            for a, b in _segments(ids, blocks):
                if split not in (None, (ids[a], blocks[a])):
                    yield from cutter.finish()
                split = ids[a], blocks[a]
                cutter.start(batch.column("file")[a].as_py(), int(ids[a]), int(blocks[a]), int(lengths[a]))
                yield from cutter.cut(batch.column("value").slice(a, b - a), outs[a:b].astype(bool), ins[a:b].astype(bool))
        yield from cutter.finish()

    columns = ("file", "file_id", "block", "length", "value", "from_out", "from_in")
    return lines.select(*columns).mapInArrow(run, _PIECES)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def _joined(parts: DataFrame) -> DataFrame:
    """Put the parts of records together that cross split borders; there are at most two parts per split."""
    earlier = Window.partitionBy("file").orderBy("block", "record").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(~F.col("head"), F.struct("block", "record"))
    owned = parts.withColumn("owner", F.last(start, ignorenulls=True).over(earlier))
    text = F.array_join(F.sort_array(F.collect_list(F.struct("block", "text")))["text"], "\n")
    whole = owned.groupBy("file", "owner").agg(text.alias("text"), F.bool_or("open").alias("open"))
    return whole.select("file", "owner.block", "owner.record", "text", "open")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, block, record, text, open. `record` counts within the split; headers have -2.

    `open` marks a record that the end of its file leaves inside quotes. The records are a written table,
    cut when this is called.
    """
    frames = _lines(planned_session(spark), path)
    pieces = stage(reduce(DataFrame.unionByName, [_cut(f, _files(_summaries(f))) for f in frames]), "records", spark)
    crossing = F.col("head") | F.col("tail")
    columns = ["file", "block", "record", "text", "open"]
    if pieces.filter(crossing).isEmpty():
        return pieces.select(*columns)
    return pieces.filter(~crossing).select(*columns).unionByName(_joined(pieces.filter(crossing)))
