"""Files as documents: listing, limits, and text, Markdown and CSV parsers.

Spark lists and reads the files; the parsers are column expressions over whole texts, so they
work on texts from any source. A file beyond the limits becomes a failed row, never an error.
"""

from __future__ import annotations

import contextlib
import dataclasses
import os
import signal
import time
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from multiprocessing import Pipe
from multiprocessing.connection import Connection, wait

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T

# Extensions by kind of file, the limits of a file, and how Markdown's fences and headings begin.
KINDS = {"text": ("txt", "text", "log"), "markdown": ("md", "markdown", "mdown"), "csv": ("csv", "tsv")}
MOST_BYTES = 1 << 30
MOST_TEXT = 64 << 20
PAGE = 50
#: Processes of a task that parse files, how long one runs before it may count as waiting, and the bytes of a file that is handed to one.
HELPERS, PATIENCE, HANDED = 8, 0.02, 1 << 20
FENCE = r"^\s*(```|~~~)"
HEADING = r"^#{1,6}\s+(.*)$"


def kind_of(path: Column) -> Column:
    """The kind of a file by its extension, whatever its case; null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return reduce(lambda out, k: out.when(extension.isin(*KINDS[k]), k), list(KINDS)[1:], F.when(extension.isin(*KINDS["text"]), "text"))


def listed(spark: SparkSession, folders: list[str], files: list[str] = ()) -> DataFrame:
    """Files (path, size_bytes, kind, folder, content): those of known kinds within the folders, and each named file.

    Nothing is read for ``content`` unless a plan asks for it, and then only of the files that the plan keeps by size.
    """
    found = None
    if folders:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(folders)).select("path", "length", "content")
        found = found.where(kind_of(F.col("path")).isNotNull())
    if files:
        named = spark.read.format("binaryFile").load(list(files)).select("path", "length", "content")
        found = named if found is None else found.unionByName(named.join(found.select("path"), "path", "left_anti"))
    return found.select("path", F.col("length").alias("size_bytes"), kind_of(F.col("path")).alias("kind"), F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("folder"), "content")


def limited(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files with status and error: too large or of an unknown kind is failed, all others are queued."""
    error = F.when(F.col("kind").isNull(), "unsupported").when(F.col("size_bytes") > most_bytes, "too-large")
    return files.withColumn("error", error).withColumn("status", F.when(error.isNotNull(), "failed").otherwise("queued"))


def texts(spark: SparkSession, files: DataFrame, most_text: int = MOST_TEXT) -> DataFrame:
    """The queued files' texts (path, kind, text), a leading byte order mark removed; a text beyond the limit is null, and not read.

    Bytes that are no UTF-8 become replacement characters. Names and contents stay with the tasks.
    """
    queued = files.where("status = 'queued'")
    read = queued.where(F.col("size_bytes") <= most_text).select("path", "kind", T.without_mark(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))
    return read.unionByName(queued.where(F.col("size_bytes") > most_text).select("path", "kind", F.lit(None).cast("string").alias("text")))


@dataclasses.dataclass(frozen=True)
class Limits:
    """What one file may take; fixed values as defaults."""

    size: int = MOST_BYTES
    text: int = MOST_TEXT
    pages: int = 5000
    seconds: float = 30.0


class _Late(Exception):
    pass


@contextlib.contextmanager
def _deadline(seconds: float) -> Iterator[None]:
    """Raise within the block once the time is over. Runs in the main thread of a Python worker."""

    def ring(*_):
        raise _Late

    before = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _parsed(content: bytes, parser: Callable[[bytes], Iterable[tuple[str | None, str]]] | None, limits: Limits) -> tuple[str | None, list[tuple[str | None, str]]]:
    """The error, or the pages of one file."""
    if parser is None:
        return "unsupported", []
    pages, size = [], 0
    try:
        with _deadline(limits.seconds):
            for label, text in parser(content):
                pages.append((label, text))
                size += len(text.encode())
                if len(pages) > limits.pages:
                    return "too-many-pages", []
                if size > limits.text:
                    return "too-much-text", []
    except _Late:
        return "timeout", []
    except Exception:  # the parser is the user's: whatever it raises is that file's state
        return "unreadable", []
    return (None, pages) if any(text.strip() for _, text in pages) else ("no-text", [])


class _Helpers:
    """Processes that parse small files, one of them at work at a time: a further one begins only while all others wait (for a device, a server, their deadline) and use no core."""

    def __init__(self, parse: Callable[[str | None, bytes], tuple]):
        self.parse, self.idle, self.at_work, self.pids = parse, [], {}, {}

    def _forked(self) -> Connection:
        ours, theirs = Pipe()
        pid = os.fork()
        if not pid:
            try:
                for other in (ours, *self.pids):
                    other.close()
                while True:
                    theirs.send(self.parse(*theirs.recv()))
            except BaseException:  # the other end is gone: there is nobody to tell
                os._exit(0)
        theirs.close()
        self.pids[ours] = pid
        return ours

    @staticmethod
    def _cores_seconds(pid: int) -> float:
        return time.clock_gettime((~pid << 3) | 2)  # the clock of another process, as Linux numbers it

    def _all_wait(self) -> bool:
        now = time.monotonic()
        try:
            return all(now - began > PATIENCE and self._cores_seconds(self.pids[c]) - used < 0.5 * (now - began) for c, (_, began, used) in self.at_work.items())
        except OSError:
            return False

    def parsed(self, files: Iterable[tuple[str | None, bytes]]) -> list[tuple]:
        """What ``parse`` makes of each file, in their order."""
        files, made, k = list(files), {}, 0
        while len(made) < len(files):
            if k < len(files) and (not self.at_work or (len(self.at_work) < HELPERS and len(files[k][1] or b"") <= HANDED and self._all_wait())):
                if len(files[k][1] or b"") > HANDED:
                    made[k] = self.parse(*files[k])
                else:
                    helper = self.idle.pop() if self.idle else self._forked()
                    try:
                        used = self._cores_seconds(self.pids[helper])
                    except OSError:
                        used = 0.0
                    self.at_work[helper] = (k, time.monotonic(), used)
                    helper.send(files[k])
                k += 1
            more = k < len(files) and len(self.at_work) < HELPERS
            for helper in wait(list(self.at_work), PATIENCE if more else None) if self.at_work else ():
                made[self.at_work.pop(helper)[0]] = helper.recv()
                self.idle.append(helper)
        return [made[i] for i in range(len(files))]

    def close(self) -> None:
        for helper, pid in self.pids.items():
            helper.close()
            with contextlib.suppress(OSError):
                os.kill(pid, signal.SIGKILL)
            with contextlib.suppress(OSError):
                os.waitpid(pid, 0)
        self.idle, self.at_work, self.pids = [], {}, {}


def parsed(files: DataFrame, parsers: dict[str, Callable[[bytes], Iterable[tuple[str | None, str]]]], limits: Limits = Limits()) -> DataFrame:
    """Files with status, error and pages (label, text), by the parser of each kind within the limits of a file.

    Every file gives one row. Errors: ``too-large`` (not read at all), ``unsupported``, ``unreadable``
    (whatever the parser raises), ``timeout``, ``too-many-pages``, ``too-much-text`` and ``no-text``;
    a failed file has no pages. A parser gives its pages one by one, so one that goes on for ever is
    stopped by a limit. While the files at hand wait, further ones are read: a task never needs more
    than one core for them, and deadlines overlap.
    """
    schema = "path string, size_bytes long, kind string, status string, error string, pages array<struct<label: string, text: string>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        helpers = _Helpers(lambda kind, content: _parsed(content, parsers.get(kind), limits))
        try:
            for frame in frames:
                made = helpers.parsed(zip(frame.kind, frame.content, strict=True))
                rows = [(path, size, kind, "failed" if error else "parsed", error, [{"label": a, "text": b} for a, b in pages]) for path, size, kind, (error, pages) in zip(frame.path, frame.size_bytes, frame.kind, made, strict=True)]
                yield pd.DataFrame(rows, columns=["path", "size_bytes", "kind", "status", "error", "pages"])
        finally:
            helpers.close()

    small = files.where(F.col("size_bytes") <= limits.size).select("path", "size_bytes", "kind", "content").mapInPandas(run, schema)
    large = files.where(F.col("size_bytes") > limits.size)
    return small.unionByName(large.select("path", "size_bytes", "kind", F.lit("failed").alias("status"), F.lit("too-large").alias("error"), F.array().cast("array<struct<label: string, text: string>>").alias("pages")))


def text_segments(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Plain texts, one segment each; none for a blank text."""
    return rows.select(key, F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("label"), T.without_mark(F.col("text")).alias("text")).where(T.stripped(F.col("text")) != "")


def markdown_segments(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections (key, ordinal, label, text) of Markdown texts.

    A heading outside fences begins a section and names it; text before the first one has no name.
    """
    lines = rows.select(key, F.posexplode(F.split(T.without_mark(F.col("text")), r"\r?\n")).alias("pos", "line"))
    order = W.partitionBy(key).orderBy("pos")
    fence = F.col("line").rlike(FENCE)
    open_ = F.coalesce(F.sum(F.col("fence").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    lines = lines.withColumn("fence", fence).withColumn("heading", ~F.col("fence") & ~open_ & F.col("line").rlike(HEADING))
    lines = lines.withColumn("section", F.sum(F.col("heading").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    label = F.max(F.when(F.col("heading"), T.stripped(F.regexp_extract("line", HEADING, 1))))
    parts = lines.groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"), label.alias("label"))
    parts = parts.select(key, "section", F.nullif("label", F.lit("")).alias("label"), T.stripped(F.array_join("x.line", "\n")).alias("text")).where("text <> ''")
    return parts.select(key, (F.row_number().over(W.partitionBy(key).orderBy("section")) - 1).alias("ordinal"), "label", "text")


def csv_records(text: Column, delimiter: str = ",") -> Column:
    """The records of a CSV text as arrays of trimmed cells; empty lines are skipped."""
    record = r'((?:"(?:[^"]++|"")*+"|[^"\r\n]++|")*+)(?:\r\n|\n|\r|$)'
    d = F.lit(delimiter)
    cell = rf'[{delimiter}](?:("(?:[^"]++|"")*+"[^{delimiter}]*+)|([^{delimiter}]*+))'

    def cells(line: Column) -> Column:
        raw = F.regexp_extract_all(F.concat(d, line), F.lit(cell), F.lit(0))
        plain = F.transform(raw, lambda c: F.substr(c, F.lit(2)))
        quoted = lambda c: F.replace(F.regexp_replace(c, r'(?s)^"(.*)"[^"]*$', "$1"), F.lit('""'), F.lit('"'))
        return F.transform(plain, lambda c: T.stripped(F.when(c.startswith('"'), quoted(c)).otherwise(c)))

    return F.transform(F.filter(F.regexp_extract_all(T.without_mark(text), F.lit(record), F.lit(1)), lambda line: line != ""), cells)


def csv_text(rows: Column) -> Column:
    """CSV records (a column of them, which is read many times) as lines of ``header: value; ...``; cells beyond the header are named by their column."""
    head = F.element_at(rows, 1)

    def line(row: Column) -> Column:
        cell = lambda i: F.coalesce(F.get(row, i), F.lit(""))
        name = lambda i: F.get(head, i)
        pair = lambda i: F.when(i < F.size(head), F.when((cell(i) != "") | (name(i) != ""), F.concat(name(i), F.lit(": "), cell(i)))).when(cell(i) != "", F.concat(F.lit("col"), (i + 1).cast("string"), F.lit(": "), cell(i)))
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(head), F.size(row)) - 1), pair)
        return F.array_join(F.filter(pairs, lambda p: p.isNotNull()), "; ")

    named = (F.size(rows) > 1) & F.exists(head, lambda h: h != "")
    lines = F.when(named, F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)).otherwise(F.transform(rows, lambda r: F.array_join(r, ", ")))
    return F.when(F.size(rows) > 0, T.stripped(F.array_join(lines, "\n"))).otherwise(F.lit(""))


def csv_segments(rows: DataFrame, delimiter: str = ",", key: str = "doc_id") -> DataFrame:
    """CSV texts, one segment each."""
    parsed = rows.select(key, F.explode(F.array(csv_records(F.col("text"), delimiter))).alias("_records"))  # so that it is made once
    return parsed.select(key, F.lit(0).alias("ordinal"), F.lit(None).cast("string").alias("label"), csv_text(F.col("_records")).alias("text")).where("text <> ''")


def segments(spark: SparkSession, files: DataFrame) -> DataFrame:
    """All segments (path, ordinal, label, text) of the queued files, each by the parser of its kind."""
    rows = texts(spark, files).where(F.col("text").isNotNull())
    tabs = F.lower("path").endswith(".tsv")
    parts = [text_segments(rows.where("kind = 'text'"), "path"), markdown_segments(rows.where("kind = 'markdown'"), "path")]
    parts += [csv_segments(rows.where((F.col("kind") == "csv") & ~tabs), ",", "path"), csv_segments(rows.where((F.col("kind") == "csv") & tabs), "\t", "path")]
    return reduce(DataFrame.unionByName, parts)


def preview(segments_: DataFrame, page: int, key: str = "doc_id", size: int = PAGE) -> DataFrame:
    """One page (from 0) of each document's segments, with how many pages there are."""
    rows = segments_.withColumn("pages", F.ceil(F.count("*").over(W.partitionBy(key)) / size).cast("int"))
    return rows.where((F.col("ordinal") >= page * size) & (F.col("ordinal") < (page + 1) * size))
