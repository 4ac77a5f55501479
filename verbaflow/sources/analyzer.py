"""External analyzers: a process that reads lines and writes records, one for each task, started when first needed.

A connector sends lines, reads what comes until the protocol's end mark, and hands the answers on as an array for
operators.records to parse. One thread writes while another reads: up to WINDOW lines are on their way at once, and answers
belong to lines by their order. A process that dies, or doesn't answer in time, is started again and gets the lines that it has
not answered yet; when it ends again and again at one line, the task fails and Spark tries it elsewhere.
"""

from __future__ import annotations

import contextlib
import os
import subprocess
import tempfile
import threading
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import string_pieces
from ..operators.records import freeling_input, lemma_without_source, mecab_input
from . import freeling as configuration

RESTARTS = 3
#: Seconds that an analyzer may take to answer one line.
PATIENCE = 60.0
#: Lines that may be unanswered at once.
WINDOW = 64
#: Rows whose answers a task holds at once.
AT_ONCE = 256


class ProcessError(OSError):
    """The analyzer can't be started, or ended before it answered."""


class MeCabError(ProcessError):
    """The same of MeCab."""


class FreeLingError(ProcessError):
    """The same of FreeLing."""


@dataclass(frozen=True)
class Protocol:
    """command: argument list; end: the line that ends an answer; hint: what to say if it can't be started; error: what is
    raised; files: (name, content) that the process needs, written to a folder of its own, which {dir} in the command names;
    patience: seconds to wait for the answer to a line."""

    command: tuple[str, ...]
    end: str
    hint: str = ""
    error: type[ProcessError] = ProcessError
    files: tuple[tuple[str, str], ...] = ()
    patience: float = PATIENCE


def mecab(command: tuple[str, ...] = ("mecab",)) -> Protocol:
    return Protocol(command, "EOS", "is MeCab installed?", MeCabError)


def freeling(lang: str, config_dir: str | None = None, command: tuple[str, ...] = ("analyze",)) -> Protocol:
    """With the configuration files in config_dir, or with this library's own."""
    files = () if config_dir else configuration.files(lang)
    names = (f"{config_dir or '{dir}'}/{lang}.cfg", "--fsplit", f"{config_dir or '{dir}'}/generic_splitter.dat")
    if lang not in configuration.LANGUAGES:
        raise ValueError(f"no configuration for language {lang!r}")
    return Protocol((*command, "-f", *names), "", "is FreeLing installed?", FreeLingError, files)


class Process:
    """One running analyzer; it starts with the first request and again after it has died or was too slow."""

    def __init__(self, protocol: Protocol, restarts: int = RESTARTS, window: int = WINDOW):
        self.protocol, self.restarts, self.window, self.process, self.folder = protocol, restarts, window, None, None

    def _start(self) -> subprocess.Popen:
        if self.protocol.files and self.folder is None:
            self.folder = tempfile.TemporaryDirectory()  # of this process only
            for name, content in self.protocol.files:
                with open(os.path.join(self.folder.name, name), "w", encoding="utf-8") as f:
                    f.write(content)
        command = [c.replace("{dir}", self.folder.name) if self.folder else c for c in self.protocol.command]
        try:
            return subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, close_fds=True)
        except OSError as e:
            raise self.protocol.error(f"can't start {command[0]}: {e}; {self.protocol.hint}") from e

    def close(self) -> None:
        if self.process:
            process, self.process = self.process, None
            with contextlib.suppress(OSError):
                process.stdin.close()
            process.stdout.close()
            process.kill()
            process.wait()

    def _answers(self, lines: list[str], done: list[list[str]]) -> None:
        """Adds the answers to lines to done, one after the other."""
        process = self.process = self.process or self._start()
        free, over, heard = threading.Semaphore(self.window), threading.Event(), [time.monotonic()]

        def write() -> None:
            with contextlib.suppress(OSError, ValueError):  # the reader sees that the process has ended
                for line in lines:
                    free.acquire()
                    if over.is_set():
                        return
                    process.stdin.write(line.encode() + b"\n")
                    process.stdin.flush()

        def watch() -> None:
            while not over.wait(min(1.0, self.protocol.patience / 4)):
                if time.monotonic() - heard[0] > self.protocol.patience:
                    process.kill()

        threads = [threading.Thread(target=f, daemon=True) for f in (write, watch)]
        for t in threads:
            t.start()
        try:
            for _ in lines:
                out: list[str] = []
                while (answer := process.stdout.readline()) and (said := answer.decode().rstrip("\n")) != self.protocol.end:
                    out.append(said)
                if not answer:
                    raise self.protocol.error("reached the end of output, or waited too long for it")
                done.append(out)
                heard[0] = time.monotonic()
                free.release()
        except (OSError, ValueError) as e:
            process.kill()  # so that the writer ends too
            raise e if isinstance(e, ProcessError) else self.protocol.error("the analyzer has ended") from e
        finally:
            over.set()
            free.release()
            for t in threads:
                t.join()

    def ask_each(self, lines: list[str]) -> list[list[str]]:
        """The answer to each line. After a restart only lines without an answer are sent, so none is lost or answered twice; the
        number of restarts that is left counts from the last answer on."""
        done: list[list[str]] = []
        left = self.restarts
        while len(done) < len(lines):
            before = len(done)
            try:
                self._answers(lines[before:], done)
            except ProcessError:
                self.close()
                left = self.restarts if len(done) > before else left
                if not left:
                    raise
                left -= 1
        return done

    def ask(self, lines: list[str]) -> list[str]:
        """The answers to all lines of a text, one after the other."""
        return [said for answer in self.ask_each(lines) for said in answer]


def analyzed(docs: DataFrame, protocol: Protocol, lines_column: str, into: str = "lines", restarts: int = RESTARTS) -> DataFrame:
    """docs with a further column, array<string>: the analyzer's output for the array of lines in lines_column."""
    return analyzed_by(docs.withColumn("__by", F.lit("")), {"": protocol}, "__by", lines_column, into, restarts).drop("__by")


def analyzed_by(docs: DataFrame, protocols: Mapping[str, Protocol], by: str, lines_column: str, into: str = "lines", restarts: int = RESTARTS) -> DataFrame:
    """The same with an analyzer chosen by the column `by`; rows that there is none for get null. All languages go through one pass
    of a table: a task has a process for each that its rows ask for."""
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        processes: dict[str, Process] = {}
        try:
            for batch in (some.iloc[low : low + AT_ONCE].copy() for some in batches for low in range(0, len(some), AT_ONCE)):
                said: list[list[str] | None] = [None] * len(batch)
                rows: dict[str, list[tuple[int, list[str]]]] = {}
                for i, (which, lines) in enumerate(zip(batch[by], batch[lines_column], strict=True)):
                    if which in protocols and lines is not None:
                        rows.setdefault(which, []).append((i, list(lines)))
                for which, asked in rows.items():
                    process = processes.setdefault(which, Process(protocols[which], restarts))
                    answers = iter(process.ask_each([line for _, lines in asked for line in lines]))
                    for i, lines in asked:
                        said[i] = [x for _ in lines for x in next(answers)]
                batch[into] = said
                yield batch
        finally:
            for process in processes.values():
                process.close()
                if process.folder:
                    process.folder.cleanup()

    return docs.mapInPandas(run, schema)


def mecab_pieces(text: Column) -> Column:
    """The lines that a MeCab process is given: pieces that it can take."""
    return string_pieces(mecab_input(text))


def analyzed_by_mecab(docs: DataFrame, protocol: Protocol | None = None, text: str = "text") -> DataFrame:
    """docs with a column lines, the output for text, which is sent in pieces that the analyzer can take."""
    return analyzed(docs.withColumn("__pieces", mecab_pieces(F.col(text))), protocol or mecab(), "__pieces").drop("__pieces")


def analyzed_by_freeling(docs: DataFrame, protocol: Protocol, text: str = "text") -> DataFrame:
    return analyzed(docs.withColumn("__pieces", freeling_input(F.col(text))), protocol, "__pieces").drop("__pieces")


def with_retries(call: Callable, errors: tuple = (OSError,), tries: int = 5, wait: float = 1.0) -> Callable:
    """call, tried again after a pause where it raises one of errors, a bounded number of times."""

    def again(*args):
        for n in range(tries):
            try:
                return call(*args)
            except errors:
                if n == tries - 1:
                    raise
                time.sleep(wait * 2**n)

    return again


def remote_lemmas(docs: DataFrame, call: Callable[[str], list[str]], text: str = "text", into: str = "lemmas", tries: int = 5, wait: float = 1.0) -> DataFrame:
    """docs with a further column: the lemmas that call, a remote analyzer's client, gives for text, each without its source
    and with spaces between. A call that fails is tried again; a null text isn't sent."""
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = with_retries(call, tries=tries, wait=wait)
        for batch in batches:
            batch[into] = [None if x is None else ask(x) for x in batch[text]]
            yield batch

    return docs.mapInPandas(run, schema).withColumn(into, F.array_join(F.transform(into, lemma_without_source), " "))


def asked_words(words: DataFrame, call: Callable[[str], list[str]], at_once: int = 4, per_second: float = 10.0, tries: int = 5, wait: float = 1.0) -> DataFrame:
    """words(word) to word, lemma: what call, a remote analyzer's client, says of each, its parts with spaces between and without
    their sources. `at_once` tasks ask, which together make `per_second` calls at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, pause, due = with_retries(call, tries=tries, wait=wait), at_once / per_second, time.monotonic()
        for batch in batches:
            said = []
            for word in batch["word"]:
                time.sleep(max(0.0, due - time.monotonic()))
                due = max(due, time.monotonic()) + pause
                said.append(ask(word))
            batch["lemma"] = said
            yield batch

    rows = words.select("word").repartition(at_once, "word").mapInPandas(run, "word string, lemma array<string>")
    return rows.withColumn("lemma", F.array_join(F.transform("lemma", lemma_without_source), " "))
