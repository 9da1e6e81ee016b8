"""Byte-level BPE files: reading one, and cutting texts into words as its library does."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import SparkSession

from skerry.llm import splitter
from skerry.llm.automaton import MergeAutomaton

#: Rows of an Arrow batch whose texts are held as strings at a time.
SLICE = 1024
#: Characters that are split at a time.
SECTION = 1 << 20


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_vocabulary(spark: SparkSession, path: str | None = None):
    """The file's bytes as a broadcast variable; its size is that of one vocabulary.

    Read on the driver, so executors need no copy of the file.
    """
    with open(path or vocabulary_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(maxsize=2)
def compiled(content: bytes) -> "Compiled":
    """One compiled automaton for each file and Python worker."""
    return Compiled(content)


class Compiled:
    """An automaton with the splitting around it and a bounded memory of words.

    ``remembered``: words kept for each purpose; the memory is emptied when full,
    and words are then run again.
    """

    def __init__(self, content: bytes, remembered: int = 150_000):
        self.automaton = MergeAutomaton(content)
        self.remembered = remembered
        self.counts: dict[str, int] = {}
        self.codes: dict[str, bytes] = {}
        names = sorted(self.automaton.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """(is special, string) in order: added special tokens are cut out first."""
        if self.special is None or not self.special.search(text):
            return [(False, text)]
        return [(i % 2 == 1, part) for i, part in enumerate(self.special.split(text)) if part]

    def words(self, texts: list[str]) -> Iterator[tuple[int, list[str]]]:
        """(place of the text, words) of texts without special tokens; a long text comes in several parts."""
        run: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            if run and held + len(text) > SECTION:
                yield from zip(run, splitter.split([texts[k] for k in run]), strict=True)
                run, held = [], 0
            if len(text) > SECTION:
                yield from ((i, some) for some in splitter.sections(text, SECTION))
            else:
                run.append(i)
                held += len(text)
        yield from zip(run, splitter.split([texts[k] for k in run]), strict=True)

    def over_words(self, texts: list[str], memory: dict, run) -> Iterator[tuple[int, list]]:
        """``words``, each replaced by what ``run`` makes of it; words new to ``memory`` run side by side."""
        group: list[tuple[int, list[str]]] = []
        held = 0
        for i, words in self.words(texts):
            group.append((i, words))
            held += len(words)
            if held > SECTION // 4:
                yield from self._learnt(group, memory, run)
                group, held = [], 0
        yield from self._learnt(group, memory, run)

    def _learnt(self, group: list[tuple[int, list[str]]], memory: dict, run) -> Iterator[tuple[int, list]]:
        self.learn([words for _, words in group], memory, run)
        for i, words in group:
            yield i, list(map(memory.__getitem__, words))

    def learn(self, lists: list[list[str]], memory: dict, run) -> None:
        """Put every word of the lists into ``memory``."""
        new: set[str] = set()
        for words in lists:
            new.update(words)
        new -= memory.keys()
        if len(memory) + len(new) > self.remembered:
            memory.clear()
            new = set().union(*lists)
        fresh = list(new)
        memory.update(zip(fresh, run([w.encode() for w in fresh]), strict=True))


def batches(texts: list[str | None], size: int = 1 << 21):
    """Runs of texts of about ``size`` characters at most, so that lists of words stay small."""
    run: list[str] = []
    held = 0
    for text in texts:
        if run and held + len(text or "") > size:
            yield run
            run, held = [], 0
        run.append(text or "")
        held += len(text or "")
    if run:
        yield run
