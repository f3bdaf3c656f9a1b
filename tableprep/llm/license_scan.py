"""License scan: template markup compiled to automata over words.

A template is a chain of atoms -- words, and wildcards for the replaceable
regions -- plus skips over optional regions and unused wildcards.  The set of
live positions is one integer, bit i meaning "atom i comes next": a word keeps
the bits whose atom takes it, moves them up by one and follows the skips.  A
text is accepted where the bit past the last atom comes up, which needs every
mandatory word, in order, with nothing between that the template doesn't allow.

Every start word's places in the whole text are tried; the automata are
small and fixed, so a row needs its own words (as small integers) and no more.
Long texts are cut into words a piece at a time.

Defined results: a null text counts as empty; a text without words has no match
and score 0; places may overlap and all count; repeated rows give repeated
results; an empty table gives an empty table; only the named columns are read.
"""
from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_templates import BASE_PHRASES, TEMPLATES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
MARK = re.compile(r"<<(beginOptional|endOptional|var;max=(\d+))>>")
PIECE = 1 << 20

MATCHES = "array<struct<label:string,start:bigint,stop:bigint,base:boolean>>"


@dataclass
class Automaton:
    label: str
    base: bool
    size: int = 0  # atoms
    takes: dict[int, int] = field(default_factory=dict)  # word id -> bits of atoms that take it
    wild: int = 0  # bits of atoms that take any word
    skips: list[tuple[int, int]] = field(default_factory=list)  # when a bit of the first is live, so is the second
    needed: list[int] = field(default_factory=list)  # mandatory words before atom i

    def reach(self, live: int) -> int:
        for when, to in self.skips:  # in the order of their starts: one pass is enough
            if live & when:
                live |= to
        return live

    def step(self, live: int, word: int) -> int:
        hit = live & (self.wild | self.takes.get(word, 0))
        return self.reach(hit << 1) if hit else 0

    def starts(self) -> list[int]:
        first = self.reach(1)
        return [w for w, bits in self.takes.items() if bits & first]

    def run(self, words: np.ndarray, at: int) -> tuple[int, float]:
        """(end of the longest match that starts at ``at`` or -1, share of the
        mandatory words that the furthest live position has behind it)."""
        live, end, best, last = self.reach(1), -1, 0, 1 << self.size
        for i in range(at, len(words)):
            live = self.step(live, int(words[i]))
            if not live:
                break
            best = max(best, self.needed[live.bit_length() - 1])
            if live & last:
                end = i + 1
        return end, best / self.needed[-1]


def compile_template(label: str, text: str, ids: dict[bytes, int], base: bool = False) -> Automaton:
    """Compile one template; words get their numbers in ``ids``."""
    out, opened, depth, need, at = Automaton(label, base), [], 0, 0, 0

    def words(part: str) -> None:
        nonlocal need
        for w in WORD.findall(part.encode().lower()):
            n = ids.setdefault(w, len(ids) + 1)
            out.takes[n] = out.takes.get(n, 0) | 1 << out.size
            out.needed.append(need)
            out.size += 1
            need += not depth

    for m in MARK.finditer(text):
        words(text[at:m.start()])
        at = m.end()
        if m[2]:
            first, n = out.size, int(m[2])
            for i in range(first, first + n):
                out.wild |= 1 << i
                out.needed.append(need)
                out.skips.append((1 << i, 1 << i + 1))
            out.size += n
        elif m[1] == "beginOptional":
            opened.append((out.size, len(out.skips)))
            out.skips.append((0, 0))
            depth += 1
        else:
            start, k = opened.pop()
            out.skips[k] = (1 << start, 1 << out.size)
            depth -= 1
    words(text[at:])
    out.needed.append(need)
    if opened or not need or out.reach(1) & out.wild:
        raise ValueError(f"template {label!r} must close its regions and begin with a word")
    return out


class Scanner:
    """All templates, indexed by the words they can begin with."""

    def __init__(self, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]]):
        self.ids: dict[bytes, int] = {}
        found = [compile_template(k, v, self.ids, True) for k, v in phrases]
        found += [compile_template(k, v, self.ids) for k, v in templates]
        self.by_start: dict[int, list[Automaton]] = {}
        for a in found:
            for w in a.starts():
                self.by_start.setdefault(w, []).append(a)
        self.is_start = np.zeros(len(self.ids) + 1, dtype=bool)
        self.is_start[list(self.by_start)] = True

    def words(self, text: str) -> np.ndarray:
        """The words of a whole text as numbers; 0: in no template."""
        data, get, parts, at = text.encode("utf-8", "replace").lower(), self.ids.get, [], 0
        while at < len(data):
            cut = GAP.search(data, at + PIECE)
            end = cut.start() if cut else len(data)
            parts.append(np.array([get(w, 0) for w in WORD.findall(data, at, end)], dtype=np.int32))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def scan(self, words: np.ndarray) -> tuple[list[tuple[str, int, int, bool]], float]:
        hits, score = [], 0.0
        for at in np.flatnonzero(self.is_start[words]):
            for a in self.by_start[int(words[at])]:
                end, share = a.run(words, int(at))
                score = max(score, share)
                if end >= 0:
                    hits.append((a.label, int(at), end, a.base))
        return hits, score


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         phrases: Sequence[tuple[str, str]] = BASE_PHRASES,
         templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``id_col``, ``n_words``, ``matches`` (label, start word, word past the
    end, whether a plain phrase) and ``score`` (the share of a template's
    mandatory wording that the best place has; 1 for an accepted one)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases, templates)
        for frame in frames:
            rows = []
            for text in frame["text"]:
                words = scanner.words(text or "")
                hits, score = scanner.scan(words)
                rows.append((len(words), [dict(zip(("label", "start", "stop", "base"), h)) for h in hits], score))
            out = pd.DataFrame(rows, columns=["n_words", "matches", "score"])
            out.insert(0, "id", frame["id"])
            yield out

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return (src.mapInPandas(run, f"id {kind}, n_words bigint, matches {MATCHES}, score double")
            .withColumnRenamed("id", id_col))
