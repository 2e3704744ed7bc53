"""Spelling variants: words one edit apart, found with forward and backward minimal acyclic automata."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import UPPER, saved, table
from gradeloom.llm.pieces import slices

#: Runs of letters; one of so many words of a document loses a letter; least length and occurrences of a word; how often the form must occur for each occurrence of the word.
RUN, SLIP, LENGTH, LEAST, TIMES = re.compile("[A-Za-zÀ-ÿ]+"), 97, 5, 3, 2
#: Words of one automaton at most.
DICTIONARY = 50_000

_LOWER = str.maketrans(UPPER, UPPER.lower())


class Automaton:
    """A minimal acyclic automaton over sorted distinct words, whose paths number them in that order.

    A state is [edges, words from here, whether a word ends here, sum of words before each edge]. States
    with equal endings are one, so common endings are kept once; a word's number is the count of words that
    its path passes by (a minimal perfect hash), and so no word is stored at its end.
    """

    def __init__(self, words: list[str]):
        self.register: dict[tuple, list] = {}
        path: list[tuple[dict, list[bool]]] = [({}, [False])]
        last = ""
        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            self._settle(path, last, same)
            path += [({}, [False]) for _ in word[same:]]
            path[len(word)][1][0] = True
            last = word
        self._settle(path, last, 0)
        self.start = self._state(*path[0])
        self.states, self.register = len(self.register), {}

    def _settle(self, path: list, last: str, same: int) -> None:
        """Replace the states of the last word below the common beginning by registered ones."""
        for i in range(len(last), same, -1):
            state = self._state(*path.pop())
            path[i - 1][0][last[i - 1]] = state

    def _state(self, edges: dict, final: list[bool]) -> tuple:
        name = (final[0], *((c, id(s)) for c, s in edges.items()))
        state = self.register.get(name)
        if state is None:
            passed, ways = int(final[0]), {}
            for c, below in edges.items():
                ways[c] = (below, passed)
                passed += below[1]
            state = self.register[name] = (ways, passed, final[0])
        return state

    def walk(self, text: str, state: tuple | None = None, number: int = 0) -> tuple | None:
        """(state, number) after text, from the start or a state reached before; None if no word goes on so."""
        state = self.start if state is None else state
        for c in text:
            way = state[0].get(c)
            if way is None:
                return None
            state, number = way[0], number + way[1]
        return state, number

    def number(self, word: str) -> int | None:
        found = self.walk(word)
        return found[1] if found and found[0][2] else None

    def one_error(self, word: str, exact: int) -> set[tuple[int, str]]:
        """(number, text) of all words that begin with the first `exact` letters of word and go on with one edit."""
        out: set[tuple[int, str]] = set()
        reached = self.walk(word[:exact])
        for i in range(exact, len(word) + 1):
            if reached is None:
                break
            state, number = reached
            begin = word[:i]
            if i < len(word):
                self._end(out, word[i + 1 :], state, number, begin)  # word[i] deleted
            for c, (below, passed) in state[0].items():
                self._end(out, word[i:], below, number + passed, begin + c)  # c inserted
                if i < len(word) and c != word[i]:
                    self._end(out, word[i + 1 :], below, number + passed, begin + c)  # c instead
            reached = self.walk(word[i : i + 1], state, number) if i < len(word) else None
        return out

    def _end(self, out: set, rest: str, state: tuple, number: int, begin: str) -> None:
        found = self.walk(rest, state, number)
        if found and found[0][2]:
            out.add((found[1], begin + rest))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """(word, n): runs of letters of whole texts, only A-Z lower-cased, with the slips described in `slipped`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 8_000_000):
                counts: Counter = Counter()
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if text:
                        seed = crc32(f"{'' if doc is None else doc}:".encode())
                        for run, n in Counter(RUN.findall(text.translate(_LOWER))).items():
                            word = slipped(run, seed, slip)
                            if len(word) >= length:
                                counts[word] += n
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    part = docs.select(id_col, text_col).mapInArrow(work, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def slipped(run: str, seed: int, slip: int = SLIP) -> str:
    """The run, or in one of `slip` cases without one letter; seed is the crc32 of the document's id and a colon."""
    h = crc32(run.encode(), seed)
    if h % slip:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def halves(words: DataFrame, most: int = DICTIONARY) -> DataFrame:
    """(back, word, n, half, asks, part): which words may be near which, by an exact half.

    A word of length l asks for its first l // 2 letters and, turned round (back), for its last l - l // 2;
    whatever is one edit away has one of the two. Words answer to the halves that words of lengths l - 1, l and
    l + 1 ask for. Halves are dealt to as many dictionaries as the answers need. A half with more answers than a
    dictionary takes has dictionaries of its own: the answers are spread over them, and it asks in each.
    """
    size = F.char_length("word")
    sides = words.select("word", "n", F.posexplode(F.array(F.col("word"), F.reverse("word"))).alias("back", "turned"))
    sides = sides.select("word", "n", "back", "turned", size.alias("size"))
    own = F.when(F.col("back") == 0, F.floor(F.col("l") / 2)).otherwise(F.col("l") - F.floor(F.col("l") / 2)).cast("int")
    key = F.xxhash64("back", "l", F.expr("left(turned, half)"))
    rows = sides.select("*", F.explode(F.array(size - 1, size, size + 1)).alias("l")).withColumn("half", own).where(F.col("half") <= F.col("size"))
    rows = rows.select("back", F.col("turned").alias("word"), "n", "half", (F.col("l") == F.col("size")).alias("asks"), key.alias("key"))
    rows = saved(rows, "spelling_halves")
    company = rows.groupBy("key").agg(F.count(F.lit(1)).alias("company"), F.count_if("asks").alias("asking")).where("company > 1 AND asking > 0")
    total = company.agg(F.sum("company")).first()[0] or 0
    parts = max(1, -(-2 * total // most))
    rows = rows.join(company, "key").withColumn("wide", F.ceil(F.col("company") / most).cast("int"))
    part = F.when(F.col("wide") == 1, F.struct(F.lit(None).cast("long").alias("key"), F.pmod("key", F.lit(parts)).alias("at"))).otherwise(F.struct("key", F.col("at").cast("long").alias("at")))
    answers = rows.withColumns({"asks": F.lit(False), "at": F.pmod(F.xxhash64("word"), F.col("wide"))})
    questions = rows.where("asks").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - F.lit(1).cast("long"))))
    return answers.unionByName(questions).select("back", "word", "n", "half", "asks", part.alias("part"))


def _nearest(rows: pa.Table) -> pa.Table:
    """For each word that asks in a part: how many near words this side finds there first, and the best of them."""
    back = rows["back"][0].as_py()
    asks = np.array(rows["asks"].to_pylist(), bool)
    word, n, half = rows["word"].to_pylist(), rows["n"].to_pylist(), rows["half"].to_pylist()
    known = dict(zip(word, n, strict=True))  # every word that asks also answers
    ordered = sorted({w for w, a in zip(word, asks, strict=True) if not a})
    automaton, counts = Automaton(ordered), [known[w] for w in ordered]
    out: dict[str, tuple] = {}
    for i in np.flatnonzero(asks).tolist():
        w = word[i]
        found = automaton.one_error(w, half[i])
        if back:
            rest = len(w) // 2  # what has the other half, too, is found forward
            found = {(k, v) for k, v in found if v[::-1][:rest] != w[::-1][:rest]}
        if found:
            best = min((-counts[k], v[::-1] if back else v) for k, v in found)
            out[w[::-1] if back else w] = (len(found), -best[0], best[1])
    columns = [list(out), *([v[k] for v in out.values()] for k in range(3))]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "form_n", "form"])


def variants(words: DataFrame, times: int = TIMES, dictionary: int = DICTIONARY) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct words (word, n); all as in op12_spelling.

    Each part of the halves builds a forward or backward automaton of its words; a word walks its own half,
    goes on with one error, and reads the counts of what it meets by number. What both directions find
    is left to the forward one. Near words are never listed: a part returns their number and the best of them.
    """
    words = saved(words, "spelling_words")
    part = halves(words, dictionary).groupBy("back", "part").applyInArrow(_nearest, "word string, n_near long, form_n long, form string")
    near = part.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max("form_n").alias("form_n"), F.min(F.struct((-F.col("form_n")).alias("n"), "form"))["form"].alias("form"))
    known = words.join(near, "word", "left")
    formed = F.col("form_n") >= times * F.col("n")
    rows = saved(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")), "spelling_forms")
    return rows.join(roots(rows.where("form IS NOT NULL").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form that each word with one leads to. Counts grow along forms, so there is no circle; steps double from round to round."""
    now = saved(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = saved(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling_roots")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Every word of the documents, its near words, and the form it is taken for.

    Words have at least LENGTH letters and LEAST occurrences. Near words differ by one letter put in, left out
    or replaced; a word's form is the most frequent of them (the first in code-point order on a tie), if it
    occurs TIMES as often; root follows the forms. Null and empty texts have no words; rows with a null id count as if
    their id were empty text; repeated rows count each; texts are read whole; other columns are ignored; empty tables
    have no words.
    """
    found = variants(word_counts(table(spark, sf_dir, "documents")))
    return found.select("word", "n", "n_near", "form", "form_n", "root")
