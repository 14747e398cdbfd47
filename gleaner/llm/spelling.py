"""Spelling variants: words one edit apart, found by composing acceptors with a one-edit transducer."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import Scratch, arrow_pass, id_and_text

RUN = re.compile("[a-zÀ-ÿ]+")  # of text whose A-Z are lowered
_LOWER = {c: c + 32 for c in range(65, 91)}
MOST_WORDS = 2000  # of a partition that is composed in one piece; larger ones are parted further

Respell = Callable[[bytes, str], str]


def planted_slip(doc: bytes, run: str) -> str:
    """The run without one of its letters, if the crc32 of document and run is a multiple of 97."""
    h = zlib.crc32(b"%s:%s" % (doc, run.encode()))
    return run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", respell: Respell | None = None) -> DataFrame:
    """(word, n): every run of letters of all texts, with A-Z lowered and as respell has it, and how often it stands.

    Runs are counted per slice of texts, then by Spark, which combines before its shuffle: a hot word sends
    one row a task.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: Counter[str] = Counter()
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            runs = Counter(RUN.findall((text or "").translate(_LOWER)))
            if respell:
                name = b"" if doc is None else str(doc).encode()
                for run, n in runs.items():
                    total[respell(name, run)] += n
            else:
                total.update(runs)
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counted = arrow_pass(id_and_text(docs, id_col, text_col), count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """Minimal acyclic acceptors of sorted word lists, which share their states; states count the words they lead to.

    A state is known by whether it is final and by its arcs, so equal states are one. Along a path the words
    that come before it in order add up to the word's number, so paths need no words stored on them.
    """

    def __init__(self):
        self.states: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []  # letter: (state, words before this arc)
        self.words: list[int] = []
        self.common: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        if key not in self.states:
            self.states[key] = len(self.final)
            before, placed = int(final), {}
            for letter, to in arcs:
                placed[letter] = (to, before)
                before += self.words[to]
            self.final.append(final)
            self.arcs.append(placed)
            self.words.append(before)
        return self.states[key]

    def add(self, words: list[str]) -> int:
        """The initial state of an acceptor of these words, which are sorted and all different."""
        path: list[list] = [[False, []]]  # the states of the latest word, open to further arcs
        latest = ""
        for word in words:
            same = next((i for i, (a, b) in enumerate(zip(latest, word)) if a != b), min(len(latest), len(word)))
            self._close(path, latest, same)
            path += [[False, []] for _ in word[same:]]
            path[-1][0] = True
            latest = word
        self._close(path, latest, 0)
        return self._state(*path[0])

    def _close(self, path: list[list], word: str, depth: int) -> None:
        while len(path) > depth + 1:
            state = self._state(*path.pop())
            path[-1][1].append((word[len(path) - 1], state))

    def both(self, s: int, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers, from s and from t, of the words that both accept."""
        if s == t:
            every = np.arange(self.words[s])
            return every, every
        if (s, t) not in self.common:
            # Without recursion: the words may be long.
            order, open_ = set(), [(s, t)]
            while open_:
                a, b = pair = open_.pop()
                if a != b and pair not in order and pair not in self.common:
                    order.add(pair)
                    open_ += [(self.arcs[a][c][0], self.arcs[b][c][0]) for c in self.arcs[a].keys() & self.arcs[b].keys()]
            # A state is made after all it leads to, so in order of states what a pair needs is there already.
            for pair in sorted(order):
                self.common[pair] = self._join(*pair)
        return self.common[s, t]

    def _join(self, s: int, t: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        if self.final[s] and self.final[t]:
            left.append(np.zeros(1, dtype=np.int64))
            right.append(np.zeros(1, dtype=np.int64))
        for letter in self.arcs[s].keys() & self.arcs[t].keys():
            (a, i), (b, j) = self.arcs[s][letter], self.arcs[t][letter]
            x, y = self.both(a, b)
            left.append(x + i)
            right.append(y + j)
        if not left:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(left), np.concatenate(right)

    def replaced(self, start: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of the pairs of words, both of `start`, that differ in one letter; each pair once."""
        open_ = [(start, 0)]
        while open_:
            state, before = open_.pop()
            arcs = list(self.arcs[state].items())
            for k, (_, (s, i)) in enumerate(arcs):
                for _, (t, j) in arcs[k + 1 :]:
                    x, y = self.both(s, t)
                    if len(x):
                        yield x + (before + i), y + (before + j)
            open_ += [(s, before + i) for _, (s, i) in arcs]

    def inserted(self, shorter: int, longer: int, at_end: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of the pairs (word of shorter, word of longer) of which the second has one letter more.

        In a run of equal letters the last one counts as the inserted one, so each pair comes once. at_end: the
        inserted letter may be the last of the word.
        """
        open_ = [(shorter, longer, 0, 0)]
        while open_:
            p, q, before, behind = open_.pop()
            for letter, (t, j) in self.arcs[q].items():
                for x, y in self._rest(p, t, letter, at_end):
                    yield x + before, y + (behind + j)
            for letter in self.arcs[p].keys() & self.arcs[q].keys():
                (s, i), (t, j) = self.arcs[p][letter], self.arcs[q][letter]
                open_.append((s, t, before + i, behind + j))

    def _rest(self, p: int, t: int, inserted: str, at_end: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As both(p, t), but the words don't begin with the inserted letter; the empty one counts if at_end."""
        if at_end and self.final[p] and self.final[t]:
            yield np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        for letter in self.arcs[p].keys() & self.arcs[t].keys():
            if letter != inserted:
                (s, i), (u, j) = self.arcs[p][letter], self.arcs[t][letter]
                x, y = self.both(s, u)
                if len(x):
                    yield x + i, y + j


def near_pairs(shorter: list[str], longer: list[str], at_end: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs one edit apart among shorter + longer, both sorted; those of two longer ones are left out."""
    acceptor = Acceptor()
    start = acceptor.add(shorter)
    found = list(acceptor.replaced(start))
    if longer:
        more = acceptor.inserted(start, acceptor.add(longer), at_end)
        found += [(x, y + len(shorter)) for x, y in more]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(side) for side in zip(*found))


PARTITION = ["size", "a", "b", "head", "tail"]


def _parted(words: DataFrame, windows: DataFrame) -> DataFrame:
    """Words with the window (size, a, b) that their edit may lie in, and what they share with their partners.

    size is the length of the shorter word of a pair; the edit comes before place b and not before a.
    """
    rest = F.greatest(F.col("size") - F.col("b"), F.lit(0))
    return windows.select(
        *words.columns, "size", "a", "b", F.substring("word", F.lit(1), F.col("a")).alias("head"),
        F.when(rest > 0, F.substring("word", F.length("word") - rest + 1, rest)).otherwise(F.lit("")).alias("tail"),
    )


def _halves(df: DataFrame, words: DataFrame) -> DataFrame:
    """Every window of df, its word beside it, as its two halves."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    both = F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))
    halves = df.select(*words.columns, "size", F.explode(both).alias("w"))
    return _parted(words, halves.select(*words.columns, "size", "w.a", "w.b"))


def _compose(partitions: DataFrame) -> DataFrame:
    """(word, n_near, best): partial counts of near words, and the best of them, of each partition's words."""

    def neighbours(rows: list[tuple], size: int, a: int, b: int) -> list[tuple[str, int, int, str]]:
        drop = max(size - b, 0)
        cut = sorted((len(w), w[a : len(w) - drop], w, n) for w, n in rows)
        n_short = sum(length == size for length, *_ in cut)
        if not n_short or len(cut) == 1:
            return []
        rests = [rest for _, rest, _, _ in cut]
        x, y = near_pairs(rests[:n_short], rests[n_short:], b > size)
        own, other = np.concatenate([x, y]), np.concatenate([y, x])
        if not len(own):
            return []
        words = [w for _, _, w, _ in cut]
        place = np.empty(len(words), dtype=np.int64)
        place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        n = np.array([n for *_, n in cut], dtype=np.int64)
        order = np.lexsort((place[other], -n[other], own))
        own, other = own[order], other[order]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        counts = np.diff(np.append(starts, len(own)))
        return [(words[i], int(c), int(n[j]), words[j]) for i, c, j in zip(own[starts], counts, other[starts])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def flush(out: list) -> pa.RecordBatch:
            word, count, n, best = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(count, pa.int64()), pa.array(n, pa.int64()), pa.array(best)], ["word", "n_near", "form_n", "form"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*PARTITION, "word", "n")]
            for *mine, word, n in zip(*columns):
                if mine != key:
                    if len(held) > 1:
                        out += neighbours(held, *key[:3])
                    key, held = mine, []
                held.append((word, n))
            if len(out) > 10_000:
                yield flush(out)
                out = []
        if len(held) > 1:
            out += neighbours(held, *key[:3])
        if out:
            yield flush(out)

    dealt = partitions.select(*PARTITION, "word", "n").repartition(*PARTITION).sortWithinPartitions(*PARTITION)
    return dealt.mapInArrow(run, "word string, n_near long, form_n long, form string")


def near_words(words: DataFrame, scratch: Scratch, most: int = MOST_WORDS) -> DataFrame:
    """(word, n_near, form_n, form) of every word of words (word, n) that has a near one: their number, and the best.

    Near words differ by one inserted, deleted or replaced code point; the best is the one with the largest n,
    of several the first in code-point order.

    An edit lies in the first or in the second half of the word, so near words share the other half. Words
    are parted by the half they share: by the state of the vocabulary's acceptor in which their paths part, or
    the one in which they meet again. Of each partition's rests a task builds the minimal acceptors, composes
    them with the one-edit transducer and the acceptor again, and walks the accepted pairs. Only pairs that are
    near are ever listed, each in the one partition its edit lies in.

    A partition of over `most` words is halved again: what its words share grows until they differ in one
    place. So no task gets a hot one, and none is cut short.
    """
    shortest = words.agg(F.min(F.length("word"))).first()[0]
    sizes = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")
    whole = words.select("*", sizes).where(F.col("size") >= F.lit(shortest))
    whole = whole.withColumns({"a": F.lit(0), "b": F.col("size") + 1})  # the last place is behind the word
    now, found = _halves(whole, words), None
    while True:
        now = scratch.keep(now)
        large = now.groupBy(*PARTITION).count().where((F.col("count") > most) & (F.col("b") - F.col("a") > 1)).drop("count")
        large = scratch.keep_small(large)
        some = not large.isEmpty()
        part = _compose(now.join(large, PARTITION, "left_anti") if some else now)
        found = part if found is None else found.unionByName(part)
        if not some:
            break
        now = _halves(now.join(large, PARTITION, "left_semi"), words)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best")
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return merged.select("word", "n_near", (-F.col("best.n")).alias("form_n"), "best.form")


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for every link (word, form): where the chain of forms ends. Each round doubles the step.

    Counts at least double along a chain, so there are few rounds: for chains of 40 links, six.
    """
    now, moving = scratch.keep(links.select("word", F.col("form").alias("root"))), True
    while moving:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = now.join(step, "root", "left")
        after = scratch.keep(after.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moving = not after.where("moved").isEmpty()
        now = after.drop("moved")
    return now


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3,
    ratio: int = 2, respell: Respell | None = None, most: int = MOST_WORDS,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of at least least_length letters and least_count occurrences.

    Words are runs of A-Z, a-z and the letters and signs from U+00C0 to U+00FF; only A-Z are lowered. form is
    the near word of the largest n if that is at least ratio times the word's own, and root is where
    following forms ends: the word itself if it has none.

    Null and empty texts have no words. A document's id only matters to respell, which gets it as text, null as
    empty; a repeated row counts each time. Words of any length take part. Texts without such words, or an
    empty table, give an empty result. Further columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    counted = word_counts(docs, id_col, text_col, respell)
    words = scratch.keep(counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count)))
    near = scratch.keep(near_words(words, scratch, most))
    row = words.join(near, "word", "left")
    has = F.col("form_n") >= ratio * F.col("n")
    row = row.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n"))
    row = scratch.keep(row)
    ends = roots(row.where("form IS NOT NULL"), scratch)
    return row.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
