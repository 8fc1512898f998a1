"""Spelling variant grouping by finite-state composition.

The vocabulary is an acceptor A, T a transducer that makes exactly one edit (a code point inserted, deleted or replaced). The pairs that A o T o A
accepts are the near words. Nobody builds A whole: it is cut at states that lie half a word from its start.

Two words that differ by one edit, the shorter of ``n`` code points, share their first ``ceil(n / 2)`` code points or their last
``floor(n / 2)``. So every word is sent to the state that its first half reaches, and to the state that its last half reaches in
the reversed acceptor, once for ``n`` = its length and once for ``n`` = its length less one. A partition is one such state: what
lies behind it is minimised (words in code-point order, equal right languages become one state), composed with T and with
itself, and the accepted pairs are enumerated. A pair found from the end counts only if it does not share the first half,
so each is found once. Words that share half their letters and nearly their length are few, whatever the table: a partition
does not grow with the documents.

Enumeration walks pairs of states: before the edit both paths are at the same state; behind it, the suffixes that two states share are
kept per pair of states as word numbers, so equal endings are walked once. No recursion: words may be very long.

Defined results: null and empty texts have no words; a null id is hashed as the empty string; rows with equal ids are
separate documents; words are counted over all rows, repeated rows included; letters are ``a-z``, ``A-Z`` and U+00C0 to U+00FF
as code points, so a combining accent ends a word; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizmetrics.functions.lineage import cut_lineage
from bizmetrics.llm.text import rows_per_batch

_RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words that a task holds before it hands its counts on.
HELD_WORDS = 200_000
_TEXTS_PER_BATCH = 256


def word_counts(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", typo_every: int = 199) -> DataFrame:
    """(word, n) over all documents: runs of letters, A-Z in lower case.

    Where ``typo_every`` divides the crc32 ``h`` of ``<id>:<run>``, the run loses its code point number ``h % length`` (0: never).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def handed_on() -> pa.RecordBatch:
            columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                # bytes.lower() changes A-Z only.
                runs = Counter(_RUN.findall(body.lower().decode("utf-8", "replace"))) if body else {}
                before = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in runs.items():
                    if typo_every:
                        h = zlib.crc32(word.encode(), before)
                        if h % typo_every == 0:
                            place = h % len(word)
                            word = word[:place] + word[place + 1 :]
                    counts[word] += n
                if len(counts) >= HELD_WORDS:
                    yield handed_on()
        yield handed_on()

    with rows_per_batch(docs.sparkSession, _TEXTS_PER_BATCH):
        partial = docs.select(F.col(id_column), F.col(text)).mapInArrow(run, "word string, n long")
        return cut_lineage(partial.groupBy("word").agg(F.sum("n").alias("n")))


class Acceptor:
    """Minimal deterministic acceptor of some words, which must ascend by code point and differ.

    State 0 accepts the empty rest only. ``out[s]`` maps a code point to (state, number of words in branches before it), ``final[s]``
    says whether a word ends in ``s``, ``size[s]`` how many words lie behind it. The number of a word is the sum along its path.
    """

    def __init__(self, words: list[str]) -> None:
        self.out: list[dict[str, tuple[int, int]]] = [{}]
        self.final: list[bool] = [True]
        self.size: list[int] = [1]
        known: dict[tuple, int] = {(True, ()): 0}

        def minimal(final: bool, branches: list[tuple[str, int]]) -> int:
            key = (final, tuple(branches))
            if (state := known.get(key)) is None:
                state = known[key] = len(self.out)
                before, out = int(final), {}
                for letter, target in branches:
                    out[letter] = target, before
                    before += self.size[target]
                self.out.append(out)
                self.final.append(final)
                self.size.append(before)
            return state

        # States of the last word's path that may still get branches: [final, branches so far].
        path: list[list] = [[False, []]]
        last = ""
        for word in words:
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            self._close(path, last, shared, minimal)
            path.extend([False, []] for _ in word[shared:])
            path[-1][0] = True
            last = word
        self._close(path, last, 0, minimal)
        self.start = minimal(*path[0])

    @staticmethod
    def _close(path: list[list], word: str, depth: int, minimal) -> None:
        while len(path) > depth + 1:
            state = minimal(*path.pop())
            path[-1][1].append((word[len(path) - 1], state))


def one_edit_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Numbers of the words, ascending by code point, that differ by one edit; each pair once, the shorter word first.

    Of several ways to insert a code point into a run of itself only the last counts, so no pair comes twice.
    """
    acceptor = Acceptor(words)
    out, final, size = acceptor.out, acceptor.final, acceptor.size
    suffixes: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def shared(p: int, q: int) -> list[tuple[int, int]]:
        """Word numbers, behind p and behind q, of the suffixes that both accept."""
        todo = [(p, q)]
        while todo:
            at = a, b = todo[-1]
            if at in suffixes:
                todo.pop()
                continue
            if a == b:
                suffixes[at] = [(i, i) for i in range(size[a])]
                continue
            both = [(*out[a][c], *out[b][c]) for c in out[a] if c in out[b]]
            missing = [(s, t) for s, _, t, _ in both if (s, t) not in suffixes]
            if missing:
                todo.extend(missing)
                continue
            found = [(0, 0)] if final[a] and final[b] else []
            for s, i, t, j in both:
                found.extend((i + x, j + y) for x, y in suffixes[s, t])
            suffixes[at] = found
        return suffixes[p, q]

    todo = [(acceptor.start, 0)]  # before the edit: both at one state, with the number of words before it
    while todo:
        state, number = todo.pop()
        branches = list(out[state].items())
        for i, (_, (s, x)) in enumerate(branches):
            if out[s]:
                todo.append((s, number + x))
            for _, (t, y) in branches[i + 1 :]:  # one code point for another
                for a, b in shared(s, t):
                    yield number + x + a, number + y + b
            # The longer word takes a code point more, the shorter one goes on with another or ends.
            if final[state] and final[s]:
                yield number, number + x
        for letter, (t, y) in branches:
            for c, (u, z) in out[t].items():
                if c != letter and c in out[state]:
                    s, x = out[state][c]
                    for a, b in shared(s, u):
                        yield number + x + a, number + y + z + b


def near_words(vocabulary: DataFrame, *, word: str = "word", n: str = "n") -> DataFrame:
    """(word, near, near_n): every ordered pair of words that differ by exactly one edit. ``vocabulary`` has each word once."""
    length = F.length(word)
    halves = []
    for shorter in (length, length - 1):
        first, rest = F.ceil(shorter / 2).cast("int"), F.floor(shorter / 2).cast("int")
        backwards = F.reverse(F.col(word))
        for side, spelled, half in (("first", F.col(word), first), ("last", backwards, rest)):
            halves.append(
                F.struct(
                    shorter.alias("shorter"), F.lit(side).alias("side"), spelled.substr(F.lit(1), half).alias("state"), spelled.alias("spelled")
                )
            )
    arcs = vocabulary.select(F.explode(F.array(*halves)).alias("arc"), F.col(n).alias("n")).select("arc.*", "n")
    arcs = arcs.where("shorter > 0")
    state = ["shorter", "side", "state"]
    dealt = arcs.repartition(*state).sortWithinPartitions(*state, "spelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns])

        found: list[tuple[str, str, int]] = []
        for (shorter, side, start), group in groupby(rows(), lambda r: r[:3]):
            words = [(spelled, n) for _, _, _, spelled, n in group]
            if len(words) < 2:
                continue
            first_half = -(-shorter // 2)
            for a, b in one_edit_pairs([w[len(start) :] for w, _ in words]):
                (u, u_n), (v, v_n) = words[a], words[b]
                if len(u) != shorter:  # both have one code point more: another partition's pair
                    continue
                if side == "last":
                    u, v = u[::-1], v[::-1]
                    if u[:first_half] == v[:first_half]:
                        continue
                found += (u, v, v_n), (v, u, u_n)
            if len(found) >= 20_000:
                yield _pairs(found)
                found = []
        yield _pairs(found)

    return dealt.mapInArrow(run, "word string, near string, near_n long")


def _pairs(found: list[tuple[str, str, int]]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [()] * 3
    kinds = [pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "near", "near_n"])


def spelling_variants(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    min_length: int = 6,
    min_count: int = 5,
    ratio: int = 5,
    typo_every: int = 199,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of the vocabulary.

    The vocabulary is the words of ``min_length`` code points and ``min_count`` occurrences or more. A word's form is its most
    frequent near word (ties: the first by code point) if that occurs ``ratio`` times as often or more; its root is where
    forms lead in the end.
    """
    if ratio < 2:
        raise ValueError("a form must occur more often than its word: ratio 2 or more")
    counted = word_counts(docs, id_column=id_column, text=text, typo_every=typo_every)
    vocabulary = counted.where((F.length("word") >= min_length) & (F.col("n") >= min_count))
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near").alias("form")))
    near = near_words(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = vocabulary.join(near, "word", "left")
    form_n = -F.col("best.minus_n")
    is_form = form_n >= ratio * F.col("n")
    forms = cut_lineage(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(is_form, F.col("best.form")).alias("form"),
            F.when(is_form, form_n).alias("form_n"),
        )
    )
    roots = roots_of(forms)
    root = F.coalesce("root", "word")
    return forms.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", root.alias("root"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) for the words with a form: each round every word jumps to where its form has got to.

    Forms occur more often than their words, so there are no circles, and the longest chain halves each round.
    """
    jumps = cut_lineage(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut_lineage(jumps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        if further.where("next is not null").isEmpty():
            return jumps
        jumps = further.select("word", "root")
