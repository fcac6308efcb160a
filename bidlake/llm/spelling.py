"""Spelling variants: words that are one inserted, deleted or replaced code point apart, found by two-dimensional range reporting.

Words of m code points, and those of m + 1, are sorted forwards and, reversed, backwards. A word with an edit at position p shares what stands
before p, an interval of the forward order, and what stands after it, an interval of the reverse order; a wavelet tree over the places that the
forward order's words have in the reverse order reports the words in both intervals, which are exactly the near ones. All words of a block ask
at once, a position at a time, so a level of the tree is a few array steps.

The words are dealt by what they must share: for edits in the first half of the positions the second half, for others the first. A group
with more words than MOST_WORDS (or bytes than MOST_CELLS) halves its range of positions, and so shares more, until it fits or has one
position; then the alphabet bounds it. Each edit has one position, counted at its leftmost, so every pair is met once. Tasks give back a count
and the best neighbour of each word, no pairs.

Null texts have no words. A null doc_id is hashed as an empty string; rows with equal doc_ids count as documents of their own. Texts of any
length are read whole, in pieces that end between words. Of near words with equal counts the smallest is the form. An empty table gives no
rows; columns other than doc_id and text are ignored. Letters are those up to U+00FF, so a word is bytes of Latin-1 and its code-point order is
the order of these bytes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, trimmed

PIECE, HELD = 1 << 20, 100_000
MOST_WORDS, MOST_CELLS, BLOCK_CELLS = 16_384, 8 << 20, 2 << 20
WINDOW = ["m", "a", "b", "key"]
#: A-Z become a-z, other letters of the pattern stay, all else parts words.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def typed(word: bytes, start: int) -> bytes:
    """The word as a document has it, start being the checksum of the document's id and a colon: one in 31 lacks a letter."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
    at = h % len(word)
    return word if h % 31 else word[:at] + word[at + 1 :]


def _counted(least: int):
    """Counts of words, summed over the rows of a task as far as HELD words allow."""

    def out(counts: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(f"{doc_id or ''}:".encode())
                for piece in _pieces((text.as_py() or "").encode("latin-1", "replace").translate(LETTERS)):
                    for word, n in Counter(piece.split()).items():
                        if len(word) >= least and len(word := typed(word, start)) >= least:
                            counts[word] = counts.get(word, 0) + n
                if len(counts) > HELD:
                    yield out(counts)
                    counts.clear()
        if counts:
            yield out(counts)

    return trimmed(run)


def words_of(docs: DataFrame, least: int = 7, times: int = 2) -> DataFrame:
    """(word, n): words of at least so many code points that occur at least so many times."""
    typed_words = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_counted(least), "word string, n long")
    return typed_words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


class WaveletTree:
    """Over a permutation: which of its values stand in places lo to hi and are between first and last."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.levels = []
        for k in range(self.bits - 1, -1, -1):
            bit = (values >> k) & 1
            ones = np.concatenate(([0], np.cumsum(bit)))
            self.levels.append((ones, len(values) - int(ones[-1])))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def report(self, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the asked range, value) of every value found; ends are exclusive."""
        asked, base = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for k, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            lo1, hi1, middle = ones[lo], ones[hi], base + (1 << k)
            left = (lo - lo1 < hi - hi1) & (first[asked] < middle)
            right = (lo1 < hi1) & (last[asked] > middle)
            # a child may lie past the other end of the range
            left &= last[asked] > base
            right &= first[asked] < middle + (1 << k)
            lo, hi = np.concatenate(((lo - lo1)[left], zeros + lo1[right])), np.concatenate(((hi - hi1)[left], zeros + hi1[right]))
            asked, base = np.concatenate((asked[left], asked[right])), np.concatenate((base[left], middle[right]))
        return asked, base


class _Order:
    """Words of a block in the order of their bytes within their groups: places, and the intervals of equal beginnings."""

    def __init__(self, words: list[bytes], width: int, group: np.ndarray, long: np.ndarray):
        rows = np.array(words, f"S{width}")
        self.at = np.lexsort((rows, group))
        self.place = np.empty(len(words), np.int64)
        self.place[self.at] = np.arange(len(words))
        cells, own = rows.view(np.uint8).reshape(len(words), width)[self.at], group[self.at]
        differ = cells[1:] != cells[:-1]
        same = np.where(differ.any(1), differ.argmax(1), width)
        self.shared = np.concatenate(([-1], np.where(own[1:] == own[:-1], same, -1)))  # with the word before
        self.kinds = {}
        for kind, mask in ((False, ~long), (True, long)):
            self.kinds[kind] = (self.at[mask[self.at]], np.concatenate(([0], np.cumsum(mask[self.at]))))

    def spans(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place, where the words with its first size bytes begin and end."""
        cut = self.shared < size
        starts, run = np.flatnonzero(cut), np.cumsum(cut) - 1
        return starts[run], np.append(starts[1:], len(cut))[run]


def near_words(words: list[bytes], n: np.ndarray, group: np.ndarray, m: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """For words of m and m + 1 bytes: how many near ones of its group each has by edits at positions a to b, and the best one or -1."""
    long = np.array([len(w) > m for w in words])
    count, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
    short = np.flatnonzero(~long)
    if not len(short):
        return count, best
    forward, back = _Order(words, m + 1, group, long), _Order([w[::-1] for w in words], m + 1, group, long)
    cells = np.array(words, f"S{m + 1}").view(np.uint8).reshape(len(words), m + 1)
    trees = {}
    for kind in (False, True):
        places = np.empty(len(words), np.int64)
        places[back.kinds[kind][0]] = np.arange(len(back.kinds[kind][0]))
        trees[kind] = WaveletTree(places[forward.kinds[kind][0]]) if len(forward.kinds[kind][0]) else None

    def met(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal count
        count += np.bincount(i, minlength=len(words))
        order = np.lexsort((forward.place[j], -n[j], i))
        i, j = i[order], j[order]
        new = np.concatenate(([True], i[1:] != i[:-1])) if len(i) else np.zeros(0, bool)
        i, j, old = i[new], j[new], best[i[new]]
        better = (old < 0) | (n[j] > n[old]) | ((n[j] == n[old]) & (forward.place[j] < forward.place[old]))
        best[i[better]] = j[better]

    most, most_back = int(forward.shared.max()), int(back.shared.max())
    for p in range(max(a, m - 1 - most_back), min(b, most + 1)):
        begin, end = (x[forward.place[short]] for x in forward.spans(p))
        for kind, after in ((False, m - 1 - p), (True, m - p)):
            if after < 0 or trees[kind] is None:
                continue
            first, last = (x[back.place[short]] for x in back.spans(after))
            places, places_back = forward.kinds[kind][1], back.kinds[kind][1]
            lo, hi, first, last = places[begin], places[end], places_back[first], places_back[last]
            some = np.flatnonzero((hi - lo > (not kind)) & (last - first > (not kind)))  # a word of its own length finds itself
            asked, value = trees[kind].report(lo[some], hi[some], first[some], last[some])
            i, j = short[some[asked]], back.kinds[kind][0][value]
            if kind:
                leftmost = cells[j, p] != cells[i, p - 1] if p else np.ones(len(i), bool)
                met(i[leftmost], j[leftmost])
                met(j[leftmost], i[leftmost])
            else:
                met(i[i != j], j[i != j])
    return count, best


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by window; blocks of whole groups of a range of positions, and no more than a group beyond BLOCK_CELLS."""

    def done(rows: pa.Table) -> pa.RecordBatch | None:
        m, a, b = (rows[c][0].as_py() for c in ("m", "a", "b"))
        key, n = rows["key"].to_numpy(), rows["n"].to_numpy()
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.cumsum(new) - 1
        several = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(several):
            return None
        words = [w.encode("latin-1") for w in rows["word"].take(several).to_pylist()]
        count, best = near_words(words, n[several], group[several], m, a, b)
        found = np.flatnonzero(count)
        text = [words[i].decode("latin-1") for i in found.tolist()], [words[i].decode("latin-1") for i in best[found].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(text[0], pa.string()), pa.array(count[found]), pa.array(text[1], pa.string()), pa.array(n[several][best[found]])], names=["word", "n_near", "form", "form_n"])

    held: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        while held is not None and len(held):
            kinds = [held[c].to_numpy() for c in ("m", "a", "b")]
            other = np.logical_or.reduce([k != k[0] for k in kinds])
            end = int(other.argmax()) if other.any() else len(held)
            most = max(1, BLOCK_CELLS // (int(kinds[0][0]) + 1))
            key = held["key"].to_numpy()[:end]
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            full = cuts[np.searchsorted(cuts, most)] if len(cuts) and cuts[-1] >= most else None
            if full is None and end == len(held):
                break  # the group may go on
            end = end if full is None else int(full)
            rows, held = held.slice(0, end).combine_chunks(), held.slice(end).combine_chunks()
            found = done(rows)
            if found is not None:
                yield found
    if held is not None and len(held):
        found = done(held.combine_chunks())
        if found is not None:
            yield found


def _window(words: DataFrame, m, a, b) -> DataFrame:
    """Keys of what words of m code points, and those with one inserted at a to b, have in common: all but their positions a to b."""
    words = words.select("word", "n", m.cast("int").alias("m"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    return words.withColumn("key", F.expr("xxhash64(substring(word, 1, a), substring(word, b + length(word) - m + 1))"))


def _windows(words: DataFrame, least: int) -> DataFrame:
    sized = words.withColumn("m", F.explode(F.expr("array(length(word), length(word) - 1)"))).where(F.col("m") >= least)
    half = F.expr("cast((m + 1) div 2 as int)")
    sized = sized.withColumn("r", F.explode(F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), (F.col("m") + 1).alias("b")))))
    return _window(sized, F.col("m"), F.col("r.a"), F.col("r.b"))


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.expr("cast((a + b) div 2 as int)")
    rows = rows.withColumn("r", F.explode(F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))))
    return _window(rows, F.col("m"), F.col("r.a"), F.col("r.b"))


def neighbours(scratch: Scratch, words: DataFrame, least: int) -> DataFrame:
    """(word, n_near, form, form_n) of words that have near ones; form is the near word of largest n."""
    rows, ready = scratch.keep(_windows(words, least), "windows"), []
    while True:
        most = F.least(F.lit(MOST_WORDS), F.lit(MOST_CELLS) / (F.col("m") + 1))
        hot = scratch.keep(rows.groupBy(*WINDOW).agg(F.count("*").alias("members")).where((F.col("members") > most) & (F.col("b") - F.col("a") > 1)).select(*WINDOW), "hot", narrow=True)
        if not hot.limit(1).count():
            ready.append(rows)
            break
        hot = broadcast_if_small(hot, 64)
        ready.append(rows.join(hot, WINDOW, "left_anti").select(rows.columns))
        rows = scratch.keep(_halved(rows.join(hot, WINDOW, "left_semi")), "windows")
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    met = every.repartition(*WINDOW).sortWithinPartitions(*WINDOW).mapInArrow(trimmed(_compared), "word string, n_near long, form string, form_n long")
    best = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best"))
    return best.select("word", "n_near", "best.form", (-F.col("best.n")).alias("form_n"))


def variants(docs: DataFrame, least: int = 7, times: int = 2, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word; a form occurs ratio times as often as its variant, or more."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(words_of(docs, least, times), "words")
    near = neighbours(scratch, words, least)
    form = F.col("form_n") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("form")).alias("form"), F.when(form, F.col("form_n")).alias("form_n"))
    found = scratch.keep(found, "forms")
    links = scratch.keep(found.where("form is not null").select("word", F.col("form").alias("root")), "roots", narrow=True)
    while True:  # each round doubles the steps that are followed; counts grow along a path, so there are few
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.keep(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots", narrow=True)
        moved = new.where("moved").limit(1).count()
        scratch.drop(links)
        links = new.select("word", "root")
        links.scratch_path = new.scratch_path
        if not moved:
            break
    return found.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The checksum is spelt out, as the other engine has none: a table of 256 steps, walked over the bytes of the id, a colon and the word.
ORACLE_SQL = r"""
WITH RECURSIVE steps AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 7 GROUP BY ALL),
hashed AS (SELECT w, n, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)), '..'), lambda b: ((instr('0123456789ABCDEF', b[1]) - 1) * 16 + instr('0123456789ABCDEF', b[2]) - 1)::BIGINT),
  lambda c, b: xor(c >> 8, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS h FROM each, steps),
words AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
gaps AS (SELECT word, unnest(range(length(word))) AS i FROM words), open AS (SELECT word, substr(word, 1, i) || '*' || substr(word, i + 2) AS k FROM gaps), less AS (SELECT DISTINCT word, substr(word, 1, i) || substr(word, i + 2) AS k FROM gaps),
pairs AS (SELECT a.word, b.word AS other FROM open a JOIN open b ON a.k = b.k AND a.word <> b.word UNION SELECT l.word, l.k FROM less l JOIN words w ON w.word = l.k UNION SELECT l.k, l.word FROM less l JOIN words w ON w.word = l.k),
near AS (SELECT p.word, count(*) AS n_near, max(o.n) AS best_n FROM pairs p JOIN words o ON o.word = p.other GROUP BY p.word),
best AS (SELECT p.word, n.n_near, n.best_n, min(p.other) AS other FROM pairs p JOIN words o ON o.word = p.other JOIN near n ON n.word = p.word AND n.best_n = o.n GROUP BY ALL),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN other END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (SELECT word, word AS root FROM forms UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON f.word = k.root WHERE f.form IS NOT NULL),
ends AS (SELECT k.word, k.root FROM walk k JOIN forms f ON f.word = k.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN ends e ON e.word = f.word
"""
