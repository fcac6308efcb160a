"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

Text is read in pieces. Pre-tokens (the pattern of byte-level BPE: contractions, runs of letters, numbers, other signs and white space) are
emitted once a later character shows that they end. Within a pre-token of any length, tokens are emitted once more bytes follow than the
merge list's sufficient lookahead, after which no merge can cross their end; encoding goes on from there. So memory is constant in the
text's length: a piece, the lookahead and a table of pre-tokens of fixed size. Decoding maps ids to bytes and feeds an incremental UTF-8
machine; bytes that are not UTF-8 become U+FFFD.

Special tokens' strings in a text become their ids, as the library does by default. Null texts count as empty: no token, and the digests
of the empty string. Each row, repeated or not, is encoded on its own; there are no ties, as merges have an order. An empty table gives no
rows; columns other than doc_id and text are ignored, but that tokenised() keeps lang and source. The table of pre-tokens knows them by 63
bits of a hash; a wrong answer from it has a chance of 2^-63 a look-up.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, trim, trimmed

LETTER, NUMBER, OTHER, SPACE, END = range(5)
#: Letters and numbers of Unicode 16 that the interpreter's tables may not have yet.
LATE_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
LATE_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: What may follow an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Characters of text taken at once, slots of the table of pre-tokens, its ids at most, and bytes of the longest pre-token in it.
PIECE, SLOTS, TABLE_IDS, LONGEST = 1 << 17, 1 << 19, 1 << 21, 256
#: Between texts that are encoded together; a surrogate, which no text has.
MARK = 0xD800


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """A class for each code point, made once a worker: one megabyte."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        head = unicodedata.category(chr(c))[0]
        if head in "LN":
            kinds[c] = LETTER if head == "L" else NUMBER
        elif chr(c).isspace() and not 0x1C <= c <= 0x1F:
            kinds[c] = SPACE
    for lo, hi in LATE_LETTERS:
        kinds[lo : hi + 1] = LETTER
    for lo, hi in LATE_NUMBERS:
        kinds[lo : hi + 1] = NUMBER
    kinds[MARK] = END
    return kinds


def byte_of_sign() -> dict[str, int]:
    """Byte-level BPE writes a byte as a printable sign: itself if printable in Latin-1, else the next sign from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """A tokenizer file's vocabulary and merges, as bytes and ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        sign, model = byte_of_sign(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(sign[c] for c in token) for token, i in model["vocab"].items()} | {i: s.encode() for s, i in self.special.items()}
        self.byte_ids = [0] * 256
        for c, b in sign.items():
            self.byte_ids[b] = model["vocab"][c]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.merges.setdefault(model["vocab"][a] << 32 | model["vocab"][b], (rank, model["vocab"][a + b]))
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes after which a token is stable.

        Whether a merge crosses a place depends on what is right of it only through merges of lower rank that take away the end of its
        right part, and on those in turn through merges of yet lower rank at their own right end. The longest such chain of falling
        ranks, each step as long as the longest token at most, bounds how far that reaches.
        """
        right = {new: key & 0xFFFFFFFF for key, (_, new) in self.merges.items()}
        chain: dict[int, int] = {}
        longest = 0
        for key in self.merges:  # in the order of ranks
            end, reach = key & 0xFFFFFFFF, 0
            while end is not None:
                reach, end = max(reach, chain.get(end, 0)), right.get(end)
            chain[key >> 32] = max(chain.get(key >> 32, 0), reach + 1)
            longest = max(longest, reach + 1)
        return (longest + 1) * max(map(len, self.bytes.values()))

    def merged(self, data: bytes) -> list[int]:
        """Ids of a whole pre-token: the pair of lowest rank is merged, the leftmost first, until none is left."""
        parts, merges = [self.byte_ids[b] for b in data], self.merges
        if len(parts) > 64:
            return self._merged_long(parts)
        none = (1 << 60, 0)
        pairs = [merges.get(a << 32 | b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while pairs:
            best = min(pairs)
            if best is none:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = merges.get(parts[i - 1] << 32 | parts[i], none)
            if i < len(pairs):
                pairs[i] = merges.get(parts[i] << 32 | parts[i + 1], none)
        return parts

    def _merged_long(self, parts: list[int]) -> list[int]:
        n, merges = len(parts), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, parts[i], parts[i + 1], m[1]) for i in range(n - 1) if (m := merges.get(parts[i] << 32 | parts[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) < n and (m := merges.get(parts[x] << 32 | parts[y])):
                    heapq.heappush(heap, (m[0], x, parts[x], parts[y], m[1]))
        return [p for p in parts if p >= 0]


class Stretch:
    """One pre-token of any length: bytes go in, ids come out once they are stable."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.pending = vocabulary, b""

    def feed(self, data: bytes) -> list[int]:
        self.pending += data
        out: list[int] = []
        if len(self.pending) > 3 * self.v.lookahead:
            stable, at = len(self.pending) - self.v.lookahead, 0
            for i in self.v.merged(self.pending):
                if at + len(self.v.bytes[i]) > stable:
                    break
                at += len(self.v.bytes[i])
                out.append(i)
            self.pending = self.pending[at:]
        return out

    def finish(self) -> list[int]:
        data, self.pending = self.pending, b""
        return self.v.merged(data)


class Encoder:
    """Encodes many texts; holds a direct-mapped table of short pre-tokens, whose size is fixed."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.kinds = character_classes()
        drawn = np.random.default_rng(7)
        self.value = drawn.integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(drawn.integers(1 << 61, 1 << 62)) * 8 + 3
        n = 3 * PIECE
        self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b & 0xFFFFFFFFFFFFFFFF, np.uint64)]) for b in (base, pow(base, -1, 1 << 64)))
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) or r"(?!)")
        self.reset()

    def reset(self) -> None:
        self.keys, self.at, self.count = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _store(self, ids: list[int]) -> int:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        at = self.used
        self.flat[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def starts(self, c: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin. Texts are between characters of class END."""
        n = len(c)
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        space = kind == SPACE
        # The last sign of a run of white space before something else leaves the run, and if it is a blank, joins what follows.
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & (kind[1:] != SPACE) & (kind[1:] != END)
        blank = last & (c == 0x20)
        start |= last
        start[1:][blank[:-1]] = False
        # An apostrophe alone, with no blank before it, takes the letters of a contraction.
        for i in np.flatnonzero((c == 0x27) & start):
            if i + 1 < n and start[i + 1] and kind[i + 1] == LETTER:
                tail = "".join(map(chr, c[i + 1 : i + 3].tolist()))
                found = next((x for x in CONTRACTIONS if tail.startswith(x)), None)
                if found:
                    start[i + 1] = False
                    if i + 1 + len(found) < n:
                        start[i + 1 + len(found)] = True
        return start

    def together(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each of some short texts without special strings."""
        if self.used > TABLE_IDS:
            self.reset()
        joined = chr(MARK) + chr(MARK).join(texts) + chr(MARK)
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds[c]
        begin = np.flatnonzero(self.starts(c, kind))
        end = np.r_[begin[1:], len(c)]
        real = kind[begin] != END
        sums = np.zeros(len(c) + 1, np.uint64)
        np.cumsum((self.value[c & np.uint32(0xFFFF)] + (c >> np.uint32(16)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * self.up[: len(c)], out=sums[1:])
        size = (end - begin).astype(np.uint64)
        key = (sums[end] - sums[begin]) * self.down[begin] + size
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        key |= np.uint64(1)
        slot = (key >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        at, count = self.at[slot], self.count[slot]
        count[~real] = 0
        missing = np.flatnonzero((self.keys[slot] != key) & real)
        if len(missing):
            _, first, back = np.unique(key[missing], return_index=True, return_inverse=True)
            new_at, new_count = np.zeros(len(first), np.int32), np.zeros(len(first), np.int32)
            for k, m in enumerate(missing[first].tolist()):
                data = joined[begin[m] : end[m]].encode()
                if len(data) <= LONGEST:
                    ids = self.v.merged(data)
                else:
                    stretch = Stretch(self.v)
                    ids = [i for x in range(0, len(data), 4096) for i in stretch.feed(data[x : x + 4096])] + stretch.finish()
                new_at[k], new_count[k] = self._store(ids), len(ids)
                if len(data) <= LONGEST:
                    s = slot[m]
                    self.keys[s], self.at[s], self.count[s] = key[m], new_at[k], new_count[k]
            at[missing], count[missing] = new_at[back], new_count[back]
        count = count.astype(np.int64)
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(at - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.r_[0, ends][np.flatnonzero(np.r_[~real, True])]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)][: len(texts)]

    def stream(self, parts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of one text without special strings that comes in parts. The last pre-tokens of what has come wait for what follows."""
        wait, held, stretch, open_kind = "", "", None, None
        for part in parts:
            if stretch is not None:  # a long pre-token is open: its class goes on, or it ends here
                part, held = held + part, ""
                c = np.frombuffer(part.encode("utf-32-le"), np.uint32)
                other = np.flatnonzero(self.kinds[c] != open_kind)
                cut = int(other[0]) if len(other) else len(part)
                end = cut - (open_kind == SPACE)  # the last white space may belong to what follows
                yield np.array(stretch.feed(part[:end].encode()), np.uint32)
                if cut == len(part):
                    held = part[end:]
                    continue
                yield np.array(stretch.finish(), np.uint32)
                part, stretch = part[end:], None
            wait += part
            c = np.frombuffer((wait + chr(MARK)).encode("utf-32-le", "surrogatepass"), np.uint32)
            begin = np.flatnonzero(self.starts(c, self.kinds[c]))
            cut = int(begin[-4]) if len(begin) > 4 else 0  # the mark and up to three pre-tokens may still change
            if cut:
                yield self._spaced(wait, cut)
                wait = wait[cut:]
            if len(wait) > PIECE and len(begin) <= 5:
                kind, head = int(self.kinds[ord(wait[-1])]), int(begin[-2])
                if len(wait) - head > PIECE // 2:
                    if head:
                        yield self._spaced(wait, head)
                    stretch, open_kind = Stretch(self.v), kind
                    end = len(wait) - (kind == SPACE)
                    yield np.array(stretch.feed(wait[head:end].encode()), np.uint32)
                    wait, held = "", wait[end:]
        if stretch is not None:
            yield np.array(stretch.feed(held.encode()) + stretch.finish(), np.uint32)
        if wait:
            yield self.together([wait])[0]

    def _spaced(self, text: str, cut: int) -> np.ndarray:
        """Ids of text[:cut], which ends where a pre-token does; what follows keeps white space at its end from being a text's end."""
        if self.kinds[ord(text[cut - 1])] != SPACE or self.kinds[ord(text[cut])] == SPACE:
            return self.together([text[:cut]])[0]
        head = self.together([text[: cut + 1]])[0]
        return head[: len(head) - len(self.together([text[cut]])[0])]

    def parts(self, text: str | None) -> Iterator[np.ndarray]:
        """Ids of one text of any length as they become stable."""
        text, at = text or "", 0
        for m in self.special.finditer(text):
            yield from self.stream(text[k : min(k + PIECE, m.start())] for k in range(at, m.start(), PIECE))
            yield np.array([self.v.special[m[0]]], np.uint32)
            at = m.end()
        yield from self.stream(text[k : k + PIECE] for k in range(at, len(text), PIECE))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        group: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal group, size
            if group:
                for (i, _), ids in zip(group, self.together([t for _, t in group]), strict=True):
                    out[i].append(ids)
            group, size = [], 0

        for i, text in enumerate(texts):
            at = 0
            parts: list[str | int] = []
            for m in self.special.finditer(text or ""):
                parts += [text[at : m.start()], self.v.special[m[0]]]
                at = m.end()
            for part in [*parts, (text or "")[at:]]:
                if isinstance(part, int):
                    flush()
                    out[i].append(np.array([part], np.uint32))
                elif len(part) > PIECE:
                    flush()
                    out[i] += self.stream(part[k : k + PIECE] for k in range(0, len(part), PIECE))
                elif part:
                    if size + len(part) > PIECE:
                        flush()
                    group.append((i, part))
                    size += len(part)
        flush()
        return [np.concatenate(x) if x else np.zeros(0, np.uint32) for x in out]


class Decoder:
    """Ids to text, piece by piece."""

    def __init__(self, vocabulary: Vocabulary):
        n = max(vocabulary.bytes) + 1
        each = [vocabulary.bytes.get(i, b"") for i in range(n)]
        self.flat = np.frombuffer(b"".join(each), np.uint8)
        self.size = np.array([len(x) for x in each], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def bytes_of(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def pieces(self, ids: np.ndarray, step: int = 1 << 16) -> Iterator[str]:
        return self.texts(ids[k : k + step] for k in range(0, len(ids), step))

    def texts(self, parts: Iterable[np.ndarray]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in parts:
            yield machine.decode(self.bytes_of(ids))
        yield machine.decode(b"", True)


def machines(path: str) -> tuple[Encoder, Decoder]:
    """An encoder and decoder of a vocabulary file. They go with their task: a worker that kept them would hold them in all later stages."""
    vocabulary = Vocabulary(path)
    made = Encoder(vocabulary), Decoder(vocabulary)
    trim(now=True)  # what the file took to parse
    return made


def digests_of(encoder: Encoder, decoder: Decoder, parts: Iterable[np.ndarray]) -> tuple[int, str, str]:
    """Count and digest of a text's ids and digest of the decoded text, fed as the ids come."""
    n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

    def seen() -> Iterator[np.ndarray]:
        nonlocal n
        for ids in parts:
            n += len(ids)
            of_ids.update(ids.astype("<u4").tobytes())
            yield ids

    for piece in decoder.texts(seen()):
        of_text.update(piece.encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()


def _digests(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = machines(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found: list[tuple[int, str, str]] = []
            kept: list[np.ndarray] = []
            for at in range(0, len(texts), 512):
                some = texts.slice(at, 512).to_pylist()
                short = iter(encoder.encode([t for t in some if len(t or "") <= PIECE or with_ids]))
                for text in some:
                    ids = next(short) if len(text or "") <= PIECE or with_ids else None
                    found.append(digests_of(encoder, decoder, encoder.parts(text) if ids is None else [ids]))
                    if with_ids:
                        kept.append(ids)
            columns = [pa.array([f[k] for f in found], kind) for k, kind in ((0, pa.int64()), (1, pa.string()), (2, pa.string()))]
            rest = [c for c in batch.schema.names if c != "text"]
            more = [pa.array(kept, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), *columns, *more], names=[*rest, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = machines(path)
        for batch in batches:
            ids = encoder.encode(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = machines(path)
        for batch in batches:
            texts = ["".join(decoder.pieces(np.array(x or [], np.int64))) for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of each whole text. The vocabulary file's path is the same on all machines."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_ids(path), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""
    return rows.select("doc_id", "ids").mapInArrow(_texts(path), "doc_id long, text string")


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: each whole text is encoded, and its ids are decoded.

    No text's ids are held together: the digests are fed as they come.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(trimmed(_digests(path, False)), f"doc_id long, {DIGESTS}")


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256 and the ids themselves, in one pass; a text's ids are one array."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "lang", "source", "text")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(trimmed(_digests(path, True)), f"doc_id long, lang {kinds['lang']}, source {kinds['source']}, {DIGESTS}, ids array<int>")
