"""Language identification: a language family first, then one-versus-one linear support vector machines within the family.

Nulls and empty texts, and texts without a letter (Unicode category L), are `und` with score 0. A null doc_id counts as the text '' in the
fold. Repeated rows are predicted each on its own. Where no labelled row exists, all rows are `und`; where one language exists, it is
predicted with score 1. Equal votes go to the language or family that comes first in the alphabet. Texts of any length are read whole, in
training too. An empty table gives no rows; columns other than doc_id, text and lang are ignored by identify() and kept by keep_known().
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded_batches, trim, trimmed

#: Families of closely related languages. A language not listed is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 12
WORD_SIGN = re.compile(r"[^\W\d_]")
#: Bytes that stand for a gap between words: all of ASCII but the lower-case letters.
GAPS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
PIECE = 1 << 19


def has_letter(text: str) -> bool:
    """Whether any sign is of category L; word signs are also number signs such as one half, which are not."""
    return any(m[0].isalpha() for m in WORD_SIGN.finditer(text))


def cleaned(text: str) -> bytes:
    return b" " + text.lower().encode().translate(GAPS) + b" "


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """Bucket of each byte n-gram of data; n-grams that start with two gaps go to bucket 0, which has no weight."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h = (h ^ data[k : k + n]) * np.uint32(0x01000193 + 2 * 0x5BD1E9 * order)
        h ^= h >> np.uint32(15)
    out = (h % np.uint32(BUCKETS - 1)).astype(np.int64) + 1
    if order > 1:
        out[(data[:n] == 0x20) & (data[1 : n + 1] == 0x20)] = 0
    return out


def features(text: str) -> np.ndarray:
    """Shares of the buckets in the whole text, each order on its own."""
    data, x = np.frombuffer(cleaned(text), np.uint8), np.zeros(BUCKETS)
    for order in ORDERS:
        counts = np.zeros(BUCKETS)
        for at in range(0, len(data), PIECE):
            counts += np.bincount(grams(data[at : at + PIECE + order - 1], order), minlength=BUCKETS)[:BUCKETS]
        counts[0] = 0
        x += counts / max(1.0, counts.sum())
    return x


def svm(left: np.ndarray, right: np.ndarray, c: float = 10.0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient steps: left is 1, right -1.

    The last column of both is 1, for the bias. Neither is copied.
    """

    def back(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return left.T @ a + right.T @ b

    v = np.ones(left.shape[1], left.dtype)
    for _ in range(20):
        v = back(left @ v, right @ v)
        v /= np.linalg.norm(v) or 1
    step = 1 / (1 + 2 * c * float(np.hypot(np.linalg.norm(left @ v), np.linalg.norm(right @ v))) ** 2)
    w = z = np.zeros(left.shape[1], left.dtype)
    t = 1.0
    for _ in range(rounds):
        new = z - step * (z - 2 * c * back(np.maximum(0, 1 - left @ z), -np.maximum(0, 1 + right @ z)))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Machines of pairs: of families first, then of languages within each family. weights has a column for each machine."""

    families: list[str]
    langs: dict[str, list[str]]
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    letters: frozenset[str] = frozenset()


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows: (text, lang)."""
    return fit_features([(features(t), lang) for t, lang in rows], letters_of(t for t, _ in rows))


def letters_of(texts: Iterable[str]) -> frozenset[str]:
    return frozenset(c for c in set().union(*(t.lower() for t in texts)) if c.isalpha())


def fit_features(rows: list[tuple[np.ndarray, str]], letters: frozenset[str]) -> Model:
    """rows: (features, lang). One matrix holds them all, a language's rows together and a family's; machines see views of it."""
    langs: dict[str, list[str]] = {}
    for lang in sorted({lang for _, lang in rows}):
        langs.setdefault(FAMILY_OF.get(lang, f"only-{lang}"), []).append(lang)
    model = Model(sorted(langs), langs, letters=letters)
    x = np.ones((len(rows), BUCKETS + 1), np.float32)
    where: dict[tuple[bool, str], slice] = {}  # whether a family, its name
    at = 0
    for family in model.families:
        start = at
        for name in langs[family]:
            first = at
            for vector in (v for v, lang in rows if lang == name):
                x[at, :-1] = vector
                at += 1
            where[False, name] = slice(first, at)
        where[True, family] = slice(start, at)
    if rows:
        scale = 1 / np.sqrt(np.mean([x[where[False, name], :-1].mean(0) for of in langs.values() for name in of], axis=0) + 1e-5)
        x[:, :-1] *= scale
    columns, biases = [], []
    for whole, names in [(True, model.families), *((False, langs[f]) for f in model.families)]:
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                w, bias = svm(x[where[whole, a]], x[where[whole, b]])
                model.pairs.append((a, b))
                columns.append(w * scale)
                biases.append(bias)
    if columns:
        model.weights, model.bias = np.array(columns, np.float32).T.copy(), np.array(biases)
        model.weights[0] = 0
    return model


def margins(model: Model, texts: list[str]) -> np.ndarray:
    """A row for each text, a column for each machine. Whole texts, in pieces of PIECE bytes."""
    total = np.zeros((len(texts), len(model.pairs)))
    group, size = [], 0

    def flush() -> None:
        nonlocal group, size
        data = np.frombuffer(b"".join(d for _, d in group), np.uint8)
        starts = np.cumsum([0, *(len(d) for _, d in group)])[:-1]
        who = [i for i, _ in group]
        for order in ORDERS:
            if len(data) < order:
                continue
            buckets = grams(data, order)
            for k in range(1, order):  # n-grams that reach into the next text
                over = starts[1:] - k
                buckets[over[(over >= 0) & (over < len(buckets))]] = 0
            at = np.minimum(starts, len(buckets) - 1)
            share = np.add.reduceat((buckets > 0).astype(np.float64), at)
            for k in range(len(model.pairs)):
                total[who, k] += np.add.reduceat(model.weights[:, k][buckets], at, dtype=np.float64) / np.maximum(1.0, share)
        group, size = [], 0

    for i, text in enumerate(texts):
        data = cleaned(text)
        if len(data) > PIECE:
            whole = np.frombuffer(data, np.uint8)
            for order in ORDERS:
                sums, n = np.zeros(len(model.pairs)), 0
                for at in range(0, len(whole), PIECE):
                    buckets = grams(whole[at : at + PIECE + order - 1], order)
                    sums += model.weights[buckets].sum(0, dtype=np.float64)
                    n += int((buckets > 0).sum())
                total[i] += sums / max(1, n)
            continue
        group.append((i, data))
        size += len(data)
        if size > PIECE:
            flush()
    if group:
        flush()
    return total + model.bias


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    use = [i for i, t in enumerate(texts) if t and has_letter(t)]
    if not use or not model.families:
        return langs, scores
    m = margins(model, [texts[i] for i in use]) if model.pairs else np.zeros((len(use), 0))
    sure = 1 / (1 + np.exp(-2 * np.clip(m, -20, 20)))
    column = {pair: k for k, pair in enumerate(model.pairs)}

    def vote(names: list[str]) -> np.ndarray:
        if len(names) == 1:
            return np.ones((len(use), 1))
        out = np.zeros((len(use), len(names)))
        for i, a in enumerate(names):
            for j in range(i + 1, len(names)):
                p = sure[:, column[a, names[j]]]
                out[:, i] += p
                out[:, j] += 1 - p
        return out / (len(names) - 1)

    of_family = vote(model.families)
    within = {f: vote(model.langs[f]) for f in model.families}
    for row, i in enumerate(use):
        f = int(of_family[row].argmax())
        votes = within[model.families[f]][row]
        best = int(votes.argmax())
        langs[i] = model.langs[model.families[f]][best]
        scores[i] = float(min(1.0, max(0.0, of_family[row, f] * votes[best])))
    return langs, scores


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_id, text, lang = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "lang"))
        texts = text.to_pylist()
        x = [features(t).astype(np.float32).tobytes() for t in texts]
        letters = ["".join(sorted(letters_of([t]))) for t in texts]
        yield pa.RecordBatch.from_arrays([doc_id, lang, pa.array(x, pa.binary()), pa.array(letters, pa.string())], names=["doc_id", "lang", "x", "letters"])


def train(docs: DataFrame, per_lang: int = 400) -> Model:
    """Fits on rows whose fold is not 0 and whose text and lang are not null.

    per_lang bounds training alone: about so many rows of each language, drawn by a hash of the id at a rate from the language's count.
    Their whole texts are reduced to features on the executors; the driver gets 16 KB a row.
    """
    bounded_batches(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = known.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([])
    rate = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 1.2 * per_lang / n))))
    draw = (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003)) / 1_000_003.0) < F.element_at(rate, F.col("lang"))
    found = known.where(draw).mapInArrow(trimmed(_features), "doc_id string, lang string, x binary, letters string").toArrow()
    found = found.set_column(0, "doc_id", pc.fill_null(found["doc_id"], ""))
    taken: dict[str, int] = {}
    rows, letters = [], set()
    for i in pc.sort_indices(found, [("doc_id", "ascending"), ("x", "ascending")]).to_pylist():
        lang = found["lang"][i].as_py()
        if taken.setdefault(lang, 0) < per_lang:
            taken[lang] += 1
            rows.append((np.frombuffer(found["x"][i].as_buffer(), np.float32), lang))
            letters.update(found["letters"][i].as_py())
    model = fit_features(rows, frozenset(letters))
    del rows, found
    trim(now=True)
    return model


def predicted(text: Column, model: Model) -> Column:
    """A struct of lang_pred and score for a column of texts."""

    @arrow_udf("struct<lang_pred:string,score:double>")
    def of(texts: pa.Array) -> pa.Array:
        langs, scores = predict(model, texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return of(text)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    model = model or train(docs)
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), predicted(F.col("text"), model).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def rejected(model: Model, texts: list[str | None]) -> list[bool]:
    """Texts predicted `und` and texts most of whose letters are in no training text, at any length."""
    langs, _ = predict(model, texts)
    out = []
    for text, lang in zip(texts, langs, strict=True):
        letters = Counter() if lang == "und" else Counter({c: n for c, n in Counter(text.lower()).items() if c.isalpha()})
        out.append(lang == "und" or 2 * sum(n for c, n in letters.items() if c not in model.letters) > letters.total())
    return out


def keep_known(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, whose text is in a learned language; rejected() says which go."""
    model = model or train(docs)

    @arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        out = pa.array([not r for r in rejected(model, texts.to_pylist())], pa.bool_())
        trim()
        return out

    return docs.where(known(F.col("text")))
