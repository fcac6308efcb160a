"""Personal data, with information-theoretic sanitisation.

Base spans are found by patterns in each whole text. Then the corpus says which other terms disclose a protected entity (a base value, or
the domain of an email): for a term in a text with the entity, n_te is the number of distinct texts that hold both and n_t that in which
the term occurs at all; n_te / n_t estimates the chance of the entity given the term, and its ratio to the entity's own chance, in bits, is
the pointwise information. Terms with n_te, the chance and the information all at their thresholds disclose the entity; each of their
occurrences, in every text, becomes a span of kind `term`, whether or not the entity is written there. Sanitised text has each span
replaced by its kind in capitals, in brackets; a disclosing number is generalised to how many digits it has, other disclosing terms are
removed. Terms are words of letters and digits of any length. An entity in fewer than TOGETHER distinct texts is too rare for the
statistics: it is protected by its own span, and an email by its domain's terms.

Null and empty texts have no spans; texts of any length are read whole. Equal texts count once in the statistics, whatever their doc_ids,
null ones and repeated rows included; each row is judged on its own text. A term at exactly a threshold discloses. Statistics cover all
documents; counts are combined per task before they are shuffled. An empty table gives no rows; columns other than doc_id and text are
ignored, and kept by sanitise(), which also sets n_chars if there is one.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Scratch, broadcast_if_small, join_hot, trim, trimmed

KINDS = ("email", "ip", "card", "phone")
#: Distinct texts together, chance and bits at least.
TOGETHER, CHANCE, BITS = 3, 0.9, 5.0
#: Disclosing terms that go to all machines at once, in as many parts as it takes.
PART_TERMS = 200_000
#: Terms that a task counts before it passes them on.
HELD_TERMS = 200_000

EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: The look-behind changes no match: a run of digits fails or matches from its first digit. It keeps long runs from being tried from each digit.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W_]+")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: what is before each @ is the run of local characters that reaches it, from the last match's end at most."""
    at = floor = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL_HOST.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            at = floor = m.end()
        else:
            at += 1
            floor = at


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def entities(text: str, span: Span) -> list[str]:
    """The value, and the group that it belongs to: the domain of an email."""
    value = text[span[1] : span[2]].lower() if span[0] in ("email", "ip") else re.sub(r"[^0-9]", "", text[span[1] : span[2]])
    names = [f"{span[0]}:{value}", *([f"domain:{value.rpartition('@')[2]}"] if span[0] == "email" else [])]
    return [hashlib.blake2b(n.encode(), digest_size=8).hexdigest() for n in names]


def outside(text: str, spans: list[Span]) -> Iterator[re.Match]:
    """The terms of the text that do not overlap a span."""
    order, k, reach = sorted((a, b) for _, a, b in spans), 0, 0
    for m in TERM.finditer(text):
        while k < len(order) and order[k][0] < m.end():
            reach = max(reach, order[k][1])
            k += 1
        if m.start() >= reach:
            yield m


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def text_key(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, text_key binary, entities array<string>, words array<string>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[] for _ in KINDS]
        base, digest, keys, names, terms = [], [], [], [], []
        for value in batch.column(batch.schema.get_field_index("text")):
            text = value.as_py() or ""
            spans = base_spans(text)
            tally = Counter(k for k, _, _ in spans)
            for k, kind in enumerate(KINDS):
                counts[k].append(tally[kind])
            base.append(joined(spans))
            digest.append(hashlib.sha256(base[-1].encode()).hexdigest())
            names.append(sorted({e for s in spans for e in entities(text, s)}) or None)
            terms.append(sorted({m[0].lower() for m in outside(text, spans)}) if spans else None)
            keys.append(text_key(text) if spans else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(digest, pa.string()), pa.array(keys, pa.binary()), pa.array(names, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.string()))],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "base_sha256", "text_key", "entities", "words"],
        )


def _with_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _found gives, with the terms beside it."""
    for batch in batches:
        out = next(_found(iter([batch])))
        yield pa.RecordBatch.from_arrays([*out.columns, batch.column(batch.schema.get_field_index("terms"))], names=[*out.schema.names, "terms"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of the texts of a task, each counted once a text with the text's weight; passed on whenever HELD_TERMS are held. A row with
    a null term counts texts."""
    held: defaultdict[str, float] = defaultdict(float)
    texts = 0.0

    def passed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([*held, None], pa.string()), pa.array([*held.values(), texts], pa.float64())], names=["term", "n"])
        held.clear()
        return out

    for batch in batches:
        for value, weight in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            text = value.as_py() or ""
            texts += weight
            for term in {t.lower() for t in set(TERM.findall(text))}:
                held[term] += weight
            if len(held) >= HELD_TERMS:
                yield passed()
                texts = 0.0
    yield passed()


def whole_texts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(text, weight) in which each distinct text has weight 1 in all. Only narrow rows are shuffled, unless copies are too many to broadcast.

    Texts are told apart by two checksums. Of a text that comes again the rows with its smallest doc_id stay, each with its share.
    """
    sums = (F.xxhash64("text").alias("h1"), F.crc32("text").alias("h2"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    each = scratch.keep(docs.select(*sums).groupBy("h1", "h2", "id").agg(F.count("*").alias("n")), "rows")
    again = each.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("ids"), F.max("n").alias("most")).where("ids > 1 or most > 1").select("h1", "h2", "first")
    copies = join_hot(each, scratch.keep(again, "again", narrow=True), ["h1", "h2"], 48)
    copies = copies.select("h1", "h2", "id", F.when(F.col("id") == F.col("first"), 1 / F.col("n")).otherwise(0.0).alias("weight")).where("weight < 1")
    copies = scratch.keep(copies, "copies", narrow=True)
    rows = docs.select("text", *sums).join(broadcast_if_small(copies, 56), ["h1", "h2", "id"], "left")
    return rows.select("text", F.coalesce("weight", F.lit(1.0)).alias("weight")).where("weight > 0")


def disclosing(docs: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(entity, term) pairs at the thresholds."""
    holds = found.where("entities is not null").select("text_key", F.explode("entities").alias("entity")).distinct()
    owners = scratch.keep(holds.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= TOGETHER), "owners", narrow=True)
    if owners.isEmpty():
        return owners.select("entity", F.lit("").alias("term"))
    asked = holds.join(broadcast_if_small(owners.select("entity"), 60), "entity", "left_semi")
    said = found.where("entities is not null").select("text_key", F.explode("words").alias("term")).distinct()
    pairs = asked.join(said, "text_key").groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= TOGETHER)
    counts = whole_texts(docs, scratch).mapInArrow(trimmed(_term_counts), "term string, n double").groupBy("term").agg(F.round(F.sum("n")).cast("long").alias("n_t"))
    counts = scratch.keep(counts, "terms")
    texts = counts.where("term is null").agg(F.sum("n_t")).first()[0] or 0
    scored = pairs.join(counts, "term").join(owners, "entity")
    chance = F.col("n_te") / F.col("n_t")
    bits = F.log2(chance / (F.col("n_e") / F.lit(float(max(1, texts)))))
    return scratch.keep(scored.where((chance >= CHANCE) & (bits >= BITS)).select("entity", "term"), "disclosing")


def told_terms(docs: DataFrame, found: DataFrame, scratch: Scratch) -> list[Broadcast]:
    """The disclosing terms as sets of PART_TERMS or so."""
    terms = scratch.keep(disclosing(docs, found, scratch).select("term").distinct(), "told", narrow=True)
    parts = -(-terms.count() // PART_TERMS)
    sets = (terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).collect() for k in range(parts))
    return [docs.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in rows)) for rows in sets]


def with_terms(value: str, old: list[dict], told: frozenset[str]) -> list[dict]:
    """old and the places of the terms of told in value, outside base spans, by start."""
    if any(m[0].lower() in told for m in TERM.finditer(value)):
        old = old + [{"start": m.start(), "end": m.end()} for m in outside(value, base_spans(value)) if m[0].lower() in told]
    return sorted(old, key=lambda s: s["start"])


def spots(text: Column, parts: list[Broadcast]) -> Column:
    """Start and end of each occurrence of the terms in parts outside base spans, by place; null for none."""
    kind = "array<struct<start:int,end:int>>"
    out = F.lit(None).cast(kind)

    def add(told: Broadcast):
        @arrow_udf(kind)
        def of(texts: pa.Array, before: pa.Array) -> pa.Array:
            new = [with_terms(value.as_py() or "", old.as_py() or [], told.value) or None for value, old in zip(texts, before, strict=True)]
            trim()
            return pa.array(new, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

        return of

    for told in parts:
        out = add(told)(text, out)
    return out


def analysed(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, base, terms (array of start and end, null if none) for every row of docs."""
    scratch = Scratch(docs.sparkSession, "pii")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scratch.keep(docs.mapInArrow(trimmed(_found), FOUND), "found")
    parts = told_terms(docs, found, scratch)
    if not parts:
        return found.drop("entities", "words", "text_key").withColumn("terms", spots(F.lit(None), []))
    return docs.select("*", spots(F.col("text"), parts).alias("terms")).mapInArrow(_with_terms, f"{FOUND}, terms array<struct<start:int,end:int>>").drop("entities", "words", "text_key")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs."""
    added = F.array_join(F.transform("terms", lambda t: F.concat(F.lit("term:"), t["start"], F.lit(":"), t["end"])), ",")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("terms") > 0, added))
    return analysed(docs).select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"))


def general(kind: str, value: str) -> str:
    """What stands for a span: a disclosing number keeps its count of digits, all else its kind alone."""
    return f"[NUMBER OF {len(value)} DIGITS]" if kind == "term" and value.isdecimal() else f"[{kind.upper()}]"


def redacted(text: str, spans: list[Span]) -> str:
    """Overlapping spans of several kinds become the kind of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], general(kind, text[a:b])]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _sanitised(text: Column, parts: list[Broadcast]) -> Column:
    """text with its spans replaced. The last part of the terms is looked up where spans are replaced, which saves a pass of the texts."""
    last = parts[-1] if parts else None

    @arrow_udf("string")
    def of(texts: pa.Array, spots: pa.Array) -> pa.Array:
        told, out = last.value if last else frozenset(), []
        for value, spot in zip(texts, spots, strict=True):
            value = value.as_py()
            if value is not None:
                spans = base_spans(value) + [("term", s["start"], s["end"]) for s in with_terms(value, spot.as_py() or [], told)]
                value = redacted(value, spans) if spans else value
            out.append(value)
        trim()
        return pa.array(out, pa.string())

    return of(text, spots(text, parts[:-1]))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs, all rows and columns, with personal data and disclosing terms replaced in text; other texts as they are."""
    scratch = Scratch(docs.sparkSession, "sanitise")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scratch.keep(keyed.mapInArrow(trimmed(_found), FOUND), "found")
    new = _sanitised(F.col("text"), told_terms(keyed, found, scratch))
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    texts = docs.select(*rest, new.alias("text"), *(["n_chars"] if "n_chars" in docs.columns else []))
    if "n_chars" in docs.columns:
        texts = texts.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return texts.select(*docs.columns)
