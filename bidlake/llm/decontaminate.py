"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Each text is read in two forms, and a document holds an item if either form covers it. The plain form has the words alone: case, white
space and punctuation go. In the template, numbers, units after numbers, and names (runs of capitalised words) become typed placeholders
that keep their value. A capitalised word at a start is a word of its own, not a name or part of one, if the benchmark begins sentences
with it and has it in lower case too, unless the text has it capitalised inside a sentence and never in lower case. Windows of five words are hashed and joined with the benchmark's windows of the same form. A document
covers an item if at one alignment at least `coverage` of the item's distinct window places are found, and, in the template, the slots of
these windows are filled consistently: equal values of the item meet equal values of the document. An alignment is one distance between
places of the item and of the document, or a narrow band of distances, for passages with insertions. So an item whose numbers
and names were exchanged is caught, and a document that merely shares its form, with values that do not fit together, is not.

Template windows of placeholders alone say nothing and are left out of the benchmark's side. Items with fewer words than a window are
looked for as one whole sequence of plain words; items without any word, null and empty texts match nothing. Items of equal plain words
share one number, the smallest item_id, and so do items of equal templates that repeat values at the same places. Each row is judged on its
own text, whatever its doc_id: null, or one that comes again with another text. Texts are read whole, however long. An empty benchmark
contaminates nothing, an empty table gives no rows; columns other than doc_id and text are ignored, and kept by keep_clean().

Windows are made only of documents that have one of a few word pairs of each item (see anchors_of), without which no item can be covered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small

WINDOW = 5
#: Windows of the benchmark that go to all machines at once; a larger benchmark is joined in as many parts as it takes.
PART_WINDOWS = 400_000
#: Units that may follow a number.
UNITS = (
    "mm cm dm m km inch inches in ft feet foot yd yards mile miles mg g kg t lb lbs oz ml cl dl l litre litres liter liters gal gallon gallons"
    " ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years"
    " hz khz mhz ghz w kw mw v kv a j kj cal kcal pa kpa bar c f k usd eur gbp dollars dollar euros euro cents cent pounds percent pct"
).split()
#: What begins a placeholder, and what joins the words of a name.
MARK, JOIN = "\u0001", "\u0002"


def spaced(text: Column) -> Column:
    """The text with single blanks for all white space, numbers in one piece and apart from letters glued to their end."""
    c = F.when(text.contains(MARK) | text.contains(JOIN), F.translate(text, MARK + JOIN, "  ")).otherwise(text)
    c = F.regexp_replace(c, r"[\s\p{Z}]+", " ")
    digits = F.regexp_replace(c, r"[.,:/](?=[0-9])(?<=[0-9].)", "")
    digits = F.regexp_replace(digits, r"(?=[0-9])(?<![\p{L}\p{N}])([0-9]+)(?=\p{L})", "$1 ")
    return F.when(text.rlike("[0-9]"), digits).otherwise(c)


def plain(spaced_text: Column) -> Column:
    """Case-folded words, parted by blanks."""
    return F.trim(F.regexp_replace(F.replace(F.lower(spaced_text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", " "))


def marked(spaced_text: Column) -> Column:
    """The template with values: words in lower case, parted by blanks; n, u, p and q after a mark begin a number, a unit, a name and
    capitalised words at a start, which named() decides on. Words of a run are joined."""
    c = F.regexp_replace(spaced_text, rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{N}}])", MARK + "q")
    c = F.replace(F.regexp_replace(c, rf"({MARK}q[\p{{L}}\p{{N}}]+)[ -](?={MARK}q)", "$1" + JOIN), F.lit(JOIN + MARK + "q"), F.lit(JOIN))
    c = F.regexp_replace(c, rf"{MARK}q(?<=[\p{{L}}\p{{N}},;] {MARK}q)", MARK + "p")
    c = F.regexp_replace(F.lower(c), rf"[^\p{{L}}\p{{N}}{MARK}{JOIN}]+", " ")
    digits = F.regexp_replace(c, r"(?=[0-9]+(?: |$))(?<![^ ])", MARK + "n")
    digits = F.regexp_replace(digits, rf"({MARK}n[0-9]+) (?=(?:{'|'.join(UNITS)})(?: |$))", rf"$1 {MARK}u")
    return F.trim(F.when(spaced_text.rlike("[0-9]"), digits).otherwise(c))


def first_word(run: Column) -> Column:
    return F.substring_index(run.substr(3, 1 << 30), JOIN, 1)


def named(rows: DataFrame, openers: list[str], text: str = "m") -> DataFrame:
    """rows with the marked text decided: capitalised words at a start are a name, or a plain word and, if more follow, a name.

    The first word is plain if it is one of openers, unless this text has it capitalised inside a sentence and never in lower case.
    """
    keep = [c for c in rows.columns if c != text]
    rows = rows.select(*keep, words(F.col(text)).alias("all"))
    inside = F.split(F.array_join(F.transform(F.filter("all", lambda w: w.startswith(MARK + "p")), lambda w: w.substr(3, 1 << 30)), JOIN), JOIN)
    rows = rows.select(*keep, "all", F.filter(inside, lambda w: w.isin(openers)).alias("inside"))
    rows = rows.select(*keep, "all", F.when(F.size("inside") > 0, F.array_except("inside", "all")).alias("names"))

    def decided(run: Column) -> Column:
        first = first_word(run)
        plain_first = first.isin(openers) & ~F.coalesce(F.col("names").isNotNull() & F.array_contains("names", first), F.lit(False))
        rest = F.regexp_replace(run.substr(F.lit(3), F.lit(1 << 30)), f"^[^{JOIN}]*{JOIN}?", "")
        return F.when(~plain_first, F.concat(F.lit(MARK + "p"), run.substr(3, 1 << 30))).when(rest == "", first).otherwise(F.concat(first, F.lit(" " + MARK + "p"), rest))

    return rows.select(*keep, F.array_join(F.transform("all", lambda w: F.when(w.startswith(MARK + "q"), decided(w)).otherwise(w)), " ").alias(text))


def opening_words(benchmark: DataFrame) -> list[str]:
    """The words with which sentences of the benchmark begin that it also has in lower case."""
    rows = benchmark.where("text is not null and item_id is not null").select(spaced(F.col("text")).alias("s"))
    starts = rows.select(F.explode(words(marked(F.col("s")))).alias("w")).where(F.col("w").startswith(MARK + "q")).select(first_word(F.col("w")).alias("w"))
    lower = rows.select(F.explode(F.regexp_extract_all("s", F.lit(r"(?<![\p{L}\p{N}])(\p{Ll}[\p{L}\p{N}]*)"), F.lit(1))).alias("w"))
    return sorted(r["w"] for r in starts.distinct().join(lower.distinct(), "w", "left_semi").collect())


def words(marked_text: Column) -> Column:
    return F.split(marked_text, " ")


def template(marked_text: Column) -> Column:
    return F.regexp_replace(marked_text, rf"({MARK}[nup])[^ ]*", "$1")


def word_hashes(ws: Column) -> Column:
    """Hashes of words, of placeholders without their values."""
    return F.transform(ws, lambda w: F.xxhash64(F.when(w.startswith(MARK), w.substr(1, 2)).otherwise(w)))


def cut(a: Column | str, n: int) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - n, F.lit(0)))


def pairs(one: str) -> Column:
    return F.zip_with(cut(one, 1), F.slice(one, 2, F.greatest(F.size(one) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def windows_of(one: str, two: str, size: int = WINDOW) -> Column:
    """Hashes of all windows of so many words, in order, from the hashes of words and of pairs of words."""
    if size < 3:
        return F.col(one if size == 1 else two)
    if size == 3:
        return F.transform(cut(two, 1), lambda p, i: F.xxhash64(p, F.get(one, i + 2)))
    if size == 4:
        return F.transform(cut(two, 2), lambda p, i: F.xxhash64(p, F.get(two, i + 2)))
    return F.transform(cut(two, 3), lambda p, i: F.xxhash64(p, F.get(two, i + 2), F.get(one, i + 4)))


def with_windows(rows: DataFrame, size: int = WINDOW, text: str = "c") -> DataFrame:
    """rows with hs, the hashes of all windows of the words of text.

    Each step is a projection of its own that uses the one before more than once, which keeps Catalyst from computing it twice.
    """
    keep = [c for c in rows.columns if c != text]
    rows = rows.select(*keep, words(F.col(text)).alias("ws"))
    rows = rows.select(*keep, word_hashes(F.col("ws")).alias("one"))
    rows = rows.select(*keep, "one", pairs("one").alias("two"))
    return rows.select(*keep, windows_of("one", "two", size).alias("hs"))


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 64-bit hash of both, by which rows without doc_id, or with one that comes again, are told apart."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias(ROW))


def document_windows(docs: DataFrame, openers: list[str], anchors: list[int], short: list[int]) -> DataFrame:
    """(ROW, at, h) of the windows of both forms, of documents that have any of anchors among their plain words and pairs.

    The form's kind is mixed into the hash, for a join on one number. The row's number in the filter keeps Spark from pushing the filter
    to the scan, where every step would be copied into it; posexplode_outer keeps it from inferring such a filter.
    """
    rows = with_key(docs).where("text is not null").select(ROW, spaced(F.col("text")).alias("s"))
    rows = rows.select(ROW, "s", words(plain(F.col("s"))).alias("ws"))
    rows = rows.select(ROW, "s", F.transform("ws", lambda w: F.xxhash64(w)).alias("one"))
    rows = rows.select(ROW, "s", "one", pairs("one").alias("two"), F.monotonically_increasing_id().alias("at_row"))
    known = ", ".join(map(str, anchors))
    has = F.expr(f"exists(two, x -> x IN ({known})) OR exists(one, x -> x IN ({known}))") if anchors else F.lit(True)
    rows = rows.where(has & (F.col("at_row") >= 0))
    plain_form = F.array(*(windows_of("one", "two", n) for n in (*short, WINDOW)))
    rows = rows.select(ROW, plain_form.alias("plain"), marked(F.col("s")).alias("m"))
    rows = named(rows, openers)
    rows = with_windows(rows, text="m")
    rows = rows.select(ROW, F.explode(F.concat(F.transform("plain", lambda a: F.struct(F.lit(0).cast("long").alias("kind"), a.alias("hs"))), F.array(F.struct(F.lit(1).cast("long").alias("kind"), F.col("hs").alias("hs"))))).alias("f"))
    return rows.select(ROW, F.col("f.kind").alias("kind"), F.posexplode_outer("f.hs").alias("at", "h")).select(ROW, "at", F.col("h").bitwiseXOR(F.col("kind")).alias("h"))


def plain_windows(rows: DataFrame) -> DataFrame:
    """(item_id, kind 0, i, h, slots, size, said): the windows of each class of items with equal plain words; shorter items are one window."""
    rows = rows.select("item_id", plain(F.col("s")).alias("c")).where("c != ''").groupBy("c").agg(F.min("item_id").alias("item_id"))
    rows = rows.select("item_id", "c", words(F.col("c")).alias("w")).withColumn("size", F.least(F.size("w"), F.lit(WINDOW)))
    none = F.array().cast("array<struct<place:int,value:string>>")
    out = [with_windows(rows.where(F.col("size") == n), n) for n in range(1, WINDOW + 1)]
    out = reduce(DataFrame.union, out).select("item_id", F.lit(0).alias("kind"), F.posexplode("hs").alias("i", "h"), none.alias("slots"), "size", "w")
    return out.select("item_id", "kind", "i", "h", "slots", "size", F.slice("w", F.col("i") + 1, F.col("size")).alias("said"))


def template_windows(rows: DataFrame, openers: list[str]) -> DataFrame:
    """(item_id, kind 1, i, h, slots, size, said): the telling windows of each class of items with equal templates, whose placeholders repeat
    their values at the same places; slots has (place, value) of a window's placeholders."""
    rows = named(rows.select("item_id", marked(F.col("s")).alias("m")), openers).select("item_id", words(F.col("m")).alias("w"), template(F.col("m")).alias("c"))
    again = F.transform("w", lambda x: F.when(x.startswith(MARK), F.array_position("w", x)))
    rows = rows.groupBy("c", again.alias("again")).agg(F.min_by("w", "item_id").alias("w"), F.min("item_id").alias("item_id"))
    rows = with_windows(rows.select("item_id", "w", "c"))
    out = rows.select("item_id", "w", F.posexplode_outer("hs").alias("i", "h")).where("h is not null")
    window = F.slice("w", F.col("i") + 1, WINDOW)
    slots = F.filter(F.transform(window, lambda w, k: F.struct((F.col("i") + k).alias("place"), w.alias("value"))), lambda s: s["value"].startswith(MARK))
    return out.select("item_id", F.lit(1).alias("kind"), "i", "h", slots.alias("slots"), F.lit(WINDOW).alias("size"), window.alias("said")).where(F.size("slots") < WINDOW)


def item_windows(benchmark: DataFrame, openers: list[str]) -> DataFrame:
    rows = benchmark.where("text is not null and item_id is not null").select("item_id", spaced(F.col("text")).alias("s"))
    return plain_windows(rows).union(template_windows(rows, openers))


def anchors_of(items: DataFrame, coverage: float) -> DataFrame:
    """(a): hashes of plain words or pairs of words of which every document that covers an item has one at least.

    Of each window one pair of neighbouring words is taken, the longest, or its longest word if no two words are beside each other. A
    document that covers an item has all but (1 - coverage) of its windows; so of any more windows than these it has one, with its pair.
    The windows whose pairs are longest are taken.
    """
    said = F.transform("said", lambda w: F.when(~w.startswith(MARK), F.replace(w, F.lit("ß"), F.lit("ss"))))
    rows = items.select("item_id", "kind", "i", said.alias("w"))
    one = F.transform("w", lambda w: F.struct(F.lit(0).alias("two"), F.length(w).alias("n"), F.xxhash64(w).alias("a")))
    two = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(F.lit(1).alias("two"), (F.length(F.get("w", k - 1)) + F.length(F.get("w", k))).alias("n"), F.xxhash64(F.xxhash64(F.get("w", k - 1)), F.xxhash64(F.get("w", k))).alias("a")))
    told = F.filter(F.concat(one, F.when(F.size("w") > 1, two).otherwise(F.array().cast("array<struct<two:int,n:int,a:bigint>>"))), lambda p: p["n"].isNotNull())
    best = rows.select("item_id", "kind", "i", F.array_max(told).alias("b"))
    place = F.row_number().over(Window.partitionBy("item_id", "kind").orderBy(F.desc("b")))
    best = best.withColumns({"place": place, "n": F.count("*").over(Window.partitionBy("item_id", "kind"))})
    return best.where(F.col("place") <= F.floor(F.col("n") * (1 - coverage) + 1e-9) + 1).select(F.col("b.a").alias("a")).distinct()


#: What tells a document's rows apart: see with_key().
ROW = "_bidlake_row"
KEY = [ROW, "item_id", "kind"]
#: Anchors that a filter holds; with more of them all documents are read in both forms.
MOST_ANCHORS = 50_000


def alignments(shift: Column, n: Column) -> Column:
    """(start, width) of the runs of shifts that a match counts in: its own shift, and two of overlapping bands for insertions.

    Shifts that differ by a quarter of the item's windows at most are in one band together; copies that lie side by side never are.
    """
    step = F.greatest(F.lit(1), F.floor(n / 4)).cast("int")
    start = (shift - F.pmod(shift, step)).cast("int")
    run = lambda at, width: F.struct(at.cast("int").alias("start"), width.cast("int").alias("width"))
    return F.array(run(shift, F.lit(1)), run(start, 2 * step), run(start - step, 2 * step))


def verdicts(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8, consistency: float = 0.8) -> DataFrame:
    """(ROW, item_id, coverage, consistency) of the rows of docs that hold an item."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    openers = opening_words(benchmark)
    items = scratch.keep(item_windows(benchmark, openers), "item-windows")
    counts = items.groupBy("item_id", "kind").agg(F.count("*").alias("n"), F.sum(F.size("slots")).alias("n_slots"))
    short = sorted(r["size"] for r in items.where(F.col("size") < WINDOW).select("size").distinct().collect())
    total = items.count()
    anchors = [r["a"] for r in anchors_of(items, coverage).limit(MOST_ANCHORS + 1).collect()]
    anchors = anchors if len(anchors) <= MOST_ANCHORS else []
    parts = max(1, -(-total // PART_WINDOWS))
    found = []
    for k in range(parts):
        some = items.select("item_id", "kind", "i", F.col("h").bitwiseXOR(F.col("kind").cast("long")).alias("h")).where(F.pmod("h", F.lit(parts)) == k)  # PART_WINDOWS or so
        found.append(document_windows(docs, openers, anchors, short).join(F.broadcast(some), "h").select(*KEY, "at", "i"))
    matched = scratch.keep(reduce(DataFrame.union, found).distinct(), "matched")
    # A first sieve, which no alignment passes that fails it: windows of all alignments together.
    near = matched.select(*KEY, "i").distinct().groupBy(*KEY).agg(F.count("*").alias("k")).join(counts, ["item_id", "kind"])
    near = scratch.keep(near.where(F.col("k") / F.col("n") >= coverage).select(*KEY, "n", "n_slots"), "near")
    placed = matched.join(near, KEY).withColumn("shift", F.col("at") - F.col("i")).withColumn("a", F.explode(alignments(F.col("shift"), F.col("n"))))
    placed = placed.select(*KEY, "n", "n_slots", "a", "shift", "i")
    covered = placed.select(*KEY, "n", "n_slots", "a", "i").distinct().groupBy(*KEY, "n", "n_slots", "a").agg(F.count("*").alias("k"))
    covered = covered.withColumn("coverage", F.col("k") / F.col("n")).where(F.col("coverage") >= coverage)
    covered = scratch.keep(covered.select(*KEY, "n_slots", "a", "coverage"), "covered")

    # Slots are read from the documents that hold items with slots alone.
    asked = covered.where("n_slots > 0").select(*KEY, "a")
    texts = with_key(docs).join(broadcast_if_small(asked.select(ROW).distinct(), 40), ROW, "left_semi").dropDuplicates([ROW])
    texts = named(texts.select(ROW, marked(spaced(F.col("text"))).alias("m")), openers).select(ROW, words(F.col("m")).alias("w"))
    slots = placed.select(*KEY, "a", "shift", "i").join(asked, [*KEY, "a"]).join(items.select("item_id", "kind", "i", F.explode("slots").alias("s")), ["item_id", "kind", "i"])
    slots = slots.select(*KEY, "a", "shift", "s.place", "s.value").distinct()
    filled = slots.join(texts, ROW).select(*KEY, "a", "place", "value", F.element_at("w", (F.col("shift") + F.col("place") + 1).cast("int")).alias("other")).distinct()
    most = filled.groupBy(*KEY, "a", "value", "other").agg(F.count("*").alias("k")).groupBy(*KEY, "a", "value").agg(F.max("k").alias("most"))
    most = most.groupBy(*KEY, "a").agg(F.sum("most").alias("most"))
    places = filled.select(*KEY, "a", "place").distinct().groupBy(*KEY, "a").agg(F.count("*").alias("all"))
    each = most.join(places, [*KEY, "a"]).select(*KEY, "a", (F.col("most") / F.col("all")).alias("consistency"))
    out = covered.join(each, [*KEY, "a"], "left").select(*KEY, "coverage", F.coalesce("consistency", F.lit(1.0)).alias("consistency"))
    out = out.where(F.col("consistency") >= consistency).groupBy(ROW, "item_id").agg(F.max("coverage").alias("coverage"), F.max("consistency").alias("consistency"))
    return scratch.keep(out, "verdicts")


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8) -> DataFrame:
    """doc_id, n_items, items (ids in order, comma-joined, null if none), coverage (the highest, null if none), contaminated for every row of docs."""
    held = verdicts(docs, benchmark, coverage).groupBy(ROW).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("items"), F.max("coverage").alias("coverage"))
    out = with_key(docs).select("doc_id", ROW).join(broadcast_if_small(held, 200), ROW, "left")
    return out.select("doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), "items", "coverage", F.col("n_items").isNotNull().alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no item."""
    held = verdicts(docs, benchmark, coverage).select(ROW).distinct()
    return docs.withColumn(ROW, F.xxhash64("doc_id", "text")).join(broadcast_if_small(held, 40), ROW, "left_anti").select(*docs.columns)
