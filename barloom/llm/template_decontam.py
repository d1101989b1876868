"""Benchmark decontamination by templates: finds test items in documents even when numbers, names or units were changed.

Only column expressions and joins are used.

1. Texts become tokens (runs of letters and digits). Numbers, units behind a number and capitalised words become typed
   placeholders; any capital may be a name, at the start of a sentence too. In a second wording of every text, words
   are folded to one case and none is a name, so a copy that only changes letter case is met there.
2. Windows of WINDOW tokens are hashed; windows of documents meet the benchmark's windows in a hash join. An item of
   fewer tokens is one window of its own length. Windows of an item with fewer than LITERALS ordinary words are left
   out, since they say too little; an item that keeps none in either wording, being short or full of numbers, is looked
   for in a third wording: folded words and literal numbers, without placeholders. Documents are read in that wording,
   and in windows of less than WINDOW tokens, only if the benchmark has such items.
3. A document that holds at least COVER of an item's windows is a candidate. Every alignment of a candidate with the
   item has its slots compared: wherever the item has one value, the document must have one value too. Slots that change
   consistently are a re-parameterised question; slots that don't are another text of the same form. The alignments that
   are consistent must hold COVER of the item's windows.

The benchmark's windows are broadcast when there are at most BROADCAST_ROWS of them (16 bytes each), and shuffled
otherwise; documents are never collected, and a window is matched by one row whatever document it is from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import load, query, rows_of, stage

WINDOW, LITERALS, COVER = 8, 5, 0.5
#: Fewest tokens of an item that is looked for.
SHORTEST = 4
#: Least share of an item's slot values that map to one value in the document.
CONSISTENT = 0.8
BROADCAST_ROWS = 1_000_000

#: Units that count as such behind a number: a fixed list.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes "
    "ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years percent dollar dollars cent cents euro euros usd eur gbp "
    "mph kmh degree degrees celsius fahrenheit w kw kwh v volt volts hz khz mhz ghz kb mb gb tb"
).split()


def tokens(text: Column) -> Column:
    """Tokens with their case; the digit groups of one number are joined."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[0-9])[.,:](?=[0-9])", "")
    return F.array_remove(F.split(joined, r"[^\p{L}\p{N}]+"), "")


def _is_number(token: Column) -> Column:
    return (token >= "0") & (token < ":")


def canonical(toks: Column) -> Column:
    """Every token's placeholder, or else its lower-case text."""

    def one(all_tokens: Column, token: Column, at: Column) -> Column:
        initial = F.substring(token, 1, 1)
        low = F.lower(token)
        return (
            F.when(_is_number(token), "#num")
            .when(initial != F.lower(initial), "#name")
            .when((at > 0) & _is_number(F.get(all_tokens, at - 1)) & low.isin(UNITS), "#unit")
            .otherwise(low)
        )

    return _let(toks, lambda all_tokens: F.transform(all_tokens, lambda t, at: one(all_tokens, t, at)))


def folded(toks: Column) -> Column:
    """Every token's placeholder, or else its text without letter case; no word is a name."""
    # Upper case first: some small letters (ß) share a capital spelling with others.
    low = F.transform(toks, lambda t: F.lower(F.upper(t)))

    def one(words: Column, word: Column, at: Column) -> Column:
        unit = (at > 0) & _is_number(F.get(words, at - 1)) & word.isin(UNITS)
        return F.when(_is_number(word), "#num").when(unit, "#unit").otherwise(word)

    return _let(low, lambda words: F.transform(words, lambda w, at: one(words, w, at)))


def literal(toks: Column) -> Column:
    """Every token without letter case, numbers as they stand."""
    return F.transform(toks, lambda t: F.lower(F.upper(t)))


#: The wordings by number (`fold`): typed, folded, literal.
WORDINGS = (canonical, folded, literal)
#: What tells hashes of one wording and width from those of another.
FOLD_BITS, WIDTH_BITS = 0x5851F42D4C957F2D, 0x14057B7EF767814F


def _mark(fold: int, width: int) -> int:
    return (fold * FOLD_BITS + (WINDOW - width) * WIDTH_BITS) % (1 << 63)


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def window_hashes(canon: Column, width: int = WINDOW) -> Column:
    """Hashes of all windows of `width` (SHORTEST to WINDOW) tokens, in order, from hashes of 1, 2 and 4 tokens."""

    def joined(hashes: Column, more: Column, ahead: int) -> Column:
        later = F.slice(more, ahead + 1, F.greatest(F.size(more), F.lit(1)))
        return F.zip_with(hashes, later, lambda a, b: F.xxhash64(a, b))

    def wide(one: Column, two: Column, four: Column) -> Column:
        if width == WINDOW:
            return joined(four, four, 4)
        rest = {4: lambda: four, 5: lambda: joined(four, one, 4), 6: lambda: joined(four, two, 4)}
        return rest[width]() if width in rest else joined(joined(four, two, 4), one, 6)

    def whole(hashes: Column) -> Column:
        return F.slice(hashes, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0)))

    return _let(
        F.transform(canon, lambda t: F.xxhash64(t)),
        lambda one: _let(joined(one, one, 1), lambda two: _let(joined(two, two, 2), lambda four: _let(wide(one, two, four), whole))),
    )


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(hash, item_id, fold, width, at, total) of every window worth looking for; equal items are one, under their smallest id.

    fold: the wording, of which an item has a total of its own. Items without a window in the first two have the third.
    """
    items = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), tokens(F.col(text_col)).alias("toks"))
    items = items.groupBy("toks").agg(F.min("item_id").alias("item_id")).withColumn("width", F.least(F.size("toks"), F.lit(WINDOW)))
    items = items.filter(F.col("width") >= SHORTEST).withColumn("item", F.xxhash64("toks"))
    spelled = _let(F.col("toks"), lambda t: F.array(*[w(t) for w in WORDINGS]))
    items = items.select("item_id", "item", "width", F.posexplode(spelled).alias("fold", "canon"))
    hashes = F.when(F.col("width") == WINDOW, window_hashes(F.col("canon")))
    for width in range(SHORTEST, WINDOW):
        hashes = hashes.when(F.col("width") == width, window_hashes(F.col("canon"), width))
    rows = items.select("item_id", "item", "width", "fold", "canon", F.posexplode(hashes).alias("at", "hash"))
    words = F.size(F.filter(F.slice(F.col("canon"), F.col("at") + 1, F.col("width")), lambda t: ~t.startswith("#")))
    rows = rows.withColumn("words", words).drop("canon")
    said = rows.filter((F.col("fold") < 2) & (F.col("words") >= LITERALS))
    rows = said.unionByName(rows.filter("fold = 2").join(said.select("item").distinct(), "item", "left_anti").select(said.columns))
    mark = F.coalesce(*[F.when((F.col("fold") == f) & (F.col("width") == w), F.lit(_mark(f, w))) for f in range(3) for w in range(SHORTEST, WINDOW + 1)])
    rows = rows.select(F.col("hash").bitwiseXOR(mark).alias("hash"), "item_id", "item", "fold", "width", "at")
    totals = rows.groupBy("item", "fold").agg(F.count(F.lit(1)).alias("total"))
    return rows.join(totals, ["item", "fold"]).select("hash", "item_id", "fold", "width", "at", "total")


def text_hashes(text: Column, streams: list[tuple[int, int]]) -> Column:
    """Per (wording, width) in `streams` the hashes of a text's windows."""

    def read(spelled: Column) -> Column:
        return F.array(*[window_hashes(F.get(spelled, fold), width) for fold, width in streams])

    used = 1 + max(fold for fold, _ in streams)
    return _let(tokens(text), lambda toks: _let(F.array(*[w(toks) for w in WORDINGS[:used]]), read))


def _bounded(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if rows_of(table) <= BROADCAST_ROWS else table


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id, coverage, shift) of documents that hold a benchmark item or a consistent variant of it.

    coverage is the share of the item's windows met where slots are consistent; shift is the alignment that meets most.

    * Null texts, and texts and items of fewer than SHORTEST tokens, match nothing; no text of so few words is called a
      leak. An item of fewer than WINDOW tokens is met where it stands whole.
    * Equal items are reported under the smallest of their ids; a null item id is smaller than none.
    * Rows sharing a doc_id are judged together; a null doc_id is reported as null.
    * Other columns are not read, in either table. Empty tables give an empty result.
    """
    sought = stage(item_windows(benchmark), "item-windows")
    # At most three wordings of five widths.
    streams = sorted((r["fold"], r["width"]) for r in sought.select("fold", "width").distinct().collect()) or [(0, WINDOW)]
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # `part` tells rows that share a doc_id apart.
    texts = texts.withColumn("part", F.xxhash64("text"))
    read = texts.select("doc_id", "part", F.posexplode(text_hashes(F.col("text"), streams)).alias("stream", "hashes"))
    read = read.select("doc_id", "part", "stream", F.posexplode("hashes").alias("place", "hash"))
    mark = F.coalesce(*[F.when(F.col("stream") == i, F.lit(_mark(*which))) for i, which in enumerate(streams)])
    read = read.select("doc_id", "part", "place", F.col("hash").bitwiseXOR(mark).alias("hash"))
    hits = read.join(_bounded(sought), "hash")
    # A window of the item counts once, however often the document repeats it. Places are bits of words of 64, so that
    # partial sums shrink a passage met in very many documents to a few rows per document and item.
    shift = (F.col("place") - F.col("at")).alias("shift")
    aligned = hits.groupBy("doc_id", "part", "item_id", "fold", shift, F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("met"),
        F.max("total").alias("total"),
        F.min("at").alias("low"),
        F.max("at").alias("high"),
    )
    aligned = stage(aligned, "aligned")
    candidates = _coverage(aligned).filter(F.col("coverage") >= COVER)
    aligned = stage(_at(aligned, candidates, "doc_id", "item_id", "fold").drop("coverage"), "candidates")
    fitting = _at(aligned, _consistent(aligned, texts, benchmark), "doc_id", "part", "item_id", "fold", "shift")
    fitting = stage(fitting, "fitting")
    best = fitting.groupBy("doc_id", "part", "item_id", "fold", "shift").agg(F.sum(F.bit_count("met")).alias("n"))
    best = best.groupBy("doc_id", "item_id", "fold").agg(F.max_by("shift", F.struct("n", -F.col("shift"))).alias("shift"))
    found = _at(best, _coverage(fitting).filter(F.col("coverage") >= COVER), "doc_id", "item_id", "fold")
    # The wording that covers more, the typed one on ties.
    one = F.max_by(F.struct("coverage", "shift"), F.struct("coverage", -F.col("fold"))).alias("one")
    return found.groupBy("doc_id", "item_id").agg(one).select("doc_id", "item_id", "one.coverage", "one.shift")


def _coverage(aligned: DataFrame) -> DataFrame:
    """(doc_id, item_id, fold, coverage): the share of the item's windows that were met at any of the shifts."""
    words = aligned.groupBy("doc_id", "item_id", "fold", "word").agg(F.bit_or("met").alias("met"), F.max("total").alias("total"))
    return words.groupBy("doc_id", "item_id", "fold").agg((F.sum(F.bit_count("met")) / F.max("total")).alias("coverage"))


def _at(rows: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Rows joined with another table on keys that may be null."""
    renamed = other.select(*[F.col(k).alias(f"o_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    met = [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys]
    return rows.join(renamed, met).drop(*[f"o_{k}" for k in keys])


def _consistent(aligned: DataFrame, texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, part, item_id, fold, shift) of the alignments whose slots are consistent between the first and last window met."""
    spans = aligned.groupBy("doc_id", "part", "item_id", "fold", "shift").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # All alignments of a text and an item in one row, so that the text is cut into tokens once.
    spans = spans.groupBy("doc_id", "part", "item_id", "fold").agg(F.collect_list(F.struct("shift", "low", "high")).alias("spans"))
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), tokens(F.col("text")).alias("item"))
    items = items.groupBy("item_id").agg(F.min("item").alias("item"))
    paired = _at(_at(spans, texts.dropDuplicates(["doc_id", "part"]), "doc_id", "part"), items, "item_id")
    paired = paired.select("doc_id", "part", "item_id", "fold", "spans", "item", tokens(F.col("text")).alias("doc"))

    def slots(item: Column, doc: Column, item_kind: Column, doc_kind: Column, span: Column) -> Column:
        """Distinct (item's value, document's value) where both have the same placeholder."""
        place = F.filter(
            F.sequence(span["low"], F.least(span["high"] + WINDOW, F.size(item)) - 1),
            lambda i: F.get(item_kind, i).startswith("#") & (F.get(item_kind, i) == F.coalesce(F.get(doc_kind, i + span["shift"]), F.lit(""))),
        )
        both = F.transform(
            place, lambda i: F.struct(F.lower(F.get(item, i)).alias("item"), F.lower(F.get(doc, i + span["shift"])).alias("doc"))
        )
        return F.array_distinct(both)

    def fits(pairs: Column) -> Column:
        values = F.size(F.array_distinct(F.transform(pairs, lambda p: p["item"])))
        return (F.size(pairs) == 0) | (values >= CONSISTENT * F.size(pairs))

    def fitting(item: Column, doc: Column, item_kind: Column, doc_kind: Column) -> Column:
        return F.filter("spans", lambda span: _let(slots(item, doc, item_kind, doc_kind, span), fits))

    def kinds(toks: Column) -> Column:
        return F.when(F.col("fold") == 0, canonical(toks)).when(F.col("fold") == 1, folded(toks)).otherwise(literal(toks))

    kept = _let(
        F.col("item"),
        lambda item: _let(
            F.col("doc"), lambda doc: _let(kinds(item), lambda ik: _let(kinds(doc), lambda dk: fitting(item, doc, ik, dk)))
        ),
    )
    told = paired.select("doc_id", "part", "item_id", "fold", F.explode(kept).alias("span"))
    return told.select("doc_id", "part", "item_id", "fold", "span.shift")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, items (ids of the items found, ascending).

    Rows that share a doc_id have a row each, with the items of them all; null texts and empty tables as in `leaks`.
    """
    found = leaks(docs, benchmark).groupBy(F.col("doc_id").alias("f_id")).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    joined = ids.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")), "left")
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return joined.select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.size(items).cast("bigint").alias("n_items"), items.alias("items")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without leaks, with all their columns (pipeline stage).

    * Null and empty texts stay. Rows sharing a doc_id go or stay together, also rows of the null doc_id.
    * Other columns are not read and are kept. Without documents or items nothing goes.
    """
    bad = stage(leaks(docs, benchmark).select(F.col("doc_id").alias("__leaked")).distinct(), "leaked")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__leaked"]), "left_anti")


@query("op7_template_decontam")
def _op7(spark, sf_dir):
    return report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
