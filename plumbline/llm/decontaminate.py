"""Benchmark decontamination by templates, with DataFrame functions only.

Words become canonical: numbers, quantities, units and names are replaced with typed placeholders, all else is
lower case without punctuation around it. Windows of canonical words of the documents are hash-joined with those of the benchmark items.
Where enough of an item's windows match, the values in its placeholders are compared on the best alignment: they are consistent when
equal values stand for equal values, both ways. So a question with other numbers or names is caught, and
a text that merely has the same shape is not.

Two more kinds of windows find what these templates miss: templates in which a capitalised word at the start of a sentence is a name too,
unless it is a function word, and the words as they are in lower case, for copies whose case differs. A pair that the first
templates find is judged by them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import keep
from plumbline.operators.joins import hold

SPACE = r"[ \t\n\x0B\f\r]+"
AROUND = r"^[^\p{L}\p{N}$€£]+|[^\p{L}\p{N}%]+$"
NUMBER = r"^[$€£]?[0-9][0-9.,/:]*%?$"
QUANTITY = r"^[0-9][0-9.,]*[a-zµ°]{1,4}$"
NAME = r"^\p{Lu}\p{Ll}+$"
MARKED = r"^[\p{Lu}0-9$€£]"
SENTENCE_END = r"[.!?:]$"
FUNCTION_WORDS = """a about after all also although an and another any are as at because before both but by can could did do does during each either
every few find for from had has have he her here his how i if in is it its let many may more most much my neither no nor not now of on once one only
or our out over she should since so some such than that the their them then there these they this those though through to under until up was we were
what when where whether which while who whose why will with would yes yet you your""".split()
#: Kinds of windows: templates, templates with names at the starts of sentences, words in lower case.
TEMPLATE, NAMED, LITERAL = 1, 2, 3
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
UNITS = """mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers
mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres
second seconds minute minutes hour hours day days week weeks month months year years
cent cents dollar dollars euro euros percent degrees mph kmh""".split()


@dataclass(frozen=True)
class TemplateSettings:
    """``window``: words per template window. ``min_literals``: fewer words that are no placeholder make a window too
    common to tell anything; such windows of the benchmark are left out. ``min_share``: matched share of an item's windows.
    ``min_words``: fewest equal words on the best alignment (all words of a shorter item) of a pair that only the other kinds of windows find.
    ``template_words``: the same for pairs that the first templates find; 0 asks for none. ``min_consistent``: below 1, a pair is contaminated too if this share of its
    slots has the value that stands most often for the item's value.
    ``broadcast_rows``: a table of more rows (of a few numbers each) than this is joined by shuffle."""

    window: int = 5
    min_literals: int = 3
    min_share: float = 0.5
    min_words: int = 8
    template_words: int = 0
    min_consistent: float = 1.0
    broadcast_rows: int = 500_000


def _canonical(core: Column, at: Column, cores: Column, words: Column) -> Column:
    before = F.element_at(cores, at)
    after_number = (at > 0) & (before.rlike(NUMBER) | F.lower(before).isin(NUMBER_WORDS))
    marked = (
        F.when(core.rlike(NUMBER), "<number>")
        .when(core.rlike(QUANTITY), "<quantity>")
        .when((at > 0) & core.rlike(NAME) & ~F.element_at(words, at).rlike(SENTENCE_END), "<name>")
        .otherwise(F.lower(core))
    )
    plain = F.when(core.isin(NUMBER_WORDS), "<number>").when(core.isin(UNITS) & after_number, "<unit>").otherwise(core)
    # most words begin with a to z, which is compared faster than a pattern is searched
    return F.when(((core < "a") | (core >= "{")) & core.rlike(MARKED), marked).otherwise(plain)


def templates(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` with ``cores`` (words without punctuation around them) and ``canon`` (canonical words). Words of punctuation
    alone are left out. A null or empty text has no words."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    first = hold(rows.select(*keys, words.alias("words")))
    second = hold(first.select(*keys, "words", F.transform("words", lambda w: F.regexp_replace(w, AROUND, "")).alias("cores")))
    canon = F.transform("cores", lambda c, i: _canonical(c, i, F.col("cores"), F.col("words")))
    return hold(second.select(*keys, "cores", canon.alias("canon")))


def _named(canon: Column, core: Column) -> Column:
    """A canonical word in which a capitalised word is a name wherever it stands."""
    return F.when(canon == core, canon).when(~canon.startswith("<") & core.rlike(NAME) & ~canon.isin(FUNCTION_WORDS), "<name>").otherwise(canon)


def _windows(table: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``keys``, the place and the hashes ``w1`` to ``w3`` (by kind) of each window of words."""
    named = F.zip_with("canon", "cores", lambda k, c: F.xxhash64(_named(k, c)))
    folded = F.transform("cores", lambda c: F.xxhash64(F.lower(c)))
    hashed = hold(table.select(*keys, F.transform("canon", lambda c: F.xxhash64(c)).alias("h1"), named.alias("h2"), folded.alias("h3")))
    # the words of a window stand side by side in a row before they are hashed: functions of rows are compiled, those inside lambdas are not
    places = F.greatest(F.size("h1") - size + 1, F.lit(0))
    shifted = [F.slice(f"h{k}", i, places).alias(f"h{k}_{i}") for k in (1, 2, 3) for i in range(1, size + 1)]
    rows = hashed.select(*keys, F.posexplode(F.arrays_zip(*shifted)).alias("place", "v"))
    return rows.select(*keys, "place", *(F.xxhash64(*(F.col(f"v.h{k}_{i}") for i in range(1, size + 1))).alias(f"w{k}") for k in (1, 2, 3)))


def _short_windows(table: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """``keys``, the place and ``window`` of each run of ``sizes`` words in lower case; fewer than three words must be the whole text."""
    hashed = hold(table.select(*keys, F.transform("cores", lambda c: F.xxhash64(F.lower(c))).alias("h3")))

    def of(n):
        fits = F.size("h3") >= n if n > 2 else F.size("h3") == n
        places = F.when(fits, F.sequence(F.lit(1), F.size("h3") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct((i - 1).alias("place"), F.xxhash64(F.slice("h3", i, n)).alias("window")))

    return hashed.select(*keys, F.explode(F.concat(*map(of, sizes))).alias("w")).select(*keys, "w.*")


def _of_kinds(windows: DataFrame) -> DataFrame:
    """A row per different hash of a place, as ``window``."""
    return windows.withColumn("window", F.explode(F.array_distinct(F.array("w1", "w2", "w3"))))


def _small(table: DataFrame, rows: int) -> DataFrame:
    """The table for a join: broadcast when it has been counted and is small, else left to a shuffled join."""
    return F.broadcast(table) if table.count() <= rows else table


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: TemplateSettings = TemplateSettings(), id_column: str = "doc_id", item_column: str = "item_id", text: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item of which at least ``min_share`` of the windows of a kind are in the document.

    Rows: the ids, ``n_windows`` of the item (of the first kind that finds the pair), ``n_matched`` of them, ``n_slots`` (placeholders in matched windows on the best
    alignment), ``changed_slots`` (those whose value differs), ``consistent`` and ``contaminated`` (= consistent, if ``min_consistent`` is 1). Null and
    empty texts match nothing. Items with fewer words than a window are one window, of their words as they are; with fewer than three words they match only a text that
    has no others. Rows that repeat with id and text give one pair; a null
    id is kept. Several items, or copies of an item, give a pair each. Empty tables give no rows.
    """
    size = settings.window
    items = benchmark.select(F.col(item_column).alias("item"), F.col(text).alias("text")).distinct()
    items = templates(items, ["item", "text"]).withColumn("key", F.xxhash64("item", "text"))
    literal = lambda c: ~c.startswith("<")
    items = keep(items.withColumn("named", F.zip_with("canon", "cores", _named)).withColumn("folded", F.transform("cores", lambda c: F.lower(c))))

    def usable(canon):
        enough = lambda i: F.when(F.size(canon) - i + 1 >= size, F.size(F.filter(F.slice(canon, i, size), literal)) >= settings.min_literals).otherwise(F.lit(False))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(canon) - size + 1, F.lit(1))), enough)

    ok = items.select("key", usable("canon").alias("ok1"), usable("named").alias("ok2"))
    at = F.col("place") + 1
    wanted = [F.when(F.element_at("ok1", at), F.struct(F.lit(TEMPLATE).alias("kind"), F.col("w1").alias("window"))), F.when(F.element_at("ok2", at), F.struct(F.lit(NAMED).alias("kind"), F.col("w2").alias("window"))), F.struct(F.lit(LITERAL).alias("kind"), F.col("w3").alias("window"))]
    index = _windows(items, ["key"], size).join(ok, "key").select("key", F.col("place").alias("item_place"), F.explode(F.filter(F.array(*wanted), lambda w: w.isNotNull())).alias("w"))
    sizes = sorted(r["n"] for r in items.select(F.size("canon").alias("n")).where(f"n between 1 and {size - 1}").distinct().collect())
    whole = items.where(F.size("canon").between(1, size - 1)).select("key", F.lit(0).alias("item_place"), F.lit(LITERAL).alias("kind"), F.xxhash64(F.transform("folded", lambda c: F.xxhash64(c))).alias("window"))
    index = keep(index.select("key", "item_place", "w.*").unionAll(whole))
    totals = index.groupBy("key", "kind").agg(F.count("*").alias("n_windows"))

    keys = ["id", "t1", "t2"]
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_column).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), F.col(text)).alias("t2"), F.col(text).alias("text"))
    canonical, small = templates(rows, keys), _small(index, settings.broadcast_rows)
    found = _of_kinds(_windows(canonical, keys, size)).join(small, "window")
    # the hash of one kind says nothing of another
    found = found.where(F.col("window") == F.when(F.col("kind") == TEMPLATE, F.col("w1")).when(F.col("kind") == NAMED, F.col("w2")).otherwise(F.col("w3"))).select(*keys, "key", "kind", "place", "item_place")
    if sizes:
        short = _short_windows(canonical, keys, sizes).join(small, "window").where(F.col("kind") == LITERAL)
        found = found.unionAll(short.select(found.columns))
    # the places of an item are bounded by its length, so its sets are too
    lines = found.groupBy(*keys, "key", "kind", (F.col("place") - F.col("item_place")).alias("shift")).agg(F.collect_set("item_place").alias("places"))
    pairs = lines.groupBy(*keys, "key", "kind").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_matched"),
        F.max_by(F.struct("shift", "places"), F.struct(F.size("places"), -F.col("shift"))).alias("best"),
    )
    pairs = keep(pairs.join(totals, ["key", "kind"]).where(F.col("n_matched") >= F.col("n_windows") * settings.min_share))

    matched = rows.join(_small(pairs, settings.broadcast_rows // 10), keys).distinct()
    matched = templates(matched, [*keys, "key", "kind", "n_matched", "n_windows", "best"])
    own = lambda canon, cores: F.when(F.col("kind") == TEMPLATE, canon).when(F.col("kind") == NAMED, F.zip_with(canon, cores, _named)).otherwise(F.transform(cores, lambda c: F.lower(c)))
    matched = hold(matched.select(*keys, "key", "kind", "n_matched", "n_windows", "best", F.col("cores").alias("doc_cores"), own(F.col("canon"), F.col("cores")).alias("doc_canon")))
    words = F.when(F.col("kind") == TEMPLATE, F.col("canon")).when(F.col("kind") == NAMED, F.col("named")).otherwise(F.col("folded"))
    both = hold(matched.join(items.select("key", "item", "cores", "canon", "named", "folded"), "key").withColumn("canon", words).drop("named", "folded"))
    shift = F.col("best.shift")
    same = F.size(F.filter(F.transform("canon", lambda c, i: c == F.get("doc_canon", i + shift)), lambda x: x))
    least = F.when(F.col("kind") == TEMPLATE, settings.template_words).otherwise(settings.min_words)
    both = both.where(same >= F.least(F.size("canon"), least))
    covered = F.array_distinct(F.flatten(F.transform("best.places", lambda p: F.sequence(p, p + size - 1))))
    slots = F.when(F.col("kind") == LITERAL, F.array().cast("array<int>")).otherwise(F.filter(covered, lambda p: ~literal(F.element_at("canon", p + 1))))
    both = hold(both.select(*keys, "key", "kind", "item", "n_windows", "n_matched", "cores", "doc_cores", shift.alias("shift"), slots.alias("slots")))
    value = F.transform("slots", lambda p: F.struct(F.lower(F.element_at("cores", p + 1)).alias("a"), F.lower(F.element_at("doc_cores", p + F.col("shift") + 1)).alias("b")))
    both = both.select(*keys, "key", "kind", F.struct("item", "n_windows", "n_matched", value.alias("values")).alias("pair"))
    # of the kinds that find a pair, the first judges it
    both = hold(both.groupBy(*keys, "key").agg(F.min_by("pair", "kind").alias("pair")).select("id", "pair.*"))
    kinds = F.size(F.array_distinct("values"))
    consistent = (kinds == F.size(F.array_distinct("values.a"))) & (kinds == F.size(F.array_distinct("values.b")))
    judged = consistent
    if settings.min_consistent < 1:
        alike = lambda v: F.size(F.filter("values", lambda u: u == v))
        most = lambda a: F.array_max(F.transform(F.filter("values", lambda v: v["a"] == a), alike))
        agreed = F.aggregate(F.transform(F.array_distinct("values.a"), most), F.lit(0), lambda x, n: x + n)
        judged = consistent | (agreed >= F.size("values") * settings.min_consistent)
    return both.select(
        F.col("id").alias(id_column),
        F.col("item").alias(item_column),
        "n_windows",
        F.col("n_matched").cast("long").alias("n_matched"),
        F.size("values").cast("long").alias("n_slots"),
        F.size(F.filter("values", lambda v: v["a"] != v["b"])).cast("long").alias("changed_slots"),
        consistent.alias("consistent"),
        judged.alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, settings: TemplateSettings = TemplateSettings(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id has no contaminated pair. Rows with a null id stay when no row with a null id is contaminated."""
    bad = keep(contaminated(docs, benchmark, settings, id_column, text=text).where("contaminated").select(F.col(id_column).alias("__id")).distinct())
    bad = _small(bad, settings.broadcast_rows)
    return docs.join(bad, docs[id_column].eqNullSafe(F.col("__id")), "left_anti")
