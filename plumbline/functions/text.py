"""Column functions over texts: tokens, attribute profiles, negation-aware report tests."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import lexicon as L


def words(terms) -> Column:
    """A constant array, as one piece of SQL text (a literal column per word would make plans slow to build)."""
    quoted = [t.replace("\\", "\\\\").replace("'", "\\'") for t in terms]
    return F.expr("array(" + ", ".join(f"'{t}'" for t in quoted) + ")") if quoted else F.array().cast("array<string>")


def normalize_text(text: Column) -> Column:
    spaced = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("_"), F.lit(" "))
    return F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def _listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def spelled(t: str) -> str:
    return f"CASE {t} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.SPELLING.items()) + f" ELSE {t} END"


def stemmed(t: str) -> str:
    """The first suffix rule that applies, as SQL text (one expression; array functions take it as a lambda body)."""

    def rule(least: int, suffixes: str, result: str) -> str:
        ends = " OR ".join(f"endswith({t}, '{s}')" for s in suffixes.split())
        return f"WHEN length({t}) > {least} AND ({ends}) THEN {result}"

    def cut(n: int) -> str:
        return f"substring({t}, 1, length({t}) - {n})"

    past = f"CASE WHEN endswith({cut(2)}, 'c') THEN {cut(2)} || 'e' ELSE {cut(2)} END"
    rules = [
        rule(6, "ations", cut(6)),
        rule(5, "ation", cut(5)),
        rule(5, "ities", f"{cut(5)} || 'y'"),
        rule(4, "ity", cut(3)),
        rule(5, "ness", cut(4)),
        rule(5, "ive ing", cut(3)),
        rule(4, "ed", past),
        rule(4, "ches shes sses xes zes", cut(2)),
        rule(3, "es s", cut(1)),
    ]
    return f"CASE {' '.join(rules)} ELSE {t} END"


def _normalized(t: str) -> str:
    """Spelling, suffix rule, spelling."""
    return f"transform(array({spelled(t)}), v -> transform(array({stemmed('v')}), w -> {spelled('w')})[0])[0]"


def normalize_token(name: str) -> Column:
    return F.expr(_normalized(name))


def normalized_each(name: str) -> Column:
    """Normalized tokens of an array column, in order."""
    return F.expr(f"transform({name}, t -> {_normalized('t')})")


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))


def tokens(name: str) -> Column:
    """Set of normalized tokens of a text column without stop words, as a distinct array."""
    stop = _listed(L.STOP_TOKENS)
    plain = f"trim(regexp_replace(replace(lower(coalesce({name}, '')), '_', ' '), '(?U)\\\\s+', ' '))"
    raw = f"array_distinct(regexp_extract_all({plain}, '[a-z0-9]+', 0))"
    kept = f"filter({raw}, t -> length(t) > 1 AND t NOT IN {stop})"
    stems = f"transform({kept}, t -> {_normalized('t')})"
    return F.expr(f"array_distinct(filter({stems}, t -> length(t) > 1 AND t NOT IN {stop}))")


def ordered_tokens(name: str) -> Column:
    """Normalized tokens of a text column in order, stop words included."""
    return F.expr(f"transform(regexp_extract_all({name}, '[a-z0-9]+', 0), t -> {_normalized('t')})")


@cache
def _normalized_lists() -> dict[str, list[str]]:
    """The fixed word lists in normalized form, so they enter plans as constants."""
    lists = {**L.ATTRIBUTES, "weak": L.WEAK_TOKENS}
    raw = SparkSession.active().range(1).select(*[words(w).alias(n) for n, w in lists.items()])
    return raw.select(*[F.array_sort(F.array_distinct(normalized_each(n))).alias(n) for n in lists]).first().asDict()


def weak_tokens() -> Column:
    return words(_normalized_lists()["weak"])


def attribute_hits(name: str) -> Column:
    """Map attribute -> hit terms (only attributes with hits), from a token array column."""
    known = _normalized_lists()
    entries = ", ".join(
        f"named_struct('key', '{a}', 'value', array_intersect(array{_listed(known[a])}, {name}))" for a in L.ATTRIBUTES
    )
    return F.expr(f"map_from_entries(filter(array({entries}), e -> size(e.value) > 0))")


def attribute_overlap(left: Column, right: Column) -> Column:
    """Map of attributes on both sides -> sorted union of their hit terms."""
    shared = F.array_sort(F.array_intersect(F.map_keys(left), F.map_keys(right)))
    return F.map_from_entries(
        F.transform(
            shared,
            lambda k: F.struct(
                k.alias("key"),
                F.array_sort(F.array_union(F.element_at(left, k), F.element_at(right, k))).alias("value"),
            ),
        )
    )


def term_count(overlap: Column) -> Column:
    return F.aggregate(F.map_values(overlap), F.lit(0), lambda n, hits: n + F.size(hits))


def overlap_text(overlap: Column) -> Column:
    """attr(a, b); attr(c) in attribute order."""
    entries = F.array_sort(F.map_entries(overlap))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("("), F.array_join(e["value"], ", "), F.lit(")"))), "; "
    )


def is_valid(text: Column) -> Column:
    """Not empty and not N/A."""
    return text.isNotNull() & (text != "") & (F.upper(F.trim(text)) != "N/A")


def affirms(token_list: Column, targets: list[str], window: int = 18) -> Column:
    """Some target word stands outside a negated span.

    A word is negated when, among the ``window`` words before it, the last negation comes
    after the last reset word. "hole" is passed over when a benign word is among the last 8.
    """
    at = F.array_compact(F.transform(token_list, lambda t, i: F.when(t.isin(targets), i)))

    def affirmed(i: Column) -> Column:
        span = F.least(i, F.lit(window))
        context = F.slice(token_list, i - span + 1, span)
        near = F.least(i, F.lit(8))
        benign = (F.get(token_list, i) == "hole") & F.exists(
            F.slice(token_list, i - near + 1, near), lambda t: t.isin(L.BENIGN_HOLE_WORDS)
        )
        negated = F.aggregate(
            context,
            F.lit(False),
            lambda acc, t: F.when(t.isin(L.NEGATIONS), True).when(t.isin(L.RESETS), False).otherwise(acc),
        )
        return ~benign & ~negated

    return F.exists(at, affirmed)


ANOMALY_WORDS = sorted({t for terms in L.ATTRIBUTES.values() for t in terms} | set(L.EXTRA_ANOMALY_WORDS))


def has_normal_phrase(normalized: Column) -> Column:
    return normalized.rlike("|".join(L.NORMAL_PHRASES))


def reports_normal(normalized: Column, token_list: Column) -> Column:
    """A normal / no-defect phrase and no affirmed anomaly word. Takes the normalized text and its ordered tokens."""
    return has_normal_phrase(normalized) & ~affirms(token_list, ANOMALY_WORDS)


def prefers_normal(task: Column, options: Column, local_evidence: Column, token_list: Column) -> Column:
    """Unsupported surface-only claims of a yes/no anomaly question count as normal."""
    option_text = F.lower(F.array_join(F.map_values(options), " "))
    applies = (F.lower(F.coalesce(task, F.lit(""))) == "anomaly detection") & ~local_evidence & options.isNotNull()
    yes_no = option_text.contains("yes") & option_text.contains("no")
    surface = F.exists(token_list, lambda t: t.isin(L.SURFACE_TERMS))
    return F.coalesce(applies & yes_no & surface & ~affirms(token_list, L.DECISIVE_TERMS), F.lit(False))


def location_terms(option: Column) -> Column:
    text = normalize_text(option)
    return F.array_compact(F.array(*[F.when(text.rlike(p), term) for term, p in L.LOCATION_PATTERNS.items()]))


def location_score(primary: Column, option: Column) -> Column:
    """Agreement of an option's location terms with a region's; null without option terms."""

    def both(term: str) -> Column:
        return F.array_contains(primary, term) & F.array_contains(option, term)

    def against(a: str, b: str) -> Column:
        return F.array_contains(primary, a) & F.array_contains(option, b)

    score = F.lit(0.0)
    for term, gain in (("left", 2.0), ("right", 2.0), ("top", 2.0), ("bottom", 2.0), ("center", 1.5), ("slightly", 0.5)):
        score = score + F.when(both(term), gain).otherwise(0.0)
    in_corner = F.arrays_overlap(primary, words(["top", "bottom"])) & F.arrays_overlap(primary, words(["left", "right"]))
    score = score - F.when(F.array_contains(option, "corner") & ~in_corner, 1.0).otherwise(0.0)
    for a, b in (("left", "right"), ("right", "left"), ("top", "bottom"), ("bottom", "top")):
        score = score - F.when(against(a, b), 2.0).otherwise(0.0)
    return F.when(F.size(option) > 0, score)


def wants_grounding(question: Column) -> Column:
    return F.lower(F.coalesce(question, F.lit(""))).rlike("|".join(L.GROUNDING_MARKERS))


def is_global_region(name: Column) -> Column:
    return F.lower(F.coalesce(name, F.lit(""))).rlike("whole|global")


def is_compound(option: Column) -> Column:
    return normalize_text(option).rlike(r"\b(and|plus|both|multiple|combined|together)\b|[,;/]")
