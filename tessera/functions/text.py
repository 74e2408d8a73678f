"""Scalar functions as column expressions: cleaning, terms, predicates, scores. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, ENVELOPE_KEYS, FILTER_FORMS, LEAD_INS, PATH_NOISE, STOP_WORDS, STUDY_TITLE, Settings

#: A token of the text index: letters and digits of any alphabet.
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def clean_token(t: Column) -> Column:
    return F.lower(F.regexp_replace(t, "[^A-Za-z0-9-]", ""))


def cleaned_words(q: Column) -> Column:
    return F.transform(F.split(F.coalesce(q, F.lit("")), r"\s+"), clean_token)


def terms_of(words: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Cleaned words of at least two characters that aren't stop words, each once, in order."""
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 2) & ~t.isin(*stop)))


def search_terms(q: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    return terms_of(cleaned_words(q), stop)


def specificity(t: Column) -> Column:
    """0 for terms with a digit, 1 with a hyphen, then by length."""
    return F.when(t.rlike("[0-9]"), 0).when(t.contains("-"), 1).when(F.length(t) <= 6, 2).when(F.length(t) <= 9, 3).otherwise(4)


def substituted(words: Column, table: dict[str, str]) -> Column:
    """Each word replaced by its canonical form, if it has one."""
    if not table:
        return words
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(words, lambda t: F.coalesce(F.try_element_at(m, t), t))


def pinned(words: Column, table: dict[str, str]) -> Column:
    """Terms of the canonical forms that are put in."""
    if not table:
        return F.array().cast("array<string>")
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    hits = F.filter(F.transform(words, lambda t: F.try_element_at(m, t)), lambda t: t.isNotNull())
    return terms_of(F.flatten(F.transform(hits, cleaned_words)))


def canonical(name: Column, table: dict[str, str]) -> Column:
    """The specifications' term for a name, in its place, if the table has another one for it."""
    if not table:
        return name
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    alias = F.nullif(F.trim(F.try_element_at(m, clean_token(name))), F.lit(""))
    return F.when(alias.isNotNull() & (F.lower(alias) != clean_token(name)), alias).otherwise(name)


def label(intent: Column) -> Column:
    """The name of an intent as it is shown."""
    return F.translate(intent, "_", "-")


def strict_terms(words: Column, every: Column, table: dict[str, str], s: Settings = DEFAULT) -> Column:
    """The terms of a strict query. words: those of the original, cleaned; every: the terms of the expanded query.

    The original's own terms, replaced; the expansion's with digits, unless the original has enough short plain ones; and its short hyphenated ones.
    """
    digit = lambda t: t.rlike("[0-9]")
    own = terms_of(words)
    short = F.size(F.filter(own, lambda t: ~digit(t) & ~t.contains("-") & (F.length(t) <= s.short_term)))
    new = F.array_except(every, own)
    digits = F.when(short < s.short_terms, F.filter(new, digit)).otherwise(F.slice(new, 1, 0))
    forms = F.flatten(F.transform(substituted(words, table), cleaned_words))
    return F.array_distinct(F.concat(terms_of(forms), digits, F.filter(new, lambda t: t.contains("-") & (F.length(t) <= s.short_term))))


def and_terms(terms: Column, pins: Column, limit: int, s: Settings = DEFAULT) -> Column:
    """The most specific terms, pinned ones first; more of them if many have digits."""
    keyed = F.array_sort(F.transform(terms, lambda t: F.struct((~F.array_contains(pins, t)).cast("int").alias("p"), specificity(t).alias("s"), F.length(t).alias("n"), t.alias("t"))))
    digits = F.size(F.filter(terms, lambda t: t.rlike("[0-9]")))
    n = F.when(digits > limit, F.least(digits, F.lit(s.digit_limit))).otherwise(F.lit(limit))
    return F.slice(F.transform(keyed, lambda x: x["t"]), F.lit(1), n)


def expand(q: Column, glossary: dict[str, str]) -> Column:
    """The query with the expansion of each abbreviation appended once."""
    if not glossary:
        return q
    m = F.create_map(*[F.lit(x) for kv in glossary.items() for x in kv])
    keys = F.transform(F.split(q, r"\s+"), lambda t: F.upper(clean_token(t)))
    more = F.array_distinct(F.filter(F.transform(F.filter(keys, lambda k: F.length(k).between(2, 12)), lambda k: F.try_element_at(m, k)), lambda x: x.isNotNull()))
    return F.when(F.size(more) > 0, F.concat_ws(" ", q, F.concat_ws(" ", more))).otherwise(q)


def strip_question(q: Column) -> Column:
    return F.trim(F.regexp_replace(q, r"(?i)^(?:" + "|".join(LEAD_INS) + r")\s*", ""))


def release_of(q: Column) -> Column:
    n = F.regexp_extract(q, r"(?i)\b(?:rel|release)[\s-]*(\d{1,2})\b", 1)
    return F.when(n != "", F.concat(F.lit("Rel-"), n))


def round_to(x: Column, digits: int = 4) -> Column:
    """Half up on the binary value, as floor(x * 10^n + 0.5) / 10^n."""
    p = float(10**digits)
    return F.floor(x * p + 0.5) / F.lit(p)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def head(text: Column, n: int) -> Column:
    c = collapse(text)
    return F.when(F.length(c) > 0, F.substring(c, 1, n))


def tail(text: Column, n: int) -> Column:
    c = collapse(text)
    return F.when(F.length(c) > 0, F.right(c, F.lit(n)))


def cap(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def content_tokens(s: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(s), "[^a-z0-9_]+"), lambda t: F.length(t) >= 3))


def jaccard(a: Column, b: Column) -> Column:
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / any_)


def is_binary(text: Column, share: int = 5) -> Column:
    """Blank text, or a start with marks of embedded objects, or one where more than 1 / share is beyond printable ASCII."""
    s = F.substring(text, 1, 600)
    odd = F.length(F.regexp_replace(s, r"[\x20-\x7E\n\r\t]", ""))
    return (F.coalesce(F.trim(text), F.lit("")) == "") | s.contains("EMF+") | s.contains("w:docVar") | s.contains("w:val=") | (odd * share > F.length(s))


def is_study(doc_type: Column, spec_id: Column, title: Column, s: Settings = DEFAULT, title_pattern: str = STUDY_TITLE) -> Column:
    n = F.regexp_extract(spec_id, r"^[^.]*\.([+-]?\d+)(?:-.*)?$", 1).try_cast("int")
    return F.coalesce((F.upper(doc_type) == "TR"), F.lit(False)) | F.coalesce((n >= s.study_from) & (n < s.study_to), F.lit(False)) | F.coalesce(title.rlike(title_pattern), F.lit(False))


def is_numbered(spec_id: Column) -> Column:
    return spec_id.rlike(r"^\d+\.\d+(-\d+)?$")


def has_word(text: Column, word: Column) -> Column:
    """Containment where neither neighbour is a letter or digit."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\p{L}\p{Nd}])\Q"), word, F.lit(r"\E(?![\p{L}\p{Nd}])")))


def names_spec(q: Column, spec_id: Column) -> Column:
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"[\s.\-_]+", "")
    bare = F.regexp_replace(squeeze(spec_id), "^(itut|ietf)", "")
    return squeeze(q).contains(squeeze(spec_id)) | ((bare != "") & squeeze(q).contains(bare))


def document_shaped(q: Column, s: Settings = DEFAULT) -> Column:
    t = F.trim(q)
    return (F.length(t) > s.guard_chars) | (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) > s.guard_lines)


def shape(text: Column, s: Settings = DEFAULT) -> Column:
    """toc, table or prose."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    short = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) < s.short_line))
    leaders = F.size(F.regexp_extract_all(text, F.lit(r"(\.{4,}\s*\d+)"), 1))
    return F.when(leaders >= s.toc_hits, "toc").when((F.size(lines) >= s.table_lines) & (short * 10 >= F.size(lines) * int(s.short_ratio * 10)), "table").otherwise("prose")


def sentences(text: Column) -> Column:
    """Sentences of at least four characters, by a rule on end marks and line ends."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.transform(F.split(F.regexp_replace(marked, r"\n+", "\u0001"), "\u0001"), lambda x: F.trim(x)), lambda x: F.length(x) >= 4)


def verbosity(v: Column) -> Column:
    x = F.lower(F.trim(F.coalesce(v, F.lit(""))))
    return F.when(x.isin("brief", "short", "terse"), "BRIEF").when(x.isin("full", "raw", "all"), "FULL").otherwise("NORMAL")


def clamp(x: Column, default: int, lo: int, hi: int) -> Column:
    return F.least(F.greatest(F.coalesce(x, F.lit(default)), F.lit(lo)), F.lit(hi))


def spec_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(?:TS|TR)?\s*(\d{2}\.\d{3}(?:-\d+)?)\b"), 1))


def display_id(spec_id: Column) -> Column:
    return F.when(F.upper(spec_id).startswith("RFC"), F.concat(F.lit("RFC "), F.substring(spec_id, 4, 1000))).otherwise(F.concat(F.lit("TS "), spec_id))


def list_items(q: Column) -> Column:
    """The items of a query that is a list: at least three by comma or line, all short and no question; else null."""
    items = F.filter(F.transform(F.split(q, "[,\n]"), lambda x: F.trim(x)), lambda x: x != "")
    fits = F.forall(items, lambda x: (F.length(x) <= 60) & (F.size(F.split(x, r"\s+")) <= 8) & ~x.contains("?"))
    t = F.trim(q)
    return F.when((F.size(items) >= 3) & fits & ~t.startswith("{") & ~t.endswith("?"), items)


def extras_weight(series: Column, q: Column, terms: list[str], s: Settings = DEFAULT) -> Column:
    """Neutral where a series is asked for or a term of another domain occurs; else a discount."""
    low = F.lower(q)
    hit = F.lit(False)
    for t in terms:
        hit = hit | (has_word(low, F.lit(t)) if len(t) <= 3 else low.contains(t))
    return F.when(F.coalesce(F.trim(series), F.lit("")) != "", s.extras_neutral).when(F.coalesce(F.trim(q), F.lit("")) == "", s.extras_discount).when(hit, s.extras_neutral).otherwise(s.extras_discount)


def passes(wanted: Column, value: Column) -> Column:
    """A filter that is null or blank passes everything; else equality."""
    return (F.coalesce(F.trim(wanted), F.lit("")) == "") | F.coalesce(wanted == value, F.lit(False))


def digest(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 12)


def unwrap(q: Column) -> Column:
    """The text in a small JSON envelope: the first of six keys that isn't blank; else the query."""
    got = F.coalesce(*[F.nullif(F.trim(F.get_json_object(q, f"$.{k}")), F.lit("")) for k in ENVELOPE_KEYS])
    return F.when((F.length(q) <= 2000) & q.startswith("{"), F.coalesce(got, q)).otherwise(q)


def object_context(path: Column, name: Column) -> Column:
    """The last levels of a managed-object path without namespaces and the parameter itself: two if it had namespaces, else three."""
    parts = F.filter(F.transform(F.split(path, "/"), lambda x: F.trim(F.regexp_replace(x, "^.*:", ""))), lambda x: (x != "") & ~F.lower(x).isin(*PATH_NOISE) & (F.lower(x) != F.lower(name)))
    n = F.when(path.contains(":"), 2).otherwise(3)
    return F.when(F.size(parts) > n, F.slice(parts, -n, n)).otherwise(parts)


def document_reason(q: Column) -> Column:
    """Why an input is a document rather than a query (long, json, xml, lines); null if it isn't."""
    t = F.trim(q)
    wrapped = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return F.when(F.length(t) > 600, "long").when(wrapped, F.when(F.length(t) > 300, "json")).when(t.startswith("<?xml") | (t.startswith("<") & t.endswith(">") & t.contains("</")), "xml").when(lines > 8, "lines")


def coverage_note(reply: Column) -> Column:
    """The leading paragraph about partial coverage; null if there is none."""
    return F.nullif(collapse(F.regexp_extract(F.ltrim(reply), r"(?s)^(Partial coverage: .+?)(?:\n\s*\n|\z)", 1)), F.lit(""))


def valid_filter(kind: str, value: Column) -> Column:
    """The value of a filter if it has the form of one; else null. Blank values are no filters."""
    v = F.trim(value)
    return F.when(v.rlike(FILTER_FORMS[kind]), v)


def ignored_filters(values: dict[str, Column]) -> Column:
    """The names of filters whose values are set but not valid."""
    bad = [F.when((F.coalesce(F.trim(v), F.lit("")) != "") & valid_filter(k, v).isNull(), F.lit(k)) for k, v in values.items()]
    return F.filter(F.array(*bad), lambda x: x.isNotNull())
