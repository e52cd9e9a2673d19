"""Text normalisation and scalar functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.model import EXPANSIONS, FILLERS, STOPWORDS, SUFFIXES, SYNONYMS

TOKEN = r"([\p{IsAlphabetic}\p{N}]+)"


def raw_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(1))


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def stem(t: Column) -> Column:
    """Cuts the first matching suffix if more than two bytes stay."""
    out = F.when(F.lit(False), t)
    for s in SUFFIXES:
        out = out.when(t.endswith(s) & (F.octet_length(t) > len(s) + 2), F.substring(t, F.lit(1), F.char_length(t) - len(s)))
    return out.otherwise(t)


def stem_word(t: str) -> str:
    """``stem`` for a Python string."""
    return next((t[: -len(s)] for s in SUFFIXES if t.endswith(s) and len(t.encode()) > len(s) + 2), t)


def normal_word(t: str) -> str | None:
    """``normal_token`` for a Python string."""
    if t.isnumeric() or t in STOPWORDS:
        return None
    cut = stem_word(t)
    return None if cut in STOPWORDS else SYNONYMS.get(cut, cut)


#: All words besides numbers that normalise to nothing: stop-words, and what stems to one.
DROPPED = sorted({w for w in STOPWORDS} | {w + s for w in STOPWORDS for s in SUFFIXES if stem_word(w + s) in STOPWORDS})


def words_of(terms: set[str]) -> dict[str, str]:
    """word -> term of all words that normalise to one of the terms: some twenty a term."""
    roots = terms | {k for k, v in SYNONYMS.items() if v in terms}
    return {w: t for w in {r + s for r in roots for s in ["", *SUFFIXES]} if (t := normal_word(w)) in terms}


def is_token(raw: Column) -> Column:
    """Whether a raw token stays after normalisation; a lookup in a fixed set, without stemming."""
    return ~raw.rlike(r"^\p{N}*$") & ~raw.isin(*DROPPED)


def normal_token(t: Column, synonyms: dict | None = None) -> Column:
    """Stemmed token with its synonym, or null for numbers and stop-words."""
    s = stem(t)
    known = _map(SYNONYMS if synonyms is None else {**SYNONYMS, **synonyms})
    keep = ~t.rlike(r"^\p{N}*$") & ~t.isin(*STOPWORDS) & ~s.isin(*STOPWORDS)
    return F.when(keep, F.coalesce(F.try_element_at(known, s), s))


def tokens(c: Column) -> Column:
    """Normalised tokens of a text, in order."""
    return F.filter(F.transform(raw_tokens(c), lambda t: normal_token(t)), lambda t: t.isNotNull())


def normalize_text(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def expand_terms(c: Column) -> Column:
    """Tokens, each followed by its expansions, first occurrences only."""
    extra = F.create_map(*[x for k, v in EXPANSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(tokens(c), lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(extra, t), F.array().cast("array<string>"))))))


def is_filler(t: Column) -> Column:
    return t.isin(*FILLERS)


def word_shingles(c: Column, n: int = 3) -> Column:
    """Distinct n-word windows; a shorter text is one window, an empty one has none."""
    t = tokens(c)
    whole = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))
    return F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(whole))


def _locate_at(ch: Column, hay: Column, at: Column) -> Column:
    """Place of a character after a Column-valued place; 0 if there is none."""
    found = F.instr(F.substring(hay, at + 1, F.lit(2**31 - 1)), ch)
    return F.when(found > 0, found + at).otherwise(F.lit(0))


def is_subsequence(needle: Column, hay: Column) -> Column:
    """All characters of the needle occur in the haystack in order."""
    step = lambda at, ch: F.when(at < 0, at).otherwise(F.when(_locate_at(ch, hay, at) == 0, F.lit(-1)).otherwise(_locate_at(ch, hay, at)))
    return F.aggregate(F.split(needle, ""), F.lit(0), lambda at, ch: step(at, ch)) >= 0


def textual_bonus(query: Column, value: Column) -> Column:
    """400 equal, 200 contained, else 80 for each token contained and 40 for each subsequence."""
    q, v = F.lower(F.trim(query)), F.lower(value)
    each = F.aggregate(F.filter(F.split(q, r"\s+"), lambda t: t != ""), F.lit(0), lambda acc, t: acc + F.when(F.contains(v, t), 80).when(is_subsequence(t, v), 40).otherwise(0))
    return F.when(v == q, 400).when(F.contains(v, q), 200).otherwise(each)


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length, of lower-cased texts; two empty ones are equal."""
    x, y = F.lower(a), F.lower(b)
    longer = F.greatest(F.char_length(x), F.char_length(y))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longer)


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of the sets of words [letters digits - _]."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{IsAlphabetic}\p{N}_-]+)"), F.lit(1)))
    x, y = words(a), words(b)
    total = F.size(x) + F.size(y)
    return F.when(total == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) * 2.0 / F.when(total == 0, 1).otherwise(total))


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths or a zero vector."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot / F.when(n == 0, 1.0).otherwise(n))


def blend(inter: Column, a: Column, b: Column) -> Column:
    """0.35 Jaccard + 0.65 containment of weighted sets, 0..1."""
    union, least = a + b - inter, F.least(a, b)
    return F.when((union <= 0) | (least <= 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.35 * inter / F.when(union <= 0, 1).otherwise(union) + 0.65 * inter / F.when(least <= 0, 1).otherwise(least))))


def fact_volume(facts: Column) -> Column:
    """sqrt(500 / characters of all facts) within 0.35..1; 1 without facts."""
    chars = F.aggregate(facts, F.lit(0), lambda s, f: s + F.char_length(f))
    return F.when(chars <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.35), F.sqrt(F.lit(500.0)) / F.sqrt(F.greatest(chars, F.lit(1)).cast("double")))))


def proximity_hits(t: Column, query: Column, window: int = 6) -> Column:
    """Most distinct query terms in a window of tokens; 0 with fewer than two tokens."""
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))), lambda i: F.size(F.array_intersect(F.slice(t, i, window), query))))
    return F.when(F.size(t) < 2, 0).otherwise(best)


def contains_phrase(t: Column, phrase: Column) -> Column:
    pad = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    return (F.size(phrase) > 0) & F.contains(pad(t), pad(phrase))


def importance_boost(c: Column) -> Column:
    one = F.when(c.between(0, 1), c).when(c.between(1, 6), (c - 1) / 5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))
    return F.round((one - 0.5) * 2 * 66).cast("long")


def feedback_boost(score: Column, count: Column) -> Column:
    safe = F.when(count > 0, count).otherwise(1)
    scaled = score / safe * 200 * F.least(F.log1p(count.cast("double")) / 3, F.lit(1.0))
    return F.when(count <= 0, 0).otherwise(F.round(F.least(F.lit(300.0), F.greatest(F.lit(-300.0), scaled)))).cast("long")


def valid_timestamp(c: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ by ranges only: days run to 31 in every month."""
    return c.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\dZ$")


def valid_date(c: Column) -> Column:
    return c.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$")


def normalize_source(c: Column) -> Column:
    """References without a known type get DOC."""
    from loomgraph.model import SOURCE_TYPES

    s = F.trim(c)
    return F.when(s == "", s).when(F.split(s, r"\s+")[0].isin(*SOURCE_TYPES), s).otherwise(F.concat(F.lit("DOC "), s))


def valid_source(c: Column) -> Column:
    """A known type and a link; conversations need a date, commits three parts."""
    from loomgraph.model import SOURCE_TYPES

    p = F.split(F.trim(c), r"\s+")
    known = F.get(p, F.lit(0)).isin(*SOURCE_TYPES) & (F.size(p) >= 2)
    return known & F.when(F.get(p, F.lit(0)) == "CONVERSATION", (F.size(p) >= 3) & valid_date(F.coalesce(F.get(p, F.lit(2)), F.lit("")))).when(F.get(p, F.lit(0)) == "GIT_COMMIT", F.size(p) >= 3).otherwise(True)


def display_number(c: Column) -> Column:
    """Numbers as text without a trailing .0, as predicates on numbers compare them."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def truncate(c: Column, n: int) -> Column:
    flat = F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.when(F.char_length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def all_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))
