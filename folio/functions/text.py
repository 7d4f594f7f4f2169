"""Text normalisers, token sets and text-derived labels as Column functions. Nulls count as empty texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Refusal label and the terms that gate keyword extraction.
UNANSWERABLE = "Unanswerable"
STOPWORDS = ("about", "after", "between", "could", "their", "there", "these", "those", "using", "where", "which", "while", "would")
FAILURES = (
    ("memory", r"out of memory|\boom\b|cannot allocate"),
    ("timeout", r"timed? ?out|deadline"),
    ("quota", r"quota|rate limit|insufficient balance"),
    ("network", r"connection|network|unreachable"),
    ("data", r"json|schema|missing field"),
)


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def valid_text(c: Column) -> Column:
    """Text of bytes or text, broken characters replaced."""
    return F.make_valid_utf8(c.cast("string"))


def squash_space(c: Column) -> Column:
    """Any run of Unicode white space becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def fold_text(c: Column) -> Column:
    """Lower case, with no-break and zero-width blanks as white space, squashed."""
    return F.trim(F.regexp_replace(F.lower(text(c)), r"(?U)[\s\x{200B}]+", " "))


def loose_text(c: Column) -> Column:
    """Folded, with typographic quotes and dashes plain, brackets and punctuation blank, no dots at the ends."""
    plain = F.translate(fold_text(c), "’‘“”–—", "''\"\"--")
    blank = F.regexp_replace(F.regexp_replace(plain, r"[\[\]{}()<>]", " "), r"[,:;!?\"'`]+", " ")
    return F.regexp_replace(squash_space(blank), r"^[ .]+|[ .]+$", "")


def content_text(c: Column) -> Column:
    """Lower case, with runs of other than word characters as one blank."""
    return F.trim(F.regexp_replace(F.lower(text(c)), r"(?U)\W+", " "))


def strip_code_fence(c: Column) -> Column:
    """Without a Markdown fence around the whole text."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text(c)), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def clean_model_text(c: Column) -> Column:
    """Without chat control tokens and a surrounding fence."""
    return strip_code_fence(F.regexp_replace(text(c), r"<\|[a-z_]+\|>", ""))


def word_tokens(c: Column, min_length: int = 1) -> Column:
    """Distinct folded word tokens of at least ``min_length`` characters."""
    words = F.split(content_text(c), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= max(1, min_length)))


def key_terms(c: Column, min_length: int = 5) -> Column:
    """Distinct longer tokens that are no stop words."""
    return F.array_except(word_tokens(c, min_length), F.array(*[F.lit(w) for w in STOPWORDS]))


def stemmed(tokens: Column) -> Column:
    """Tokens without ing, ed, es or s where enough is left."""

    def stem(w: Column) -> Column:
        n = F.length(w)
        return (
            F.when(w.endswith("ing") & (n > 5), F.substring(w, F.lit(1), n - 3))
            .when(w.endswith("ed") & (n > 4), F.substring(w, F.lit(1), n - 2))
            .when(w.endswith("es") & (n > 4), F.substring(w, F.lit(1), n - 2))
            .when(w.endswith("s") & (n > 3), F.substring(w, F.lit(1), n - 1))
            .otherwise(w)
        )

    return F.array_distinct(F.transform(tokens, stem))


def question_prefix(c: Column, words: int = 2) -> Column:
    """The first folded words, for template statistics."""
    return F.array_join(F.slice(F.split(content_text(c), " "), 1, words), " ")


def judge_label(c: Column) -> Column:
    """correct, partial, wrong or null. INCORRECT is looked for before CORRECT, which it contains."""
    up = F.upper(text(c))
    return F.when(up.rlike(r"\bINCORRECT\b"), "wrong").when(up.rlike(r"\bPARTIAL\b"), "partial").when(up.rlike(r"\bWRONG\b"), "wrong").when(up.rlike(r"\bCORRECT\b"), "correct")


def is_refusal(c: Column, exact: bool = True) -> Column:
    bare = F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")
    return bare == UNANSWERABLE if exact else F.lower(bare) == UNANSWERABLE.lower()


def looks_like_error(c: Column) -> Column:
    folded = fold_text(c)
    return folded.startswith("[error") | folded.startswith("error:")


def is_illegal_answer(c: Column) -> Column:
    """Blank, an error report, or an unfinished thought instead of an answer."""
    folded = fold_text(clean_model_text(c))
    return (folded == "") | looks_like_error(c) | folded.rlike(r"^(none|null|nan|n/a)$|cuda out of memory|traceback \(most recent")


def failure_class(c: Column) -> Column:
    """First class whose pattern matches, else other."""
    folded, out = fold_text(c), None
    for name, pattern in FAILURES:
        out = F.when(folded.rlike(pattern), name) if out is None else out.when(folded.rlike(pattern), name)
    return out.otherwise("other")


def safe_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text(c), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def paper_number(c: Column) -> Column:
    """Identifier at a path's end without its version."""
    return F.regexp_extract(text(c), r"([0-9]{4}\.[0-9]{4,5}|[^/]+?)(?:v[0-9]+)?(?:\.pdf)?$", 1)


def natural_key(c: Column) -> Column:
    """Sort key in which runs of digits compare as numbers: padded to 12 places."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text(c)), F.lit(r"([0-9]+|[^0-9]+)"), 1), lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 12, "0")).otherwise(p)), "")


def answer_leaks(question: Column, answer: Column, minimum: int = 4) -> Column:
    """Whether the folded answer, if long enough, stands in the folded question."""
    a = content_text(answer)
    return (F.length(a) >= minimum) & F.contains(content_text(question), a)


def token_cover(question: Column, answer: Column) -> Column:
    """Share of the answer's stemmed tokens that the question has; null without tokens."""
    a, q = stemmed(word_tokens(answer)), stemmed(word_tokens(question))
    return F.try_divide(F.size(F.array_intersect(a, q)).cast("double"), F.size(a))


def strip_citations(c: Column) -> Column:
    """Without parenthetical source references such as (QA5) or (from QA 5, QA 6)."""
    return squash_space(F.regexp_replace(text(c), r"(?i)\s*\((?:from\s+)?QA\s*\d+(?:\s*(?:,|and)\s*QA\s*\d+)*\)", ""))


def answer_is_concatenation(answer: Column, parts: Column, residual: int = 8) -> Column:
    """Whether the answer holds all (two or more) parts and fewer than ``residual`` other tokens."""
    whole = content_text(answer)
    folded = F.transform(parts, lambda p: content_text(p))
    rest = F.aggregate(folded, whole, lambda acc, p: F.replace(acc, p, F.lit(" ")))
    left = F.size(F.filter(F.split(rest, " +"), lambda w: w != ""))
    return (F.size(parts) >= 2) & F.forall(folded, lambda p: (p != "") & F.contains(whole, p)) & (left < residual)


def scientific_terms(c: Column) -> Column:
    """Distinct lower-case words, hyphens inside, of five or more characters; no stop words, none that begins with paper."""
    words = F.regexp_extract_all(F.lower(text(c)), F.lit(r"([a-z][a-z0-9]+(?:-[a-z0-9]+)*)"), 1)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 5) & ~w.startswith("paper") & ~w.isin(*STOPWORDS)))
