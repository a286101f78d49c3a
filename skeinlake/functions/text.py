"""Text as columns: normalisers, tokens, n-grams, skeletons and classifiers. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern of words, numbers and stretches of Chinese signs.
WORD_RE = r"[A-Za-z]+(?:['-][A-Za-z]+)*|\d+(?:\.\d+)?|[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+"
# Words masked in skeletons.
VIEW_WORDS = ("ant", "anterior", "neutral", "post", "posterior")
CLASS_WORDS = ("abnormal", "metastasis", "metastatic", "non-metastatic", "nonmetastatic", "normal")
# Fixed values: (class, pattern on normalised text), in the order in which they are tried.
_B = r"([^\p{L}\p{N}]|$)"
QUESTION_RULES = (
    ("localization_plus_classification", rf"^(locate|where){_B}(.*[^\p{{L}}\p{{N}}])?(determine whether|identify whether|labelled|labeled){_B}"),
    ("localization", r"^(locate|where) "),
    ("yes_no", rf"^(is|are|does|do|did|can|has|have|was|were){_B}"),
    ("counting", rf"^(how many|what number|count){_B}"),
    ("classification", rf"^(which|what type|what kind){_B}"),
    ("identification_or_description", rf"^(what|describe|identify){_B}"),
    ("comparison", rf"(^|[^\p{{L}}\p{{N}}])(compare|difference|versus){_B}"),
    ("reasoning", rf"^(why|how){_B}"),
)


def squeeze(col: Column) -> Column:
    """Lower case, blanks of any length as one."""
    return F.trim(F.regexp_replace(F.lower(col), r"\s+", " "))


def normalise(col: Column) -> Column:
    """Lower case; underscores and all but letters, digits, blanks and ``<>-'`` as one blank."""
    return F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}<>\-']+", " "))


def exact_form(col: Column) -> Column:
    """Lower-case ASCII letters and digits, all else as one blank."""
    return F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " "))


def matches_any(col: Column, answers: Column) -> Column:
    """Whether the exact form equals that of one of several answers."""
    return F.exists(answers, lambda a: exact_form(a) == exact_form(col))


def tokens(col: Column, pattern: str = WORD_RE) -> Column:
    """Lower-case matches of ``pattern``, in order."""
    return F.transform(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)), F.lower)


def letter_tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit("[a-z]+"), F.lit(0))


def code_tokens(col: Column) -> Column:
    """[a-z0-9_]+ with hyphens read as underscores."""
    return F.regexp_extract_all(F.replace(F.lower(col), F.lit("-"), F.lit("_")), F.lit("[a-z0-9_]+"), F.lit(0))


def let(value: Column, f) -> Column:
    """``f(value)`` with the value made once: inside a lambda an expression would be made again for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    join = lambda w: F.transform(F.slice(w, F.lit(1), F.size(w) - n + 1), lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, n)]))
    return let(words, lambda w: F.when(F.size(w) >= n, join(w)).otherwise(none))


def skeleton(col: Column, regions: list[str]) -> Column:
    """Normalised text with region, view and class words masked, longest first."""
    swaps = [(r, "<REGION>") for r in regions] + [(w, "<VIEW>") for w in VIEW_WORDS] + [(w, "<CLASS>") for w in CLASS_WORDS]
    out = F.concat(F.lit(" "), F.replace(normalise(col), F.lit(" "), F.lit("  ")), F.lit(" "))
    for word, mask in sorted(swaps, key=lambda s: (-len(s[0]), s[0])):
        out = F.replace(out, F.lit(f" {word.replace(' ', '  ')} "), F.lit(f" {mask} "))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def question_type(col: Column, grounding: Column) -> Column:
    """Class of a question by ordered rules; ``grounding`` marks tasks that ask for a place whatever the words."""
    text = normalise(col)
    out = F.lit("other")
    for name, pattern in reversed(QUESTION_RULES):
        hit = text.rlike(pattern)
        out = F.when(hit | grounding if name == "localization" else hit, name).otherwise(out)
    return F.when(F.coalesce(text, F.lit("")) == "", "missing").otherwise(out)


# Forms of a question and the first words that make them.
FORMS = {
    "what": ("what",), "where": ("where", "locate", "find", "mark", "identify", "indicate", "point", "select", "give", "box"), "does": ("does", "do"), "is": ("is", "are", "can", "has", "have"),
}


def question_form(col: Column) -> Column:
    """Form of a question by its first word."""
    first = F.get(F.split(F.trim(F.lower(col)), r"\s+"), F.lit(0))
    return F.coalesce(*[F.when(first.isin(*w), F.lit(n)) for n, w in FORMS.items()], F.lit("other"))


def language_hint(col: Column) -> Column:
    cjk, latin = col.rlike(r"[\x{3400}-\x{9fff}]"), col.rlike("[A-Za-z]")
    return F.when(cjk & latin, "mixed").when(cjk, "zh").when(latin, "en").otherwise("other")


def pii_flags(col: Column) -> dict[str, Column]:
    return {"email": col.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), "long_number": col.rlike("(^|[^0-9])[0-9]{6,}([^0-9]|$)")}


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """``{name}`` places filled from columns."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def pick_variant(key: Column, n: Column | int) -> Column:
    """Index in 0..n-1 from the first 8 bytes of sha256 of the key (unsigned)."""
    big = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(big, (F.lit(n) if isinstance(n, int) else n).cast("decimal(20,0)")).cast("int")


def find_region(prompt: Column, regions: list[str]) -> Column:
    """The longest region name that stands in a prompt as a whole word."""
    text = F.concat(F.lit(" "), F.regexp_replace(F.lower(prompt), "[^a-z0-9_]+", " "), F.lit(" "))
    names = F.array(*[F.lit(r) for r in sorted(regions, key=lambda r: (-len(r), r))])
    return let(text, lambda t: F.get(F.filter(names, lambda r: F.contains(t, F.concat(F.lit(" "), r, F.lit(" ")))), F.lit(0)))


# Ordinal words and their index.
ORDINALS = {"first": 0, "second": 1, "third": 2, "fourth": 3, "fifth": 4, "sixth": 5, "seventh": 6, "eighth": 7}


def last_ordinal(col: Column) -> Column:
    """Index of the last ordinal a text mentions, from 0; null without one."""
    words = F.regexp_extract_all(F.lower(col), F.lit("(" + "|".join(ORDINALS) + ")"), F.lit(1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ORDINALS.items() for x in kv]), F.try_element_at(words, F.lit(-1)))


def slug(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
