"""Quality rules from distribution divergence, with DataFrame functions only.

A document's histogram over character classes and over common words is compared with the reference of each language by
the Jensen-Shannon distance (base 2, 0 to 1); the nearest language counts. The references are measured on all documents
of the table: character and common-word counts summed by the language column. Guards leave texts alone that are too
short for a histogram to mean something. All work on one document happens inside its row, so nothing is shuffled but
small partial sums per task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarlake.plans.durable import durable

from .common import BLANK, BLANK_RE, let, pick

SYMBOLS = "#*$%&|<>"
#: Character classes counted by removing their members; what is left over is the class "other".
CLASSES = ("lower", "upper", "digit", "blank", "stop", "shout", "symbol", "other")
#: Everyday function words of each language.
COMMON_WORDS = {
    "en": "the of and to in is that for it with as was on be by are this at from or an have not he you".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se il".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más es".split(),
}


@dataclass(frozen=True)
class DivergenceRules:
    """Limits of the rules. Distances are compared only from the minimum lengths on."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    char_limit: float = 0.22
    char_min_chars: int = 80
    word_limit: float = 0.31
    word_min_words: int = 60
    languages: dict[str, list[str]] = field(default_factory=lambda: dict(COMMON_WORDS))

    @property
    def vocabulary(self) -> list[str]:
        return sorted({w for words in self.languages.values() for w in words})


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _char_facts(text: Column) -> Column:
    """Symbols, characters in words, and counts in the order of CLASSES, of one text.

    Letters are cut out first, so that the other classes are counted on the short remainder.
    """
    rest_of = F.regexp_replace(text, r"\p{L}+", "")
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}\p{Lt}]+", ""))

    def facts(rest: Column) -> Column:
        total, left = F.length(text), F.length(rest)
        digits = left - F.length(F.regexp_replace(rest, r"\p{N}+", ""))
        blank, stop = left - _without(rest, BLANK), left - _without(rest, ".,;:'\"()-")
        shout, symbol = left - _without(rest, "!?"), left - _without(rest, SYMBOLS)
        named = F.struct(total.alias("total"), (total - left).alias("letters"), upper.alias("upper"), digits.alias("digit"), blank.alias("blank"),
                         stop.alias("stop"), shout.alias("shout"), symbol.alias("symbol"))
        return let(named, lambda x: F.struct(
            x["symbol"].cast("long").alias("n_symbols"), (x["total"] - x["blank"]).cast("long").alias("word_chars"),
            F.array(*[c.cast("double") for c in (
                x["letters"] - x["upper"], x["upper"], x["digit"], x["blank"], x["stop"], x["shout"], x["symbol"],
                x["total"] - x["letters"] - x["digit"] - x["blank"] - x["stop"] - x["shout"] - x["symbol"])]).alias("chars")))

    return let(rest_of, facts)


def _repeat_words(words: Column, window: int) -> Column:
    """Words lying in a window of ``window`` words that occurs at least twice in ``words``."""
    n = F.size(words)

    def covered(hashed: Column) -> Column:
        """hashed: array of (h, i), sorted. Neighbours of equal hash mark both places as repeated."""
        def places(s: Column) -> Column:
            pairs = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1),
                               lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            return F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

        def length(p: Column) -> Column:
            steps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1),
                               lambda a, b: F.least(b - a, F.lit(window)))
            return F.when(F.size(p) > 0, F.aggregate(steps, F.lit(window), lambda t, x: t + x)).otherwise(0)

        return let(places(hashed), length)

    def windows(hashes: Column) -> Column:
        indexed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return (F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0)
                .otherwise(let(F.array_sort(indexed), covered)))

    # Hashes of windows of 1, 2, 4, ... words: each step joins a hash with the one half a window further on.
    def widen(hashes: Column, width: int) -> Column:
        if width == window:
            return windows(hashes)
        step = min(width, window - width)
        return let(F.zip_with(F.slice(hashes, 1, F.size(hashes) - step), F.slice(hashes, 1 + step, F.size(hashes) - step),
                              lambda a, b: F.xxhash64(a, b)), lambda h: widen(h, width + step))

    return F.when(n > window, let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: widen(h, 1))).otherwise(0)


def measure(docs: DataFrame, rules: DivergenceRules, text: str = "_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Base counts and histograms of every row; a null text counts as empty.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs), ``_chars`` (class counts) and ``_common``
    (place in the vocabulary and count of each common word present).
    """
    full = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(full, BLANK_RE), lambda w: w != "")
    dup = let(F.split(full, "\n"), lambda x: F.when(F.size(x) == F.size(F.array_distinct(x)), 0).otherwise(
        let(F.filter(x, lambda y: y.rlike(r"[^\x20\x09-\x0D]")), lambda y: F.size(y) - F.size(F.array_distinct(y)))))
    vocabulary = F.array(*[F.lit(w) for w in rules.vocabulary])

    def counted(s: Column) -> Column:
        """Runs of the sorted occurrences: place of the word in the vocabulary and run length."""
        starts = F.transform(F.array_distinct(s), lambda w: F.struct(w.alias("w"), F.array_position(s, w).alias("f")))
        return let(starts, lambda d: F.transform(d, lambda x, i: F.struct(
            F.array_position(vocabulary, x["w"]).cast("int").alias("at"),
            (F.coalesce(F.get(d, i + 1)["f"], F.size(s) + 1) - x["f"]).cast("double").alias("n"))))

    in_words = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        _repeat_words(w, rules.window).cast("long").alias("n_repeat_words"),
        let(F.array_sort(F.filter(w, lambda x: x.isin(rules.vocabulary))), counted).alias("common")))
    return docs.select(
        *keep, in_words.alias("_w"), _char_facts(full).alias("_c"), dup.cast("long").alias("n_dup_lines"),
    ).select(*keep, "_w.n_words", "_c.word_chars", "_c.n_symbols", "n_dup_lines", "_w.n_repeat_words", F.col("_c.chars").alias("_chars"),
             F.col("_w.common").alias("_common"))


def references(facts: DataFrame, rules: DivergenceRules, lang: str = "_lang") -> dict[str, dict]:
    """Character-class and common-word shares per known language, from the measures of all rows of that language.

    Only the configured languages and words come back, so the result has a fixed size.
    """
    rows = facts.filter(F.col(lang).isin(*rules.languages))
    chars = rows.groupBy(lang).agg(*[F.sum(F.col("_chars")[i]).alias(c) for i, c in enumerate(CLASSES)],
                                   F.sum("n_words").alias("_words")).collect()
    words = rows.select(lang, F.explode("_common").alias("_x")).groupBy(lang, "_x.at").agg(F.sum("_x.n").alias("n")).collect()
    out: dict[str, dict] = {}
    for r in chars:
        total = sum(r[c] for c in CLASSES)
        if total and r["_words"]:
            share = [0.0] * len(rules.vocabulary)
            for w in words:
                if w[lang] == r[lang]:
                    share[w["at"] - 1] = w["n"] / r["_words"]
            out[r[lang]] = {"chars": [r[c] / total for c in CLASSES], "words": share}
    return dict(sorted(out.items()))


def _xlog(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)


def _js_chars(share: Column, ref: list[float]) -> Column:
    """Jensen-Shannon distance between an array of shares and a fixed reference."""
    total = F.lit(0.0)
    for i, q in enumerate(ref):
        p, m = share[i], (share[i] + F.lit(q)) / 2
        total = total + _xlog(p, m) + (_xlog(F.lit(q), m) if q > 0 else F.lit(0.0))
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _js_words(counts: Column, n: Column, ref: list[float]) -> Column:
    """The same over common words plus all other words; ``counts`` holds (place in the vocabulary, count) of present words.

    A word that is absent adds half its reference share, so the sum runs over present words only.
    """
    q_all = F.array(*[F.lit(q) for q in ref])

    def add(acc: Column, x: Column) -> Column:
        p, q = x["n"] / n, F.element_at(q_all, x["at"])
        m = (p + q) / 2
        return F.struct((acc["s"] + _xlog(p, m) + _xlog(q, m)).alias("s"), (acc["p"] + p).alias("p"), (acc["q"] + q).alias("q"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))

    def close(acc: Column) -> Column:
        p = F.greatest(F.lit(1.0) - acc["p"], F.lit(0.0))
        q = F.lit(1.0 - sum(ref))
        m = (p + q) / 2
        return F.sqrt(F.greatest((acc["s"] + _xlog(p, m) + _xlog(q, m) + F.greatest(F.lit(sum(ref)) - acc["q"], F.lit(0.0))) / 2, F.lit(0.0)))

    return F.aggregate(counts, zero, add, close)


def divergence_rules(docs: DataFrame, rules: DivergenceRules = DivergenceRules(), text: str = "text", lang: str = "lang",
                     doc_id: str = "doc_id", refs: dict[str, dict] | None = None) -> DataFrame:
    """Measures and verdict per row.

    Texts are read once: their measures are stored, the references are summed from the stored rows, and the verdict
    compares both. Null text counts as empty and fails the base rule; a null or unknown language changes nothing, as the
    nearest reference counts; repeated rows each get their row; an empty table gives no rows. Without any reference (no
    row of a known language) the distances are null and only the base rule decides.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance,
    word_distance and kept.
    """
    m = durable(measure(pick(docs, doc_id=doc_id, _text=text, _lang=lang), rules, keep=("doc_id", "_lang")), "measures")
    refs = references(m, rules) if refs is None else refs
    total = F.aggregate("_chars", F.lit(0.0), lambda a, x: a + x)
    none = F.lit(None).cast("double")

    def nearest(parts: list[Column]) -> Column:
        return F.least(*parts) if len(parts) > 1 else parts[0] if parts else none

    char_distance = let(let(total, lambda t: F.transform("_chars", lambda c: c / t)),
                        lambda s: nearest([_js_chars(s, r["chars"]) for r in refs.values()]))
    n = F.col("n_words").cast("double")
    word_distance = let(F.col("_common"), lambda c: nearest([_js_words(c, n, r["words"]) for r in refs.values()]))
    out = m.withColumns({
        "base_failed": (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
        "char_distance": F.when(total >= rules.char_min_chars, char_distance),
        "word_distance": F.when(F.col("n_words") >= rules.word_min_words, word_distance)})
    far = F.coalesce(F.col("char_distance") > rules.char_limit, F.lit(False)) | F.coalesce(F.col("word_distance") > rules.word_limit, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "char_distance", "word_distance", (~F.col("base_failed") & ~far).alias("kept"))
