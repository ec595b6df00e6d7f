"""Document fingerprints by consistent weighted sampling of words.

For sample k every distinct word of a text draws, from hashes of the word and k alone, r and c from Gamma(2, 1) and b
uniformly. A word of weight w (its count) stands at t = floor(ln w / r + b) and bids ln a = ln c - r * (t - b) - r; the
word with the lowest bid gives the sample (word, t). Two texts share a sample with the probability of the generalised
Jaccard similarity of their word counts, sum of minima over sum of maxima, so the share of equal samples estimates it.

A fingerprint is ``samples`` numbers of 16 bits in hexadecimal; 0000 stands for a text without words. Bids are minimised as
64-bit numbers (bid to 24 binary digits above, 31 bits that name the sample below), so all samples of a text are plain
minima that one hash aggregation keeps in generated code; everything is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarlake.plans.durable import durable
from sonarlake.plans.ordered import dense_index

from .common import BLANK_RE, pick

#: Copies of one text are listed in runs of this length, so no row holds a long array.
RUN = 10_000


@dataclass(frozen=True)
class SamplingRule:
    """32 samples give a standard error of at most 1/11; the cost of a fingerprint is words times samples."""

    samples: int = 32
    seed: int = 0


def bid(h: Column, log_w: Column, k: int, seed: int = 0) -> Column:
    """The word's bid for sample k with the sample's name in its low 31 bits; the least one wins. Null for no word.

    One 64-bit hash is cut into five uniform numbers: two of 12 bits for r, two of 13 bits for c, 14 bits for b.
    """
    x = F.xxhash64(h, F.lit(k + 1000 * seed))

    def uniform(shift: int, bits: int) -> Column:
        return F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)

    r = -F.log(uniform(0, 12) * uniform(12, 12) * F.lit(2.0 ** -24))
    log_c = F.log(-F.log(uniform(24, 13) * uniform(37, 13) * F.lit(2.0 ** -26)))
    b = uniform(50, 14) * F.lit(2.0 ** -14)
    t = F.floor(log_w / r + b)
    name = h.bitwiseXOR(t * 40503).bitwiseAND(F.lit((1 << 31) - 1))
    return F.shiftleft(((log_c - r * (t - b + 1) + 128.0) * F.lit(2.0 ** 24)).cast("bigint"), 31).bitwiseOR(name)


def _hex(value: Column) -> Column:
    """The 16-bit number of a winning bid, 1 to 65535, or 0 where no word made a bid, in four digits."""
    number = F.coalesce(value.bitwiseAND(F.lit((1 << 31) - 1)) % 65535 + 1, F.lit(0))
    return F.lower(F.lpad(F.hex(number), 4, "0"))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", rule: SamplingRule = SamplingRule(), digest: str | None = None) -> DataFrame:
    """``keys`` and ``fingerprint`` of every row; keys must tell rows apart and hold no nulls.

    A null, empty or blank text has the fingerprint of zeros. The keys' partitioning, if there is one, is kept, so rows
    that are already dealt by their keys are counted and sampled in place. A column ``digest`` of 64 hexadecimal digits is
    carried along as four numbers among the words (no word starts with a tab), so that nothing needs to be joined back.
    """
    words = F.split(F.coalesce(F.col(text), F.lit("")), BLANK_RE)
    if digest:
        words = F.concat(words, F.array(*[F.concat(F.lit(f"\t{k}"), F.substring(digest, 16 * k + 1, 16)) for k in range(4)]))
    rows = texts.select(*keys, F.explode(words).alias("_w"))
    noted = F.col("_w").startswith("\t")
    rows = rows.select(*keys, F.when(noted, F.substring("_w", 2, 1).cast("int")).alias("_part"), F.when(noted, F.conv(F.substring("_w", 3, 16), 16, -10).cast("bigint"))
                       .when(F.col("_w") != "", F.xxhash64("_w")).alias("_h"))
    terms = rows.groupBy(*keys, "_part", "_h").agg(F.count(F.lit(1)).alias("_n"))
    terms = terms.select(*keys, "_part", "_h", F.when(F.col("_part").isNull(), F.log(F.col("_n").cast("double"))).alias("_lw"))
    samples = [F.min(bid(F.col("_h"), F.col("_lw"), k, rule.seed)).alias(f"_s{k}") for k in range(rule.samples)]
    notes = [F.max(F.when(F.col("_part") == k, F.col("_h"))).alias(f"_d{k}") for k in range(4)] if digest else []
    won = terms.groupBy(*keys).agg(*samples, *notes)
    kept = [F.lower(F.concat(*[F.lpad(F.hex(f"_d{k}"), 16, "0") for k in range(4)])).alias(digest)] if digest else []
    return won.select(*keys, *kept, F.concat(*[_hex(F.col(f"_s{k}")) for k in range(rule.samples)]).alias("fingerprint"))


def likeness(a: Column, b: Column, samples: int = SamplingRule.samples) -> Column:
    """Share of equal samples of two fingerprints, the estimate of their texts' generalised Jaccard similarity.

    Two texts without words are alike (1.0), one without words and one with some are not (0.0).
    """
    places = F.sequence(F.lit(1), F.lit(4 * samples - 3), F.lit(4))
    return F.size(F.filter(places, lambda i: F.substr(a, i, F.lit(4)) == F.substr(b, i, F.lit(4)))) / F.lit(float(samples))


def _named(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Rows with 128-bit names (k1, k2) of (doc_id, text), never null; equal rows have one name."""
    rows = pick(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(F.xxhash64("doc_id", "text", F.col("doc_id").isNull()).alias("k1"), F.xxhash64(F.lit(7), "text", "doc_id").alias("k2"), "doc_id", "text")


def _successors(rows: DataFrame) -> DataFrame:
    """Per distinct row: id, length, number of copies and the name of the next distinct row in descending id (after the last: the first)."""
    keys = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min(F.char_length("text").cast("long")).alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    order = durable(dense_index(keys, [], [F.desc_nulls_last("doc_id"), F.col("k1"), F.col("k2")], "place"), "order")
    total = order.count()
    after = order.select(F.pmod(F.col("place") - 1, F.lit(max(1, total))).alias("place"), F.col("k1").alias("next1"), F.col("k2").alias("next2"))
    return durable(order.join(after, "place").select("k1", "k2", "doc_id", "n_chars", "copies", "next1", "next2"), "successors")


def compare_with_next(docs: DataFrame, rule: SamplingRule = SamplingRule(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last half replaced by the start of the next document's text (as many code points, or all of it
    if that is shorter). The next document is the next row in descending doc_id, nulls last, equal ids in a fixed order of
    name; of rows that repeat id and text all but one have a copy of themselves as the next. A null text is empty; texts
    without words have a fingerprint of zeros; one row alone is its own next; an empty table gives no rows.

    Texts are shuffled once by name, and their first halves once more on the way to the document before; both uses of the
    texts read the same columns, so that the exchange is shared. Repeated rows are described once and listed again at the end.
    """
    named = _named(docs, text, doc_id)
    nxt = _successors(named)
    rows = named.select("k1", "k2", "text").dropDuplicates(["k1", "k2"])
    asked = nxt.select("k1", "k2", "next1", "next2", "copies", F.floor(F.col("n_chars") / 2).cast("int").alias("half"))
    heads = rows.select(F.col("k1").alias("next1"), F.col("k2").alias("next2"), F.col("text").alias("_next")).join(asked, ["next1", "next2"])
    both = rows.join(heads.select("k1", "k2", "copies", "half", F.expr("substring(_next, 1, half)").alias("head")), ["k1", "k2"])
    start = F.expr("substring(text, 1, char_length(text) - half)")
    texts = F.array_compact(F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("words")),
        F.struct(F.lit(1).alias("side"), F.concat(start, "head").alias("words")),
        F.when(F.col("copies") > 1, F.struct(F.lit(2).alias("side"), F.concat(start, F.expr("substring(text, 1, half)")).alias("words")))))
    sides = both.select("k1", "k2", F.explode(texts).alias("_s")).select("k1", "k2", "_s.side", "_s.words")
    sides = sides.withColumn("sha", F.sha2("words", 256))
    signed = durable(fingerprints(sides, ["k1", "k2", "side"], "words", rule, "sha"), "signed")

    base = signed.filter("side = 0").select("k1", "k2", "fingerprint").join(nxt, ["k1", "k2"])
    edited = signed.filter("side > 0").select("k1", "k2", "side", F.col("sha").alias("edited_sha256"), F.col("fingerprint").alias("edited_fingerprint"))
    ahead = base.select(F.col("k1").alias("next1"), F.col("k2").alias("next2"), F.col("fingerprint").alias("_ahead"))
    out = base.join(edited, ["k1", "k2"]).join(ahead, ["next1", "next2"])
    near_next = F.when(F.col("side") == 2, F.lit(1.0)).otherwise(likeness(F.col("fingerprint"), F.col("_ahead"), rule.samples))
    out = out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                     likeness(F.col("fingerprint"), F.col("edited_fingerprint"), rule.samples).alias("near_edited"), near_next.alias("near_next"),
                     F.when(F.col("side") == 1, F.lit(1)).otherwise(F.col("copies") - 1).cast("long").alias("_n"))
    runs = out.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN))))
    again = F.sequence(F.lit(1).cast("long"), F.least(F.lit(RUN), F.col("_n") - F.col("_run") * RUN))
    return runs.withColumn("_again", F.explode(again)).drop("_n", "_run", "_again")
