import math
import random
import re

from sonarlake.llm.divergence import COMMON_WORDS, SYMBOLS, DivergenceRules, divergence_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text, window=8):
    text = text or ""
    words = WORD.findall(text)
    places = {}
    for i in range(len(words) - window + 1):
        places.setdefault(tuple(words[i:i + window]), []).append(i)
    repeated = {i + j for at in places.values() if len(at) > 1 for i in at for j in range(window)}
    lines, seen, dups = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in SYMBOLS for c in text), dups, len(repeated)


def test_measures_equal_brute_force(spark):
    rnd = random.Random(1)
    alphabet = ["a", "bb", "the", "und", "É", "#", "|", "1", "😀", "x-y"]
    texts = [None, "", " ", "\n\n", "a", "a b c d e f g h", "a b c d e f g h " * 2, "a " * 40, "one\ntwo\none\n one\n\t\n\t\ntwo"]
    texts += ["".join(rnd.choice(alphabet) + rnd.choice([" ", " ", "\n", "\t", "\x0b", "\r\n", "  ", "\xa0", ""]) for _ in range(rnd.randint(0, 80))) for _ in range(150)]
    phrase = " ".join(f"w{i}" for i in range(12))
    texts += [f"{phrase} x {phrase}\n{phrase}", f"{phrase} " * 300]
    df = spark.createDataFrame([(i, t, "en", "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, chars string, n_words int")
    got = {r.doc_id: r for r in divergence_rules(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), repr(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_distances_and_guards(spark):
    prose = ["the cat and the dog of a town in the hills is at this place and that was it for him", "to be or not to be is the question that he was on by"]
    rows = [(i, " ".join(prose * 3) + f" word{i}", "en") for i in range(30)] + [(100, "### | $$$ " * 40, None), (101, "the " * 30, "xx"), (None, " ".join(prose * 4), None)]
    rules = DivergenceRules()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in divergence_rules(df, rules).collect()}
    assert got[100].char_distance > 0.8 and got[100].word_distance > rules.word_limit and not got[100].kept
    assert got[101].word_distance is None and got[101].char_distance is not None  # 30 words are below the guard
    vocabulary, words = rules.vocabulary, (" ".join(prose * 3) + " word3").split()
    corpus = [w for _, t, lang in rows if lang == "en" for w in t.split()]
    p = [words.count(w) / len(words) for w in vocabulary]
    q = [corpus.count(w) / len(corpus) for w in vocabulary]
    p, q = p + [1 - sum(p)], q + [1 - sum(q)]
    js = sum((a * math.log2(a / ((a + b) / 2)) if a else 0) + (b * math.log2(b / ((a + b) / 2)) if b else 0) for a, b in zip(p, q)) / 2
    assert abs(got[3].word_distance - math.sqrt(max(js, 0))) < 1e-7
    assert set(COMMON_WORDS) == {"en", "de", "fr", "es"}
    assert divergence_rules(df.limit(0)).count() == 0
    none = divergence_rules(df.filter("doc_id = 101")).collect()[0]
    assert none.char_distance is None and not none.base_failed is None
