import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonarlake.llm import prefix_trie as pt


def loop(rows, hashes):
    """Every prefix as a tuple in a dictionary."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            said = (role or "", text or "")
            own.setdefault(c, []).append((turn is not None, turn or 0, hashes[said], said))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
        for d in range(len(full) + 1):
            n = nodes.setdefault(tuple(full[:d]), {"members": [], "ends": []})
            n["members"].append(c)
            if d == len(full):
                n["ends"].append(c)
    out = []
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    totals = {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [totals[k] for k in kids.get(p, [])]
        totals[p] = (sum(b[0] for b in below) or 1, (len(nodes[p]["members"]) - 1) * words + sum(b[1] for b in below))
        parent = min(nodes[p[:-1]]["members"]) if p else None
        ends = hashlib.sha256(",".join(map(str, sorted(nodes[p]["ends"]))).encode()).hexdigest()
        out.append((min(nodes[p]["members"]), len(p), parent, len(nodes[p]["members"]), len(kids.get(p, [])), *totals[p], ends))
    return sorted(out, key=str)


def run(spark, rows, span, chunk):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, pos int, band int").repartition(3)
    turns, convs = pt.borrow_starts(pt.ordered_turns(df))
    got = pt.prefix_trie(turns, convs, span, chunk)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.select(*columns).collect()), key=str)


def hashes_of(spark, rows):
    said = [(a, b) for a, b in {(r or "", t or "") for _, _, r, t in rows}]
    df = spark.createDataFrame(said, "role string, text string").select("role", "text", *[F.xxhash64(F.lit(k), "role", "text").alias(f"h{k}") for k in (0, 1)])
    return {(r.role, r.text): (r.h0, r.h1) for r in df.collect()}


def conversations(seed):
    rng = random.Random(seed)
    phrases = ["hello there", "yes", "no no", "tell me more\x0bplease", "", "日本 é", "x " * 400]
    rows = []
    for c in list(range(0, 45)) + [100, 101, 119, -3, -20, 2_000_000_000_007]:
        for t in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(phrases[:3]) if rng.random() < 0.7 else rng.choice(phrases)))
    rows += [(c, t, "user", "same again") for c in range(200, 230) for t in range(14)]  # copies
    rows += [(300, t, "user", f"turn {t % 5}") for t in range(90)] + [(301, t, "user", f"turn {t % 5}") for t in range(70)]  # long
    rows += [(400, None, None, None), (400, 1, None, "b"), (400, 1, None, "a"), (400, 1, None, "a"), (400, None, "user", None), (None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize("span, chunk", [(3, 4), (64, 8192), (5, 1)])
def test_equals_a_dictionary_of_prefixes(spark, span, chunk):
    rows = conversations(span)
    assert run(spark, rows, span, chunk) == loop(rows, hashes_of(spark, rows))


def test_empty_and_single(spark):
    assert run(spark, [(7, 0, "user", "a")], 4, 4) == loop([(7, 0, "user", "a")], hashes_of(spark, [(7, 0, "user", "a")]))
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert pt.prefix_trie(*pt.borrow_starts(pt.ordered_turns(df))).count() == 0


def test_slots_refuse_a_shared_digest():
    import pyarrow as pa
    one = {"own": [1, 1], "n_convs": [1, 1], "n_ends": [1, 1], "first": [1, 2], "aa": [0, 0], "ab": [0, 0], "a": [[5], [5]], "b": [[6], [6]], "w": [[1], [1]]}
    good = pa.table({**one, "f": [[9], [9]]})
    assert pt.Rows(good, 0, 64).parts().num_rows == 2
    with pytest.raises(ValueError):
        pt.Rows(pa.table({**one, "f": [[9], [8]]}), 0, 64).parts()
