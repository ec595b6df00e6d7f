import hashlib
import heapq
import random

import public_tokenizers
import tiktoken

from sonarlake.llm.rank_queue_bpe import Bpe, RankQueue, TextBpe, digest_texts, encode_texts

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
BPE = Bpe.from_file(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})


def test_queue_gives_the_lowest_rank_and_its_leftmost_position():
    rnd, queue, plain = random.Random(1), RankQueue(50_000), []
    for _ in range(4000):
        if rnd.random() < 0.6:
            entry = rnd.randrange(50_000) if rnd.random() < 0.5 else rnd.randrange(5), rnd.randrange(1000)
            queue.push(*entry)
            plain.append(entry)
        elif plain:
            rank = queue.lowest()
            got = rank, heapq.heappop(queue.buckets[rank])
            assert got == min(plain)
            plain.remove(got)
            if not queue.buckets[rank]:
                queue.close(rank)
        else:
            assert queue.lowest() == -1


def test_pieces_equal_the_library():
    rnd = random.Random(2)
    for _ in range(3000):
        letters = rnd.choice(["ab", "a", "etaoin shrdlu", "äöüßéèñ", "日本語テキスト", "0123456789", "=-_*#"]).replace(" ", "")
        piece = "".join(rnd.choice(letters) for _ in range(rnd.choice([1, 2, 5, 9, 30, 200])))
        assert BPE.encode(piece.encode()) == LIBRARY._encode_single_piece(piece.encode())
    long = "ab" * 40_000 + "the" * 20_000
    assert BPE.encode(long.encode()) == LIBRARY._encode_single_piece(long.encode())


def test_texts_equal_the_library(spark):
    rnd = random.Random(3)
    parts = ["word", "B", " ", "  ", "\n", "\t", " \n", "\n ", "'s", "don't", "1", "é", "ß", "!?", "　", "<|endoftext|>", "日本", "\r\n", "'", "\x1c", "\x85"]
    texts = ["", None, " ", "x", *("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 10))) for _ in range(800)), "the " * 3000]
    small = TextBpe(PATH, PATTERN, cache=20)
    for t in texts:
        ids = LIBRARY.encode_ordinary(t or "")
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()
        assert small.digest(t) == want
    docs = spark.createDataFrame([(i if i % 7 else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = digest_texts(docs, PATH, PATTERN).collect()
    assert len(rows) == len(texts)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i, t in enumerate(texts):
        if i % 7:
            assert by[i].n_tokens == len(LIBRARY.encode_ordinary(t or ""))
    ids = {r.doc_id: r.ids for r in encode_texts(docs, PATH, PATTERN).collect()}
    assert BPE.decode(ids[len(texts) - 1 if (len(texts) - 1) % 7 else 1]).decode() == (texts[-1] if (len(texts) - 1) % 7 else texts[1] or "")
    assert digest_texts(docs.limit(0), PATH, PATTERN).count() == 0
