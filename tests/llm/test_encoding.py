"""Ids against two public libraries, on odd texts of every kind."""

import base64
import os
import random

import numpy as np
import pytest

from loomspan.llm.encoding import ASCII_PATTERN, PATTERN, STRETCHES, RankQueue, count_tokens, encode_texts, encoder
from loomspan.llm.queries import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")

TEXTS = [
    None, "", " ", "\n", "a", "Hello world", "aaaa", "a" * 1001, "ab" * 500, "ACGT" * 2000, "    x   y  ", "\t\r\n \n", "don't we'll I'M '", "12345 678901234567890", "żółć ☎ 𝛼 קשת 中文字符 한국어 ру́сский", "é̀", "<|endoftext|>", "\x00\x01\x1c\x85", "a\xa0b　c",
    "!!!???...---===", "https://x.y/z?q=1#f", "zzzzqqqqxxxx" * 50, "".join(map(chr, range(0x20, 0x2FF))), "🙂🙃" * 30,
]


def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(VOCABULARY, "rb").read().splitlines() if x)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def mine(texts):
    ids, k = encoder(VOCABULARY).encode(texts)
    at = np.concatenate(([0], np.cumsum(k)))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def test_odd_texts():
    lib = library()
    want = [lib.encode_ordinary(t) if t else [] for t in TEXTS]
    assert mine(TEXTS) == want
    assert [mine([t])[0] for t in TEXTS] == want


def test_random_texts():
    lib, rng = library(), random.Random(5)
    alphabet = list("aabbcctheing  '\n.0123") + ["é", "中", "𝛼"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += ["".join(rng.choice("ACGTN") for _ in range(20_000)), "".join(rng.choice("ab") for _ in range(5000))]
    assert mine(texts) == [lib.encode_ordinary(t) for t in texts]


def test_round_trip_and_other_library():
    from tokenizers import Tokenizer

    path = os.path.join(os.path.dirname(VOCABULARY), "byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    assert mine(TEXTS) == [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]
    back = {r: b for b, r in encoder(VOCABULARY).ranks.items()}
    assert [b"".join(back[i] for i in ids).decode() for ids in mine(TEXTS)] == [x or "" for x in TEXTS]


def test_queue_finds_the_lowest():
    rng, q, held = random.Random(1), RankQueue(50_257), {}
    for _ in range(3000):
        if rng.random() < 0.6 or not held:
            r = rng.randrange(50_257)
            q.push(r, np.array([r]))
            held[r] = held.get(r, 0) + 1
        else:
            rank, bucket = q.pop()
            assert rank == min(held) and len(bucket) == held.pop(rank)
    while held:
        assert q.pop()[0] == min(held)
        held.pop(min(held))
    assert q.pop() is None


def test_frame(spark):
    df = spark.createDataFrame([(i, t, "e") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode_texts(df, "text", ["doc_id"], VOCABULARY).collect()}
    assert got == dict(enumerate(mine(TEXTS))) and got[0] == [] and got[1] == []
    n = {r["doc_id"]: r["tokens"] for r in count_tokens(df, "text", ["doc_id"], VOCABULARY).collect()}
    assert n == {i: len(x) for i, x in got.items()}
    assert encode_texts(df.limit(0), "text", ["doc_id"], VOCABULARY).count() == 0


def test_stretches_cut_alike():
    """Pre-tokens of the stretches, one after another, are those of the text; every character is tried."""
    import random
    import re
    import sys

    import regex

    rng = random.Random(9)
    odd = [c for c in map(chr, range(sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and (c.isspace() or regex.match(r"\s", c) or not c.isprintable() and ord(c) < 0x3100)]
    alphabet = odd + list("éß漢²Ⅷ\u0301'") * 40 + list("  \n\t'stmdrevl019.,aZ") * 60
    find, cut = regex.compile(PATTERN).findall, re.compile(STRETCHES).findall
    for _ in range(30_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert [p for x in cut(text) for p in find(x)] == find(text), repr(text)
    for c in odd:
        for text in (c, c + "a", f"a{c}", f"a {c} b", f"a{c}{c}b", f" {c}", f"{c} b"):
            assert [p for x in cut(text) for p in find(x)] == find(text), repr(text)


def test_ascii_pattern_cuts_alike():
    import random
    import re

    import regex

    rng = random.Random(9)
    alphabet = [chr(i) for i in range(128)] + list("  \n\t'stmdrevl019.,aZ") * 6
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert re.findall(ASCII_PATTERN, text) == regex.findall(PATTERN, text), repr(text)
