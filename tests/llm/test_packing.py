import json
import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from rankloom.llm import packing


def ids(text, vocabulary):
    return np.array([*vocabulary.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")


def test_ids_equal_the_tokenizer():
    vocabulary, fast, rng = Tokenizer.from_file(packing.tokenizer_file()), packing.id_bytes(), random.Random(2)
    letters = "abcXYZ019 \n\t\r\v\f\x00\x1f'é'ñßÄ²ªº½\xa0\x85\xad.,!don't I'll É İ ΣΑΣ 漢字 😀 ſ ŉ ǅ ɏ ɐ _-+`´¨\u0301\u2028 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["a<|endoftext|>b", "<|startoftext|>", "'S x's9's", ""]
    for t in texts:
        assert fast(t) == ids(t, vocabulary)[:-1].tobytes(), t


def test_ids_of_plain_text():
    vocabulary, fast, rng = Tokenizer.from_file(packing.tokenizer_file()), packing.id_bytes(), random.Random(5)
    plain = [chr(i) for i in range(0x250)]
    words = ["the", "und", "they're", "we've", "I'm", "'tis", "d'été", "rock'n'roll", "''s", "!'ll", "x" * 3000, "ab" * 2000, "1234", "a_b", "www.x.org"]
    texts = ["".join(rng.choice(plain) for _ in range(rng.randrange(80))) for _ in range(2000)]
    texts += [rng.choice(" \n\r").join(rng.choice([rng.choice(words), "".join(rng.choice(plain[33:]) for _ in range(rng.randrange(12)))]) for _ in range(rng.randrange(30))) for _ in range(2000)]
    for t in texts:
        assert fast(t) == ids(t, vocabulary)[:-1].tobytes(), t


def test_every_token_is_its_own_spelling():
    """Ranks give what the listed merges give if each merge, in its order, makes a new token of what its text has become by then."""
    with open(packing.tokenizer_file(), encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = {m: i for i, m in enumerate(merges)}
    for a, b in merges:
        text, end = (a + b).removesuffix(packing.WORD_END), (a + b).endswith(packing.WORD_END)
        parts = [*text[:-1], text[-1] + packing.WORD_END * end]
        while len(parts) > 2:
            rank, at = min((order.get(pair, len(order)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            assert rank < order[a, b], (a, b)
            parts[at : at + 2] = ["".join(parts[at : at + 2])]
        assert parts == [a, b]
    made = [model["vocab"][a + b] for a, b in merges]
    assert made == sorted(set(made)) and made[0] == len(model["vocab"]) - len(merges)


def test_filling_uses_every_piece_once():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([7, 16, 64, 300])
        counts = Counter(rng.randrange(1, capacity) for _ in range(rng.randrange(0, 120)))
        used = Counter()
        for window, times in packing.fill(counts, capacity):
            assert sum(n * c for n, c in window.items()) <= capacity and times >= 1
            for n, c in window.items():
                used[n] += c * times
        assert used == counts


def test_a_window_is_as_full_as_it_can_be():
    rng = random.Random(4)
    for _ in range(200):
        counts = Counter(rng.randrange(3, 40) for _ in range(rng.randrange(1, 9)))
        window, _ = packing.fill(counts, 40)[0]
        first, sums = max(counts), {0}
        for n in (counts - Counter([first])).elements():
            sums |= {s + n for s in sums}
        assert sum(n * c for n, c in window.items()) == max(first + s for s in sums if first + s <= 40)


def test_pack(spark, odd, none):
    vocabulary = Tokenizer.from_file(packing.tokenizer_file())
    rows = [(r.doc_id, ids(r.text, vocabulary)) for r in odd.collect()]
    got = packing.pack(odd).collect()
    want = sorted((str(i), at, min(4096, len(x) - at), zlib.crc32(x[at : at + 4096].tobytes()), len(x)) for i, x in rows for at in range(0, len(x), 4096))
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(windows) == list(range(len(windows)))
    assert len(windows) <= -(-sum(len(x) for _, x in rows) // 4096) + 1
    assert packing.pack(none).count() == 0
