import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from graphloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    library = Library.from_file(PATH)
    library.no_padding()
    library.no_truncation()
    return bpe.Tokenizer(PATH), library


def test_against_the_library(both):
    mine, library = both
    r = random.Random(3)
    letters = "aabbeetthnsi'’ 12!?éß中😀ΣſİﬁÅ\x1c\x85 ՘"
    texts = ["", "aaaaaaa" * 50, "hahahahah", "it's I'LL we've", "<|endoftext|>a<|startoftext|> b <|endoftext", "x" * 20_000, "a\x00b"]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == want, text
        assert mine.decode(want) == library.decode(want, skip_special_tokens=False)


def test_small_merge_lists_against_rule_by_rule():
    """Merges applied one by one, in order, leftmost first, on every short word."""
    from itertools import product

    r = random.Random(8)
    for _ in range(60):
        tokens, merges = ["a", "b", "c"], []
        while len(merges) < 8:
            u, v = r.choice(tokens), r.choice(tokens)
            if u + v not in tokens:
                merges.append((u, v))
                tokens.append(u + v)
        automaton = bpe.Automaton({t: i for i, t in enumerate(tokens)}, merges)
        for n in range(1, 8):
            for word in map("".join, product("abc" if n < 6 else "ab", repeat=n)):
                want = list(word)
                for u, v in merges:
                    out = []
                    for t in want:
                        if out and out[-1] == u and t == v:
                            out[-1] = u + v
                        else:
                            out.append(t)
                    want = out
                assert automaton.encode(word) == want, (merges, word)


def test_digests_of_a_table(spark, both):
    _, library = both
    docs = [(1, None, 5), (1, None, 5), (None, "Hello there", 6), (3, "", 7), (4, "the cat " * 30_000, 8)]
    got = bpe.digests(spark.createDataFrame(docs, "doc_id long, text string, ids int"), PATH).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t, _ in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    rows = bpe.encode_documents(spark.createDataFrame(docs, "doc_id long, text string, ids int"), PATH).collect()
    assert all(r.n_tokens == len(r.ids.split()) for r in rows)


def test_young_characters_are_looked_up_not_searched(both):
    """Every code point is told by its category, again when it is remembered, and a long text costs about what its normal form does."""
    import time
    import unicodedata

    mine, library = both
    for c in [*range(0x20, 0xD800, 7), *range(0xE000, 0x30000, 7), 0x10FFFF]:
        young = unicodedata.category(chr(c)) == "Cn"
        assert mine._young(chr(c)) == mine._young("aß" + chr(c)) == young, hex(c)
    text = "Größe: déjà vu, á \U0001fadc naïve " * 3
    assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids

    def least(run) -> float:
        took = []
        for _ in range(5):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    text = "Größe déjà über naïve schöne lange Wörter " * 5000
    assert least(lambda: mine.split(text)) < 8 * least(lambda: unicodedata.normalize("NFC", text).lower().split())


def test_a_word_that_comes_back_is_encoded_once(both):
    """A full table goes in two steps: a word that is met again and again stays, whatever passes by, and the ids are the library's."""
    _, library = both
    mine, ran = bpe.Tokenizer(PATH, memory=20), []
    encode = mine.automaton.encode
    mine.automaton.encode = lambda word: ran.append(word) or encode(word)
    r = random.Random(12)
    word = lambda: "".join(r.choice("abdeéßñ中") for _ in range(9))
    for _ in range(100):
        text = f"whhaedor {word()} {word()}. ({word()}) {word()}, whhaedor! ça: 'whhaedor'"
        assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids, text
    assert ran.count("whhaedor") == 1
    assert len(mine.cache) <= 20 and len(mine.older) <= 20


def test_a_long_word_costs_in_proportion(both):
    """No position looks at the whole rest of its word."""
    import time

    mine, library = both
    r = random.Random(13)
    word = "".join(r.choice("etaoinshrdlu") for _ in range(600_000))
    automaton, took = mine.automaton, []
    for n in (20_000, 600_000):
        began = time.process_time()
        automaton.encode(word[:n])
        took.append(time.process_time() - began)
    assert took[1] < 100 * took[0]
    assert mine.encode(word[:20_000]) == library.encode(word[:20_000], add_special_tokens=False).ids
