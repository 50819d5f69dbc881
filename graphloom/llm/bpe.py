"""BPE by a tokenization automaton.

The merges are compiled, in their order, by merge gadgets: at first every base
symbol loops on one state.  The gadget of merge (u, v) copies the state reached
by u without its v-arc, redirects u there, and lays an arc u+v to where v led,
beside every u-arc.  What is left accepts exactly the token sequences that the
merges would give.  The arcs of a state aren't listed (each has nearly the whole
vocabulary): a state knows which redirections it is copied from, and ``arc`` tells
whether a token may follow by the gadgets of these, along the token's left parts
(each must have had an arc when the next was laid beside it).  Answers are kept in
a transition table.

A pre-split word is encoded by one left-to-right run: each prefix has one accepted
last token, so a position holds one state and the arcs out of it that spell the
next symbols move on.  Decoding joins the labels of the arcs.  Stretches and their
words are remembered in two bounded tables of ``memory`` entries: a full one becomes
the older, whose entries move over when they are met again, and the older one goes.

Defined cases: a null or empty text has no ids and decodes to the empty string.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer as LibraryTokenizer

from .common import slices

OLD = unicodedata.ucd_3_2_0.category
LETTER = regex.compile(r"\p{L}").fullmatch
MARKS = frozenset(".,;:!?")
#: Entries of each of the two tables of a worker.
MEMORY = 150_000


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte, as byte-level tokenizers use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.made: list[tuple[str, int]] = [("", -1)]  # of each state: the token whose arc was redirected to it, and when; 0 is the first
        self.target: dict[str, int] = {}  # the state that a token's arcs lead to
        self.origin: dict[str, int] = {}  # where they led at first
        self.left: dict[str, tuple[str, int]] = {}  # a merged token's left part and the time of its merge
        self.gadgets: dict[tuple[str, str], int] = {}  # (u, v): when v was removed behind u
        self.known: dict[int, bool] = {}  # by state and number of the token
        self.copies: dict[int, list[tuple[str, int]]] = {}
        for at, (u, v) in enumerate(merges):
            self._gadget(at, u, v)
        # a leaf: symbols, token, its number, the state that its arcs lead to
        labels = [t for t in vocab if self._live(t)]
        self.states = len(self.made)
        leaf = {t: (len(t), t, k * self.states, self.target.get(t, 0)) for k, t in enumerate(labels)}
        self.last = {t.removesuffix(suffix): leaf[t] for t in labels if t.endswith(suffix)}  # what may end a word, without the suffix
        self.reach = 1 + max((len(t.removesuffix(suffix)) for t in labels), default=0)
        self.trie: dict = {}  # the others by their symbols: the leaf that ends there or None, and what follows
        for t in labels:
            if not suffix or not t.endswith(suffix):
                node = self.trie
                for symbol in t:
                    entry = node.setdefault(symbol, [None, {}])
                    node = entry[1]
                entry[0] = leaf[t]

    def _live(self, token: str) -> bool:
        """Whether a token has arcs: base symbols do, others once a gadget laid them."""
        return token in self.left or len(token.removesuffix(self.suffix) or self.suffix) == 1

    def _gadget(self, at: int, u: str, v: str) -> None:
        if not (self._live(u) and self._live(v) and self.arc(self.target.get(u, 0), v)):
            return  # no path spells u v: the merge never applies
        led = self.target.get(v, 0)
        self.made.append((u, at))
        self.target[u] = len(self.made) - 1
        self.target[u + v] = self.origin[u + v] = led
        self.left[u + v] = (u, at)
        self.gadgets[u, v] = at

    def _history(self, state: int) -> list[tuple[str, int]]:
        """The redirections that a state is copied from: gadgets of (token, anything) up to a time."""
        got = self.copies.get(state)
        if got is None:
            got, s = [], state
            while s > 0:
                got.append(self.made[s])
                s = self.origin.get(self.made[s][0], 0)
            self.copies[state] = got
        return got

    def arc(self, state: int, token: str) -> bool:
        """Whether token may follow in state."""
        gadgets, part, until = self.gadgets, token, 1 << 60
        history = self._history(state)
        while True:
            for u, at in history:
                gone = gadgets.get((u, part))
                # a part must have had its arc when the longer token was laid beside it;
                # a gadget removes before it lays, so the same time counts as gone
                if gone is not None and gone <= at and gone <= until:
                    return False
            if part not in self.left:
                return True
            part, until = self.left[part]

    def _arc(self, state: int, token: str, key: int) -> bool:
        if len(self.known) > 300_000:
            self.known.clear()
        got = self.known[key] = self.arc(state, token)
        return got

    def encode(self, word: str) -> list[str]:
        """Tokens of one pre-split word of base symbols (the suffix marks its last one).

        A path of arcs from the start spells the one right tokenization of its prefix,
        so a position can be reached in one state only and is left for good when no
        path from it ends: the run is linear in the number of positions.
        """
        n, last, trie, known, reach = len(word), self.last, self.trie, self.known, self.reach
        if word in last:
            return [last[word][1]]
        path: list[tuple[int, int, list[tuple]]] = []
        dead: set[int] = set()
        i, state, out = 0, 0, []
        while i < n:
            rest = word[i : i + reach]  # no token is longer
            ending = last.get(rest) if i + reach > n else None
            if ending is not None:
                key = ending[2] + state
                got = known.get(key)
                if self._arc(state, ending[1], key) if got is None else got:
                    out.append(ending[1])
                    return out
            options, node = [], trie
            for symbol in rest if i + reach <= n else rest[:-1]:
                entry = node.get(symbol)
                if entry is None:
                    break
                leaf, node = entry
                if leaf is not None:
                    options.append(leaf)
            while True:
                while options:
                    symbols, token, key, to = options.pop()  # the longest first
                    j = i + symbols
                    if j in dead:
                        continue
                    key += state
                    got = known.get(key)
                    if self._arc(state, token, key) if got is None else got:
                        break
                else:
                    dead.add(i)
                    if not path:
                        raise ValueError(f"no token sequence spells {word!r}")
                    i, state, options = path.pop()
                    out.pop()
                    continue
                break
            path.append((i, state, options))
            out.append(token)
            i, state = j, to
        return out


class Tokenizer:
    """A tokenizers-library file of kind BPE, with its normalizer and pre-split."""

    def __init__(self, path: str, memory: int = MEMORY):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError(f"{path}: only BPE files without decoder and post-processor are read here")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.table = str.maketrans({chr(b): c for b, c in enumerate(_byte_letters())})
        self.back = str.maketrans({c: chr(b) for b, c in enumerate(_byte_letters())})
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        library = LibraryTokenizer.from_file(path)
        self.rule, self.normalizer = library.pre_tokenizer, library.normalizer
        self.memory = memory
        self.cache: dict[str, tuple[str, int]] = {}
        self.older: dict[str, tuple[str, int]] = {}
        self.numbers = {t: str(i) for t, i in model["vocab"].items()}
        self.aged: set[str] = set()
        self.settled: set[str] = set()
        self.letters: set[str] = set()
        self.labels = {str(i): t for t, i in model["vocab"].items()} | {str(i): t for t, i in self.added.items()}

    def _old(self, stretch: str) -> bool:
        """Whether a stretch has no character younger than Unicode 3.2.  Those found old are remembered, as in ``_young``."""
        if self.settled.issuperset(stretch):
            return True
        old = {c for c in stretch if OLD(c) != "Cn"}
        self.settled |= old
        return old.issuperset(stretch)

    def _letters(self, stretch: str) -> bool:
        """Whether a stretch without young characters is letters alone, and so one word.  Letters are remembered, as in ``_young``."""
        if not stretch.isalpha():
            return False
        if not self.letters.issuperset(stretch):
            self.letters |= {c for c in stretch if LETTER(c)}
            return self.letters.issuperset(stretch)
        return True

    def _split(self, stretch: str) -> list[str]:
        """The pre-split of a stretch without young characters; letters, and letters before one mark, needn't be searched."""
        if self._letters(stretch):
            return [stretch]
        if stretch[-1:] in MARKS and self._letters(stretch[:-1]):
            return [stretch[:-1], stretch[-1]]
        return self.words.findall(stretch)

    def _word(self, word: str) -> tuple[str, int]:
        plain = word.isascii() and word.isprintable()  # such characters stand for themselves
        tokens = self.automaton.encode(word if plain else word.encode().decode("latin-1").translate(self.table))
        return " ".join(map(self.numbers.__getitem__, tokens)), len(tokens)

    def _stretch(self, stretch: str) -> tuple[str, int]:
        """(ids, number) of a stretch without blanks; no rule of the pre-split looks across a blank.

        Characters younger than Unicode 3.2 go by the library's own rule: its tables and regex's differ on new ones.
        The words of other stretches are remembered beside these: each is its own only word.
        """
        got = self.older.get(stretch)
        if got is None:
            if not self._old(stretch):
                parts = [self._word(w.translate(self.back).encode("latin-1").decode()) for w, _ in self.rule.pre_tokenize_str(stretch)]
                got = " ".join([p[0] for p in parts]), sum([p[1] for p in parts])
            else:
                words = self._split(stretch)
                if len(words) == 1:
                    got = self._word(words[0])
                else:
                    get = self.cache.get
                    parts = [get(w) or self._stretch(w) for w in words]
                    got = " ".join([p[0] for p in parts]), sum([p[1] for p in parts])
        if len(self.cache) >= self.memory:
            self.cache, self.older = {}, self.cache
        self.cache[stretch] = got
        return got

    def _young(self, text: str) -> bool:
        """Whether a text holds characters that Python's Unicode tables lack: the library, which follows newer ones, normalises such texts.

        Characters that the tables have are remembered, so that a text is one look-up a character.
        """
        if self.aged.issuperset(text):
            return False
        new = set(text) - self.aged
        young = {c for c in new if unicodedata.category(c) == "Cn"}
        self.aged |= new - young
        return bool(young)

    def split(self, text: str) -> list[str]:
        """Normalise a part without added tokens and split it at blanks."""
        if text.isascii():
            text = text.lower()
        elif self._young(text):
            text = self.normalizer.normalize_str(text)
        else:
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")  # lower() makes a final sigma of some; the library maps characters singly
            text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return regex.split(r"\s+", text)  # blanks to str.split(), but not to the rules
        return text.split()

    def pieces(self, text: str) -> list[tuple[str, int]]:
        """(ids, number) of each stretch that has any."""
        out, get, stretch = [], self.cache.get, self._stretch
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append((str(self.added[part]), 1))
            else:
                out += [get(w) or stretch(w) for w in self.split(part)]
        return [x for x in out if x[1]]

    def encoded(self, text: str) -> tuple[str, int]:
        """Space-joined ids of a text, and their number."""
        got = self.pieces(text)
        return " ".join([p[0] for p in got]), sum([p[1] for p in got])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encoded(text)[0].split()]

    def decoded(self, ids: str) -> str:
        """The labels of the arcs that space-joined ids name, joined as the library does without a decoder."""
        return " ".join(map(self.labels.__getitem__, ids.split()))

    def decode(self, ids: list[int]) -> str:
        return self.decoded(" ".join(map(str, ids)))


_LOADED: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    """One automaton for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def _mapped(docs: DataFrame, path: str, row, columns: str) -> DataFrame:
    """doc_id and the columns (n_tokens and strings) that row(tokenizer, text) gives for every row."""
    names = ["doc_id", *[c.split()[0] for c in columns.split(", ")]]
    types = [pa.int64() if c.endswith(" long") else pa.string() for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in slices(batches):
            rows = [row(tokenizer, text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {columns}")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (space-joined) for every row."""
    return _mapped(docs, path, lambda tokenizer, text: tokenizer.encoded(text)[::-1], "n_tokens long, ids string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the ids are decoded and hashed where they are made, so that they are never sent on."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def row(tokenizer: Tokenizer, text: str) -> tuple[int, str, str]:
        ids, n = tokenizer.encoded(text)
        return n, sha(ids), sha(tokenizer.decoded(ids))

    return _mapped(docs, path, row, "n_tokens long, ids_sha256 string, decoded_sha256 string")
