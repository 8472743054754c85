"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens, and accepts exactly the token sequences that BPE gives. It starts as one state with a loop
for every base symbol; then each merge (x, y), in rank order, adds a gadget: the state of the new token takes
the arcs that the state of y has at that time, and from every state whose last piece is x, no arc may go on whose first
piece is y. What results is one table, compiled once on the driver and broadcast: for each state, tokens whose ends no later
merge tells apart being one, and each token, those whose beginnings none tells apart being one, whether the state has the arc. A second table
leads from symbol to symbol through the tokens' spellings. As the automaton is deterministic and every prefix of a word has one
tokenization, a position of a word has one state: words are read once from left to right, many together, each arc a look into both
tables, and none is taken back. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stretches of text whose encoding a task keeps; beyond that only those go on that are met again before as many others.
KEEP = 100_000
#: Characters of text that a task encodes at once, about, and of decoded text that it hands on at once.
HELD = 1 << 20
#: Symbols of words that are read together; longer ones are read by themselves.
TOGETHER = 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it shows, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(free)) for b in range(256)]


_NEVER = 1 << 60


class Automaton:
    """Compiled from a vocabulary and its merges, in rank order. Symbols are coded by their place in ``alphabet``, of which there are at most 256."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>"):
        self.labels = {i: t for t, i in vocab.items()}
        rank: dict[tuple[int, int], int] = {}
        #: What a gadget leaves of a token: its last and first piece, and the rank from which they are pieces no more.
        last: dict[int, tuple[int, int]] = {}
        first: dict[int, tuple[int, int]] = {}
        made = {i for t, i in vocab.items() if len(t.removesuffix(end)) == 1}
        for r, (x, y) in enumerate(merges):
            x, y, xy = vocab[x], vocab[y], vocab[x + y]
            rank.setdefault((x, y), r)
            # the gadget adds an arc only where nothing of lower rank would have joined x and y otherwise
            if xy not in made and x in made and y in made and not _joined(rank, _spine(last, x), _spine(first, y), r):
                made.add(xy)
                last[xy], first[xy] = (y, r), (x, r)
        inner = {t: i for t, i in vocab.items() if i in made and not t.endswith(end)}
        final = {t.removesuffix(end): i for t, i in vocab.items() if i in made and t.endswith(end)}
        self._compile_arcs(rank, last, first, [*inner.values()], [*inner.values(), *final.values()], max(vocab.values()) + 1)
        self._compile_spellings(inner, final)

    def _compile_arcs(self, rank, last, first, inner: list[int], tokens: list[int], size: int) -> None:
        """``arcs`` (state, token), as bits; ``state_of`` and ``arc_of`` a token. State 0 is a word's start."""
        lefts, rights = {x for x, _ in rank}, {y for _, y in rank}
        states: dict[tuple, int] = {(): 0}
        kinds: dict[tuple, int] = {}
        self.state_of, self.arc_of = np.zeros(size, np.int32), np.zeros(size, np.int32)
        for t in inner:
            self.state_of[t] = states.setdefault(tuple(p for p in _spine(last, t) if p[0] in lefts), len(states))
        for v in tokens:
            self.arc_of[v] = kinds.setdefault(tuple(p for p in _spine(first, v) if p[0] in rights), len(kinds))
        # which states end in a piece, which tokens begin with one, and until which rank
        ending: dict[int, list[tuple[int, int]]] = {}
        for spine, state in states.items():
            for piece, until in spine:
                ending.setdefault(piece, []).append((until, state))
        beginning: dict[int, list[tuple[int, int]]] = {}
        for spine, kind in kinds.items():
            for piece, until in spine:
                beginning.setdefault(piece, []).append((until, kind))
        starts = {y: (np.array([u for u, _ in found]), np.array([k for _, k in found])) for y, found in beginning.items()}
        by_left: dict[int, list[tuple[int, int]]] = {}
        for (x, y), r in rank.items():
            by_left.setdefault(x, []).append((r, y))
        self.arcs = np.full((len(states), len(kinds) // 8 + 1), 255, np.uint8)
        for x, found in ending.items():
            # merges in order; at the same rank the leftmost pair goes first: that within the state before, that within the token after this one
            gone, todo = np.zeros(self.arcs.shape[1] * 8, bool), iter(sorted(by_left[x]))
            merge = next(todo, None)
            for until, state in sorted(found):
                while merge and merge[0] < until:
                    if merge[1] in starts:
                        stays, kind = starts[merge[1]]
                        gone[kind[stays >= merge[0]]] = True
                    merge = next(todo, None)
                self.arcs[state] &= ~np.packbits(gone, bitorder="little")

    def _compile_spellings(self, inner: dict[str, int], final: dict[str, int]) -> None:
        """Nodes of spellings: which symbols go on from one, as bits, and the node of the first of them for each word of bits; the tokens that end there, within a word and at its end."""
        self.alphabet = {c: k for k, c in enumerate(sorted({c for t in (*inner, *final) for c in t}))}
        if len(self.alphabet) > 256:
            raise ValueError("more than 256 symbols")
        code = lambda t: bytes([self.alphabet[c] for c in t])
        inner, final = {code(t): i for t, i in inner.items()}, {code(t): i for t, i in final.items()}
        # by length and symbols: what goes on from a node stands together
        nodes = sorted({t[:i] for t in (*inner, *final) for i in range(len(t) + 1)}, key=lambda t: (len(t), t))
        at = {t: k for k, t in enumerate(nodes)}
        self.longest = len(nodes[-1])
        self.goes_on, self.first_on = np.zeros((len(nodes), 4), np.uint64), np.zeros((len(nodes), 4), np.int32)
        for t in reversed(nodes[1:]):
            parent, word, bit = at[t[:-1]], t[-1] >> 6, t[-1] & 63
            self.goes_on[parent, word] |= np.uint64(1 << bit)
            self.first_on[parent, word] = at[t]
        self.inner, self.final = (np.array([tokens.get(t, -1) for t in nodes], np.int32) for tokens in (inner, final))

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``symbol`` goes on from ``node``, and the nodes that it leads to there."""
        word, bit = symbol >> 6, (symbol & 63).astype(np.uint64)
        on = self.goes_on[node, word] >> bit
        there = np.flatnonzero(on & np.uint64(1))
        node, word, bit = node[there], word[there], bit[there]
        before = self.goes_on[node, word] & ((np.uint64(1) << bit) - np.uint64(1))
        return there, self.first_on[node, word] + np.bitwise_count(before)

    def read(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token that ends, its length) at each position of words of one length, rows of coded symbols."""
        many, n = words.shape
        token, length = np.full((many, n + 1), -1, np.int32), np.zeros((many, n + 1), np.int16)
        for i in range(n):
            state = self.state_of[token[:, i]] if i else np.zeros(many, np.int32)
            rows, node = np.arange(many), np.zeros(many, np.int32)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                there, node = self._step(node, words[rows, j - 1])
                rows = rows[there]
                if not len(rows):
                    break
                v = (self.final if j == n else self.inner)[node]
                arc = self.arc_of[v]
                ok = np.flatnonzero((v >= 0) & (self.arcs[state[rows], arc >> 3] >> (arc & 7) & 1).astype(bool))
                token[rows[ok], j], length[rows[ok], j] = v[ok], j - i
        return token, length

    def encode_coded(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words, given as coded symbols without the end mark."""
        out: list[list[int]] = [[] for _ in words]
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for n, places in by.items():
            if n > TOGETHER:
                for k in places:
                    out[k] = self._encode_long(words[k])
                continue
            for lo in range(0, len(places) if n else 0, 32_768):
                part = places[lo : lo + 32_768]
                token, length = self.read(np.frombuffer(b"".join([words[k] for k in part]), np.uint8).reshape(-1, n))
                # back from the end, all words together; what is at its start stays there
                at, back, rows = np.full(len(part), n), [], np.arange(len(part))
                while (at > 0).any():
                    back.append(np.where(at > 0, token[rows, at], -1))
                    at = at - length[rows, at]
                for k, ids in zip(part, np.stack(back, axis=1)[:, ::-1].tolist(), strict=True):
                    out[k] = [x for x in ids if x >= 0]
        return out

    def _encode_long(self, word: bytes) -> list[int]:
        """As :meth:`read` for one word, a position at a time."""
        n, goes_on, first_on, inner, final = len(word), self.goes_on, self.first_on, self.inner, self.final
        token, length = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            arcs = self.arcs[self.state_of[token[i]] if i else 0]
            node = 0
            for j in range(i + 1, min(n, i + self.longest) + 1):
                w, bit = word[j - 1] >> 6, word[j - 1] & 63
                on = int(goes_on[node, w])
                if not on >> bit & 1:
                    break
                node = int(first_on[node, w]) + (on & (1 << bit) - 1).bit_count()
                v = int((final if j == n else inner)[node])
                if v >= 0:
                    arc = int(self.arc_of[v])
                    if arcs[arc >> 3] >> (arc & 7) & 1:
                        token[j], length[j] = v, j - i
        out, j = [], n
        while j:
            out.append(token[j])
            j -= length[j]
        return out[::-1]

    def encode(self, word: str) -> list[int]:
        return self.encode_coded([bytes([self.alphabet[c] for c in word])])[0]


def _spine(pieces: dict[int, tuple[int, int]], token: int) -> list[tuple[int, int]]:
    """The pieces at one end of a token, itself first, each with the rank from which it is one no more."""
    out, until = [], _NEVER
    while True:
        out.append((token, until))
        if token not in pieces:
            return out
        token, until = pieces[token]


def _joined(rank, ends: list[tuple[int, int]], starts: list[tuple[int, int]], below: int) -> bool:
    """Whether a merge of lower rank than ``below`` joins a last piece with a first one while both are pieces."""
    for x, until in ends:
        for y, stays in starts:
            r = rank.get((x, y))
            if r is not None and r < below and r < until and r <= stays:
                return True
    return False


class WordTokenizer:
    """The word-end BPE of a ``tokenizers`` file: NFC, white space, lower case; words split by the file's pattern; special tokens found first."""

    def __init__(self, path: str, keep: int = KEEP):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.automaton = Automaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
        code = self.automaton.alphabet
        self.codes = bytes([code[s] for s in byte_symbols()])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = self.automaton.labels | {i: t for t, i in self.special.items()}
        self.labels = [labels.get(i, "") for i in range(max(labels) + 1)]
        self.shown = [str(i) for i in range(len(self.labels))]
        self.special_pattern = "(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
        self.split_pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.keep = keep
        self.start()

    def start(self) -> None:
        self.find_special, self.split = regex.compile(self.special_pattern), regex.compile(self.split_pattern)
        #: Separators that str.split() takes for white space, and the pattern does not.
        self.odd = regex.compile("[\x1c-\x1f]")
        self.space = regex.compile("[\t-\r \x85\xa0  -     　]+")
        #: (number of ids, ids as text, labels as text) of stretches without white space.
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find_special", "split", "odd", "space", "known", "older")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.start()

    def stretches(self, text: str) -> list[str]:
        """Special tokens and stretches without white space, in order."""
        if "<|" not in text:
            return text.split() if not self.odd.search(text) else [c for c in self.space.split(text) if c]
        out = []
        for part in self.find_special.split(text):
            out += [part] if part in self.special else [c for c in self.space.split(part) if c]
        return out

    def _words(self, stretch: str) -> list[str]:
        if stretch.isascii():
            stretch = stretch.lower()
            if stretch.isalpha():
                return [stretch]
        else:  # letter by letter: no final sigma
            stretch = "".join([c.lower() for c in unicodedata.normalize("NFC", stretch)])
        return self.split.findall(stretch)

    def learn(self, stretches) -> None:
        """Encode those stretches that are not known, together."""
        if len(self.known) > self.keep:
            self.older, self.known = self.known, {}
        new = [s for s in set(stretches) if s not in self.known]
        self.known |= {s: self.older[s] for s in new if s in self.older}
        new = [s for s in new if s not in self.known]
        split = [[] if s in self.special else self._words(s) for s in new]
        words = list({w for ws in split for w in ws})
        ids = dict(zip(words, self.automaton.encode_coded([w.encode("utf-8").translate(self.codes) for w in words]), strict=True))
        shown, labels = self.shown, self.labels
        for s, ws in zip(new, split, strict=True):
            own = [self.special[s]] if s in self.special else ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]]
            self.known[s] = len(own), " ".join([shown[i] for i in own]), " ".join([labels[i] for i in own])

    def slices(self, text: str | None):
        """``text`` in parts of about HELD characters, cut at white space."""
        text, at = text or "", 0
        while len(text) - at > HELD:
            m = self.space.search(text, at + HELD)
            if not m:
                break
            yield text[at : m.start()]
            at = m.end()
        yield text[at:]

    def pieces(self, texts):
        """(place, parts) for each slice of ``texts``, in order: what is known of its stretches that have tokens. Nothing but the slices held is in memory."""
        held, size = [], 0
        for place, text in enumerate(texts):
            for part in self.slices(text):
                held.append((place, self.stretches(part)))
                size += len(part)
                if size >= HELD:
                    yield from self._held(held)
                    held, size = [], 0
        yield from self._held(held)

    def _held(self, held):
        self.learn([s for _, stretches in held for s in stretches])
        known = self.known
        for place, stretches in held:
            yield place, [x for s in stretches if (x := known[s])[0]]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, parts in self.pieces([text]) for _, ids, _ in parts for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one space between; the file has no decoder that would join them otherwise."""
        return " ".join([self.labels[i] for i in ids])


def _digests(held):
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        bpe = held.value
        for b in batches:
            n, ids, decoded = [0] * b.num_rows, [hashlib.sha256() for _ in range(b.num_rows)], [hashlib.sha256() for _ in range(b.num_rows)]
            for k, parts in bpe.pieces(t.as_py() for t in b.column(1)):
                if parts:
                    gap = b" " if n[k] else b""
                    n[k] += sum([x[0] for x in parts])
                    ids[k].update(gap + " ".join([x[1] for x in parts]).encode())
                    decoded[k].update(gap + " ".join([x[2] for x in parts]).encode())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x.hexdigest() for x in ids], pa.string()), pa.array([x.hexdigest() for x in decoded], pa.string())], schema=schema)

    return run


def _encoded(held):
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def rows(whole):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in whole], pa.int64()), pa.array([r[1] for r in whole], pa.list_(pa.int32())), pa.array([r[2] for r in whole], pa.string())], schema=schema)

    def run(batches):
        bpe = held.value
        for b in batches:
            whole, size, now, ids, decoded = [], 0, 0, [], []
            for k, parts in bpe.pieces(t.as_py() for t in b.column(1)):
                if k != now:
                    whole.append((b.column(0)[now].as_py(), np.fromstring(" ".join(ids), np.int32, sep=" "), " ".join(decoded)))
                    size += len(whole[-1][2])
                    now, ids, decoded = k, [], []
                    if size > HELD:
                        yield rows(whole)
                        whole, size = [], 0
                if parts:
                    ids.append(" ".join([x[1] for x in parts]))
                    decoded.append(" ".join([x[2] for x in parts]))
            if b.num_rows:
                whole.append((b.column(0)[now].as_py(), np.fromstring(" ".join(ids), np.int32, sep=" "), " ".join(decoded)))
                yield rows(whole)

    return run


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def _compiled(docs: DataFrame, path: str):
    """The tables of ``path``, compiled on the driver, which doesn't keep them."""
    return docs.sparkSession.sparkContext.broadcast(WordTokenizer(path))


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) for each row of ``docs``. ``path`` is the tokenizer's file on the driver.

    Null counts as empty, and empty texts have no ids. Repeated rows and ids stay as they are; other columns
    are not read. No shuffle: each text is encoded where it is read.
    """
    return _slim(docs, id_col, text_col).mapInArrow(_encoded(_compiled(docs, path)), "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of what :func:`bpe_encode` gives, without moving it."""
    return _slim(docs, id_col, text_col).mapInArrow(_digests(_compiled(docs, path)), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
