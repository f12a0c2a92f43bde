"""Merge-type SentencePiece encoding by a prefix table, and decoding.

For every prefix of a piece of text exactly one token can be the last one of its encoding. An Aho-Corasick automaton lists the
vocabulary tokens that end at each position; the one whose pair with the last token of the prefix before it is compatible (the
merges of the two strings side by side leave these two tokens) is stored. Following the stored tokens backwards gives the ids in
time linear in the text, with no merge queue over the text.

Text is cut before each run of marks U+2581 that follows another character: no token of the vocabulary contains another character
followed by a mark, so merges never cross such a cut. The runs of marks themselves have equal scores and are merged from the left.
A vocabulary that lacks one of these properties is refused.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import in_slices
from millrace.shipping import ship

MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class MergeCodec:
    """Encoder and decoder of one model file. ``cache_bytes`` bounds (about) each of the two generations of remembered pieces."""

    def __init__(self, model: str, cache_bytes: int = 50_000_000):
        import ahocorasick
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        size = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(size)]
        self.end_id, self.unknown_id = library.eos_id(), library.unk_id()
        self.controls = {i for i in range(size) if library.is_control(i)}
        self.byte_of = {i: int(self.pieces[i][3:-1], 16) for i in range(size) if library.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.id_of = {self.pieces[i]: i for i in range(size) if i not in self.byte_of and i not in self.controls and i != self.unknown_id}
        self.score = {p: library.get_score(i) for p, i in self.id_of.items()}
        for p in self.id_of:
            if re.search(f"[^{MARK}]{MARK}|{MARK}{MARK}[^{MARK}]", p):
                raise ValueError(f"token {p!r} joins words; this codec needs a vocabulary without such tokens")
        runs = {p: s for p, s in self.score.items() if len(p) > 1 and p == MARK * len(p)}
        if runs and max(runs.values()) >= min((s for p, s in self.score.items() if p not in runs and len(p) > 1), default=0):
            raise ValueError("runs of marks must have the lowest scores")
        if not self.id_of_byte or any(library.is_unused(i) for i in range(size)):
            raise ValueError("a vocabulary with byte fallback and without unused tokens is needed")
        self.automaton = ahocorasick.Automaton()
        self.halves: dict[str, tuple[str, str]] = {}
        for p, i in sorted(self.id_of.items(), key=lambda x: len(x[0])):
            if p not in runs and (len(p) == 1 or self._reachable(p)):
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.tokens = list(self.pieces)  # and, appended, characters outside the vocabulary
        self.sizes = [len(p) for p in self.pieces]
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        self.decimal = [str(i) for i in range(size)]
        self.special = frozenset(self.byte_of) | self.controls | {self.unknown_id}
        if not self.id_of.keys() >= {c for p in self.id_of for c in p}:
            raise ValueError("every character of a token must be a token")
        self.strange = re.compile(f"[^{''.join(map(re.escape, sorted(p for p in self.id_of if len(p) == 1)))}]")
        self.extra: dict[str, int] = {}
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, str] = {}  # a word behind one mark, without it, to its decimal ids joined by one space
        self.old: dict[str, str] = {}
        self.odd: dict[str, str] = {}  # words whose ids decode to something else than a blank and the word
        self.most, self.load = cache_bytes, 0

    def merged(self, text: str) -> list[str]:
        """The merges by definition: the adjacent pair of the highest score first, from the left among equals."""
        part: list[str | None] = list(text)
        n = len(part)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        score, queue = self.score, []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (s := score.get(part[i] + part[j])) is not None:
                heapq.heappush(queue, (-s, i, j, len(part[i]) + len(part[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, size = heapq.heappop(queue)
            if part[i] is None or part[j] is None or len(part[i]) + len(part[j]) != size or right[i] != j:
                continue
            part[i] += part[j]
            part[j] = None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in part if p is not None]

    def _reachable(self, token: str) -> bool:
        """Whether the token is the encoding of its own string; if so, keep the two strings that its last merge joins."""
        own = self.score[token]
        for k in range(1, len(token)):
            x, y = token[:k], token[k:]
            if (len(x) == 1 or x in self.halves) and (len(y) == 1 or y in self.halves) and all(len(s) == 1 or self.score[s] > own for s in (x, y)):
                del_score = self.score.pop(token)
                apart = self._apart(x, y)
                self.score[token] = del_score
                if apart:
                    self.halves[token] = (x, y)
                    return True
        if self.merged(token) == [token]:
            raise ValueError(f"token {token!r} is made from tokens of lower scores; this codec needs scores that fall with each merge")
        return False

    def compatible(self, a: int, b: int) -> bool:
        """Whether the tokens a and b can follow one another."""
        key = a << 24 | b
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            found = self.pairs[key] = self._apart(self.tokens[a], self.tokens[b])
        return found

    def _apart(self, x: str, y: str) -> bool:
        """Whether no merge crosses the border of x and y: undo, latest first, the merges that made the strings beside the border; a
        merge across it would have come first if its score is above that of the merge undone (or equal, where it lies further left)."""
        score, halves = self.score, self.halves
        if x + y in score:
            return False
        while True:
            sx, sy = (score[s] if len(s) > 1 else math.inf for s in (x, y))
            if sx == sy == math.inf:
                return True
            if sx < sy:
                x = halves[x][1]
                if score.get(x + y, -math.inf) > sx:
                    return False
            else:
                y = halves[y][0]
                if score.get(x + y, -math.inf) >= sy:
                    return False

    def _single(self, char: str) -> int:
        if char not in self.extra:
            self.extra[char] = len(self.tokens)
            self.tokens.append(char)
        return self.extra[char]

    def last_tokens(self, text: str) -> list[int]:
        """Tokens of a piece without runs of marks, from its prefix table."""
        n, known = len(text), self.id_of
        if self.strange.search(text):
            # a character outside the vocabulary is a token of its own, and no token goes across it
            out, start = [], 0
            for at, char in enumerate(text):
                if char not in known:
                    out += self.last_tokens(text[start:at]) if start < at else []
                    out.append(self._single(char))
                    start = at + 1
            return out + (self.last_tokens(text[start:]) if start < n else [])
        last = [0] * (n + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end]:
                continue
            if end > length:
                prev = last[end - length]
                found = pairs.get(prev << 24 | token)
                if not (compatible(prev, token) if found is None else found):
                    continue
            last[end] = token
        out, sizes = [], self.sizes
        while n:
            out.append(token := last[n])
            n -= sizes[token]
        return out[::-1]

    def chunk_ids(self, chunk: str) -> list[int]:
        marks = len(chunk) - len(chunk.lstrip(MARK)) if chunk[1:2] == MARK else 1
        tokens = self.last_tokens(chunk[marks - 1 :])
        if marks > 1:
            alone = tokens and tokens[0] == self.id_of.get(MARK)
            run = self.merged(MARK * (marks if alone else marks - 1))
            tokens = [self.id_of[p] for p in run] + tokens[1 if alone else 0 :]
        n, ids = len(self.pieces), []
        if not tokens or max(tokens) < n:
            return tokens
        for t in tokens:
            if t < n:
                ids.append(t)
            else:
                ids += [self.id_of_byte[b] for b in self.tokens[t].encode()]
        return ids

    def chunks(self, text: str) -> list[str]:
        """The pieces that are encoded on their own; together they are a mark and the text with marks for blanks."""
        if not text:
            return []
        return re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))

    def encode(self, text: str) -> list[int]:
        """The ids of the text, then the end id."""
        return [i for c in self.chunks(text) for i in self.chunk_ids(c)] + [self.end_id]

    def surface(self, ids: list[int]) -> str:
        if self.special.isdisjoint(ids):
            return "".join(map(self.shown.__getitem__, ids))
        out, raw = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if i == self.unknown_id:
                out.append(" ⁇ ")
            elif i >= 0 and i not in self.controls:
                out.append(self.pieces[i].replace(MARK, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: control tokens vanish, the mark that encoding put in front is taken off."""
        first = next((i for i in ids if i not in self.controls), -1)
        text = self.surface(ids)
        return text[1:] if first >= 0 and first not in self.byte_of and self.pieces[first].startswith(MARK) else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text), piece by piece with a bounded cache."""
        said, out = self._whole(text)
        return said.count(" ") + 1, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(out[1:].encode()).hexdigest()

    def encode_cached(self, text: str) -> np.ndarray:
        """The ids of ``encode``, by way of the cache."""
        return np.array(self._whole(text)[0].split(" "), dtype=np.int32)

    def _whole(self, text: str) -> tuple[str, str]:
        """(decimal ids joined by one space, the text they decode to with its mark in front)."""
        if not text:
            return str(self.end_id), ""
        if MARK in text:
            text = text.replace(MARK, " ")
        words = text.split(" ")
        found = list(map(self.young.get, words))
        if None in found:
            for k, entry in enumerate(found):
                if entry is None:
                    found[k] = self._remembered(words[k])
        if "" in words:  # runs of marks are merged with what follows them
            return self._with_runs(text)
        shown = words if self.odd.keys().isdisjoint(words) else [self.odd.get(w, w) for w in words]
        return f"{' '.join(found)} {self.end_id}", " " + " ".join(shown)

    def _with_runs(self, text: str) -> tuple[str, str]:
        said, shown = [], []
        for chunk in self.chunks(text):
            if chunk.count(MARK) == 1 and len(chunk) > 1:
                said.append(self.young.get(chunk[1:]) or self._remembered(chunk[1:]))
                shown.append(" " + self.odd.get(chunk[1:], chunk[1:]))
            else:
                ids = self.chunk_ids(chunk)
                said.append(" ".join(map(self.decimal.__getitem__, ids)))
                shown.append(self.surface(ids))
        return f"{' '.join(said)} {self.end_id}", "".join(shown)

    def _remembered(self, word: str) -> str:
        entry = self.old.get(word)
        if entry is None:
            ids = self.chunk_ids(MARK + word)
            entry = " ".join(map(self.decimal.__getitem__, ids))
            if (shown := self.surface(ids)) != " " + word:
                self.odd[word] = shown[1:]
        if len(word) <= 64:
            if self.load >= self.most:
                self.old, self.young, self.load = self.young, {}, 0
            self.young[word] = entry
            self.load += 200 + 2 * len(word) + len(entry)
        return entry


def _utf8(raw: bytes) -> str:
    """Valid sequences as their characters, each byte of the others as U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                size = 1
            at += size
        return "".join(out)


_CODECS: dict[str, MergeCodec] = {}


def codec(model: str) -> MergeCodec:
    """One codec a process and model."""
    if model not in _CODECS:
        _CODECS[model] = MergeCodec(model)
    return _CODECS[model]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, ids array) of every whole text: its ids and the end id. A null text counts as empty; repeated rows stay repeated."""
    model = model or default_model()
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode_cached(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(in_slices(run), f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the inverse of ``encode_documents``; null ids give a null text."""
    model = model or default_model()
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else c.decode(i) for i in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(in_slices(run), f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded in one pass, one row an input row.

    A null text is encoded as an empty one. Extra columns are not looked at; nulls in the id stay.
    """
    model = model or default_model()
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            found = [c.digest(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(x) if found else [], k) for x, k in zip(zip(*found) if found else ((), (), ()), (pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(in_slices(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
