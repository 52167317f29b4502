"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can stand last in its BPE
encoding. `Prefixes` stores that token per prefix: bytes can be appended without
encoding anew, and after an edit only the prefixes near it are computed again.
The encoding is read off by walking back from the end.

Whether token t may follow token s is decided from the merge table alone: s and t
stay apart if undoing the later merges step by step never meets a pair across
their border that merges earlier than the parts around it.

Defined results (encode_texts): a null text is empty and has no tokens, and the
digests of no bytes; texts are encoded whole; repeated rows give repeated
results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import regex
from pyspark.sql import DataFrame

from guardwalk.llm.arrow import map_rows

#: Entries of a worker's piece memory; beyond it the memory starts anew. It bounds memory, not results.
MEMORY = 400_000


class Vocabulary:
    """Ranks of a byte-level BPE, the tokens' bytes, and each token's last merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self._apart: dict[int, bool] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            pair = self._last_merge(token, i) if len(token) > 1 else None
            self.halves[i] = pair or (i, i)
            if pair:
                self.merged[pair] = i
        self.automaton = ahocorasick.Automaton()  # over bytes taken as characters
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two parts that merge into the token at its own rank, found with the merges before it."""
        parts = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((m, i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if (m := self.merged.get(p, rank)) < rank), default=None)
            if best is None:
                return None
            parts[best[1] : best[1] + 2] = [best[0]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens apart when their bytes stand side by side."""
        key = left << 32 | right
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > MEMORY:
                self._apart.clear()
            known = self._apart[key] = self._stay_apart(left, right)
        return known

    def last_tokens(self, data: bytes) -> list[int]:
        """The last token of every prefix; the automaton gives the tokens that end at each byte, longest first."""
        last, known, ends = [-1], self._apart, 0
        for end, (size, token) in self.automaton.iter(data.decode("latin-1")):
            if end == ends:
                start = end + 1 - size
                if start:
                    left = last[start]
                    ok = known.get(left << 32 | token)
                    if ok or ok is None and self.apart(left, token):
                        last.append(token)
                        ends += 1
                else:
                    last.append(token)
                    ends += 1
        if ends < len(data):
            raise ValueError("the vocabulary lacks single bytes")
        return last

    def _stay_apart(self, left: int, right: int) -> bool:
        # Go back in time: undo whichever of the two border tokens was made last. The border pair must not
        # merge before that moment; on equal ranks the left one is made first.
        before = float("inf")
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < before:
                return False
            l_whole, r_whole = self.halves[left][0] == left, self.halves[right][0] == right
            if l_whole and r_whole:
                return True
            if not l_whole and (r_whole or left > right):
                before, left = left, self.halves[left][1]
            else:
                before, right = right + 1, self.halves[right][0]


class Prefixes:
    """The last token of every prefix of a growing or edited byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, data, vocabulary.last_tokens(data)

    def _token_at(self, data: bytes, end: int) -> int:
        ranks, last, apart = self.v.ranks, self.last, self.v.apart
        for start in range(max(0, end - self.v.longest), end):
            t = ranks.get(data[start:end])
            if t is not None and (start == 0 or apart(last[start], t)):
                return t
        raise ValueError("the vocabulary lacks single bytes")

    def append(self, more: bytes) -> None:
        self.data += more
        for end in range(len(self.last), len(self.data) + 1):
            self.last.append(self._token_at(self.data, end))

    def edit(self, start: int, stop: int, put: bytes) -> int:
        """Replace bytes [start, stop); returns how many prefixes were computed again.

        A prefix's token depends on the `longest` prefixes before it and on its own last
        bytes, so once that many tokens in a row are as before, the rest is too.
        """
        old, tail = self.last, self.data[stop:]
        self.data = self.data[:start] + put + tail
        self.last, shift, same, done = old[: start + 1], start + len(put) - stop, 0, 0
        for end in range(start + 1, len(self.data) + 1):
            token = self._token_at(self.data, end)
            self.last.append(token)
            done += 1
            past = end - shift
            same = same + 1 if end > start + len(put) and old[past] == token else 0
            if same >= self.v.longest:
                self.last += old[past + 1 :]
                break
        return done

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.v.bytes[self.last[end]])
        return out[::-1]


def compiled(pattern: str) -> regex.Pattern:
    r"""The split pattern with \s as the Unicode property, which is what tiktoken's engine takes it for."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Encoder:
    """Encodes texts; remembers pieces. Values are the ids as one string, which the digests need."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.v, self.split = vocabulary, compiled(pattern).findall
        self.memory: dict[str, str] = {}
        self.chunks: dict[str, str] = {}
        self.decoded = {str(i): t for i, t in vocabulary.bytes.items()}

    def piece(self, piece: str) -> str:
        ids = self.memory.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.v.ranks.get(data)
            ids = str(whole) if whole is not None else " ".join(map(str, Prefixes(self.v, data).tokens()))
            if len(piece) < 40:
                if len(self.memory) >= MEMORY:
                    self.memory.clear()
                self.memory[piece] = ids
        return ids

    def run(self, text: str) -> str:
        return " ".join(map(self.piece, self.split(text)))

    def chunk(self, chunk: str) -> str:
        ids = self.run(" " + chunk)
        if len(chunk) < 40:
            if len(self.chunks) >= MEMORY:
                self.chunks.clear()
            self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> str:
        """The ids, joined by one space.

        A space with a non-space behind it always begins a piece, so a text without
        longer runs of white space can be cut there and known chunks looked up.
        """
        first, *rest = text.split(" ")
        if any(not c or c[0].isspace() for c in rest):
            return self.run(text)
        get, make = self.chunks.get, self.chunk
        out = [get(c) or make(c) for c in rest]
        if first:
            out.insert(0, self.run(first))
        return " ".join(out)

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.decoded.__getitem__, ids.split(" "))) if ids else b""


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process."""
    return Encoder(Vocabulary.read(path), pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token count, digest of the ids, digest of the bytes decoded from them; `with_ids` adds the ids."""

    def make():
        e = encoder(path, pattern)

        def one(doc_id, text):
            ids = e.encode(text or "")
            row = (doc_id, ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest())
            return (*row, list(map(int, ids.split(" "))) if ids else []) if with_ids else row

        return one

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_rows(docs, [docs[id_col], docs[text_col]], schema, make)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
