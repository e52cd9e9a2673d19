"""Exact BPE by backtracking, and decoding from an offset table.

The encoder takes the longest token at a position (found by an Aho-Corasick automaton over all
tokens) and keeps it if the pair with the token before is compatible, that is if merging would
leave both as they are; otherwise it tries the next shorter token, and then goes back one token.
Positions that failed once are not tried again, so the work is linear in the word's length.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from loomgraph.llm import kernel as K
from loomgraph.llm.line_dedup import arrow_schema, with_ids

_FAR = regex.compile(r"[^\x00-\u024F]").search
END = "\x00"  # stands for the end-of-word mark, which is no symbol of the byte alphabet
#: Words whose encodings a task holds; the table starts anew beyond it.
CACHE_WORDS = 400_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBPE:
    """Encoder and decoder of a tokenizer file with word ends, byte alphabet and lower-casing."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.mark = model["end_of_word_suffix"]
        self.alphabet = byte_alphabet()
        self.places = {c: i for i, c in enumerate(self.alphabet)}
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        # The library's \s is the White_Space property.
        self.words = regex.compile(split.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]")).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.vocab = {self._plain(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.size = {i: len(t) for t, i in self.vocab.items()}
        self.text = {i: t for t, i in self.vocab.items()}
        self.joins: dict[tuple[int, int], int] = {}  # pair -> rank of its merge
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = self.vocab[self._plain(left)], self.vocab[self._plain(right)]
            whole = self.vocab[self._plain(left + right)]
            self.joins.setdefault((a, b), rank)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (a, b), rank
        self.automaton = ahocorasick.Automaton()
        for t, i in self.vocab.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        # Decoding: the strings of all ids in one buffer, and where each begins.
        top = max([*model["vocab"].values(), *self.special.values()]) + 1
        shown = [""] * top
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            shown[i] = t
        raw = [t.encode() for t in shown]
        self.offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(raw), np.uint8)

    def _plain(self, token: str) -> str:
        return token[: -len(self.mark)] + END if token.endswith(self.mark) and len(token) > len(self.mark) else token

    def _prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of a token, or -1."""
        got = self.shorter.get(token)
        if got is None:
            t = self.text[token]
            got = next((self.vocab[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.vocab), -1)
            self.shorter[token] = got
        return got

    def fits(self, left: int, right: int) -> bool:
        """True if no merge across the border would come before the merges that made both tokens."""
        key = (left, right)
        got = self.compatible.get(key)
        if got is None:
            got = self.compatible[key] = self._fits(left, right)
        return got

    def _fits(self, left: int, right: int) -> bool:
        # Undo the later of the two tokens' last merges again and again: at each stage the symbols at
        # the border are those that stood there just before it, so a merge of them with a smaller
        # rank (or the same, where it lies further left) would have been made first.
        limit = float("inf")
        base = -1
        while True:
            if self.joins.get((left, right), float("inf")) < limit:
                return False
            a, b = self.rank.get(left, base), self.rank.get(right, base)
            if a == base and b == base:
                return True
            if a > b:
                limit, left = a, self.parts[left][1]
            else:
                # An equal merge at the border lies left of the one inside the right token.
                limit, right = b + 0.5, self.parts[right][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        text = "".join(map(self.alphabet.__getitem__, word.encode())) + END
        n = len(text)
        longest: list[int] = [-1] * (n + 1)
        best = [0] * (n + 1)
        for end, (size, token) in self.automaton.iter(text):
            at = end - size + 1
            if size > best[at]:
                best[at], longest[at] = size, token
        ids: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            last = ids[-1] if ids else -1
            while token >= 0:
                end = at + self.size[token]
                if not dead[end] and (end == n or longest[end] >= 0) and (last < 0 or self.fits(last, token)):
                    break
                token = self._prefix(token)
            if token >= 0:
                ids.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                if not ids:
                    raise ValueError(f"no tokens make up {word!r}")
                dead[at] = 1
                token = ids.pop()
                at -= self.size[token]
        return ids

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of text without special tokens.

        Texts beyond the extended Latin letters are split by the library, as the classes of rarer
        characters depend on its version of Unicode.
        """
        if text.isascii():
            return self.words(text.lower())
        if not _FAR(text):
            return self.words(unicodedata.normalize("NFC", text).lower())
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.places.__getitem__, w)).decode() for w, _ in shown]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for w in self.pieces(part):
                    out += self.encode_word(w)
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Tokens joined by one space, as a tokenizer without decoder has it."""
        return self._decoded(np.asarray(ids, np.int64)).decode()

    def _decoded(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        lo = self.offsets[ids]
        size = self.offsets[ids + 1] - lo + 1
        cut = np.cumsum(size)
        at = np.repeat(lo - (cut - size), size) + np.arange(cut[-1])
        out = self.buffer[np.minimum(at, len(self.buffer) - 1)]
        out[cut - 1] = 32
        return out[:-1].tobytes()


class _Cache(dict):
    def __init__(self, bpe: WordBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[word] = np.array(self.bpe.encode_word(word), np.int32)
        return got


@functools.lru_cache(2)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def encode_documents(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """Encodes and decodes every text (null: empty).

    Returns doc_id, n_tokens, ids_sha256 (decimal ids joined by one space) and decoded_sha256, and
    the ids themselves with ``ids``.  The texts of special tokens are those tokens, as the
    tokenizers library has it.  Rows without doc_id are left out; repeated rows give repeated rows.
    """
    src = with_ids(docs)
    schema, ddl = arrow_schema(src, (), [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    if ids:
        schema, ddl = schema.append(pa.field("ids", pa.list_(pa.int32()))), ddl + ", ids array<int>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        cache = _Cache(bpe)
        size = np.diff(bpe.offsets)
        shown = np.array([str(i) for i in range(len(size))], object)
        empty = np.zeros(0, np.int32)
        for part in K.slices(batches):
            rows: list[list] = [[], [], [], []]
            for text in part.column("text").to_pylist():
                got = []
                for x in bpe.cut.split(text or "") if bpe.cut else [text or ""]:
                    if x in bpe.special:
                        got.append(np.array([bpe.special[x]], np.int32))
                    else:
                        got += map(cache.__getitem__, bpe.pieces(x))
                all_ids = np.concatenate(got) if got else empty
                rows[0].append(len(all_ids))
                rows[1].append(hashlib.sha256(" ".join(shown[all_ids].tolist()).encode()).hexdigest())
                rows[2].append(hashlib.sha256(bpe._decoded(all_ids)).hexdigest())
                rows[3].append(all_ids)
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(rows[0], pa.int64()), pa.array(rows[1]), pa.array(rows[2]), *([pa.array(rows[3], pa.list_(pa.int32()))] if ids else [])], schema=schema)

    return src.mapInArrow(run, ddl)
