"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that ends the prefix's encoding. A token ends prefix ``i`` if it
is a suffix of it and forms a stable pair with the last token of what comes before. Storing that token for each prefix
gives the encoding by walking back, lets bytes be appended exactly, and after an edit only prefixes near it are redone.
"""

from __future__ import annotations

import array
import base64
import bisect
import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretokens import WordCache


class Ranks:
    """Merge ranks of a byte-level vocabulary; a token's id is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.rank.values()) + 1)
        for token, r in self.rank.items():
            self.bytes[r] = token
        self.longest = max(map(len, self.rank))
        self.stable: dict[int, bool] = {}
        self._split: dict[int, tuple[int, int]] = {}

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge of ``token`` joined; a single byte is its own half."""
        if token not in self._split:
            parts = [self.rank[bytes([b])] for b in self.bytes[token]]
            while len(parts) > 2:
                best, at = min((self.rank.get(self.bytes[a] + self.bytes[b], 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best >= token:
                    break
                parts[at : at + 2] = [best]
            self._split[token] = (parts[0], parts[-1]) if len(parts) == 2 else (token, token)
        return self._split[token]

    def is_stable(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens ends with exactly these two.

        The merges of both are undone from the latest on; at each moment a merge across the border must not come
        before the next one that really happened.
        """
        key = left << 32 | right
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) > 600_000:
                self.stable.clear()
            known = self.stable[key] = self._is_stable(left, right)
        return known

    def _is_stable(self, left: int, right: int) -> bool:
        limit = 1 << 60  # merges of a lower rank than this come before what is undone
        while True:
            across = self.rank.get(self.bytes[left] + self.bytes[right])
            if across is not None and across < limit:
                return False
            inner_left, inner_right = self.split(left)[1], self.split(right)[0]
            undo_left, undo_right = inner_left != left, inner_right != right
            if not undo_left and not undo_right:
                return True
            if undo_left and (left > right or not undo_right):
                limit, left = left, inner_left  # at equal rank the left merge comes first
            else:
                limit, right = right + 1, inner_right

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of every prefix; ``known`` has those of the first prefixes."""
        last = known or []
        for i in range(len(last) + 1, len(piece) + 1):
            last.append(self.last_token(piece, i, last))
        return last

    def last_token(self, piece: bytes, i: int, last: list[int]) -> int:
        """The last token of the prefix of ``i`` bytes, given those of the shorter ones."""
        rank, stable = self.rank.get, self.is_stable
        for j in range(max(0, i - self.longest), i):
            token = rank(piece[j:i])
            if token is not None and (j == 0 or stable(last[j - 1], token)):
                return token
        raise ValueError("the vocabulary lacks single bytes")

    def walk(self, last: list[int]) -> list[int]:
        """The encoding that the last tokens of all prefixes spell."""
        out, i = [], len(last)
        while i:
            out.append(last[i - 1])
            i -= len(self.bytes[last[i - 1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        return [whole] if whole is not None else self.walk(self.last_tokens(piece))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class PieceEncoding:
    """A piece that can be appended to and edited; only prefixes near the change are encoded again."""

    def __init__(self, ranks: Ranks, piece: bytes = b""):
        self.ranks, self.piece, self.last = ranks, piece, ranks.last_tokens(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.last = self.ranks.last_tokens(self.piece, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Put ``new`` where ``piece[start:stop]`` was.

        Prefixes up to ``start`` are kept. A prefix's last token depends on the bytes and last tokens of the ``longest``
        prefixes before it; once so many in a row past the edit are what they were, all later ones are, too.
        """
        old, shift, same = self.last, len(new) - (min(stop, len(self.piece)) - start), 0
        self.piece = self.piece[:start] + new + self.piece[stop:]
        last = old[:start]
        for i in range(start + 1, len(self.piece) + 1):
            last.append(self.ranks.last_token(self.piece, i, last))
            same = same + 1 if i > start + len(new) and old[i - shift - 1] == last[-1] else 0
            if same >= self.ranks.longest:
                last += old[i - shift :]
                break
        self.last = last

    def ids(self) -> list[int]:
        return self.ranks.walk(self.last)


class TextEncoding:
    """A text that can be appended to and edited; only the pattern's matches near the change are found and encoded again."""

    def __init__(self, ranks: Ranks, text: str = ""):
        import public_tokenizers
        import regex

        self.ranks, self.pattern, self.text = ranks, regex.compile(public_tokenizers.PATTERN), ""
        self.starts: list[int] = []
        self.parts: list[list[int]] = []
        self.append(text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` where ``text[start:stop]`` was.

        A match looks no further than one character past the run of white space it ends in, so matches from the third
        one before the edit on are found anew, until one begins where an old match began behind the edit.
        """
        stop = min(stop, len(self.text))
        shift = len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        first = max(0, bisect.bisect_right(self.starts, start) - 3)
        begin = self.starts[first] if self.starts else 0
        behind = {s + shift: i for i, s in enumerate(self.starts) if s >= stop}
        starts, parts, rest = [], [], len(self.starts)
        for m in self.pattern.finditer(self.text, begin):
            if m.start() >= start + len(new) and m.start() in behind:
                rest = behind[m.start()]
                break
            starts.append(m.start())
            parts.append(self.ranks.encode_piece(m[0].encode()))
        self.starts = self.starts[:first] + starts + [s + shift for s in self.starts[rest:]]
        self.parts = self.parts[:first] + parts + self.parts[rest:]

    def ids(self) -> list[int]:
        return [x for part in self.parts for x in part]


@lru_cache(2)
def _worker(path: str) -> tuple[Ranks, WordCache]:
    ranks = Ranks(path)

    def encode(words: list[str]) -> list[bytes]:
        return [array.array("I", ranks.encode_piece(w.encode())).tobytes() for w in words]

    return ranks, WordCache(encode)


def rank_file() -> str:
    """The default vocabulary, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode_texts(df: DataFrame, key: str, text: str, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids`` of every row.

    Each text is split by the public pattern, each match encoded alone without special tokens, and the ids decoded
    again. A null text counts as empty: no ids. Rows are independent, so ties and repeated rows give equal results, an
    empty table an empty one; other columns are not read. One narrow pass; a worker keeps a bounded number of matches.
    """

    def run(batches):
        ranks, words = _worker(path or rank_file())
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                n, sha, back, ids = [], [], [], []
                for raw in words.ids(texts):
                    got = array.array("I", raw)
                    n.append(len(got))
                    sha.append(hashlib.sha256(raw).hexdigest())
                    back.append(hashlib.sha256(ranks.decode(got)).hexdigest())
                    if with_ids:
                        ids.append(got.tolist())
                cols = {key: part.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
                yield pa.record_batch(cols | ({"ids": pa.array(ids, pa.list_(pa.int64()))} if with_ids else {}))

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids
    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
