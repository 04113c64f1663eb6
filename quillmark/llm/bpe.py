"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the UTF-8 bytes cuts every text into chunks whose borders depend on nearby content only, so that copies
and shared passages give equal chunks wherever they stand; a text without a border is one chunk. A chunk is encoded once while it
is in the task's cache, whose size in tokens is bounded; what isn't asked for again leaves it first. Sharing chunks between tasks
would shuffle the whole corpus, which costs more than encoding it (figures in the README).

Joining the token lists of chunks isn't exact near a border, so each join is repaired: the text from a seam inside the left chunk
to a seam inside the right one is encoded anew, and the window grows seam by seam until its first and its last tokens agree with
the tokens that both chunks have there; if no seam is left, the whole text is encoded. A seam is a place between a letter and
another character: no pre-token of this vocabulary spans it and no look-ahead sees across it, hence the tokens outside an agreeing
window are those of the whole text. Chunks with too few seams are never encoded alone; they join the window.

Long runs of white space are cut out before the encoder's pattern sees them: its look-ahead would need a stack as deep as the run.

Null and empty text: no token. Texts of any length are encoded whole, in memory in proportion to one text. Equal texts and repeated
rows give equal ids, each row its own. Empty tables give empty results. Columns beyond the id, the text and ``also`` are left out,
whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
#: A border on average every 2**CHUNK_BITS bytes, and never nearer to the one before than LEAST bytes.
CHUNK_BITS = 10
LEAST = 256
#: Bytes that the rolling hash sees.
WINDOW = 16
#: Tokens that each of the two generations of a task's chunk cache may hold.
CACHE_TOKENS = 2_000_000
#: Seams that are kept at each end of a chunk.
SEAMS = 6
#: White space as the vocabulary's pattern has it, and the run length from which a run is cut out.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 20_000
_LONG = re.compile(f"(?<![{_WHITE}])[{_WHITE}]{{{LONG_RUN},}}+")
#: Ranges of code points that are letters, and that aren't, in every version of Unicode.
_LETTERS = ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x3B1, 0x3C9), (0x400, 0x481), (0x5D0, 0x5EA), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
_OTHERS = ((0, 0x40), (0x5B, 0x60), (0x7B, 0x7F), (0xA0, 0xA9), (0x2010, 0x2027), (0x2030, 0x205E), (0x3000, 0x3003), (0x3008, 0x3011), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20))


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The vocabulary as a tiktoken encoding, read from the tokenizers file itself: its merges give the ranks."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocab = model["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable}
    back |= {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(printable))}
    ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token != SPECIAL}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def borders(data: bytes, bits: int = CHUNK_BITS) -> np.ndarray:
    """Byte offsets of the chunk borders inside ``data``: where the hash of the last WINDOW bytes has ``bits`` zero bits."""
    if len(data) <= WINDOW:
        return np.empty(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    h = (raw.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    step, mult = 1, 0x01000193
    while step < WINDOW:
        h[step:] = h[step:] + h[:-step] * np.uint32(mult)
        mult = mult * mult & 0xFFFFFFFF
        step *= 2
    at = np.flatnonzero((h[WINDOW - 1 : -1] >> np.uint32(32 - bits)) == 0) + WINDOW
    at = at[(raw[at] & 0xC0) != 0x80]  # between characters only
    if len(at) > 1 and np.diff(at, prepend=0).min() < LEAST or len(at) and at[0] < LEAST:
        kept, last = [], 0
        for x in at.tolist():
            if x - last >= LEAST:
                kept.append(x)
                last = x
        at = np.array(kept, np.int64)
    return at


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of the code points of the basic plane: 1 for a letter, 2 for another character, 0 for those that no seam touches."""
    out = np.zeros(65536, np.uint8)
    for kind, ranges in ((1, _LETTERS), (2, _OTHERS)):
        for a, b in ranges:
            out[a : b + 1] = kind
    return out


def seams(text: str) -> np.ndarray:
    """Places (in code points) between a letter and another character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[np.minimum(codes, 65535)]
    return np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1


class Chunk:
    """A chunk's ids and its outer seams, each with its place in the text and the number of tokens before it."""

    __slots__ = ("ids", "text", "first", "last")

    def __init__(self, text: str, ids: np.ndarray, first: list, last: list):
        self.text, self.ids, self.first, self.last = text, ids, first, last


class ChunkEncoder:
    """Encodes texts chunk by chunk; ``hits`` and ``misses`` count the reuse, ``repairs`` the joins, ``grown`` those that had to grow."""

    def __init__(self, path: str, bits: int = CHUNK_BITS, cache_tokens: int = CACHE_TOKENS):
        self.enc, self.bits, self.limit = encoder(path), bits, cache_tokens
        self.young: dict[str, Chunk] = {}
        self.old: dict[str, Chunk] = {}
        self.held = self.hits = self.misses = self.repairs = self.grown = 0
        self.lengths = np.zeros(self.enc.n_vocab + 1, np.int64)
        for i in range(self.enc.n_vocab):
            try:
                self.lengths[i] = len(self.enc.decode_single_token_bytes(i))
            except KeyError:
                continue

    def plain(self, text: str) -> np.ndarray:
        """The ids of a text as the vocabulary's own encoder gives them."""
        if len(text) >= LONG_RUN and (runs := [m.span() for m in _LONG.finditer(text)]):
            out, at = [], 0
            for a, b in runs:
                # the last character of a run inside the text belongs to what follows
                end = b if b == len(text) else b - 1
                if a > at:
                    out.append(self._ids(text[at:a]))
                out.append(np.asarray(self.enc._encode_single_piece(text[a:end]), np.int32))
                at = end
            if at < len(text):
                out.append(self._ids(text[at:]))
            return np.concatenate(out)
        return self._ids(text)

    def _ids(self, text: str) -> np.ndarray:
        return self.enc.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def chunk(self, text: str, joined: bool) -> Chunk | None:
        """The encoded chunk; None if it is to be joined with others and has too few seams for that."""
        found = self.young.get(text)
        if found is None and (found := self.old.get(text)) is not None:
            self._keep(text, found)
        if found is not None and not (joined and found.first is None):
            self.hits += 1
            return found
        at = seams(text) if joined else None
        if joined and len(at) < 4:
            return None
        self.misses += 1
        ids, first, last = self.plain(text), None, None
        if joined:
            near = np.r_[at[:SEAMS], at[-SEAMS:]].tolist()
            done, places, upto = 0, [], 0
            for x in near:  # byte offsets, each counted from the place before
                done, upto = done + len(text[upto:x].encode("utf-8", "surrogatepass")) if x >= upto else done - len(text[x:upto].encode("utf-8", "surrogatepass")), x
                places.append(done)
            ends = np.cumsum(self.lengths[ids])
            tokens = np.searchsorted(ends, places, "right").tolist()
            # a place inside a token is no seam (it can't happen with this vocabulary)
            fine = [t > 0 and ends[t - 1] == b for t, b in zip(tokens, places, strict=True)]
            pairs = [(x, t) if f else None for x, t, f in zip(near, tokens, fine, strict=True)]
            half = min(SEAMS, len(at))
            first, last = [p for p in pairs[:half] if p], [p for p in pairs[half:] if p]
            if len(first) < 2 or len(last) < 2:
                return None
        found = Chunk(text, ids, first, last)
        self._keep(text, found)
        return found

    def _keep(self, text: str, chunk: Chunk) -> None:
        if self.held + len(chunk.ids) > self.limit:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[text] = chunk
        self.held += len(chunk.ids)

    def repaired(self, left: Chunk, least: int, between: str, right: Chunk) -> tuple[int, np.ndarray, int, int] | None:
        """(tokens of the left chunk that stay, ids of the window, tokens of the right chunk that go, its place): the window
        grows until its ids begin and end with ids that the chunks have between their own seams. None if the seams run out."""
        for k in range(1, SEAMS):
            if k >= len(right.first) or k >= len(left.last):
                break
            (a, before), (a2, inner) = left.last[-1 - k], left.last[-k]
            (b2, inner2), (b, upto) = right.first[k - 1], right.first[k]
            if before < least:
                break
            ids = self.plain(left.text[a:] + between + right.text[:b])
            one, two = left.ids[before:inner], right.ids[inner2:upto]
            if len(ids) >= len(one) + len(two) and np.array_equal(ids[: len(one)], one) and np.array_equal(ids[len(ids) - len(two) :], two):
                return before, ids, upto, b
            self.grown += 1
        return None

    def segment(self, text: str) -> list[np.ndarray]:
        data = text.encode("utf-8", "surrogatepass")
        cuts = borders(data, self.bits)
        if not len(cuts):
            return [self.chunk(text, False).ids]
        out: list[np.ndarray] = []
        left, taken, start, between = None, 0, 0, ""  # taken: tokens of the left chunk that are out already
        for end in [*cuts.tolist(), len(data)]:
            part = data[start:end].decode("utf-8", "surrogatepass")
            start = end
            chunk = self.chunk(part, True)
            if chunk is None:
                between += part
                continue
            if left is None:
                if between:  # nothing before the window: it starts with the text
                    b, upto = chunk.first[0]
                    out.append(self.plain(between + part[:b]))
                    taken = upto
                left, between = chunk, ""
                continue
            self.repairs += 1
            join = self.repaired(left, taken, between, chunk)
            if join is None:
                return [self.plain(text)]
            stays, ids, taken_next, _ = join
            out += [left.ids[taken:stays], ids]
            left, taken, between = chunk, taken_next, ""
        if left is None:
            return [self.plain(text)]
        if between:
            a, before = left.last[-1]
            if before < taken:
                return [self.plain(text)]
            out += [left.ids[taken:before], self.plain(left.text[a:] + between)]
        else:
            out.append(left.ids[taken:])
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Exactly the ids of the whole text."""
        if not text:
            return np.empty(0, np.int32)
        out: list[np.ndarray] = []
        for k, piece in enumerate(text.split(SPECIAL)):
            if k:
                out.append(np.array([SPECIAL_ID], np.int32))
            if piece:
                out += self.segment(piece)
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.enc.decode_bytes(ids.tolist()).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each id its decimal digits and a comma, left-aligned in a fixed width, and which bytes of it count."""
    width = len(str(n)) + 1
    text = np.zeros((n + 1, width), np.uint8)
    used = np.zeros((n + 1, width), bool)
    for i in range(n + 1):
        s = f"{i},".encode()
        text[i, : len(s)] = np.frombuffer(s, np.uint8)
        used[i, : len(s)] = True
    return text, used


def ids_digest(ids: np.ndarray) -> str:
    """SHA-256 of the decimal ids joined by commas."""
    digest = hashlib.sha256()
    text, used = _decimals(SPECIAL_ID)
    for a in range(0, len(ids), 100_000):
        part = ids[a : a + 100_000]
        joined = text[part][used[part]]
        digest.update(memoryview(joined if a + 100_000 < len(ids) else joined[:-1]))
    return digest.hexdigest()


def encode_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, ``ids`` array<int> and ``decoded``, the text that the ids give."""

    def make():
        coder = ChunkEncoder(vocabulary)

        def apply(texts):
            ids = [coder.encode(t) for t in texts]
            return {"ids": ids, "decoded": [coder.decode(x) for x in ids]}

        return apply

    return map_texts(df, id_col, text_col, "ids array<int>, decoded string", make, also)


def encode_digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """The same work with only counts and digests of the ids and of the decoded text as output."""

    def make():
        coder = ChunkEncoder(vocabulary)

        def apply(texts):
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in texts:
                ids = coder.encode(t)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(ids_digest(ids))
                out["decoded_sha256"].append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            return out

        return apply

    return map_texts(df, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make, also)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
