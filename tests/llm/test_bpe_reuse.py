"""Chunk reuse and long runs of the BPE encoder, against the tokenizers library."""

import random

import pytest

from quillmark.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 1_200_000 + "x", "a" + " \n" * 600_000 + "b " * 50, " " * 1_100_000 + "a", "x" + chr(0x1C) * 50_000, "漢字、かな。" * 20_000, "é" * 400_000], ids=range(7))
def test_long_runs(library, text):
    coder = bpe.ChunkEncoder(bpe.default_vocabulary())
    ids = coder.encode(text)
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and coder.decode(ids) == text


def test_copies_are_encoded_once(library):
    r = random.Random(1)
    words = [f"w{r.randrange(900)}" for _ in range(30_000)]
    texts = [" ".join(words[i : i + 40]) for i in range(0, 4000, 40)]  # short: one chunk each
    coder = bpe.ChunkEncoder(bpe.default_vocabulary())
    for t in texts * 3:
        coder.encode(t)
    assert (coder.misses, coder.hits) == (len(texts), 2 * len(texts))
    long = " ".join(words)
    coder = bpe.ChunkEncoder(bpe.default_vocabulary())
    coder.encode(long)
    first = coder.misses
    got = coder.encode("Another start. " + long[137:])  # chunks realign after the first
    assert coder.misses - first <= 3 and coder.hits >= first - 4 and coder.repairs > 20
    assert got.tolist() == library.encode("Another start. " + long[137:], add_special_tokens=False).ids


def test_window_grows_until_both_sides_agree(library):
    """With a chunk's ids spoilt at its outer seams, the window grows past them; spoilt everywhere, the whole text is encoded."""
    r = random.Random(2)
    text = " ".join(f"word{r.randrange(99)}" for _ in range(2000))
    want = library.encode(text, add_special_tokens=False).ids
    for reach in (1, bpe.SEAMS):
        coder = bpe.ChunkEncoder(bpe.default_vocabulary())
        honest, seen = coder.chunk, []

        def spoilt(part, joined, honest=honest, seen=seen, reach=reach):
            found = honest(part, joined)
            if found is not None and found.first and part not in seen:
                seen.append(part)
                if len(seen) == 1:  # nothing before it to agree with
                    return found
                found.ids = found.ids.copy()
                # between the first seam and seam ``reach``: what a join has to agree with
                found.ids[found.first[0][1] : found.first[min(reach, len(found.first) - 1)][1]] = 7
            return found

        coder.chunk = spoilt
        assert coder.encode(text).tolist() == want and coder.grown > 0


def test_chunks_without_seams_are_not_encoded_twice():
    coder = bpe.ChunkEncoder(bpe.default_vocabulary())
    text = "".join(random.Random(3).choices("0123456789+-", k=20_000))
    assert len(bpe.borders(text.encode())) > 3
    calls = []
    plain = coder.plain
    coder.plain = lambda t: calls.append(len(t)) or plain(t)
    coder.encode(text)
    assert sum(calls) == len(text)


def test_cache_is_bounded():
    coder = bpe.ChunkEncoder(bpe.default_vocabulary(), cache_tokens=500)
    r = random.Random(4)
    for i in range(300):
        coder.encode(" ".join(f"{r.random():.6f}" for _ in range(20)) + f" {i}")
    assert sum(len(c.ids) for c in (*coder.young.values(), *coder.old.values())) <= 1000
