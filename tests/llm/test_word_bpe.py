"""The word-end BPE against the tokenizers library: ids, decoded text, Unicode, long pieces, and odd rows."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Regex, Tokenizer, pre_tokenizers

from lectern.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "  \n\t ", "Hello  World's it'S ΑΣ <|endoftext|> x<|startoftext|>y", "<|ENDOFTEXT|>", "<|endoftext|>", " á x\x00y\x1fz\x85w", "#" * 5000, "x" * 3000, "ab" * 2000, "İstanbul ẞ ǅ ﬁ Ạ̣", "日本語テキスト 한국어 ภาษาไทย हिन्दी العربية 𝄞𝒜", "क़ ̈́ Å Ω Ᲊ Ɤ", "the " * 4000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return word_bpe.Encoder(PATH)


def told(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_random_texts_are_the_librarys(own, library):
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x20, 0x530)] + list("日本語한국ภาहि̣́\U0001f600\U00010400ᲉꟋ߽࢘\U00011938'sdlmtr   ")
    kinds = [letters, "abcdefghijklmnopqrstuvwxyz'  ", "!#$%&*()-=_+.,;:'\" ", "aàé ", "ab", "<|endoftx>| "]
    texts = ODD + ["".join(rng.choice(k) for _ in range(250)) for k in kinds for _ in range(150)]
    for text, got in zip(texts, own.encode_batch(texts), strict=True):
        ids, decoded = told(library, text)
        assert np.frombuffer(got, "<u4").tolist() == ids and own.decode(got).decode() == decoded


def plain_merges(own, units):
    """Merging as the ranks say: the least rank, and of equal ones the leftmost, one at a time."""
    row = [ord(u) for u in units]
    while (found := [(own.merges.pairs[a << 20 | b], k) for k, (a, b) in enumerate(zip(row, row[1:])) if a << 20 | b in own.merges.pairs]):
        made, at = min(found)
        row[at : at + 2] = [made]
    return row


def test_pairs_are_compatible_as_merging_says(own):
    """A pair's verdict, by numpy and by the table, is that merging the two spellings gives the two tokens."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 40_000, 3000), rng.integers(0, 49_000, 3000)
    a[:1000], b[:1000] = rng.integers(0, 900, 1000), rng.integers(0, 900, 1000)
    alike = rng.integers(0, 49_000, 500)
    a, b = np.concatenate([a, own.merges.left[alike], alike]), np.concatenate([b, own.merges.right[alike], alike])
    inner = np.array([not any(ord(u) >= 256 for u in own.merges.spelled[x]) for x in a])  # a piece ends once
    a, b = a[inner], b[inner]
    said = own.merges.compatible(a, b)
    assert 0.05 < said.mean() < 0.95
    for x, y, fits in zip(a.tolist(), b.tolist(), said.tolist(), strict=True):
        assert fits == own.merges.agree(x, y) == (plain_merges(own, own.merges.spelled[x] + own.merges.spelled[y]) == [x, y])


def test_classes_are_the_librarys(own):
    """Every character is a letter, number or space for the library if and only if it is for us."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    for name, ranges in word_bpe.classes().items():
        spans = pre_tokenizers.Split(Regex(name + "+"), "removed", invert=True).pre_tokenize_str(text)
        assert {points[k] for _, (begin, end) in spans for k in range(begin, end)} == {c for a, b in ranges for c in range(a, b + 1)}


def test_stable_characters_are_normalized_alike(own, library):
    stable = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000 and word_bpe._STABLE.fullmatch(chr(c))]
    marks = [c for c in stable if unicodedata.combining(c)]
    spaces = re.compile("[" + "".join(f"{chr(x)}-{chr(y)}" for x, y in word_bpe.classes()[r"\s"]) + "]+")
    rng = random.Random(6)
    for text in stable + [rng.choice(stable) + rng.choice(marks) + rng.choice(marks) + rng.choice(stable) for _ in range(20_000)]:
        here = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        assert library.normalizer.normalize_str(text) == spaces.sub(" ", here)


def test_rows(spark, library):
    docs = spark.createDataFrame([*enumerate(ODD), (0, "again"), (None, "no id")], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS decoded", "3 AS n_tokens")
    got = {}
    for r in word_bpe.digests(docs, PATH).collect():
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]))
    for k, text in [*enumerate(ODD), (0, "again"), (None, "no id")]:
        ids, decoded = told(library, text)
        assert (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()) in got[k]
    assert len(got[0]) == 2 and word_bpe.digests(docs.limit(0), PATH).count() == 0
    back = {r["doc_id"]: r["decoded"] for r in word_bpe.decode(word_bpe.encode(docs.filter("doc_id > 0"), PATH), PATH).collect()}
    assert back[3] == told(library, ODD[3])[1] and back[1] == ""
