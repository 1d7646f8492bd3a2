import os
import random

import pytest

from hearken.llm.encode import VOCABULARIES, ByteBPE, encode_texts

pytestmark = pytest.mark.skipif(not os.path.exists(f"{VOCABULARIES}/byte_bpe_50k.tiktoken"), reason="no vocabularies here")
TEXTS = ["", None, " ", "Hello world", "it's  we'll\n\n\tDON'T", "<|endoftext|>", "é中🎵​", "a" * 40_000, "=-" * 20_000, "ab\x00\x07", "  lead and trail  ", "१२३ 123"]


def reference(text):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{VOCABULARIES}/byte_bpe_50k.json")
    own.encode_special_tokens = True
    return own.encode(text, add_special_tokens=False).ids


def test_equals_the_library(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, "Hello world", "again")]
    got = encode_texts(spark.createDataFrame(rows, "doc int, body string, ids string"), key="doc", text="body").collect()
    assert sorted((r.doc, list(r.ids)) for r in got) == sorted((i, reference(t) if t else []) for i, t, _ in rows)
    assert encode_texts(spark.createDataFrame([], "doc int, body string"), key="doc", text="body").count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_random_strings_equal_merging(name):
    import base64

    import tiktoken

    from hearken.llm.encode import WORDS

    path = f"{VOCABULARIES}/{name}.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own, lib = ByteBPE(path), tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("aabcdeinorst   -=\n'é中ж0🎵") for _ in range(rng.randint(1, 50)))
        assert own.encode(text) == lib.encode_ordinary(text)
