"""Special tokens count in the raw text only; letters of every Unicode version are treated as the library does."""

import random

import pytest
from tokenizers import Tokenizer

from serialspark.llm import bpe, queries

PATH = queries.vocabulary("word_bpe_49k.json")
RARE = [0x1C89, 0xA7CB, 0xA7CC, 0xA7CE, 0xA7DA, 0xA7DC, 0x10D50, 0x10D65, 0x16EA0, 0x16EB8, 0x558, 0x88F, 0xC5C, 0x1246F, 0x323B0, 0x3FC3F, 0x2B73A, 0x130, 0x3A3, 0xBD, 0xB2, 0x2167, 0x85, 0xA0, 0x2028, 0x1ACC, 0x8E3, 0x334, 0x11935, 0x11930, 0x11938, 0x9FE]


def test_as_the_library():
    theirs = Tokenizer.from_file(PATH)
    theirs.no_truncation(), theirs.no_padding()
    rnd = random.Random(9)
    texts = ["<|ENDOFTEXT|>", "a <|EndOfText|> b", "x<|endoftext|>Y<|startoftext|>\n<|endoftext|>", "<|endoftext|", "\n<|endoftext|>", "ΑΣ ΑΣΑ ς", None, "", " ", "word " * 40000]
    texts += [f"a{chr(i)}b 1{chr(i)} '{chr(i)}S" for i in [*range(0x20, 0x3400), *range(0xA000, 0xB000), *range(0x10000, 0x1F000, 7), *RARE]]
    texts += ["".join(chr(rnd.choice([*RARE, rnd.randint(33, 126), rnd.randint(0x80, 0x2FFF)])) for _ in range(30)) for _ in range(300)]
    want = theirs.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for text, w, (ids, decoded) in zip(texts, want, bpe.encode_batch(texts, bpe.load(PATH)), strict=True):
        assert ids.tolist() == w.ids, ascii(text)
        assert decoded == theirs.decode(w.ids, skip_special_tokens=False)


def test_other_token_files_are_refused():
    source = open(PATH, encoding="utf-8").read()
    for was, now in (('"dropout":null', '"dropout":0.1'), ('"ignore_merges":false', '"ignore_merges":true'), ('"normalized":false', '"normalized":true'), ('{"type":"NFC"}', '{"type":"NFKC"}')):
        changed = source.replace(was, now, 1) if was in source else source.replace(was.replace(":", ": "), now.replace(":", ": "), 1)
        assert changed != source
        with pytest.raises(ValueError):
            bpe.Vocabulary(changed)
