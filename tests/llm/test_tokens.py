"""The unit-wise encoder against the tokenizer on whole texts."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trainlake.llm import tokens

TOKENIZER = Tokenizer.from_file(tokens.word_bpe_path())
ENCODER = tokens.WordEncoder(tokens.word_bpe_path())


def check(texts):
    ids, ends = ENCODER.encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], repr(text)


def test_table():
    check([t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()])


def test_odd_texts():
    check([None, "", " ", "a", "Don't we'll 'S x'", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "J̌ é É", "İstanbul ÀÉß×÷ «x» naïve Ǆ", "日本語 テスト mixed日本", "a b c\u0085d\x1ce\x0bf", "12ab34 ½ x² ١٢", "🙂👍🏽 ok", "K Å ﬁ", "a\x00b", "word,word;;word\r\n", "́x", "x ́y"])
    check([])
    check(["one two", "three", "", "fo", "ur"])


def test_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_UNITS", 3)
    for _ in range(3):
        check(["one two three four", "five two"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aB1'|<> .,é\ńİß"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_any_text(texts):
    check(texts)


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_long(size):
    check(["x" * size, "ab " * (size // 3)])


class Counted:
    """A tokenizer that notes the texts it encodes."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **how):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **how)


def test_words_spare_the_whole_tokenizer(monkeypatch):
    """Units that are one word each do without its NFC and regular expressions; others go through them."""
    encoder = tokens.WordEncoder(tokens.word_bpe_path())
    counted = Counted(encoder.tokenizer)
    monkeypatch.setattr(encoder, "tokenizer", counted)
    text = "Über den Fluß: 12 naïve ÉTÉ words, %%% and a;b (x) it's ét l|r a\x01b"
    ids, _ = encoder.encode(pa.array([text, text]))
    assert ids.tolist() == 2 * [*TOKENIZER.encode(text, add_special_tokens=False).ids, 2]
    assert sorted(counted.texts) == sorted(["it's", "ét", "l|r", "\x01"])


def test_every_character():
    """Alone, twice, between letters, and before a digit and a sign."""
    chars = [chr(c) for c in (*range(0x3000), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F600, 0x1F650))]
    for k in range(0, len(chars), 2048):
        check([f"{c} {c}{c} a{c}B {c}1 {c}!" for c in chars[k : k + 2048]])


def test_other_tokenizers(tmp_path):
    """One that splits in another way, cuts, or has an added word is used as it is."""
    from tokenizers import normalizers

    assert all(t is not TOKENIZER for t in tokens.one_word_tokenizers(TOKENIZER))
    plain, cutting, added = (Tokenizer.from_file(tokens.word_bpe_path()) for _ in range(3))
    plain.normalizer = normalizers.NFC()
    cutting.enable_truncation(100)
    added.add_tokens(["wordy"])
    for tokenizer in (plain, cutting, added):
        assert all(t is tokenizer for t in tokens.one_word_tokenizers(tokenizer))
    plain.normalizer = normalizers.Sequence([])
    plain.pre_tokenizer = None
    assert all(t is plain for t in tokens.one_word_tokenizers(plain))
    added.save(str(tmp_path / "added.json"))
    ids, _ = tokens.WordEncoder(str(tmp_path / "added.json")).encode(pa.array(["a wordy b"]), None)
    assert ids.tolist() == added.encode("a wordy b", add_special_tokens=False).ids


@pytest.mark.parametrize("end_id", [None, 2, 49_407, 2**32 - 1])
def test_end_ids(end_id):
    texts = ["", "two words", None, " ", "it's"]
    ids, ends = ENCODER.encode(pa.array(texts), end_id)
    for k, text in enumerate(texts):
        own = TOKENIZER.encode(text or "", add_special_tokens=False).ids
        assert ids[ends[k] : ends[k + 1]].tolist() == own + [end_id] * (end_id is not None)
    assert len(ENCODER.encode(pa.array(["", None], pa.string()), None)[0]) == 0
