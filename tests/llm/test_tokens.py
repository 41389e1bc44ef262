import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from opinara.llm import token_records
from opinara.llm._shared import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows):
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((key, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def check(df):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in token_records.token_digest(df).collect()), key=lambda r: r[1])
    assert got == brute(rows)


def test_tables(documents, odd_documents, no_documents):
    check(documents)
    check(odd_documents)
    check(no_documents)


@pytest.mark.parametrize("text", ["", " ", "  a", "a  ", "a\n\nb", "a \n b", "\ta\tb ", "it's we'll  don't", "x<|endoftext|>y", "\0a b\0", "a b  c", "a\x1cb \x85 c", "日本語 テキスト", "ab\r\n\r\ncd", "  \n", "a ,b .c 12a3 $%^"])
def test_pieces_are_the_librarys(text):
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    want = struct.pack(f"<{len(ids)}H", *ids)
    assert token_records.Encoder(PATH).encode([text]) == [want]
    small = token_records.Encoder(PATH, most=900)
    assert [small.encode([text, "other words here", None]) for _ in range(3)][2][0] == want


def test_a_damaged_record_is_an_error(spark, documents):
    path = shared_dir(spark, "damaged")
    manifest = token_records.write_token_records(documents, path, tokenizer=PATH, shards=3)
    assert token_records.read_token_records(spark, path, part_records=7).count() == documents.count()
    file = f"{path.removeprefix('file://')}/{manifest.first()['bin']}"
    with open(file, "r+b") as f:
        f.seek(40)
        byte = f.read(1)
        f.seek(40)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="damaged"):
        token_records.read_token_records(spark, path).collect()


def test_a_very_long_word_is_not_kept():
    encoder = token_records.Encoder(PATH, most=1 << 20)
    word = "abcdefgh" * (1 << 17)
    assert len(encoder.encode([word, "short words", word + " and more"])) == 3
    assert max(map(len, encoder.pieces)) <= 64
    for i in range(50):
        encoder.encode([" ".join(f"w{i}x{k}" for k in range(400))])
    assert encoder.held < 2 << 20 and encoder.held == sum(encoder._size(k, v) for k, v in encoder.pieces.items())


def test_shards_follow_bytes(spark, documents):
    path = shared_dir(spark, "sized")
    size = sum(len((r.text or "").encode()) for r in documents.select("text").collect())
    manifest = token_records.write_token_records(documents, path, tokenizer=PATH, shard_bytes=size // 20)
    assert manifest.count() > 12


@pytest.mark.parametrize("text", ["word, word. word! word's word'", "l'été, d'où; naïve-té.", "don't,won't.(a) x_y _z a1,b2 3.4 ß. ĀƏ, β, ñ.", "'s 's, a'sb 've.d", ", . a ,b .c Ġ Ġa aĠ. ̀á, ª. ², Ⅷ.", "a,\nb.\n", " a", "a ", "\n", "\na\n"])
def test_signs_after_letters_are_pieces(text):
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    encoder = token_records.Encoder(PATH)
    assert encoder.encode([None, text, "", text + " and more."])[1] == struct.pack(f"<{len(ids)}H", *ids)
    assert encoder.encode([text])[0] == struct.pack(f"<{len(ids)}H", *ids)


def test_a_word_is_encoded_once_whatever_sign_follows():
    encoder = token_records.Encoder(PATH)
    encoder.encode(["strange, strange. strange! and strange; strange"])
    assert sum("strange" in p for p in encoder.pieces) == 2  # with a space before it, and without
