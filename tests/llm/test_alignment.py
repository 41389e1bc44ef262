import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opinara.llm.token_alignment import Tokenizers, _links, align_tokenizers, lockstep, op11_token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def groups_of(text, a, b):
    """Groups of a text, token by token, with the libraries on whole texts."""
    if not text:
        return []
    whole = b" " + text.encode()
    # the bytes that byte-level characters stand for, as the vocabulary's publishers define them
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    pieces = [b.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    cuts = sorted(set(ends_a) & set(ends_b))
    at_a, at_b = {e: k for k, e in enumerate(ends_a)}, {e: k for k, e in enumerate(ends_b)}
    ka = [0, *(at_a[c] + 1 for c in cuts)]
    kb = [0, *(at_b[c] + 1 for c in cuts)]
    return [(ids_a[ka[i] : ka[i + 1]], ids_b[kb[i] : kb[i + 1]]) for i in range(len(cuts))]


def brute(texts, a, b):
    groups = [groups_of(t, a, b) for t in texts]
    links = [collections.Counter((x, y) for ga, gb in g for x in ga for y in gb) for g in groups]
    count = collections.Counter(p for c in links for p in c)
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    rows = []
    for g, c in zip(groups, links, strict=True):
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        best = sum(n for p, n in c.items() if count[p] == most[p[0]])
        rows.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), best, sum(n * count[p] for p, n in c.items()), hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return rows


def test_query_as_by_brute_force(spark, documents, libraries):
    docs = documents.collect()
    expected = {(d.doc_id, *r) for d, r in zip(docs, brute([d.text for d in docs], *libraries), strict=True)}
    got = op11_token_alignment(spark, "/root/testdata/sf0.001").select("doc_id", *COLUMNS).collect()
    assert len(got) == len(docs) and set(map(tuple, got)) == expected


def test_odd_documents_in_many_batches(spark, odd_documents, libraries):
    extra = ["x▁y", "a\0b", "  two  spaces ", " ", "\n", "<s> <0x41> <|endoftext|>", "ééé漢字" * 300, "word " * 3000, "́a‏‮", "aaaaaaaaaa" * 500]
    docs = odd_documents.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    texts = docs.collect()
    expected = sorted(((d.doc_id, *r) for d, r in zip(texts, brute([d.text for d in texts], *libraries), strict=True)), key=repr)
    for sizes in ({}, {"batch_chars": 500, "slice_chars": 100}):
        out = align_tokenizers(docs, tokenizer_a=A, tokenizer_b=B, **sizes)
        assert sorted(map(tuple, out.select("doc_id", *COLUMNS).collect()), key=repr) == expected


def test_groups_columns_and_empty_tables(spark, odd_documents, no_documents):
    out = align_tokenizers(odd_documents, tokenizer_a=A, tokenizer_b=B, groups=True)
    assert [c for c in odd_documents.columns if c not in ("n_links",)] == out.columns[: len(odd_documents.columns) - 1]
    for r in out.where("groups <> ''").collect():
        assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 and r.groups.count("|") == r.n_groups
    assert align_tokenizers(no_documents, tokenizer_a=A, tokenizer_b=B).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 39)), st.sets(st.integers(1, 39))), max_size=6))
def test_lockstep_finds_all_common_ends(docs):
    docs = [(sorted(x | {40}), sorted(y | {40})) for x, y in docs]
    base = np.arange(len(docs)) * 40
    first = [np.r_[0, np.cumsum([len(d[k]) for d in docs])].astype(int) for k in (0, 1)]
    ends = [np.concatenate([np.zeros(0, int), *(np.array(d[k]) + o for d, o in zip(docs, base, strict=True))]) for k in (0, 1)]
    cut_a, cut_b = lockstep(*ends, *first)
    common = set(ends[0]) & set(ends[1])
    assert set(ends[0][cut_a]) == set(ends[1][cut_b]) == common


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_links_are_the_same_in_any_stretches(most):
    rng = np.random.default_rng(1)
    size_a, size_b = rng.integers(1, 6, 200), rng.integers(1, 6, 200)
    ids_a, ids_b = rng.integers(0, 9, size_a.sum()).astype("<u2"), rng.integers(0, 9, size_b.sum()).astype("<u2")
    starts_a, starts_b = np.r_[0, np.cumsum(size_a)], np.r_[0, np.cumsum(size_b)]
    doc = np.sort(rng.integers(0, 12, 200))
    expected = collections.Counter()
    for g in range(200):
        for x in ids_a[starts_a[g] : starts_a[g + 1]]:
            for y in ids_b[starts_b[g] : starts_b[g + 1]]:
                expected[(int(doc[g]) << 32) + (int(x) << 16) + int(y)] += 1
    key, n = _links(ids_a, ids_b, starts_a, starts_b, doc, most)
    assert key.tolist() == sorted(expected) and dict(zip(key.tolist(), n.tolist(), strict=True)) == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aé漢 \n\t▁\0x1.😀　'st"), max_size=30), max_size=5))
def test_cached_pieces_give_the_libraries_ids(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tokens = _once()
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    assert [np.frombuffer(x, "<u2").tolist() for x in tokens.a.encode([" " + t for t in texts])] == [a.encode(" " + t, add_special_tokens=False).ids for t in texts]
    for text, ids in zip(texts, tokens.b.encode(texts), strict=True):
        if "▁" in text:
            assert ids is None
        elif text:
            assert np.frombuffer(ids, "<u2").tolist() == b.encode(text)


_KEPT = []


def _once():
    if not _KEPT:
        _KEPT.append(Tokenizers(A, B))
    return _KEPT[0]
