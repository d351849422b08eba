"""BPE, token counts and token files against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from serieslake.llm import bpe, common, queries, token_counts, token_files
from tables import awkward, documents, found

WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ODD = st.text(
    st.one_of(st.sampled_from(list("abcdeABCDE  \n\t\r.,'!<|>/019\x00\x1c\x1f\x85\xa0 ΣσéÉñß中ﬁ²́İ")), st.characters(exclude_categories=["Cs"])),
    max_size=40,
)


@given(ODD, st.sampled_from(["", "<|endoftext|>", " <|startoftext|> ", "</w>", "don't we'll"]), ODD)
@settings(max_examples=400, deadline=None)
def test_encodes_as_the_library(before, middle, after):
    text = before + middle + after
    own = bpe.coder(bpe.vocabulary_path())
    want = WORDS.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), "<u4").tolist() == want
    assert own.decode(own.encode(text)) == WORDS.decode(want, skip_special_tokens=False)


@given(ODD, st.sampled_from(["", "<|endoftext|>", " <|endoftext|> ", "  \n\n x"]), ODD)
@settings(max_examples=400, deadline=None)
def test_counts_as_the_library(before, middle, after):
    text = before + middle + after
    own = token_counts.pieces(public_tokenizers.path("byte_bpe_50k.json"))
    chunks, n = own.chunks(text)
    n += sum(times * own.count(p) for chunk, times in chunks.items() for p in own.pretokens(chunk))
    assert n == len(BYTES.encode(text, add_special_tokens=False).ids)


def test_cuts_only_between_bytes_that_no_token_joins():
    own = bpe.coder(bpe.vocabulary_path())
    letters = bpe.byte_letters()
    assert len(set(letters)) == 256
    word = "".join(letters[b] for b in "q中zx".encode())
    parts = own.fragments(word)
    assert "".join(parts) == word and len(parts) > 1
    for left, right in zip(parts, parts[1:]):
        assert not any(left[-1] + right[0] in token for token in own.token.values())


def test_another_operator_drops_what_the_coder_kept():
    path = bpe.vocabulary_path()
    own = bpe.coder(path)
    common.begin("bpe")
    assert bpe.coder(path) is own  # tasks of one operator share it
    common.begin()
    assert bpe.coder(path) is not own


def digest(ids):
    return hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_digests_of_awkward_texts(spark):
    got = found(bpe.digests(documents(spark, awkward(), extra=True), ["doc_id"]))
    want = {}
    for i, text in awkward():
        ids = WORDS.encode(text or "", add_special_tokens=False).ids
        decoded = hashlib.sha256(WORDS.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        want.setdefault(i, []).append((len(ids), digest(ids), decoded))
    assert {k: sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in v) for k, v in got.items()} == {
        k: sorted(v) for k, v in want.items()
    }


def test_digests_keep_asked_columns_and_replace_clashes(spark):
    df = documents(spark, [(1, "a b")]).selectExpr("*", "'x' AS n_tokens")
    assert bpe.digests(df).columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert bpe.encode(df, ["doc_id"]).first()["ids"] == WORDS.encode("a b", add_special_tokens=False).ids


def test_token_counts_of_awkward_texts(spark):
    rows = awkward() * 2  # so that some pre-tokens are frequent and most are not
    got = found(token_counts.count_tokens(documents(spark, rows, extra=True)))
    want = {}
    for i, text in rows:
        text = text or ""
        want.setdefault(i, []).append((len(text.encode()), len(BYTES.encode(text, add_special_tokens=False).ids)))
    assert {k: sorted((r["n_bytes"], r["n_tokens"]) for r in v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_token_counts_without_frequent_pretokens(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "FREQUENT", 3)
    rows = [(i, f"the cat number {i % 7} sat") for i in range(50)]
    got = found(token_counts.count_tokens(documents(spark, rows)))
    for i, text in rows:
        assert got[i][0]["n_tokens"] == len(BYTES.encode(text, add_special_tokens=False).ids)


def stored(rows):
    """(doc_id, start, n_tokens, crc) as the files should give them, ids in ascending order."""
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = WORDS.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_return_what_was_stored(spark):
    rows = [r for k, r in enumerate(awkward()) if r[0] not in (None, 7, 10) or k in (1, 8, 13)]
    manifest = token_files.write(documents(spark, rows, extra=True), end_id=2, files=4)
    got = [tuple(r) for r in token_files.checksums(manifest).orderBy("start").collect()]
    assert got == stored(rows)
    assert manifest.agg({"n_docs": "sum"}).first()[0] == len(rows)


def test_files_keep_rows_that_repeat(spark):
    rows = [(7, "a b"), (7, "a b"), (None, "c"), (None, None)]
    got = token_files.checksums(token_files.write(documents(spark, rows), end_id=2, files=3)).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 2, 3, 3] and sum(r["doc_id"] == 7 for r in got) == 2


def test_reading_some_documents_opens_only_their_frames(spark):
    rows = [(i, f"text number {i}") for i in range(40)]
    manifest = token_files.write(documents(spark, rows), end_id=2, files=4)
    got = {r["doc_id"]: r["ids"] for r in token_files.read(manifest, [3, 39, 1000]).collect()}
    assert got == {i: WORDS.encode(f"text number {i}", add_special_tokens=False).ids + [2] for i in (3, 39)}
    assert token_files.read(manifest, []).count() == 0


def test_damaged_frames_are_refused(spark, tmp_path):
    path = tmp_path / "one.zst"
    writer = token_files.Writer(open(path, "wb"))
    for i in range(3):
        writer.add(i, np.arange(50, dtype="<u4").tobytes() + bytes([i, 0, 0, 0]))
    writer.close()
    whole = path.read_bytes()

    def reader():
        return token_files.Reader(open(path, "rb"), path.stat().st_size)

    assert reader().read(2)[-4] == 2 and reader().ids.tolist() == [0, 1, 2]
    entries = reader().entries.copy()
    broken = whole.replace(entries.tobytes(), entries[[1, 1, 2]].tobytes())
    path.write_bytes(broken)
    with pytest.raises(ValueError):
        reader().read(0)
    path.write_bytes(whole[:-1])
    with pytest.raises(ValueError):
        reader()


def test_empty_table(spark):
    none = documents(spark, [])
    assert bpe.digests(none).count() == 0
    assert token_counts.count_tokens(none).count() == 0
    assert token_files.checksums(token_files.write(none, end_id=2, files=2)).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_queries_against_the_library(spark, folder):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    counts = {r["doc_id"]: r for r in queries.op6_token_counts(spark, folder).collect()}
    digests = {r["doc_id"]: r for r in queries.op5_bpe(spark, folder).collect()}
    assert set(counts) == set(digests) == set(texts)
    for i, text in texts.items():
        n = len(BYTES.encode(text, add_special_tokens=False).ids)
        assert (counts[i]["n_bytes"], counts[i]["n_tokens"], counts[i]["over_limit"]) == (len(text.encode()), n, n > 512)
        ids = WORDS.encode(text, add_special_tokens=False).ids
        assert (digests[i]["n_tokens"], digests[i]["ids_sha256"]) == (len(ids), digest(ids))
    got = [tuple(r) for r in queries.op8_token_files(spark, folder).orderBy("start").collect()]
    assert got == stored(list(texts.items()))
