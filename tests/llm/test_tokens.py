"""Packing and sentencepiece encoding against the libraries."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from stationmine.llm import packing, pieces

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "a", "a  b", "\n\na b \n c\n", "x\ty z", "it's we'll <|endoftext|> ok", "é b", "　a b", "a" * 3000,
    "no " * 5000, "1234 5,6;7 \r\n b", "end\n", "▁x ▁", "  lead", "\n", "a\nb", "日本語 テキスト", "👩‍👩‍👧 x\x00y", "<s> </s> <unk>",
    "a b c", "one\n\ntwo", "tail ", "ﬁ ①", "a <|endoftext|> b", "x<|endoftext|>y z", "<|endoftext|>\nb <|endoftext|>",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_packed_ids_are_the_librarys(spark, docs, library):
    rows = list(enumerate(ODD))
    got = packing.pack(docs(rows), BPE).toPandas().sort_values(["doc_id", "start"])
    for i, text in rows:
        mine = got[got.doc_id == i]
        want = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert b"".join(mine.ids) == np.array(want, "<u4").tobytes()
        assert list(mine.start) == [0, *np.cumsum(mine.length)[:-1]]
        assert set(mine.doc_tokens) == {len(want)}
    assert all(zlib.crc32(i) == c for i, c in zip(got.ids, got.ids_crc32))


def test_sequences_are_gapless_and_full(spark, docs):
    rows = [(i, "word " * (i * 37 % 1500) + "end") for i in range(400)]
    got = packing.pack(docs(rows), BPE).toPandas().sort_values(["sequence_id", "offset"])
    for _, s in got.groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]]
        assert s.length.sum() <= 1024
    assert got.length.sum() / (got.sequence_id.nunique() * 1024) > 0.97


def test_classes_close_after_a_fixed_count():
    bins = packing.Bins(1024, 0)
    for i in range(7):
        bins.add((i, 0, b"\0" * 4 * 300, 300))  # 1024 // 300 = 3
    assert bins.made == 2 and len(bins.open[3]) == 1
    bins.finish()
    assert bins.made == 3


@pytest.mark.parametrize("capacity", [2, 7, 64, 1024])
def test_cuts_add_up(capacity):
    for r, parts in enumerate(packing.cuts(capacity, 16)):
        assert sum(parts) == r and all(0 < p < capacity for p in parts) and len(parts) <= 3


def test_repeated_and_null_ids_and_no_rows(spark, docs):
    got = packing.pack(docs([(1, "a"), (1, "a"), (None, "b")]), BPE).toPandas()
    assert sorted(got.doc_id.fillna(-1)) == [-1, 1, 1]
    assert packing.pack(docs([]), BPE).count() == 0


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_are_the_librarys(spark, docs, sp):
    rows = [*enumerate(ODD), (None, "x y"), (3, "again a")]
    got = pieces.encode(docs(rows), PIECES).collect()
    want = []
    for i, text in rows:
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        want.append((i, np.array(ids, "<u4").tobytes(), len(ids), sp.decode(ids)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r[0], bytes(r[1]), r[2], r[3]) for r in got), key=key) == sorted(want, key=key)
    assert pieces.encode(docs([]), PIECES).count() == 0


def test_both_agendas_agree_with_the_library(sp):
    own = pieces.pieces(PIECES)
    rng = np.random.default_rng(1)
    letters = list("etaoinshrdlu éß▁0")
    for _ in range(400):
        word = "".join(rng.choice(letters, rng.integers(1, 60))).replace(" ", "")
        if not word.strip("▁"):
            continue
        assert pieces.agenda(list(word), own.rank) == pieces.short_agenda(list(word), own.rank)
    for _ in range(200):
        text = "".join(rng.choice(letters[:12], rng.integers(1, 80)))
        assert own.encode(text) == np.array(sp.encode(text), "<u4").tobytes()


def test_tables_stay_bounded(sp, monkeypatch):
    monkeypatch.setattr(pieces.Pieces, "LIMIT", 3)
    monkeypatch.setattr(packing.WordIds, "LIMIT", 3)
    own, words = pieces.Pieces(PIECES), packing.WordIds(BPE)
    text = "one two three four five six seven one two"
    assert own.encode(text) == np.array(sp.encode(text), "<u4").tobytes() and len(own) <= 3
    ids = words.library.encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert words.encode([text, "one"])[0] == np.array(ids, "<u4").tobytes()


def test_words_of_letters_and_signs_are_not_encoded_one_by_one(library, monkeypatch):
    words = packing.WordIds(BPE)
    asked = []
    ids = words._ids
    monkeypatch.setattr(words, "_ids", lambda texts: asked.extend(texts) or ids(texts))
    text = "\n".join(f"Wörd{c}a x{c}o. {c}e,*** É{c}&&&" for c in "abcdefghijklmnopqrstuvwxyz")
    assert words.encode([text]) == [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert sorted(asked) == ["\n&&&", "\n,***", "\n."]


def test_made_up_words_are_the_librarys(library):
    rng = np.random.default_rng(5)
    signs = ["", "", ".", ",***", "'", "'s", "'S", "&&&", "_", "<|endoftext|>", "12", "²", "\u0301", "\x00", "\x85", "日本", "€"]
    letters = list("etaoinshrdlu") + ["é", "ß", "Ñ", "ʼ", "ж", "ي", "日", "\U0001e900", "ﬁ", "ª", "\ua7da", "\u1c89"]
    texts = []
    for _ in range(400):
        made = ["".join(rng.choice(letters, rng.integers(0, 9))) + rng.choice(signs) for _ in range(rng.integers(1, 30))]
        texts.append("".join(w + str(rng.choice([" ", " ", " ", "\n"])) for w in made if w).strip(" \n"))
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    words = packing.WordIds(BPE)
    assert words.encode(texts) == want == words.encode(texts)


@pytest.mark.parametrize("known", ["<|endoftext", "e\u0301", "12", "it's", "a²", "x_y", "\x00"])
def test_a_known_word_that_is_not_of_letters_is_no_part_of_another(library, known):
    text = f"{known} {known}|> {known}. {known}' {known},***\n{known}\n{known}|> b"
    want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    words = packing.WordIds(BPE)
    assert [words.encode([text])[0] for _ in range(2)] == [want, want]


def test_tokens_cut_out_of_words_first_go_to_the_library(tmp_path, library):
    from tokenizers import Tokenizer

    for content in ("cd", "&&", "cd&"):
        own = Tokenizer.from_file(BPE)
        own.add_tokens([content])
        path = str(tmp_path / "own.json")
        own.save(path)
        text = "abcde ab&&&& cd& abcd&e"
        got = packing.WordIds(path).encode([text])[0]
        assert got == np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_every_white_space_sends_a_text_to_the_library():
    words = packing.WordIds(BPE)
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace() and chr(c) not in " \n"]
    assert not any(words._plain(f"a b{c}d") for c in [*spaces, "  ", "\n\n", " \n", "\n "])
    assert words._plain("a b\nc é")


def test_a_wrong_merge_is_noticed():
    own = pieces.Pieces(PIECES)
    own.encode("hello there")
    own["hello"] = b"\1\0\0\0"
    with pytest.raises(AssertionError):
        own.check()


@pytest.mark.parametrize("text", ["plain words", "two  spaces", " lead", "trail ", "line\nends", "a\n\nb", "▁mark", "\n", "x \n y"])
@pytest.mark.parametrize("letter", "wasr▁\nby")
def test_every_merged_unit_is_checked(text, letter):
    """A table of merges that gives wrong ids for one letter is noticed in every kind of unit."""
    own = pieces.Pieces(PIECES)
    own.encode(text)
    own.check()
    right = own.merged
    own.merged = lambda chunk: right(chunk) + (b"\7\0\0\0" if letter in chunk else b"")
    own.clear()
    own.encode(text)
    if letter in text:
        with pytest.raises(AssertionError):
            own.check()
